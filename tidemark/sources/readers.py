"""Readers of transcripts, subtitles, comments and detector logs: Spark's own readers and column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEGMENTS = "Segments array<struct<Id: string, Start: double, End: double, Text: string, Language: string, Speaker: string, Confidence: double>>"
_TIME = r"(\d{1,2}):(\d{2}):(\d{2})[,.](\d{1,3})"


def _us(seconds):
    return F.round(seconds * 1_000_000).cast("long")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Segments of transcript documents, one document a file, in document order; either case of names."""
    spark_case = spark.read.schema(SEGMENTS).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("file"), F.posexplode_outer("Segments").alias("pos", "x"))
    return spark_case.select("file", "pos", F.col("x.Id").alias("seg_id"), _us(F.col("x.Start")).alias("s"), _us(F.col("x.End")).alias("e"), F.col("x.Text").alias("text"), F.col("x.Speaker").alias("speaker"), F.col("x.Confidence").alias("confidence"))


def tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, inferSchema=False)


def srt(spark: SparkSession, path: str) -> DataFrame:
    """Cues of subtitle files; blocks without a time line are skipped, and cues are numbered anew from 1."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "﻿|\r", "").alias("value"))
    blocks = files.select("file", F.posexplode(F.split("value", r"\n\s*\n")).alias("pos", "block"))
    times = [F.regexp_extract("block", rf"{_TIME}\s*-->\s*{_TIME}", i).try_cast("long") for i in range(1, 9)]
    at = lambda k: (((times[k] * 60 + times[k + 1]) * 60 + times[k + 2]) * 1000 + F.rpad(F.regexp_extract("block", rf"{_TIME}\s*-->\s*{_TIME}", k + 4), 3, "0").try_cast("long")) * 1000
    text = F.regexp_replace(F.regexp_extract("block", r"(?s)-->[^\n]*\n(.*)$", 1), r"^\s+|\s+$", "")
    rows = blocks.where(F.col("block").rlike(rf"{_TIME}\s*-->\s*{_TIME}")).select("file", "pos", at(0).alias("s"), at(4).alias("e"), text.alias("text"))
    return rows.withColumn("index", F.row_number().over(Window.partitionBy("file").orderBy("pos"))).drop("pos")


def comments(spark: SparkSession, path: str) -> DataFrame:
    """Comments ``<d p="time,mode,size,color,...">text</d>``; those with fewer than four values are skipped."""
    rows = spark.read.format("xml").option("rowTag", "d").schema("_VALUE string, _p string").load(path)
    p = F.split("_p", ",")
    out = rows.where(F.size(p) >= 4).select(_us(p[0].try_cast("double")).alias("at"), p[1].try_cast("int").alias("mode"), p[2].try_cast("double").cast("int").alias("font_size"), p[3].try_cast("long").alias("color"), F.coalesce("_VALUE", F.lit("")).alias("content"))
    return out.where("at is not null and mode is not null and color is not null")


def silence_log(lines: DataFrame, by: list[str], order: str, line: str = "value") -> DataFrame:
    """Log lines as start and end rows for ``intervals.pair_start_end``."""
    number = lambda name: F.nullif(F.regexp_extract(line, rf"{name}:\s*(-?[0-9.]+)", 1), F.lit("")).try_cast("double")
    rows = lines.select(*by, order, number("silence_start").alias("a"), number("silence_end").alias("b"), number("silence_duration").alias("d"))
    rows = rows.where("a is not null or b is not null")
    return rows.select(*by, order, F.when(F.col("b").isNotNull(), "end").otherwise("start").alias("kind"), _us(F.coalesce("b", "a")).alias("t"), _us(F.coalesce("d", F.lit(0.0))).alias("dur"))


def between_ranges(text: DataFrame, column: str) -> DataFrame:
    """All between(t,a,b) of a filter expression, in order: of the video's select clause if there is one, else of all."""
    video = F.regexp_extract(column, r"(?s)\[0:v:0\]select='([^']*)'", 1)
    source = F.when(video != "", video).otherwise(F.col(column))
    find = lambda i: F.regexp_extract_all(source, F.lit(r"between\(t\s*,\s*([0-9.]+)\s*,\s*([0-9.]+)\)"), F.lit(i))
    return text.select("*", F.posexplode(F.arrays_zip(find(1).alias("a"), find(2).alias("b"))).alias("pos", "between_range")).select("*", _us(F.col("between_range.a").cast("double")).alias("s"), _us(F.col("between_range.b").cast("double")).alias("e")).drop("between_range")


def responses(rows: DataFrame, column: str) -> DataFrame:
    """Decisions in replies: from the text as it is, or from the stretch between its first and last brace."""
    inner = F.regexp_extract(column, r"(?s)(\{.*\})", 1)
    value = lambda name: F.coalesce(F.get_json_object(column, f"$.{name}"), F.get_json_object(inner, f"$.{name}"))
    return rows.select("*", value("decision").alias("decision"), value("confidence").try_cast("double").alias("confidence"), value("suggested_text").alias("suggestion"))
