"""Text forms of interval and cue tables: one row for each group, ready to be written as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T


def _listed(df: DataFrame, by: list[str], order: str, line: str, sep: str, name: str) -> DataFrame:
    """The lines of a group, in order. A group is one file, so it must fit a row."""
    pairs = F.sort_array(F.collect_list(F.struct(order, line)))
    return df.groupBy(*by).agg(F.array_join(F.transform(pairs, lambda x: x[line]), sep).alias(name))


def srt(cues: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*by).orderBy("s", "seg_id"))
    block = F.concat(n.cast("string"), F.lit("\n"), T.srt_time(F.col("s")), F.lit(" --> "), T.srt_time(F.col("e")), F.lit("\n"), F.col(text))
    return _listed(cues.withColumn("_n", n).withColumn("_block", block), by, "_n", "_block", "\n\n", "srt")


def seconds(us: str) -> Column:
    """Microseconds as seconds, rounded to three decimals, without zeros at the end."""
    ms = F.floor((F.col(us) + 500) / 1000)
    return F.rtrim(F.rtrim(F.format_string("%d.%03d", F.floor(ms / 1000), ms % 1000), F.lit("0")), F.lit("."))


def keep_expression(merged: DataFrame, by: list[str]) -> DataFrame:
    """The kept stretches (s, e in microseconds) as one expression over the time in seconds."""
    line = F.concat(F.lit("between(t,"), seconds("s"), F.lit(","), seconds("e"), F.lit(")"))
    return _listed(merged.withColumn("_line", line), by, "s", "_line", "+", "expression")


def concat_list(clips: DataFrame, by: list[str], path: str) -> DataFrame:
    """Entries of a concat list: file, in point and out point in seconds."""
    sec = lambda c: F.format_string("%d.%06d", F.floor(F.col(c) / 1_000_000), F.col(c) % 1_000_000)
    line = F.concat(F.lit("file '"), F.replace(path, F.lit("'"), F.lit("'\\''")), F.lit("'\ninpoint "), sec("s"), F.lit("\noutpoint "), sec("e"))
    return _listed(clips.withColumn("_line", line), by, "s", "_line", "\n", "listing")


def write_tsv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The columns in order, missing ones empty; nulls as ''."""
    kept = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns))
    kept.write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="")
