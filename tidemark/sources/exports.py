"""Cue, comment and clip tables as files' texts: one row a file, or partitioned folders, by Spark's writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.folds import lane_counts

By = list[str]


def listed(df: DataFrame, by: By, order: str, line: Column, separator: str, name: str) -> DataFrame:
    """The lines of a group, in order, as one text. A group is one file, so it must fit a row."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("k"), line.alias("line"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(pairs, lambda x: x["line"]), separator).alias(name))


def cues_json(cues: DataFrame, by: By, language: str = "zh-Hans") -> DataFrame:
    """A JSON document a file: version, language, count and the cues, numbered in order; seconds to 3, confidence to 4 digits."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy("s", "e", "pos"))
    seconds = lambda us: F.round(us / 1e6, 3)
    one = F.struct(
        F.format_string("cue_%05d", F.col("_n")).alias("id"), F.col("_n").alias("index"), seconds(F.col("s")).alias("start"), seconds(F.col("e")).alias("end"),
        seconds(F.greatest(F.col("e") - F.col("s"), F.lit(0))).alias("duration"), T.normalize_text(F.col("text")).alias("text"), F.round("conf", 4).alias("confidence"),
    )
    rows = F.transform(F.sort_array(F.collect_list(F.struct(F.col("_n").alias("k"), one.alias("cue")))), lambda x: x["cue"])
    made = cues.withColumn("_n", n).groupBy(*by).agg(F.count(F.lit(1)).alias("_c"), rows.alias("_r"))
    return made.select(*by, F.to_json(F.struct(F.lit("1.0").alias("version"), F.lit(language).alias("language"), F.col("_c").alias("cue_count"), F.col("_r").alias("cues"))).alias("json"))


def bilingual_srt(cues: DataFrame, by: By, first: str, second: str) -> DataFrame:
    """Subtitles of two lines a cue; a line that is empty is left out."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy("s", "e", "pos"))
    line = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    block = F.concat_ws("\n", F.col("_n").cast("string"), F.concat(T.srt_time(F.col("s")), F.lit(" --> "), T.srt_time(F.col("e"))), line(first), line(second))
    return listed(cues.withColumn("_n", n), by, "_n", block, "\n\n", "srt")


def ass_escaped(text: Column) -> Column:
    """A text that a style line takes as it is: no commands, line breaks as \\\\N."""
    t = F.translate(text, "\\{}", "＼｛｝")
    return F.replace(F.replace(t, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("\\N"))


#: Size of the picture that comments are laid out on (fixed values).
WIDTH, HEIGHT, TOP = 1920, 1080, 36


def ass_lines(comments: DataFrame, font_size: int, upper_half: bool = False, embedded: bool = False) -> DataFrame:
    """Adds ``line``: the dialogue line of each comment (at, mode, color, content) with its pool and lane.

    Comments at top and bottom stand still in the middle; the others move across, mode 6 from left to right.
    """
    step = max(font_size + 6, 18)
    reserved = max(font_size * 2 + 40, 140) if embedded else 48
    bottom = max(TOP + step * 4, HEIGHT // 2 if upper_half else HEIGHT - reserved)
    text = ass_escaped(F.col("content"))
    width = F.greatest(F.lit(120), F.ceil(T.text_width(text, max(12, font_size)))).cast("int")
    y = F.when(F.col("pool") == "bottom", bottom - 20 - F.col("lane") * step).otherwise(TOP + F.col("lane") * step).cast("string")
    still = lambda n: F.concat(F.lit(f"\\an{n}\\pos({WIDTH // 2},"), y, F.lit(")"))
    out, back = (WIDTH + width).cast("string"), (-width).cast("string")
    move = lambda a, b: F.concat(F.lit("\\move("), a, F.lit(","), y, F.lit(","), b, F.lit(","), y, F.lit(")"))
    placed = F.when(F.col("pool") == "top", still(8)).when(F.col("pool") == "bottom", still(2)).when(F.col("mode") == 6, move(back, out)).otherwise(move(out, back))
    colour = F.when((F.col("color") > 0) & (F.col("color") != 16777215), F.concat(F.lit("\\c"), T.ass_colour(F.col("color")))).otherwise(F.lit(""))
    end = F.col("at") + F.when(F.col("pool") == "scroll", F.lit(12_000_000)).otherwise(F.lit(4_200_000))
    line = F.concat(F.lit("Dialogue: 0,"), T.ass_time(F.col("at")), F.lit(","), T.ass_time(end), F.lit(",Danmaku,,0,0,0,,{\\fs" + str(max(12, font_size))), colour, placed, F.lit("}"), text)
    return comments.where(F.trim(text) != "").withColumn("line", line)


def ass_document(lines: DataFrame, by: By, font: str, font_size: int) -> DataFrame:
    """The document of a file's dialogue lines (at, pos, line) with its header."""
    style = f"Style: Danmaku,{font.replace(',', '')},{font_size},&H00FFFFFF,&H000000FF,&H00000000,&H64000000,0,0,0,0,100,100,0,0,1,2,0,7,16,16,16,1"
    head = ["[Script Info]", "ScriptType: v4.00+", "WrapStyle: 2", "ScaledBorderAndShadow: yes", f"PlayResX: {WIDTH}", f"PlayResY: {HEIGHT}", "Collisions: Normal", "", "[V4+ Styles]"]
    head += ["Format: Name,Fontname,Fontsize,PrimaryColour,SecondaryColour,OutlineColour,BackColour,Bold,Italic,Underline,StrikeOut,ScaleX,ScaleY,Spacing,Angle,BorderStyle,Outline,Shadow,Alignment,MarginL,MarginR,MarginV,Encoding", style, ""]
    head += ["[Events]", "Format: Layer,Start,End,Style,Name,MarginL,MarginR,MarginV,Effect,Text"]
    rows = lines.withColumn("_k", F.struct("at", "pos"))
    return listed(rows, by, "_k", F.col("line"), "\n", "_body").select(*by, F.concat(F.lit("\n".join(head) + "\n"), "_body", F.lit("\n")).alias("ass"))


def keep_graph(kept: DataFrame, by: By) -> DataFrame:
    """A filter graph that trims and joins kept intervals; fades of a twentieth of a second at most from .12 seconds on."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy("s"))
    sec = lambda us: F.regexp_replace(F.format_string("%.6f", us / 1e6), r"\.?0+$", "")
    length = F.col("e") - F.col("s")
    fade = F.least(F.lit(50_000), F.floor(length / 2))
    faded = F.concat(F.lit(",afade=t=in:st=0:d="), sec(fade), F.lit(",afade=t=out:st="), sec(length - fade), F.lit(":d="), sec(fade))
    label = F.concat(F.lit("[a"), F.col("_n").cast("string"), F.lit("]"))
    part = F.concat(F.lit("[0:a]atrim=start="), sec(F.col("s")), F.lit(":end="), sec(F.col("e")), F.lit(",asetpts=PTS-STARTPTS"), F.when(length >= 120_000, faded).otherwise(F.lit("")), label)
    rows = kept.withColumn("_n", n)
    graph = listed(rows, by, "_n", part, ";", "_parts").join(listed(rows, by, "_n", label, "", "_labels"), by).join(rows.groupBy(*by).agg(F.max("_n").alias("_count")), by)
    return graph.select(*by, F.concat("_parts", F.lit(";"), "_labels", F.lit("concat=n="), F.col("_count").cast("string"), F.lit(":v=0:a=1[out]")).alias("graph"))


def exclusion_text(keys: DataFrame, by: By, key: str = "key") -> DataFrame:
    """The distinct keys of a file in order of their bytes, one a line, and as a JSON list."""
    rows = keys.select(*by, key).where(F.trim(key) != "").distinct()
    ordered = F.sort_array(F.collect_list(key))
    return rows.groupBy(*by).agg(F.array_join(ordered, "\n").alias("txt"), F.to_json(ordered).alias("json"))


def history_text(rows: DataFrame, by: By, order: str, columns: By) -> DataFrame:
    """Entries of a history, newest first: the columns of each, parted by bars."""
    line = F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns))
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(order).desc(), *columns)))
    return listed(rows, by, "_k", line, "\n", "history")


def write_parts(df: DataFrame, path: str, by: str, form: str = "json") -> None:
    """A folder for each part, in JSON lines or TSV."""
    writer = df.write.mode("overwrite").partitionBy(by)
    writer.json(path) if form == "json" else writer.csv(path, sep="\t", header=True, emptyValue="")


def tsv_text(df: DataFrame, by: By, order: str, columns: By) -> DataFrame:
    """A TSV document a group with a byte order mark: the columns in order, missing ones and nulls empty, tabs and breaks as blanks."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]+", " ") if c in df.columns else F.lit("")
    body = listed(df, by, order, F.concat_ws("\t", *map(cell, columns)), "\n", "_body")
    return body.select(*by, F.concat(F.lit("﻿" + "\t".join(columns) + "\n"), "_body", F.lit("\n")).alias("tsv"))


__all__ = ["ass_document", "ass_lines", "bilingual_srt", "cues_json", "exclusion_text", "history_text", "keep_graph", "lane_counts", "listed", "tsv_text", "write_parts"]
