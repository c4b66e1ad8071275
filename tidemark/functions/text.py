"""Scalar functions on subtitle and comment texts, as column expressions; two pandas UDFs where none exists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize_text(text: Column) -> Column:
    """Bars to the stroke character, an ellipsis to three dots, white space to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.replace(F.replace(text, F.lit("|"), F.lit("丨")), F.lit("…"), F.lit("...")), r"(?U)\s+", " "))


def chinese_chars(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[一-鿿]"))


def latin_ratio_bp(text: Column) -> Column:
    """Latin letters per 10,000 characters."""
    return F.floor(F.regexp_count(text, F.lit("[A-Za-z]")) * 10000 / F.greatest(F.length(text), F.lit(1))).cast("long")


def speaker(text: Column) -> Column:
    """What stands before the first colon of a line, if it is short."""
    return F.nullif(F.trim(F.regexp_extract(text, r"^([^:：]{1,20})[:：]", 1)), F.lit(""))


def srt_time(us: Column) -> Column:
    ms = F.floor(us / 1000)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def ass_time(us: Column) -> Column:
    """Hours without padding; hundredths are cut, not rounded."""
    cs = F.floor(us / 10000)
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)


def ass_colour(rgb: Column) -> Column:
    """An RGB number as &HBBGGRR&."""
    part = lambda shift: F.lpad(F.hex(F.shiftright(rgb, shift).bitwiseAND(F.lit(255))), 2, "0")
    return F.concat(F.lit("&H"), part(0), part(8), part(16), F.lit("&"))


def text_width(text: Column, size: float) -> Column:
    """Width in pixels: ASCII characters count 0.62, others 1."""
    narrow = F.regexp_count(text, F.lit("[\\x00-\\x7f]"))
    return size * (narrow * 0.62 + (F.length(text) - narrow))


def comment_key(us: Column, mode: Column, text: Column) -> Column:
    ms = F.floor(us / 1000)
    return F.concat_ws("|", F.format_string("%d.%03d", F.floor(ms / 1000), ms % 1000), mode.cast("string"), text)


def char_accuracy(text: Column, reference: Column) -> Column:
    """1 - Levenshtein distance over the longer length, in code points, 0 at least."""
    longest = F.greatest(F.length(text), F.length(reference))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.greatest(1 - F.levenshtein(text, reference) / longest, F.lit(0.0)))


def fold_replace(text: Column, fixes: list[tuple[str, str]]) -> Column:
    for old, new in fixes:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


@F.pandas_udf(DoubleType())
def sequence_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of matching blocks, which depends on the order of its arguments."""
    import difflib

    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    import unicodedata

    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


#: Patterns of season and episode in file names, in order of trust (fixed values).
EPISODE_PATTERNS = (r"(?i)\bS\d{1,2}E(\d{1,3})\b", r"第\s*(\d{1,3})\s*[话話集]", r"(?i)\bEP?\.?\s*(\d{1,3})\b", r"\s-\s(\d{1,3})\b", r"\[(\d{1,3})\]")
SEASON_PATTERNS = (r"(?i)\bS(\d{1,2})E\d", r"第\s*(\d{1,2})\s*季", r"(?i)\bSeason\s*(\d{1,2})\b")


def _first_number(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns)).try_cast("int")


def file_name_parts(path: Column) -> Column:
    """raw_title, normalized_title, season and episode of a media file's path."""
    name = F.regexp_replace(F.element_at(F.split(path, r"[/\\]"), -1), r"\.[A-Za-z0-9]{2,4}$", "")
    bare = F.regexp_replace(F.regexp_replace(name, r"^\[[^\]]*\]\s*", ""), r"(?i)(\s-\s\d{1,3}\b|\bS\d{1,2}E\d|第\s*\d{1,3}\s*[季话話集]|\[\d{1,3}\]|\bEP?\.?\s*\d).*$", "")
    title = F.trim(bare)
    return F.struct(title.alias("raw_title"), F.lower(F.regexp_replace(title, r"\s+", " ")).alias("normalized_title"), _first_number(name, SEASON_PATTERNS).alias("season"), _first_number(name, EPISODE_PATTERNS).alias("episode"))
