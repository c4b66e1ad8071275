"""Rule cascades, filters and scores, as column expressions that push down and need no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_words(text: str) -> list[str]:
    """Words between bars and line breaks, trimmed, each once whatever its case."""
    found = {w.strip().lower(): None for w in text.replace("\r", "|").replace("\n", "|").split("|") if w.strip()}
    return list(found)


def filter_comments(df: DataFrame, words: list[str], excluded: DataFrame | None, drop_special: bool, offset: int) -> DataFrame:
    """Comments that aren't blank, special, blocked or excluded by key, shifted by ``offset`` and clamped at 0."""
    kept = df.where(F.trim("content") != "")
    if drop_special:
        kept = kept.where(~F.col("mode").isin(7, 8))
    for w in words:
        kept = kept.where(~F.contains(F.lower("content"), F.lit(w)))
    if excluded is not None:
        kept = kept.join(excluded.select("raw_key"), "raw_key", "left_anti")
    return kept.withColumn("at", F.greatest(F.col("at") + offset, F.lit(0)))


def density_sample(df: DataFrame, by: list[str], at: str, order: list[str], percent: int) -> DataFrame:
    """Of each second's comments the first max(1, ceil(n * percent / 100)); all from 99.9 percent on."""
    if percent >= 99.9:
        return df
    second = F.expr(f"{at} div 1000000")
    w = Window.partitionBy(*by, second)
    rows = df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(at, *order)))
    share = max(5, min(100, percent))
    return rows.where(F.col("_r") <= F.greatest(F.expr(f"(_n * {share} + 99) div 100"), F.lit(1))).drop("_n", "_r")


def select_segments(text: Column, duration: Column, include: str, exclude: str, min_duration: int, keep_empty: bool = False) -> Column:
    """The first rule that hits: empty, too short, include missing, exclude found, include found, default."""
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    rule = F.when(blank & F.lit(not keep_empty), "Exclude:empty").when(duration < min_duration, "Exclude:short")
    if include:
        rule = rule.when(~text.rlike("(?i)" + include), "Exclude:include-miss")
    if exclude:
        rule = rule.when(text.rlike("(?i)" + exclude), "Exclude:exclude-hit")
    return rule.otherwise(F.lit("Keep:include-hit" if include else "Keep:default"))


def violations(segments: DataFrame, key: str) -> DataFrame:
    """Rows that break a rule of transcripts: blank id, repeated id, end before start."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    found = F.array_compact(F.array(F.when(F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == "", "blank-id"), F.when(n > 1, "duplicate-id"), F.when(F.col("e") < F.col("s"), "negative-duration")))
    return segments.withColumn("rules", found).where(F.size("rules") > 0)


def reasons(*pairs: tuple[str, Column]) -> Column:
    """The names of the conditions that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, name) for name, c in pairs)))


def gate(df: DataFrame, found: Column, reset: list[str]) -> DataFrame:
    """Adds ``gate_reasons`` and empties the columns ``reset`` of rows that have any."""
    rows = df.withColumn("gate_reasons", found)
    bad = F.size("gate_reasons") > 0
    for c in reset:
        rows = rows.withColumn(c, F.when(~bad, F.col(c)))
    return rows.withColumn("status", F.when(bad, "unmatched").otherwise("matched"))


def bands(score: Column, high: float, low: float) -> Column:
    return F.when(score >= high, "high").when(score >= low, "medium").otherwise("low")


def additive(*pairs: tuple[Column, float]) -> Column:
    """The sum of the points whose conditions hold."""
    total = F.lit(0.0)
    for condition, points in pairs:
        total = total + F.when(condition, F.lit(points)).otherwise(F.lit(0.0))
    return total


def storage_ok(size: Column, free: Column, fast_start: Column, margin: Column) -> Column:
    mib = 1 << 20
    return F.greatest(size, F.lit(512 * mib)) * F.when(fast_start, 2).otherwise(1) + F.greatest(F.lit(256 * mib), margin) <= free


def output_ok(readable: Column, duration: Column, expected: Column, stereo: Column, tolerance: int = 5_000_000) -> Column:
    return readable & (F.abs(duration - expected) <= tolerance) & stereo
