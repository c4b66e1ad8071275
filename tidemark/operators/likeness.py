"""Pairs of like texts without comparing all with all: a prefix filter on characters before the exact ratio.

The ratio of matching blocks is twice the matched characters over both lengths. Matched characters are common to both texts, each
as often as it occurs in both; so a pair of at least ``threshold`` has at least t / (2 - t) of either text's numbered
characters (the first a, the second a, ...) in common. If both list them in one order, rarest first, two such texts share one among
the first ones, as many as the text can do without and one more. Texts meet by these, then lengths and common characters are
compared in the JVM, and only what is left goes to the exact ratio.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import let, sequence_similarity
from tidemark.storage import dealt, large, stored

#: Texts that share a character are dealt to so many parts on either side, and every part meets every other in a task of its own.
GRID = 4


def numbered_characters(text: Column) -> Column:
    """The characters of a text, each with how often it has occurred so far: a set that counts."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    count = lambda cs: F.flatten(F.transform(F.array_distinct(cs), lambda c: F.transform(F.sequence(F.lit(1), F.size(F.filter(cs, lambda x: x == c))), lambda i: F.concat(c, i.cast("string")))))
    return let(chars, lambda cs: F.when(F.size(cs) > 0, count(cs)).otherwise(F.array().cast("array<string>")))


def similar_texts(left: DataFrame, right: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """Pairs (by, text_a, text_b, ratio) of distinct texts of both sides whose ratio of matching blocks, in this order, is at
    least ``threshold`` (over 0). left, right: by, text; pairs only within equal ``by``.

    Each distinct text counts once, however many rows have it: join the pairs back to rows by text. Blank and null
    texts pair with nothing. No pair is lost: the filter asks less than the ratio does. Empty sides give nothing.
    """
    by = by or []
    sides = [df.select(*by, "text").where("text is not null and text <> ''").distinct().withColumn("items", numbered_characters(F.col("text"))) for df in (left, right)]
    sides = [stored(df) for df in sides]
    uses = sides[0].select(F.explode("items").alias("item")).unionByName(sides[1].select(F.explode("items").alias("item"))).groupBy("item").agg(F.count(F.lit(1)).alias("uses"))
    share = threshold / (2 - threshold)

    def heads(df: DataFrame, name: str, other: str) -> DataFrame:
        ranked = df.select(*by, "text", F.explode("items").alias("item")).join(uses, "item")
        rows = ranked.groupBy(*by, "text").agg(F.sort_array(F.collect_list(F.struct("uses", "item")))["item"].alias("items"))
        n = F.size("items")
        head = F.slice("items", 1, F.greatest(n - F.ceil(n * share - 1e-9) + 1, F.lit(1)).cast("int"))
        rows = rows.select(*by, F.col("text").alias(f"text_{name}"), F.col("items").alias(f"items_{name}"), head.alias(f"head_{name}"), F.pmod(F.xxhash64("text"), F.lit(GRID)).cast("int").alias(f"part_{name}"))
        rows = rows.withColumn("item", F.explode(f"head_{name}")).withColumn(f"part_{other}", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))))
        return large(dealt(rows, *key))

    n_a, n_b = F.size("items_a"), F.size("items_b")
    key = [*by, "item", "part_a", "part_b"]
    near = 2 * F.least(n_a, n_b) >= threshold * (n_a + n_b) - 1e-9
    first = F.array_intersect("head_a", "head_b")[0] == F.col("item")  # a pair counts where it meets first, so once
    alike = 2 * F.size(F.array_intersect("items_a", "items_b")) >= threshold * (n_a + n_b) - 1e-9
    pairs = heads(sides[0], "a", "b").join(heads(sides[1], "b", "a"), key).where(near & first & alike)
    made = dealt(stored(pairs.select(*by, "text_a", "text_b")), "text_a", "text_b")  # the ratio is computed once, in tasks of their own
    return made.withColumn("ratio", sequence_similarity("text_a", "text_b")).where(F.col("ratio") >= threshold)


def like_overrides(rows: DataFrame, overrides: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """rows (by, text) with ``value`` of the override (by, text, value) whose text is most alike, null if none reaches
    ``threshold``; on ties the alphabetically first override, of equal texts the least value."""
    by = by or []
    pairs = similar_texts(rows, overrides, threshold, by)
    values = overrides.where("text is not null").groupBy(*by, F.col("text").alias("text_b")).agg(F.min("value").alias("value"))
    best = pairs.join(values, [*by, "text_b"]).groupBy(*by, "text_a").agg(F.min(F.struct((-F.col("ratio")).alias("away"), "text_b", "value"))["value"].alias("value"))
    return rows.join(best.withColumnRenamed("text_a", "text"), [*by, "text"], "left")
