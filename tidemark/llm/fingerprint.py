"""Document fingerprints: one-permutation MinHash, in DataFrame functions only.

The hashes of a text's 5-word shingles are dealt into ``BINS`` by their top bits, and the smallest of each bin stays.
An empty bin copies the filled bin that comes first in the empty bin's own pseudo-random order of all bins (optimal
densification). The low 4 bits of each bin's value are kept as one hexadecimal digit. Likeness is the share of equal
digits, corrected for those equal by chance.

Nulls and edge cases: null counts as empty; a text without words has the empty fingerprint, which is like itself (1)
and unlike all others (0); fewer than five words give one shingle. "Next" follows descending doc_id, null ids last, ties
by the texts' descending hash; after the last comes the first. A single row is its own next. An empty table gives an
empty one. Ids must be numbers. Extra columns are ignored. Rows that repeat id and text stay in one cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import let, stored, task_count

BINS, BITS, SIZE = 128, 4, 5
_SHIFT = 64 - 7
#: Bytes of text that a task, and a cell of neighbouring ids, should have at most; beyond CELLS of them cells grow instead.
CELL_BYTES, CELLS = 16 << 20, 50_000


def shingles(text: Column) -> Column:
    """Hashes of the 5-word shingles of a text, repeats included."""
    words = F.filter(F.split(text, "[\\x20\\t-\\r]+"), lambda x: x != "")

    def of(h: Column) -> Column:
        n = F.size(h)
        many = F.transform(F.sequence(F.lit(0), n - SIZE), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(SIZE))))
        none = F.array().cast("array<long>")
        return F.when(n >= SIZE, many).when(n > 0, F.array(F.aggregate(h, F.lit(7).cast("long"), lambda a, x: F.xxhash64(a, x)))).otherwise(none)

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def digits(text: Column) -> Column:
    """The low bits of each bin of a text's fingerprint; an empty array if it has no words."""

    def firsts(ordered: Column) -> Column:
        return F.filter(ordered, lambda x, i: (i == 0) | (F.shiftrightunsigned(x, _SHIFT) != F.shiftrightunsigned(F.get(ordered, i - 1), _SHIFT)))

    def dense(low: Column) -> Column:
        return let(F.transform(low, lambda x: F.shiftrightunsigned(x, _SHIFT)), lambda bins: F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")), lambda i: digit(low, bins, i)))

    def digit(low: Column, bins: Column, i: Column) -> Column:
        mask = (1 << BITS) - 1
        borrowed = F.array_min(F.transform(low, lambda x: F.xxhash64(i, F.shiftrightunsigned(x, _SHIFT)).bitwiseAND(F.lit(~mask)).bitwiseOR(x.bitwiseAND(F.lit(mask)))))
        return let(F.array_position(bins, i), lambda p: F.when(p > 0, F.get(low, p - 1)).otherwise(borrowed)).bitwiseAND(F.lit(mask)).cast("int")

    ordered = F.sort_array(shingles(text))
    return let(let(ordered, firsts), lambda low: F.when(F.size(low) > 0, dense(low)).otherwise(F.array().cast("array<int>")))


def packed(digit_array: Column) -> Column:
    return F.array_join(F.transform(digit_array, lambda d: F.substring(F.lit("0123456789abcdef"), d + 1, F.lit(1))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of two digit arrays, 0 to 1."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(BINS))
    chance = 2.0**-BITS
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def _placed(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """``rows`` (key, h, cell, ...) with the cells that ``cut`` names cut evenly between their ends."""
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    part = F.floor((F.when(F.col("by_h"), wide("h")).otherwise(wide("key")) - wide("lo")) / F.col("step"))
    rows = rows.join(F.broadcast(cut), "cell", "left")  # a row for each cell that is too large: CELLS or so at most
    return rows.withColumn("cell", F.when(F.col("step").isNotNull(), F.concat_ws("/", "cell", part.cast("string"))).otherwise(F.col("cell"))).drop("by_h", "lo", "step")


def _cuts(ids: DataFrame, most: int) -> list[DataFrame]:
    """How to cut the range of (key, h) into cells of at most ``most`` bytes: level by level, each cell that is larger is
    cut evenly between its own least and greatest key, or hash where all keys are equal. So neither gaps nor outliers
    nor repeated ids gather rows, and levels are few. A cell is a stretch of the order; only equal rows can't be cut."""
    levels: list[DataFrame] = []
    now = ids.withColumn("cell", F.lit(""))
    while True:
        ends = now.groupBy("cell").agg(F.sum("size").alias("size"), *(f(c).alias(n) for c, lo, hi in (("key", "a", "b"), ("h", "c", "d")) for f, n in ((F.min, lo), (F.max, hi))))
        ends = ends.where((F.col("size") > most) & ((F.col("a") < F.col("b")) | (F.col("c") < F.col("d"))))
        span = F.when(F.col("a") < F.col("b"), F.col("b").cast("decimal(20,0)") - F.col("a").cast("decimal(20,0)")).otherwise(F.col("d").cast("decimal(20,0)") - F.col("c").cast("decimal(20,0)"))
        parts = 2 * F.ceil(F.col("size") / most)
        cut = stored(ends.select("cell", (F.col("a") == F.col("b")).alias("by_h"), F.when(F.col("a") < F.col("b"), F.col("a")).otherwise(F.col("c")).alias("lo"), (F.floor(span / parts) + 1).cast("decimal(20,0)").alias("step")))
        if cut.isEmpty():
            return levels
        levels.append(cut)
        now = _placed(now, cut)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, cell, key, h, ghost: all rows in cells of neighbouring ids, each with a ghost of the row that
    comes after it; so a window inside a cell sees every row's next, and no task sees all ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("h", F.xxhash64("text"))
    ids = stored(rows.select("key", "h", F.octet_length("text").cast("long").alias("size")))
    total = ids.agg(F.sum("size")).first()[0] or 0
    tasks = task_count(docs.sparkSession, total, CELL_BYTES, CELLS)
    levels = _cuts(ids, max(1, total // tasks))

    def placed(df: DataFrame) -> DataFrame:
        df = df.withColumn("cell", F.lit(""))
        for cut in levels:
            df = _placed(df, cut)
        return df

    tops = stored(placed(ids.select("key", "h")).groupBy("cell").agg(F.max(F.struct("key", "h")).alias("top")))
    down = Window.orderBy(F.col("top").desc())  # one row a cell: a few times CELLS at most, whatever the input
    after = tops.select("cell", F.coalesce(F.lead("top").over(down), F.max("top").over(Window.partitionBy(F.lit(1)))).alias("top"))
    heads = rows.select("key", "h", "text").join(F.broadcast(tops.select("top.key", "top.h")), ["key", "h"])  # one pair of numbers a cell
    heads = heads.groupBy("key", "h").agg(F.first("text").alias("text")).select(F.struct("key", "h").alias("top"), "text")
    ghosts = after.join(heads, "top").select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(-(1 << 63)).alias("key"), F.lit(-(1 << 63)).alias("h"), "cell", F.lit(True).alias("ghost"))
    return placed(rows).withColumn("ghost", F.lit(False)).unionByName(ghosts).repartition(tasks, "cell")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and how like the edited and the next text's they are."""
    order = Window.partitionBy("cell").orderBy("ghost", F.col("key").desc(), F.col("h").desc())
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = with_next(docs).withColumn("following", F.lead("text").over(order))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.coalesce("following", F.lit("")), F.lit(1), third))
    rows = rows.select("doc_id", "cell", "key", "h", "ghost", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.select("doc_id", "cell", "key", "h", "ghost", "text", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digits(F.col("text")).alias("own"), digits(F.col("edited")).alias("other"))
    rows = rows.withColumn("next", F.lead("own").over(order)).where(~F.col("ghost"))
    return rows.select("doc_id", "n_chars", "edited_sha256", packed(F.col("own")).alias("fingerprint"), packed(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))
