"""Ranking, context, sampling and batching over ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

By = list[str]


def context_text(df: DataFrame, by: By, order: str, text: str, before: int, after: int, max_chars: int) -> DataFrame:
    """Adds ``context``: the texts around a row, joined and cut to ``max_chars``."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-before, after)
    return df.withColumn("context", F.substring(F.array_join(F.collect_list(text).over(w), " / "), 1, max_chars))


def nearest_set(df: DataFrame, by: By, order: list[str], value: str) -> DataFrame:
    """Adds the last non-null ``value`` before a row and the first after it."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("previous", F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("following", F.first(value, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))


def sliding_rows(df: DataFrame, by: By, order: str, size: int, stride: int) -> DataFrame:
    """Adds ``window``: each row is in every window of ``size`` rows that starts at a multiple of ``stride``."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = df.withColumn("_p", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    first = F.greatest(F.ceil((F.col("_p") - size + 1) / stride), F.lit(0))
    last = F.least(F.floor(F.col("_p") / stride), F.floor(F.greatest(F.col("_n") - size, F.lit(0)) / stride))
    return rows.where(first <= last).withColumn("window", F.explode(F.sequence(first.cast("long"), last.cast("long")))).drop("_p", "_n")


def head_middle_tail(df: DataFrame, by: By, order: str, k: int) -> DataFrame:
    """The first, middle and last ``k`` rows of each group, with the part they are from (first match wins)."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = df.withColumn("_p", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    middle = F.expr(f"greatest((_n - {k}) div 2, 0)")
    part = F.when(F.col("_p") < k, "head").when((F.col("_p") >= middle) & (F.col("_p") < middle + k), "middle").when(F.col("_p") >= F.col("_n") - k, "tail")
    return rows.withColumn("part", part).where("part is not null").drop("_p", "_n")


def even_sample(df: DataFrame, by: By, order: str, n: int, single: str = "middle") -> DataFrame:
    """``n`` rows of each group at even distances, rounded half to even, first and last included; all rows of smaller
    groups. For one row: the ``middle`` or the ``first``."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = df.withColumn("_p", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    if n == 1:
        picked = F.col("_p") == (F.floor(F.col("_n") / 2) if single == "middle" else F.lit(0))
    else:
        picked = F.exists(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / (n - 1)) == F.col("_p"))
    return rows.where((F.col("_n") <= n) | picked).drop("_p", "_n")


def neighbours(df: DataFrame, by: By, order: str, value: str, before: int, after: int) -> DataFrame:
    """Adds previous_values and following_values: the values of the rows around, nearest last and first."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("previous_values", F.collect_list(value).over(w.rowsBetween(-before, -1))).withColumn("following_values", F.collect_list(value).over(w.rowsBetween(1, after)))


def first_wins(df: DataFrame, key: By, order: list) -> DataFrame:
    """The first row of each key by ``order``, which must be unique."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def cover_times(totals: DataFrame, n: int, lo: float = 0.1, hi: float = 0.9) -> DataFrame:
    """``n`` times of each row's ``total``, evenly spaced from ``lo`` to ``hi`` of it; the middle for one."""
    share = F.lit((lo + hi) / 2) if n == 1 else lo + (hi - lo) * F.col("k") / (n - 1)
    return totals.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("at", F.floor(F.col("total") * share).cast("long"))


def index_slice(df: DataFrame, by: By, order: list, first: int, last: int) -> DataFrame:
    """Rows ``first`` to ``last`` of each group, counted from 1, that last; ``index`` is their place."""
    rows = df.withColumn("index", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    return rows.where(F.col("index").between(first, last) & (F.col("e") > F.col("s")))


def joined_fragments(df: DataFrame, by: By, order: str, text: str, separator: str = " ") -> DataFrame:
    """One text a group: fragments in order, without those that the one before holds; one that holds it replaces it."""
    bare = lambda x: F.regexp_replace(x, r"[\s,.!?;:'，。！？：；]", "")
    rows = F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text])

    def add(out, x):
        last = F.element_at(out, -1)
        inside, around = F.contains(bare(last), bare(x)), F.contains(bare(x), bare(last))
        replaced = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(x))
        return F.when(bare(x) == "", out).when(F.size(out) == 0, F.array(x)).when(inside, out).when(around, replaced).otherwise(F.concat(out, F.array(x)))

    made = df.groupBy(*by).agg(rows.alias("_t"))
    return made.select(*by, F.array_join(F.aggregate("_t", F.array().cast("array<string>"), add), separator).alias(text))


def signature(df: DataFrame, by: By, order: str, text: str, k: int = 15, most: int = 900) -> DataFrame:
    """The distinct texts of a group's first, middle and last ``k`` rows, in order, joined and cut to ``most`` characters."""
    rows = head_middle_tail(df, by, order, k)
    texts = F.array_distinct(F.filter(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), lambda x: F.trim(x) != ""))
    return rows.groupBy(*by).agg(F.substring(F.array_join(texts, " "), 1, most).alias("signature"))


def sampled_stats(df: DataFrame, by: By, order: str, value: str, step: int) -> DataFrame:
    """Population mean and deviation of every ``step``-th value of each group, from the first on."""
    rows = df.withColumn("_p", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1).where(F.col("_p") % step == 0)
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.count(F.lit(1)).alias("samples"))


def representative(df: DataFrame, by: By, value: str, order: str) -> DataFrame:
    """The row of each group whose value is nearest to the median, the first by ``order`` on ties."""
    rows = df.withColumn("median", F.median(value).over(Window.partitionBy(*by)))
    return first_wins(rows, by, [F.abs(F.col(value) - F.col("median")), order])


def batch_no(df: DataFrame, by: By, order: list[str], k: int) -> DataFrame:
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / k).cast("long"))


def halves(df: DataFrame, by: By, order: list[str]) -> DataFrame:
    return df.withColumn("half", F.ntile(2).over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def runs(df: DataFrame, by: By, order: list[str], flag: str) -> DataFrame:
    """Runs of neighbouring rows whose ``flag`` holds: first and last position, and length."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("_p", F.row_number().over(w)).withColumn("_x", F.sum(F.when(F.col(flag), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where(F.col(flag)).groupBy(*by, "_x").agg(F.min("_p").cast("long").alias("first_pos"), F.max("_p").cast("long").alias("last_pos"), F.count(F.lit(1)).alias("length")).drop("_x")


def lag_clusters(df: DataFrame, by: By, order: list[str], at: str, gap: int) -> DataFrame:
    """Clusters of rows whose ``at`` lies within ``gap`` of the row before (not of the running maximum)."""
    w = Window.partitionBy(*by).orderBy(*order)
    previous = F.lag(at).over(w)
    rows = df.withColumn("_new", F.when(previous.isNull() | (F.col(at) - previous > gap), 1).otherwise(0))
    return rows.withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def anchor_windows(anchors: DataFrame, totals: DataFrame, by: By) -> DataFrame:
    """The spaces between anchors (s, e), from the running maximum end to the next start, and the tail."""
    rows = anchors.select(*by, "s", "e").unionByName(totals.select(*by, F.col("total").alias("s"), F.col("total").alias("e")))
    w = Window.partitionBy(*by).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("from", F.coalesce(F.max("e").over(w), F.lit(0)))
    return rows.where(F.col("s") > F.col("from")).select(*by, F.col("from").alias("window_start"), F.col("s").alias("window_end"))


def last_wins(df: DataFrame, key: By, order: list) -> DataFrame:
    """The last row of each key by ``order``, which must be unique."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def superseded(df: DataFrame, key: By, order: list, label: str) -> DataFrame:
    """Pairs of a row and the one that replaced it, in order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("replaced", F.lag(label).over(w)).where("replaced is not null")


def top_k(df: DataFrame, by: By, order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def runner_up_gap(df: DataFrame, by: By, score: str, order: list) -> DataFrame:
    """The best row of each group and how far its score is ahead; null when it is alone."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("gap", F.col(score) - F.lead(score).over(w)).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def weighted_median(df: DataFrame, by: By, x: str, weight: str) -> DataFrame:
    """The first x at which the running weight reaches half of the total; weights are 1e-6 at least."""
    df = df.withColumn(weight, F.greatest(F.col(weight).cast("double"), F.lit(1e-6)))
    w = Window.partitionBy(*by).orderBy(x).rangeBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_c", F.sum(weight).over(w)).withColumn("_t", F.sum(weight).over(Window.partitionBy(*by)))
    return rows.where(2 * F.col("_c") >= F.col("_t")).groupBy(*by).agg(F.min(x).alias("weighted_median"))
