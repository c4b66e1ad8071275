"""Centroid clustering of integer vectors by an incremental distance matrix.

Each vector keeps its exact integer products with all centroids, in a table in the shared folder. When centroids move,
a product changes only by the components that moved: product += sum of component times change over these. The nearest
centroid then follows from the products and the lengths of both, |v|² - 2 v·c + |c|², without a distance being computed
anew. Sums and counts of clusters are carried on likewise, by the vectors that changed their cluster alone. Rounds end
early when no centroid moves, for then nothing else would either.

A round reads the table once, in tasks, and writes the next one; vectors are never shuffled. What goes to the driver are
sums of clusters, one row for each cluster and task at most before they are added up, and k centroids after. The table of
the round before is deleted once the next one stands.

Vectors of another length, with null or non-finite components, or null themselves, are left out. Components are
floor(scale * x); one of more than 2 ** 27 raises an error, since distances wouldn't fit in a long. Starts are the kept
vectors with the smallest hash of their ids (ties by components); a null id hashes as ''. With fewer vectors than
centroids, each is a start; equal starts leave the later ones empty, and empty clusters stay where they are. Repeated
rows count each time. An empty table gives an empty one. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import spent, stored

#: The largest component whose squared differences over some hundred components fit in a long.
LARGEST = 1 << 27


def _matrix(column: pa.Array, width: int, kind: type = np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width), pa.int32()), pa.array(rows.ravel(), kind))


def integers(vectors: DataFrame, vector: str, size: int, scale: int) -> DataFrame:
    """(vec_id, v) of the vectors of ``size`` finite components, each of them floor(scale * x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), size), False)
            ids, lists = batch.column(0).filter(right), batch.column(1).filter(right)
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)  # nulls become NaN
            good = np.isfinite(x).all(axis=1)
            scaled = np.floor(scale * x[good])
            if (np.abs(scaled) > LARGEST).any():
                raise ArithmeticError(f"a component over {LARGEST}: distances don't fit in a long")
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), _lists(scaled.astype(np.int32), pa.int32())], ["vec_id", "v"])

    rows = vectors.select("vec_id", F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, f"vec_id {dict(rows.dtypes)['vec_id']}, v array<int>")


def product(v: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Exact integer products of rows with one vector; by floating point where no sum can pass 2 ** 53."""
    if np.abs(v).max(initial=0) * np.abs(change).astype(object).sum() < 1 << 53:
        return (v.astype(np.float64) @ change.astype(np.float64)).astype(np.int64)
    return v @ change


def moved(v: np.ndarray, dots: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The products with the centroids ``after``, from those with ``before``: changed components only."""
    dots = dots.copy()
    for j, change in enumerate(after - before):
        at = np.flatnonzero(change)
        if len(at):
            dots[:, j] += product(v[:, at], change[at])
    return dots


def _round(state: DataFrame, before: np.ndarray, after: np.ndarray, first: bool) -> DataFrame:
    """The state with products and clusters for the centroids ``after``; ``last``: the cluster a vector was in before."""
    k, size = after.shape
    length = (after**2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), size)
            dots = np.zeros((len(v), k), np.int64) if first else _matrix(batch.column(2), k)
            last = np.full(len(v), -1, np.int32) if first else batch.column(3).to_numpy()
            dots = moved(v, dots, before, after)
            away = length - 2 * dots
            cluster = away.argmin(axis=1)
            distance = (v**2).sum(axis=1) + away[np.arange(len(v)), cluster]
            columns = [batch.column(0), batch.column(1), _lists(dots, pa.int64()), pa.array(cluster, pa.int32()), pa.array(last, pa.int32()), pa.array(distance, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "dots", "cluster", "last", "distance"])

    columns = ["vec_id", "v"] if first else ["vec_id", "v", "dots", "cluster"]
    return state.select(columns).mapInArrow(run, f"vec_id {dict(state.dtypes)['vec_id']}, v array<int>, dots array<bigint>, cluster int, last int, distance bigint")


def _changes(state: DataFrame, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """By how much each cluster's sums and counts grow, from the vectors that came and went; exact whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k + 1, size), np.int64), np.zeros(k + 1, np.int64)
        for batch in batches:
            v = _matrix(batch.column(0), size)
            for column, sign in ((batch.column(1), 1), (batch.column(2), -1)):
                at = column.to_numpy() % (k + 1)  # -1, in no cluster, is the last row
                np.add.at(sums, at, sign * v)
                np.add.at(counts, at, sign)
        used = np.flatnonzero(np.abs(sums).any(axis=1) | (counts != 0))
        used = used[used < k]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), _lists(sums[used], pa.int64()), pa.array(counts[used], pa.int64())], ["cluster", "sums", "n"])

    parts = state.where("cluster <> last").select("v", "cluster", "last").mapInArrow(run, "cluster int, sums array<bigint>, n bigint")
    rows = parts.select("cluster", F.posexplode(F.array_append("sums", F.col("n"))).alias("at", "x"))
    sums, counts = np.zeros((k, size), object), np.zeros(k, object)
    for cluster, at, x in rows.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)"))).collect():  # k rows of ``size`` sums
        (counts if at == size else sums[:, at])[cluster] = int(x)
    return sums, counts


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2", vector: str = "embedding", size: int = 64, scale: int = 256) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and the final centroid of each kept vector's cluster."""
    state = stored(integers(vectors, vector, size, scale))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    starts = state.select(hashed.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    after = np.array([x.v for x in starts], np.int64).reshape(-1, size)
    k = max(1, len(after))
    after = after if len(starts) else np.zeros((1, size), np.int64)
    before = np.zeros_like(after)
    sums, counts = np.zeros((k, size), object), np.zeros(k, object)
    for i in range(rounds + 1):
        made = stored(_round(state, before, after, i == 0))
        spent(state)
        state = made
        if i == rounds:
            break
        more, came = _changes(state, k, size)
        sums, counts = sums + more, counts + came
        before = after
        after = np.array([[x // n for x in row] if n else list(old) for row, n, old in zip(sums, counts, before, strict=True)], np.int64)
        if (after == before).all():
            break
    inertia = {x.cluster: x.inertia for x in state.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # k rows
    final = [(j, inertia.get(j, 0), sum(inertia.values()), row.tolist()) for j, row in enumerate(after)]
    final = vectors.sparkSession.createDataFrame(final, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return state.join(F.broadcast(final), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(centroid: str) -> Column:
    """The SHA-256 of a centroid's components as decimal integers, joined by commas."""
    return F.sha2(F.array_join(F.col(centroid).cast("array<string>"), ","), 256)
