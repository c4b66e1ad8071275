"""Near-duplicate detection with b-bit MinHash, confirmed on whole shingle sets.

1. Every text becomes its set of distinct 5-word shingles (hashed to 64 bits). Texts with equal sets form one class.
2. Each class gets ``ROWS * BANDS`` minima. Bands of whole minima give candidate buckets; of each minimum the low
   ``BITS`` bits are kept, packed into longs, and estimate similarity by bit counts, corrected for chance agreement.
3. Round one compares a text with the centres of its buckets only: the members whose minima are the most common, so
   likely the originals. The most common of them comes first; where that links both a text and another centre, the two
   needn't be compared. So a group whose members hang together costs about one pair a member.
4. Round two compares the members of a bucket that round one left in different components; those with too many shingles
   that no other such text has can be linked with nothing and go first, so texts of one template, which share minima but
   are not alike, aren't compared. A bucket is dealt in blocks of ``BLOCK`` members, each pair of blocks on its own, so
   that no task gets a whole one. No candidate pair between components stays untested; members that differ in common
   shingles only are compared pair by pair, so that case costs the square of a bucket's members.
5. Pairs whose estimate or set sizes allow the threshold are confirmed on the whole sets; links give components.

With 5 rows and 32 bands a pair of similarity 0.85 shares no bucket with probability 7e-9.

Nulls and edge cases: an empty table gives an empty one; very long texts form blocks of their own, and their sets must fit
a task's memory. A null or blank text has the empty set, is linked with nothing and is kept; a text with fewer
than five words has one shingle, the whole sequence. Rows with a null id are kept and never linked. Rows that repeat
an id count as one node: what links one of them links all. Ties: of equally common members the one with the smallest id
is the centre, and a component is named by its smallest id. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textops as T
from tidemark.llm.common import blocks, stored
from tidemark.llm.components import components

SIZE, ROWS, BANDS, BITS = 5, 5, 32, 2
#: The estimate may lie this far below the threshold: over four standard deviations at 160 minima and two bits.
MARGIN = 0.16
#: Members of a bucket that one task compares with as many others.
BLOCK = 512

_rng = np.random.RandomState(20240229)
_XOR = _rng.randint(0, 1 << 32, ROWS * BANDS, dtype=np.uint64).astype(np.uint32)
_MUL = _rng.randint(0, 1 << 31, ROWS * BANDS, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_BAND = np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407) | np.uint64(1)

SKETCH = "doc_id long, n_shingles long, digest binary, sig array<long>, bands array<long>"
SETS = "doc_id long, n_shingles long, shingles array<long>"


def shingle_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each row, repeats included, and the rows' bounds."""
    data = T.lower_ascii(data)
    start, end, rows = T.words(data, offsets)
    hashes = T.range_hashes(T.prefix_sums(data), start, end)
    found, _, bounds = T.windows(hashes, rows, SIZE)
    counts = np.diff(rows)
    short = np.flatnonzero((counts > 0) & (counts < SIZE))
    if not len(short):
        return found, bounds
    whole = np.zeros(len(short), np.uint64)
    for j in range(SIZE - 1):
        has = counts[short] > j
        whole[has] = T.mix(whole[has] + hashes[rows[short[has]] + j] + np.uint64(j + 1))
    sizes = np.diff(bounds)
    sizes[short] = 1
    new = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(new[-1], np.uint64)
    mask = np.ones(len(out), bool)
    mask[new[:-1][short]] = False
    out[mask], out[~mask] = found, whole
    return out, new


def _sets(batch: pa.RecordBatch):
    """(row, sorted distinct shingle hashes) of every row, block by block."""
    for lo, hi, data, offsets in blocks(batch.column(1)):
        hashes, bounds = shingle_hashes(data, offsets)
        for i in range(hi - lo):
            yield lo + i, np.unique(hashes[bounds[i] : bounds[i + 1]])


def minima(distinct: np.ndarray) -> np.ndarray:
    """The smallest of the distinct shingles' hashes under each of the permutations."""
    short = (distinct >> np.uint64(32)).astype(np.uint32)
    return np.array([((short ^ x) * m).min() for x, m in zip(_XOR, _MUL, strict=True)], np.uint32)


def packed(low: np.ndarray) -> np.ndarray:
    """The low bits of the minima, packed into 64-bit longs."""
    per = 64 // BITS
    low = ((low >> np.uint32(7)) & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, per)
    return (low << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)


def _longs(rows: list[np.ndarray], width: int | None = None) -> pa.Array:
    flat = np.concatenate(rows) if rows else np.empty(0, np.uint64)
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.view(np.int64)))


def _sketched(batches):
    bands_of = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)
    for batch in batches:
        sizes, digests, sigs, bands = [], [], [], []
        for _, found in _sets(batch):
            sizes.append(len(found))
            digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
            if len(found):
                low = minima(found)
                sigs.append(packed(low))
                bands.append(T.mix((low.astype(np.uint64).reshape(BANDS, ROWS) * _BAND).sum(axis=1, dtype=np.uint64) ^ bands_of))
            else:
                sigs.append(np.empty(0, np.uint64))
                bands.append(np.empty(0, np.uint64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _longs(sigs), _longs(bands)], ["doc_id", "n_shingles", "digest", "sig", "bands"])


def _set_rows(batches):
    for batch in batches:
        found = [x for _, x in _sets(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int64()), _longs(found)], ["doc_id", "n_shingles", "shingles"])


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed low bits: agreeing positions, corrected for agreement by chance."""
    per, chance = 64 // BITS, 2.0**-BITS
    ones = sum(1 << (BITS * i) for i in range(per))
    differing = []
    for i in range(ROWS * BANDS // per):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        any_bit = reduce(lambda p, q: p.bitwiseOR(q), [x] + [F.shiftrightunsigned(x, k) for k in range(1, BITS)])
        differing.append(F.bit_count(any_bit.bitwiseAND(F.lit(ones))))
    agreeing = F.lit(1.0) - reduce(lambda p, q: p + q, differing) / F.lit(float(ROWS * BANDS))
    return (agreeing - chance) / (1 - chance)


def _may_link(a: str, b: str, percent: int) -> Column:
    n, m = F.col(f"n_{a}"), F.col(f"n_{b}")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (estimate(F.col(f"sig_{a}"), F.col(f"sig_{b}")) >= percent / 100 - MARGIN)


def _with_sets(pairs: DataFrame, sets: DataFrame, side: str) -> DataFrame:
    """``pairs`` with the shingle set of their ``side``. A text with more than BLOCK partners is dealt to a task for each
    BLOCK of them, and its set copied so often only; other sets aren't copied at all."""
    other = "a" if side == "b" else "b"
    own = sets.select(F.col("doc_id").alias(side), F.col("shingles").alias(f"set_{side}"))
    hubs = stored(pairs.groupBy(side).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")).where("parts > 1"))
    if hubs.isEmpty():
        return pairs.join(own, side)
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(other), F.col("parts"))).cast("int")
    dealt = pairs.join(hubs, side, "left").withColumn("part", part).drop("parts")
    once = own.join(hubs, side, "left_anti").withColumn("part", F.lit(0))
    copies = own.join(hubs, side, "left").where("parts is not null").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return dealt.join(once.unionByName(copies), [side, "part"]).drop("part")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets have 100 * intersection >= percent * union."""
    both = F.size(F.array_intersect("set_a", "set_b"))
    found = _with_sets(_with_sets(pairs.select("a", "b"), sets, "b"), sets, "a")
    return found.where(100 * both >= percent * (F.size("set_a") + F.size("set_b") - both)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = stored(docs.mapInArrow(_sketched, SKETCH))
    real = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = stored(real.groupBy("digest").agg(F.min("doc_id").alias("node")))
    nodes = real.join(classes.withColumnRenamed("node", "doc_id"), ["digest", "doc_id"], "left_semi")
    nodes = stored(nodes.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "sig", "bands", "digest").dropDuplicates(["node", "digest"]))
    attrs = nodes.select("node", "n", "sig")
    a, b = (attrs.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}")) for x in "ab")

    member = nodes.select("node", F.explode("bands").alias("bucket"))
    crowds = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
    hits = stored(member.join(crowds, "bucket"))
    popular = hits.groupBy("node").agg(F.sum("crowd").alias("popularity"))
    sets = stored(docs.join(popular.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").mapInArrow(_set_rows, SETS))

    # round one: each text against the one centre of its buckets whose minima are the most common, likely the original
    ranked = stored(hits.join(popular, "node").select("bucket", "node", F.struct("popularity", (-F.col("node")).alias("first")).alias("rank")))
    centres = ranked.groupBy("bucket").agg(F.max("rank").alias("top")).withColumn("centre", -F.col("top")["first"])
    met = stored(ranked.join(centres, "bucket").where("node <> centre").select("node", "centre", "top").distinct())
    ends = F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")

    def alike(pairs: DataFrame) -> DataFrame:
        return stored(pairs.join(b, "b").join(a, "a").where(_may_link("a", "b", percent)).select("a", "b"))

    choice = stored(met.groupBy("node").agg(F.max_by("centre", "top").alias("centre")).select("node", "centre", *ends))
    star = alike(choice.select("a", "b").distinct())
    linked = stored(confirmed(star, sets, percent))
    # then against the centres of its other buckets, unless both hang on the same one already
    own = choice.join(linked, ["a", "b"], "left_semi")
    labels = [own.select(F.col("node").alias(c), F.col("centre").alias(f"label_{c}")) for c in ("node", "centre")]
    others = met.select("node", "centre").join(choice.select("node", "centre"), ["node", "centre"], "left_anti").join(labels[0], "node", "left").join(labels[1], "centre", "left")
    others = others.where(F.coalesce("label_node", "node") != F.coalesce("label_centre", "centre")).select(*ends).distinct()
    second = alike(others.join(star, ["a", "b"], "left_anti"))
    star = star.unionByName(second)
    linked = linked.unionByName(stored(confirmed(second, sets, percent)))
    first = components(linked)

    # round two: what the first left apart in a bucket
    def apart(rows: DataFrame) -> DataFrame:
        split = rows.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("open")).where("lo < hi")
        return rows.drop("open").join(split.select("bucket", "open"), "bucket")

    placed = hits.select("bucket", "node").join(first, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    open_ = stored(apart(placed))
    shingles = sets.join(open_.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", F.explode("shingles").alias("shingle"))
    alone = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.min("doc_id").alias("node")).where("k = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    shared = attrs.join(alone, "node", "left").withColumn("shared", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone").where(100 * F.col("shared") >= percent * F.col("n"))
    open_ = stored(apart(open_.join(shared, "node")).join(nodes.select("node", "n", "bands"), ["node", "n"]))
    blocks_of = F.ceil(F.col("open") / BLOCK).cast("int")
    dealt = open_.withColumn("block", F.pmod(F.xxhash64("node"), blocks_of).cast("int"))
    left, right = (dealt.select("bucket", "block", blocks_of.alias("blocks"), *(F.col(c).alias(f"{c}_{x}") for c in ("node", "component", "n", "sig", "shared", "bands"))) for x in "ab")
    left = left.select("*", F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("j")).drop("block", "blocks")
    right = right.select("*", F.col("block").alias("j"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("i")).drop("block", "blocks")
    once = F.col("bucket") == F.array_min(F.array_intersect("bands_a", "bands_b"))
    enough = (100 + percent) * F.least("shared_a", "shared_b") >= percent * (F.col("n_a") + F.col("n_b"))
    rest = left.join(right, ["bucket", "i", "j"]).where((F.col("component_a") != F.col("component_b")) & ((F.col("i") != F.col("j")) | (F.col("node_a") < F.col("node_b"))) & enough & _may_link("a", "b", percent) & once)
    rest = rest.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    more = stored(confirmed(stored(rest.join(star, ["a", "b"], "left_anti")), sets, percent))
    final = first if more.isEmpty() else components(linked.unionByName(more))

    by_class = classes.join(final, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    full = F.col("n_shingles") > 0  # empty sets have all one digest, and no links
    out = sketch.where(full).join(by_class, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
    out = out.unionByName(sketch.where(~full).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
