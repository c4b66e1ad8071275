"""Alignments of two long sequences in tiles, and the blended similarity that they follow.

A sequence lies in blocks of ``tile`` rows; a tile is a block of one side against a block of the other. Only tiles that the
band around the diagonal crosses are made. The table of sums is filled one anti-diagonal of tiles a round, the tiles of
all sequences at once; a round leaves the last row and the last column of each tile, nothing else. The way back starts
at each sequence's end: in each round the tile that holds it is filled once more from its borders, and the way leads
through it to the next. So a task holds a tile, never a whole table, a long sequence is spread over as many tasks as its
diagonal has tiles, and rounds grow with the longest sequence's blocks. Sequences of one block each need one round in all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.storage import large, spent, stored

By = list[str]
#: Rows of a block: where each cell becomes a row, in ``aligned``, and in ``grouped``, which holds a table for each size of groups.
TILE, WIDE, GROUPS = 512, 2048, 1024
#: Cells of the small tables that are filled together, of scores made at once, and of those rounded at once.
TOGETHER, STRIP, ROUNDED = 1 << 19, 1 << 18, 1 << 15
NONE = np.float32(-1e9)


@dataclass(frozen=True)
class Blend:
    """How alike two cues are: products of their own vectors and of their contexts', equal progress, less penalties.

    ``incompatible``: both name speakers, none of them the same. ``unnamed``: the first names one, the second doesn't.
    ``short``: (characters at most in the second, at least in the first, penalty); the first that holds counts.
    A weight of 0 needs no column. Columns: vector, context, progress (0 to 1), names (array; of the second a string,
    name), named, chars; and length, that of the context, if contexts aren't directions.
    """

    base: float = 1.0
    context: float = 0.0
    progress: float = 0.0
    width: float = 0.16
    incompatible: float = 0.0
    unnamed: float = 0.0
    short: tuple[tuple[int, int, float], ...] = ()

    def columns(self) -> list[str]:
        wanted = {"vector": self.base, "context": self.context, "length": self.context, "progress": self.progress, "names": self.incompatible, "name": self.incompatible, "named": self.unnamed, "chars": self.short}
        return [c for c, w in wanted.items() if w]


@dataclass(frozen=True)
class Path:
    """What a pair must reach to be walked over (``match``) and to be returned (``output``), what skipped rows cost, and
    how far from the diagonal a pair may lie: ``ratio`` of the second sequence, ``least`` rows at least."""

    match: float = 0.46
    output: float = 0.50
    skip_a: float = 0.015
    skip_b: float = 0.010
    ratio: float = 0.22
    least: int = 180

    def band(self, m: Column) -> Column:
        return F.greatest(F.least(F.lit(self.least), m).cast("double"), self.ratio * m).cast("long")


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


#: Vectors of at most so many components are multiplied as SQL would, in order; longer ones as matrices.
SHORT = 16


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of each row of ``a`` with each of ``b``; of short rows summed in the order of their components."""
    if a.shape[1] > SHORT or not a.shape[1]:
        return a @ b.T
    out = np.multiply.outer(a[:, 0], b[:, 0])
    for k in range(1, a.shape[1]):
        out += np.multiply.outer(a[:, k], b[:, k])
    return out


def _nine_digits(x: np.ndarray) -> np.ndarray:
    """Rounds ``x`` itself to nine digits, halves away from zero, as SQL rounds; some rows at once, so that they stay in cache."""
    step = max(1, ROUNDED // max(1, x.shape[1]))
    for i in range(0, len(x), step):
        part = x[i : i + step] * 1e9
        whole = np.trunc(part)
        x[i : i + step] = np.where(np.abs(part - whole) == 0.5, whole + np.sign(part), np.rint(part)) / 1e9
    return x


def similarity(a: pa.StructArray, b: pa.StructArray, blend: Blend) -> np.ndarray:
    """The blended similarity of each row of one block with each of another, rounded to nine digits, so that the same
    pair has the same value in whatever block it lies."""
    out = np.zeros((len(a), len(b)))
    column = lambda x, name: x.field(name).to_numpy(zero_copy_only=False)
    if blend.base:
        out += blend.base * _products(_vectors(a.field("vector")), _vectors(b.field("vector")))
    if blend.context:
        near = blend.context * _products(_vectors(a.field("context")), _vectors(b.field("context")))
        out += near / np.multiply.outer(column(a, "length"), column(b, "length")) if a.type.get_field_index("length") >= 0 else near
    if blend.progress:
        away = np.abs(column(a, "progress")[:, None] - column(b, "progress")[None, :])
        out += blend.progress * np.clip(1 - away / blend.width, 0, 1)
    if blend.incompatible:
        out -= blend.incompatible * _strangers(a.field("names").to_pylist(), b.field("name").to_pylist())
    if blend.unnamed:
        out -= blend.unnamed * (column(a, "named").astype(bool)[:, None] & ~column(b, "named").astype(bool)[None, :])
    if blend.short:
        open_ = np.ones(out.shape, bool)
        for most, least, penalty in blend.short:
            hit = open_ & (column(a, "chars") >= least)[:, None] & (column(b, "chars") <= most)[None, :]
            out -= penalty * hit
            open_ &= ~hit
    return _nine_digits(out)


def _strangers(names: list[list[str] | None], name: list[str | None]) -> np.ndarray:
    """Where both sides name speakers and no name begins with the other side's."""
    firsts, seconds = sorted({x for xs in names for x in xs or []}), sorted({x for x in name if x})
    if not firsts or not seconds:
        return np.zeros((len(names), len(name)), bool)
    at = {x: i for i, x in enumerate(seconds)}
    agree = {x: [at[y] for y in seconds if x.startswith(y) or y.startswith(x)] for x in firsts}
    known = np.zeros((len(names), len(seconds)), bool)
    for i, xs in enumerate(names):
        for x in xs or []:
            known[i, agree[x]] = True
    where = np.array([at.get(x, -1) for x in name])
    return np.array([bool(xs) for xs in names])[:, None] & (where >= 0)[None, :] & ~known[:, np.maximum(where, 0)]


def _edge(cost: float, end: int) -> np.ndarray:
    """What 0 .. end skipped rows cost, as 32-bit sums."""
    return np.cumsum(np.concatenate(([0], np.full(end, -cost))), dtype=np.float32)


def _by_diagonals(n: int, m: int, k: int, kind: type, value: float = 0) -> tuple[np.ndarray, np.ndarray]:
    """``k`` tables of n by m cells in the order in which they are filled, [i + j, i, k], and the same cells as [i, j, k]."""
    made = np.full((n + m - 1, n, k), value, kind)
    d, i, x = made.strides
    return made, as_strided(made, (n, m, k), (d + i, d, x))


def fill(sim: np.ndarray, i0: int, j0: int, n: int, m: int, band: int, path: Path, top: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, moves) of a tile whose rows begin after ``i0`` and columns after ``j0``, with a border row and column before.

    On equal sums skipping a row comes before skipping a column, and that before a pair (moves 1, 2, 3). Cells outside the
    band can't be entered; a way that ends up there goes up. Sums are 32-bit floats. ``top`` holds the corner too.
    """
    p, q = sim.shape
    (sums, best), (moves, move), (gains, gain) = _by_diagonals(p + 1, q + 1, 1, np.float32, NONE), _by_diagonals(p + 1, q + 1, 1, np.int8), _by_diagonals(p, q, 1, np.float32)
    gain[..., 0] = sim
    gains -= np.float32(path.match)
    best[0, :, 0], best[1:, 0, 0] = top, left
    centre = (np.arange(i0, i0 + p + 1) - 1) * (m / max(n, 1))
    at = (centre.astype(np.int64) - j0 + np.arange(p + 1))[1:]  # rises with i, so the band is a stretch of each diagonal
    first, last = (np.searchsorted(at, np.arange(p + q + 1) + x, side) for x, side in ((-band, "left"), (band, "right")))
    for d in range(2, p + q + 1):
        i, j = max(1, d - q, int(first[d]) + 1), min(p, d - 1, int(last[d])) + 1
        if i >= j:
            continue
        up, beside = sums[d - 1, i - 1 : j - 1, 0] - np.float32(path.skip_a), sums[d - 1, i:j, 0] - np.float32(path.skip_b)
        pair = sums[d - 2, i - 1 : j - 1, 0] + gains[d - 2, i - 1 : j - 1, 0]
        value, how = sums[d, i:j, 0], moves[d, i:j, 0]
        np.maximum(up, beside, out=value)
        np.add(beside > up, 1, out=how, casting="unsafe")
        how[pair > value] = 3
        np.maximum(value, pair, out=value)
    return best[..., 0], move[..., 0]


def _packed(rows: DataFrame, by: By, columns: list[str], tile: int, halo: dict[str, int] | None = None) -> DataFrame:
    """``scope``, side, block, and the block's rows in order; a block has at most ``tile`` rows, and before them as many of
    the block before as ``halo`` says for its side."""
    scope = F.to_json(F.struct(*by)) if by else F.lit("{}")
    order = Window.partitionBy("scope", "side").orderBy("pos")
    rows = rows.select(scope.alias("scope"), "side", F.col("pos").cast("long").alias("pos"), *columns)
    rows = rows.withColumn("at", F.row_number().over(order) - 1).withColumn("block", F.floor(F.col("at") / tile).cast("int"))
    if halo:
        late = F.col("at") % tile >= tile - F.when(F.col("side") == "a", halo["a"]).otherwise(halo["b"])
        rows = rows.withColumn("block", F.explode(F.when(late, F.array("block", F.col("block") + 1)).otherwise(F.array("block"))))
    return rows.groupBy("scope", "side", "block").agg(F.sort_array(F.collect_list(F.struct("at", "pos", *columns))).alias("rows"))


def _scopes(blocks: DataFrame, path: Path) -> DataFrame:
    """``scope``, n, m and band of the sequences that have rows on both sides."""
    count = lambda side: F.sum(F.when(F.col("side") == side, F.size("rows")).otherwise(0)).alias("n" if side == "a" else "m")
    sums = blocks.groupBy("scope").agg(count("a"), count("b")).where("n > 0 and m > 0")
    return sums.withColumn("band", path.band(F.col("m")))


def _crossed(scopes: DataFrame, tile: int) -> DataFrame:
    """All tiles (ti, tj) that a band crosses."""
    rows = scopes.withColumn("ti", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / tile).cast("int"))))
    step = F.col("m") / F.col("n")
    first = F.greatest(F.lit(1), F.floor(F.col("ti") * tile * step) - F.col("band"))
    last = F.least(F.col("m"), F.floor((F.least(F.col("n"), (F.col("ti") + 1) * tile) - 1) * step) + F.col("band"))
    rows = rows.withColumn("j0", F.floor((first - 1) / tile).cast("int")).withColumn("j1", F.floor((last - 1) / tile).cast("int"))
    return rows.where("j0 <= j1").withColumn("tj", F.explode(F.sequence("j0", "j1"))).drop("j0", "j1")


def _sides(tiles: DataFrame, blocks: DataFrame) -> DataFrame:
    """Tiles with the rows of both their blocks."""
    for side, key in (("a", "ti"), ("b", "tj")):
        tiles = tiles.join(large(blocks.where(F.col("side") == side).select("scope", F.col("block").alias(key), F.col("rows").alias(f"rows_{side}"))), ["scope", key])
    return tiles


def _bordered(tiles: DataFrame, before: dict[int, DataFrame], diagonal: int) -> DataFrame:
    """Tiles of one anti-diagonal with what the tiles above, beside and before the corner left: null where there are none."""
    for name, back, di, dj, part in (("top", 1, 1, 0, "bottom"), ("side", 1, 0, 1, "right"), ("corner", 2, 1, 1, "bottom")):
        value = F.element_at(part, -1) if name == "corner" else F.col(part)
        if diagonal - back in before:
            near = before[diagonal - back].select("scope", (F.col("ti") + di).alias("ti"), (F.col("tj") + dj).alias("tj"), value.alias(name))
            tiles = tiles.join(large(near), ["scope", "ti", "tj"], "left")
        else:
            tiles = tiles.withColumn(name, F.lit(None).cast("float" if name == "corner" else "array<float>"))
    return tiles


def _tile(row: dict, tile: int, blend: Blend, path: Path) -> tuple[pa.StructArray, pa.StructArray, np.ndarray, np.ndarray, np.ndarray]:
    """The blocks of a tile, their similarity, and the tile's sums and moves."""
    a, b = row["rows_a"].values, row["rows_b"].values
    i0, j0, n, m = (row[x].as_py() for x in ("ti", "tj", "n", "m"))
    i0, j0 = i0 * tile, j0 * tile
    sim = similarity(a, b, blend)
    floats = lambda x, size: np.full(size, NONE, np.float32) if not x.is_valid else x.values.to_numpy().astype(np.float32)
    edge_a, edge_b = _edge(path.skip_a, i0 + len(a)), _edge(path.skip_b, j0 + len(b))
    top = edge_b[j0 + 1 :] if i0 == 0 else floats(row["top"], len(b))
    left = edge_a[i0 + 1 :] if j0 == 0 else floats(row["side"], len(a))
    corner = edge_b[j0] if i0 == 0 else edge_a[i0] if j0 == 0 else np.float32(row["corner"].as_py() if row["corner"].is_valid else NONE)
    return a, b, sim, *fill(sim, i0, j0, n, m, row["band"].as_py(), path, np.concatenate(([corner], top)), left)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """One tile costs much more than its bytes tell, so tiles are dealt over all tasks by their keys."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "scope", *keys)


def _keys(df: DataFrame, by: By, kinds: dict[str, str]) -> DataFrame:
    """The columns of ``by`` again, in place of ``scope``."""
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in by)
    parsed = F.from_json("scope", StructType.fromDDL(schema)) if by else None
    return df.select(*(parsed[k].alias(k) for k in by), *(c for c in df.columns if c != "scope"))


def _back(scopes: DataFrame, longest: int, tile: int, borders: dict[int, DataFrame], step: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """What ``step`` leaves (scope, i, j where the way leaves a tile, pairs) of all tiles on the ways, one job for each
    anti-diagonal. A way that leaves a tile goes on in the next anti-diagonal or in that after it."""
    at = lambda c: F.floor((F.col(c) - 1) / tile).cast("int")
    done: dict[int, DataFrame] = {}
    for diagonal in range(longest, -1, -1):
        ways = scopes.select("scope", F.col("n").alias("i"), F.col("m").alias("j"))
        for before in (diagonal + 1, diagonal + 2):
            if before in done:
                ways = ways.unionByName(done[before].select("scope", "i", "j"))
        here = ways.where("i > 0 and j > 0").withColumn("ti", at("i")).withColumn("tj", at("j")).where(F.col("ti") + F.col("tj") == diagonal)
        done[diagonal] = stored(step(here.join(large(scopes), "scope"), diagonal))
        if diagonal in borders:
            spent(borders.pop(diagonal))
    steps = list(done.values())
    out = steps[0]
    for more in steps[1:]:
        out = out.unionByName(more)
    return out


def aligned(rows: DataFrame, by: By, blend: Blend, path: Path, tile: int = WIDE) -> DataFrame:
    """The best increasing alignment of both sides of each sequence pair: by, a_pos, b_pos, score.

    rows: side ('a' or 'b'), pos (unique in its side), and the columns that ``blend`` names, none of them null. A pair counts its
    similarity less ``path.match``; pairs below ``path.output`` are walked over but not returned. One side without rows
    gives nothing. Groups whose keys are null are groups too.
    """
    columns = [c for c in blend.columns() if c in rows.columns]
    blocks = stored(_packed(rows, by, columns, tile))
    scopes = stored(_scopes(blocks, path))
    longest = scopes.agg(F.max(F.floor((F.col("n") - 1) / tile) + F.floor((F.col("m") - 1) / tile))).first()[0]
    kinds = dict(rows.dtypes)
    if longest is None:
        return _keys(scopes.select("scope", F.lit(0).cast("long").alias("a_pos"), F.lit(0).cast("long").alias("b_pos"), F.lit(0.0).alias("score")), by, kinds)
    crossed = _crossed(scopes, tile)

    def forth(batches):
        for row in _each(batches):
            _, _, _, best, _ = _tile(row, tile, blend, path)
            values = [[row[x].as_py()] for x in ("scope", "ti", "tj")] + [[best[-1, 1:].copy()], [best[1:, -1].copy()]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float32()), pa.list_(pa.float32())), strict=True)], ["scope", "ti", "tj", "bottom", "right"])

    borders: dict[int, DataFrame] = {}
    inner = (F.col("ti") < F.floor((F.col("n") - 1) / tile)) | (F.col("tj") < F.floor((F.col("m") - 1) / tile))  # the last tile leaves nothing
    for diagonal in range(longest):
        now = crossed.where((F.col("ti") + F.col("tj") == diagonal) & inner)
        borders[diagonal] = stored(_dealt(_bordered(_sides(now, blocks), borders, diagonal), "ti", "tj").mapInArrow(forth, "scope string, ti int, tj int, bottom array<float>, right array<float>"))

    def back(batches):
        for row in _each(batches):
            i0, j0 = row["ti"].as_py() * tile, row["tj"].as_py() * tile
            i, j = row["i"].as_py() - i0, row["j"].as_py() - j0
            found = []
            if not row["crossed"].as_py():  # nothing of the band: up through it
                i = 0
            else:
                a, b, sim, _, move = _tile(row, tile, blend, path)
                small = sim.astype(np.float32)
                while i > 0 and j > 0:
                    how = move[i, j]
                    if how == 3 and small[i - 1, j - 1] >= np.float32(path.output):
                        found.append((a.field("pos")[i - 1].as_py(), b.field("pos")[j - 1].as_py(), float(sim[i - 1, j - 1])))
                    i, j = i - (how != 2), j - (how >= 2)
            pairs = pa.array([[{"a_pos": x, "b_pos": y, "score": z} for x, y, z in reversed(found)]], pa.list_(pa.struct([("a_pos", pa.int64()), ("b_pos", pa.int64()), ("score", pa.float64())])))
            yield pa.RecordBatch.from_arrays([pa.array([row["scope"].as_py()]), pa.array([i + i0], pa.int64()), pa.array([j + j0], pa.int64()), pairs], ["scope", "i", "j", "pairs"])

    def step(here: DataFrame, diagonal: int) -> DataFrame:
        here = here.join(large(crossed.select("scope", "ti", "tj", F.lit(True).alias("crossed"))), ["scope", "ti", "tj"], "left").withColumn("crossed", F.coalesce("crossed", F.lit(False)))
        here = _bordered(_sides(here, blocks), borders, diagonal)
        return _dealt(here, "ti", "tj").mapInArrow(back, "scope string, i long, j long, pairs array<struct<a_pos: long, b_pos: long, score: double>>")

    return _keys(_back(scopes, longest, tile, borders, step).select("scope", F.inline("pairs")), by, kinds)


def blended(rows: DataFrame, by: By, blend: Blend, path: Path, tile: int = TILE) -> DataFrame:
    """The similarity in long form: by, a_pos, b_pos, score for each cell inside the band, and for no other."""
    columns = [c for c in blend.columns() if c in rows.columns]
    blocks = stored(_packed(rows, by, columns, tile))
    tiles = _sides(_crossed(_scopes(blocks, path), tile), blocks)

    def cells(batches):
        for row in _each(batches):
            a, b = row["rows_a"].values, row["rows_b"].values
            sim = similarity(a, b, blend)
            centre = (a.field("at").to_numpy() * (row["m"].as_py() / row["n"].as_py())).astype(np.int64)
            inside = np.abs(b.field("at").to_numpy()[None, :] + 1 - centre[:, None]) <= row["band"].as_py()
            i, j = np.nonzero(inside)
            yield pa.RecordBatch.from_arrays([pa.array([row["scope"].as_py()] * len(i), pa.string()), a.field("pos").take(pa.array(i)), b.field("pos").take(pa.array(j)), pa.array(sim[i, j])], ["scope", "a_pos", "b_pos", "score"])

    return _keys(_dealt(tiles, "ti", "tj").mapInArrow(cells, "scope string, a_pos long, b_pos long, score double"), by, dict(rows.dtypes))


@dataclass(frozen=True)
class Grouping:
    """Groups of up to ``largest`` (of a, of b) neighbours that match as one; thresholds and costs as in ``Path``, the
    least product of vectors, and whether groups of different speakers are kept apart."""

    largest: tuple[int, int] = (3, 3)
    match: float = 0.60
    output: float = 0.68
    skip_a: float = 0.08
    skip_b: float = 0.05
    least: float = 0.50
    speakers: bool = False

    def sizes(self, n: int, m: int) -> list[tuple[int, int]]:
        """All sizes, the largest first: so they come first on equal sums."""
        return sorted(((p, q) for p in range(1, min(self.largest[0], n) + 1) for q in range(1, min(self.largest[1], m) + 1)), reverse=True)


Cues = tuple[np.ndarray, np.ndarray, np.ndarray]  # vectors, starts, ends


def group_scores(a: Cues, b: Cues, p: int, q: int, least: float, spans: tuple[float, float, float, float]) -> np.ndarray:
    """Scores of all groups of ``p`` cues from a with ``q`` from b, by first positions; NaN where they don't match.

    A group's vector is the direction of its cues' sum. Meaning counts .76, progress in ``spans`` (first start and last
    end of a, then of b) .16, durations .08, less .02 for each cue that one group has more. Times are in seconds. Sums
    are rounded to nine digits, so that a group has the same score in whatever tile it lies. Arrays may have an axis of
    tables before all others.
    """

    def grouped(x: Cues, k: int, lo: float, hi: float) -> tuple[np.ndarray, ...]:
        v, s, e = x
        n = s.shape[-1] - k + 1
        total = sum(v[..., i : n + i, :] for i in range(k))
        start, end = s[..., :n], e[..., k - 1 :]
        return total / np.maximum(np.linalg.norm(total, axis=-1, keepdims=True), 1e-12), ((start + end) / 2 - lo) / np.maximum(hi - lo, 1e-6), np.maximum(end - start, 0.25)

    (u, x, dx), (v, y, dy) = grouped(a, p, *spans[:2]), grouped(b, q, *spans[2:])
    meaning = u @ v.swapaxes(-1, -2)
    np.round(meaning, 9, out=meaning)
    near = np.abs(x[..., :, None] - y[..., None, :])
    near /= 0.26
    np.clip(np.subtract(1, near, out=near), 0, 1, out=near)
    score, near = 0.76 * meaning, np.multiply(0.16, near, out=near)
    score += near
    np.multiply(0.08, np.minimum(dx[..., :, None], dy[..., None, :], out=near), out=near)
    near /= np.maximum(dx[..., :, None], dy[..., None, :])
    score += near
    score -= 0.02 * abs(p - q)
    np.round(score, 9, out=score)
    score[~(meaning >= least)] = np.nan
    return score


def _fill_groups(gains: dict[tuple[int, int], np.ndarray], sums: np.ndarray, before: tuple[int, int], how: Grouping) -> np.ndarray:
    """Fills ``sums`` (by diagonals, borders given) of several tables at once and returns the moves as [i, j, k].

    ``gains``: of groups by the places of their first cues, by diagonals: their scores less ``how.match``, minus infinity for none.
    """
    x, y = before
    n, m = sums.shape[1], sums.shape[0] + 1 - sums.shape[1]
    moves, move = _by_diagonals(n, m, sums.shape[2], np.int8, -1)
    sizes = sorted(gains, reverse=True)
    for d in range(x + y, n + m - 1):
        lo, hi = max(x, d - m + 1), min(n - 1, d - y) + 1
        value, code = sums[d, lo:hi], moves[d, lo:hi]
        offers = [(name, max(lo, a), min(hi, d - b + 1), a, d - a - b, gains[a, b]) for name, (a, b) in enumerate(sizes)]
        new, better = np.empty(value.shape, np.float32), np.empty(value.shape, bool)
        for name, i, j, a, back, gain in offers:
            if i < j:
                at, to = slice(i - lo, j - lo), slice(i - a, j - a)
                np.add(sums[back, to], gain[back, to], out=new[at], casting="same_kind")
                np.greater(new[at], value[at], out=better[at])
                np.copyto(value[at], new[at], where=better[at])
                np.copyto(code[at], name, where=better[at])
        for name, near, cost in ((len(sizes), sums[d - 1, lo - 1 : hi - 1], how.skip_a), (len(sizes) + 1, sums[d - 1, lo:hi], how.skip_b)):
            np.subtract(near, np.float32(cost), out=new)
            np.greater(new, value, out=better)
            np.copyto(value, new, where=better)
            np.copyto(code, name, where=better)
    return move


def fill_groups(scores: dict[tuple[int, int], np.ndarray], shape: tuple[int, int], before: tuple[int, int], border: np.ndarray, how: Grouping) -> tuple[np.ndarray, np.ndarray]:
    """(sums, moves) of a tile of ``shape`` cells, the ``before`` rows and columns of ``border`` included.

    ``scores``: of groups by the places of their first cues, counted from the first cue that the tile's groups can begin
    with. Moves are places in the order of sizes, then a skip in a, then in b; an earlier one stays on equal sums.
    """
    sums, best = _by_diagonals(*border.shape, 1, np.float32, NONE)
    best[..., 0] = border
    gains = {}
    for size, score in scores.items():
        gains[size], gain = _by_diagonals(*score.shape, 1, np.float64)
        gain[..., 0] = np.where(np.isnan(score), -np.inf, score - how.match)
    return best[..., 0], _fill_groups(gains, sums, before, how)[..., 0]


def whole_border(n: int, m: int, how: Grouping) -> np.ndarray:
    """The border of a table that is one tile."""
    best = np.full((n + 1, m + 1), NONE, np.float32)
    best[0], best[:, 0] = _edge(how.skip_b, m), _edge(how.skip_a, n)
    return best


@dataclass
class _Table:
    """A tile's cues (with those before it that its groups can begin with, ``x`` of a and ``y`` of b), its sums, its moves, and
    the gains of groups by size."""

    row: dict
    a: pa.StructArray
    b: pa.StructArray
    x: int
    y: int
    best: np.ndarray
    move: np.ndarray
    gains: dict[tuple[int, int], np.ndarray]


def _border(best: np.ndarray, row: dict, tile: int, x: int, y: int, n: int, m: int, how: Grouping) -> None:
    """The border of a tile of n by m cues; row 0 stands before the first cue held."""
    i0, j0 = row["ti"].as_py() * tile, row["tj"].as_py() * tile
    if i0 == 0:
        best[0, :] = _edge(how.skip_b, j0 + m - y)[j0 - y :]
    elif row["top"].is_valid:
        best[: x + 1, y + 1 :] = np.array(row["top"].as_py(), np.float32)[-(x + 1) :]
    if j0 == 0:
        best[:, 0] = _edge(how.skip_a, i0 + n - x)[i0 - x :]
    elif row["side"].is_valid:
        best[x + 1 :, : y + 1] = np.array(row["side"].as_py(), np.float32)[:, -(y + 1) :]
    if i0 and j0 and row["corner"].is_valid:
        best[: x + 1, : y + 1] = np.array(row["corner"].as_py(), np.float32)[-(x + 1) :, -(y + 1) :]
    elif i0 == 0 and j0:
        best[0, : y + 1] = _edge(how.skip_b, j0)[j0 - y :]
    elif j0 == 0 and i0:
        best[: x + 1, 0] = _edge(how.skip_a, i0)[i0 - x :]


def _stacked(rows: list[dict], tile: int, how: Grouping) -> list[_Table]:
    """Tables of several tiles filled at once. Of more than one, all are the first of their sequences; the cells beyond the
    shorter ones' ends are filled too, but no other cell looks there."""
    sides = [(r["rows_a"].values, r["rows_b"].values) for r in rows]
    n, m = (max(len(s[k]) for s in sides) for k in (0, 1))

    def cues(k: int, size: int) -> Cues:
        first = _vectors(sides[0][k].field("vector"))
        v, s, e = np.zeros((len(rows), size, first.shape[1])), np.zeros((len(rows), size)), np.zeros((len(rows), size))
        for i, side in enumerate(x[k] for x in sides):
            v[i, : len(side)] = _vectors(side.field("vector")) if i else first
            s[i, : len(side)], e[i, : len(side)] = side.field("s").to_numpy(), side.field("e").to_numpy()
        return v, s, e

    (va, sa, ea), two = cues(0, n), cues(1, m)
    spans = tuple(np.array([[r[c].as_py()] for r in rows]) for c in ("a0", "a1", "b0", "b1"))
    x, y = (rows[0][c].as_py() * tile - sides[0][k].field("at")[0].as_py() for k, c in ((0, "ti"), (1, "tj")))  # cues of the blocks before
    sums, best = _by_diagonals(n + 1, m + 1, len(rows), np.float32, NONE)
    for k, (row, (a, b)) in enumerate(zip(rows, sides, strict=True)):
        _border(best[: len(a) + 1, : len(b) + 1, k], row, tile, x, y, len(a), len(b), how)
    made = {}
    for p, q in how.sizes(n, m):
        made[p, q] = _by_diagonals(n - p + 1, m - q + 1, len(rows), np.float64)
        step = max(1, STRIP // (len(rows) * m))
        for i in range(0, n - p + 1, step):
            j = i + step + p - 1
            score = group_scores((va[:, i:j], sa[:, i:j], ea[:, i:j]), two, p, q, how.least, spans) - how.match
            score[np.isnan(score)] = -np.inf
            made[p, q][1][i : i + step] = np.moveaxis(score, 0, -1)
    if how.speakers:
        for k, (a, b) in enumerate(sides):
            names, name = [v or [] for v in a.field("names").to_pylist()], b.field("name").to_pylist()
            for p in {p for p, _ in made if p <= len(a)}:
                apart = _strangers([sum(names[i : i + p], []) for i in range(len(a) - p + 1)], name)
                for q in {q for _, q in made if q <= len(b)}:
                    made[p, q][1][: len(a) - p + 1, : len(b) - q + 1, k][apart[:, : len(b) - q + 1]] = -np.inf
    move = _fill_groups({size: by for size, (by, _) in made.items()}, sums, (x + 1, y + 1), how)
    own = lambda table, k: table[: len(sides[k][0]) + 1, : len(sides[k][1]) + 1, k]
    return [_Table(row, *sides[k], x, y, own(best, k), own(move, k), {size: gain[..., k] for size, (_, gain) in made.items()}) for k, row in enumerate(rows)]


def _tables(batches: Iterator[pa.RecordBatch], tile: int, how: Grouping) -> Iterator[list[_Table]]:
    """The tables of all tiles. Of a batch, short sequences of like lengths are filled together, up to ``TOGETHER`` cells."""
    for batch in batches:
        first, size = [], lambda r: (len(r["rows_a"]), len(r["rows_b"]))
        for row in _each([batch]):
            if row["ti"].as_py() or row["tj"].as_py():
                yield _stacked([row], tile, how)
            else:
                first.append((*size(row), row))
        stack, widest = [], 0
        for n, m, row in sorted(first, key=lambda r: r[:2], reverse=True):
            wide = max(widest, m)
            if stack and ((len(stack) + 1) * most * (most + wide) > TOGETHER or 2 * n < most or 2 * min(m, narrow) < wide):
                yield _stacked(stack, tile, how)
                stack = []
            if not stack:
                most, wide, narrow = n, m, m
            stack.append(row)
            widest, narrow = wide, min(narrow, m)
        if stack:
            yield _stacked(stack, tile, how)


def _way(t: _Table, how: Grouping, i: int, j: int) -> tuple[int, int, list[dict]]:
    """Where the way from (i, j) leaves a table, and the groups on it that are returned, in order."""
    sizes, found = sorted(t.gains, reverse=True), []
    a, b = t.a.field("pos").to_pylist(), t.b.field("pos").to_pylist()
    while i > t.x and j > t.y:
        code = t.move[i, j]
        if code == len(sizes):
            i -= 1
        elif code == len(sizes) + 1:
            j -= 1
        else:
            p, q = sizes[code]
            i, j = i - p, j - q
            score = float(np.round(t.gains[p, q][i, j] + how.match, 9))
            if score >= how.output:
                found.append({"a_pos": a[i : i + p], "b_pos": b[j : j + q], "alignment": f"{p}:{q}", "score": score})
    return i, j, found[::-1]


def grouped(rows: DataFrame, by: By, how: Grouping, tile: int = GROUPS) -> DataFrame:
    """The best increasing alignment of groups of neighbours: by, a_pos, b_pos (arrays), alignment ('2:1') and score.

    rows: side, pos, s, e (seconds), vector, and names and name if speakers count. Tiles are those of ``aligned``, without a
    band; a tile holds as many cues and sums of the tiles before it as a group can reach back, and leaves as many.
    """
    reach = how.largest
    columns = ["s", "e", "vector", *(["names", "name"] if how.speakers else [])]
    blocks = stored(_packed(rows, by, columns, tile, {"a": reach[0] - 1, "b": reach[1] - 1}))
    own = F.filter("rows", lambda x: F.floor(x["at"] / tile) == F.col("block"))
    ends = blocks.where(F.size(own) > 0).groupBy("scope", "side").agg(F.sum(F.size(own)).alias("n"), F.min_by(own[0]["s"], "block").alias("first"), F.max_by(F.element_at(own, -1)["e"], "block").alias("last"))
    side = lambda x, n: ends.where(F.col("side") == x).select("scope", F.col("n").alias(n), F.col("first").cast("double").alias(f"{x}0"), F.col("last").cast("double").alias(f"{x}1"))
    scopes = stored(side("a", "n").join(large(side("b", "m")), "scope"))
    last = lambda c: F.floor((F.col(c) - 1) / tile).cast("int")
    longest = scopes.agg(F.max(last("n") + last("m"))).first()[0]
    kinds = dict(rows.dtypes)
    shape = "a_pos array<long>, b_pos array<long>, alignment string, score double"
    if longest is None:
        return _keys(scopes.select("scope", F.array().cast("array<long>").alias("a_pos"), F.array().cast("array<long>").alias("b_pos"), F.lit("").alias("alignment"), F.lit(0.0).alias("score")), by, kinds)
    floats = pa.list_(pa.list_(pa.float32()))
    borders: dict[int, DataFrame] = {}

    def bordered(tiles: DataFrame, diagonal: int) -> DataFrame:
        for name, back, di, dj, part in (("top", 1, 1, 0, "bottom"), ("side", 1, 0, 1, "right"), ("corner", 2, 1, 1, "edge")):
            if diagonal - back in borders:
                near = borders[diagonal - back].select("scope", (F.col("ti") + di).alias("ti"), (F.col("tj") + dj).alias("tj"), F.col(part).alias(name))
                tiles = tiles.join(large(near), ["scope", "ti", "tj"], "left")
            else:
                tiles = tiles.withColumn(name, F.lit(None).cast("array<array<float>>"))
        return tiles

    def forth(batches):
        for t in (t for stack in _tables(batches, tile, how) for t in stack):
            bottom, right, edge = t.best[-reach[0] :, t.y + 1 :], t.best[t.x + 1 :, -reach[1] :], t.best[-reach[0] :, -reach[1] :]
            values = [[t.row[c].as_py()] for c in ("scope", "ti", "tj")] + [[v.tolist()] for v in (bottom, right, edge)]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.string(), pa.int32(), pa.int32(), floats, floats, floats), strict=True)], ["scope", "ti", "tj", "bottom", "right", "edge"])

    for diagonal in range(longest):
        now = scopes.withColumn("ti", F.explode(F.sequence(F.lit(0), last("n")))).withColumn("tj", F.lit(diagonal) - F.col("ti"))
        now = now.where(F.col("tj").between(F.lit(0), last("m")) & ((F.col("ti") < last("n")) | (F.col("tj") < last("m"))))
        borders[diagonal] = stored(_dealt(bordered(_sides(now, blocks), diagonal), "ti", "tj").mapInArrow(forth, "scope string, ti int, tj int, bottom array<array<float>>, right array<array<float>>, edge array<array<float>>"))

    def back(batches):
        kind = pa.list_(pa.struct([("a_pos", pa.list_(pa.int64())), ("b_pos", pa.list_(pa.int64())), ("alignment", pa.string()), ("score", pa.float64())]))
        for stack in _tables(batches, tile, how):
            out = []
            for t in stack:
                row, di, dj = t.row, t.row["ti"].as_py() * tile - t.x, t.row["tj"].as_py() * tile - t.y
                i, j, found = _way(t, how, row["i"].as_py() - di, row["j"].as_py() - dj)
                out.append((row["scope"].as_py(), i + di, j + dj, found))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(map(list, zip(*out, strict=True)), (pa.string(), pa.int64(), pa.int64(), kind), strict=True)], ["scope", "i", "j", "pairs"])

    def step(here: DataFrame, diagonal: int) -> DataFrame:
        here = bordered(_sides(here, blocks), diagonal)
        return _dealt(here, "ti", "tj").mapInArrow(back, f"scope string, i long, j long, pairs array<struct<{', '.join(f.replace(' ', ': ', 1) for f in shape.split(', '))}>>")

    steps = _back(scopes, longest, tile, borders, step)
    return _keys(steps.select("scope", F.inline("pairs")), by, kinds)
