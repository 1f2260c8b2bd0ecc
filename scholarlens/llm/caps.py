"""Near copies among embeddings by spherical-cap filters.

A filter is a direction; a vector falls into it if their cosine reaches a height, that is, if it
lies in the filter's cap. Directions are not stored: each is a product of one short codeword per
block of coordinates, from a seeded codebook after a seeded rotation, and a vector is
list-decoded to all directions that it exceeds by adding up block scores, dropping partial codes
that cannot get there any more. Two vectors close to each other share a filter with a chance that follows
from the height, so the number of filters is set for a wanted mean number of shared ones. The
height follows the number of vectors, so that a filter holds about the same number at any size.

Vectors are joined on filters and verified there in double precision, in tiles of bounded size; a
pair counts in the least filter it shares. A filter with too many vectors is thinned out first:
all vectors within half the linking angle of its first vector are linked with each other by the
triangle inequality, so inside such a ball nothing is compared, and its members only meet others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarlens.llm.nearness import _components as components
from scholarlens.session import written

THRESHOLD = 0.95
#: Codebooks, and blocks of coordinates in each.
CODES = 16
BLOCKS = 2
#: Filters that two vectors exactly at the threshold share on average.
SHARED = 9.0
#: Vectors that lie in a filter by chance, on average.
OCCUPANCY = 512
#: Vectors on one side of a tile.
ROWS = 2048
#: Vectors decoded together.
DECODED = 256
#: Room for rounding in what the triangle inequality decides.
SLACK = 1e-9
LEAST_DIMENSION = 8
_STEPS = 4000


def width_of(dimension: int) -> int:
    """The power of two that a vector is filled up to with zeros."""
    return max(LEAST_DIMENSION, 1 << (dimension - 1).bit_length())


def plan(width: int, n: int, cosine: float, occupancy: float = OCCUPANCY,
         shared: float = SHARED, codes: int = CODES) -> tuple[float, int]:
    """Height of the caps, and codewords per block, for ``n`` vectors.

    A cap takes ``occupancy`` of ``n`` evenly spread vectors, a quarter of the sphere at most.
    The chance that two vectors at ``cosine`` share it is integrated over the first one's height.
    """
    u = np.linspace(-1, 1, _STEPS + 1)
    inside = np.maximum(1 - u * u, 1e-300)
    first, second = inside ** ((width - 3) / 2), inside ** ((width - 4) / 2)
    first, second = first / first.sum(), np.append(np.cumsum((second / second.sum())[::-1])[::-1], 0)
    above = np.cumsum(first[::-1])[::-1]
    i = int(np.searchsorted(-above, -min(0.25, occupancy / max(n, 1)), side="right")) - 1
    lift = math.sqrt(1 - cosine * cosine) * np.sqrt(np.maximum(inside[i:], 1e-12))
    both = (first[i:] * second[np.clip(np.searchsorted(
        u, (u[i] - cosine * u[i:]) / lift), 0, _STEPS + 1)]).sum()
    return float(u[i]), math.ceil((shared / both / codes) ** (1 / BLOCKS))


def _hadamard(n: int) -> np.ndarray:
    return np.ones((1, 1)) if n == 1 else np.kron(np.array([[1.0, 1.0], [1.0, -1.0]]), _hadamard(n // 2))


class Filters:
    """All filters of one dimension, drawn from a seed that the dimension gives."""

    def __init__(self, dimension: int, height: float, words: int, codes: int = CODES):
        self.width, self.height, self.words, self.codes = width_of(dimension), height, words, codes
        rng = np.random.default_rng([dimension, codes])
        self.signs = rng.choice([-1.0, 1.0], (codes, 2, self.width))
        side = 1 << (self.width.bit_length() - 1) // 2
        self.shape = (side, self.width // side)
        self.hadamard = [_hadamard(n) / math.sqrt(n) for n in self.shape]
        self.books = rng.standard_normal((codes, BLOCKS, self.width // BLOCKS, words))
        self.books /= np.linalg.norm(self.books, axis=2, keepdims=True) * math.sqrt(BLOCKS)

    def _rotated(self, x: np.ndarray, signs: np.ndarray) -> np.ndarray:
        """Rounds of random signs and a Hadamard transform, as a product of two small ones."""
        for s in signs:
            x = (self.hadamard[0] @ (x * s).reshape(len(x), *self.shape) @ self.hadamard[1]).reshape(
                len(x), self.width)
        return x

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and number of every filter that a row of unit vectors exceeds, in order."""
        x = np.pad(x, ((0, 0), (0, self.width - x.shape[1])))
        rows, found = [], []
        for code in range(self.codes):
            blocks = self._rotated(x, self.signs[code]).reshape(len(x), BLOCKS, -1)
            scores = [blocks[:, b] @ self.books[code, b] for b in range(BLOCKS)]
            rest = np.cumsum([s.max(1) for s in scores[::-1]], axis=0)[::-1]
            row, total = np.arange(len(x)), np.zeros(len(x))
            number = np.full(len(x), code, np.int64)
            for b, score in enumerate(scores):
                every = total[:, None] + score[row]
                after = rest[b + 1][row] if b + 1 < BLOCKS else np.zeros(len(row))
                at, word = np.nonzero(every + after[:, None] >= self.height)
                row, total, number = row[at], every[at, word], number[at] * self.words + word
            rows.append(row)
            found.append(number)
        row, number = np.concatenate(rows), np.concatenate(found)
        order = np.lexsort((number, row))
        return row[order], number[order]


def _units(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packer(kind: str):
    """Bytes of each vector that can be linked; null for the others."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(2):
                values = x.values
                whole = values is not None and len(values) and not values.null_count
                x = values.to_numpy(zero_copy_only=False).astype(kind) if whole else np.zeros(0, kind)
                out.append(x.tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["row", "key", "v"])
    return pack


def _decoder(plans: dict[int, tuple[float, int]], kind: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {}
        for batch in batches:
            nodes, raw, weight = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
            sizes = np.array([len(v) for v in raw])
            for size in np.unique(sizes):
                if size not in filters:
                    d = int(size) // np.dtype(kind).itemsize
                    filters[size] = Filters(d, *plans[d])
                mine = np.flatnonzero(sizes == size)
                for i in range(0, len(mine), DECODED):
                    part = mine[i:i + DECODED]
                    row, number = filters[size].decode(_units([raw[k] for k in part], kind))
                    at = np.searchsorted(row, np.arange(len(part) + 1))
                    lists = [number[a:b].tobytes() for a, b in zip(at, at[1:])]
                    take = pa.array(part[row])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(row), size, np.int32)), pa.array(number), nodes.take(take),
                        weight.take(take), pa.array([raw[k] for k in part[row]], pa.binary()),
                        pa.array([lists[k] for k in row], pa.binary())],
                        ["size", "filter", "node", "weight", "v", "filters"])
    return decode


def _within(kind: str, least: float):
    """Rows whose vector is in the ball around the first vector of their filter."""
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            sizes = np.array([len(x) for x in a])
            cosine = np.zeros(len(a))
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                cosine[at] = (_units([a[i] for i in at], kind) * _units([b[i] for i in at], kind)).sum(1)
            keep = pa.array(cosine >= least)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(keep), batch.column(1).filter(keep)], ["node", "ball"])
    return near


def _met_before(lists: list[bytes], filter_: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether rows ``left`` and ``right`` share a filter of smaller number."""
    sets = [x[x < filter_] for x in (np.frombuffer(v, np.int64) for v in lists)]
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    names, column = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]), return_inverse=True)
    common = np.flatnonzero(np.bincount(column, minlength=len(names)) > 1)
    met = np.zeros((len(left), len(right)), bool)
    for i in range(0, len(common), ROWS):
        place = np.full(len(names), -1)
        place[common[i:i + ROWS]] = np.arange(len(common[i:i + ROWS]))
        mine = place[column] >= 0
        held = np.zeros((len(sets), len(common[i:i + ROWS])), np.float32)
        held[owner[mine], place[column[mine]]] = 1
        met |= held[left] @ held[right].T > 0
    return met


def _tile(rows: list[tuple], kind: str, threshold: float) -> pa.RecordBatch:
    """Links of a tile: per vector the weight of its partners, and the least vector it leads to."""
    side = np.array([r[0] for r in rows])
    node, weight = (np.array([r[i] for r in rows], np.int64) for i in (1, 2))
    unit = _units([r[3] for r in rows], kind)
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() or rows[0][6] else left
    linked = unit[left] @ unit[right].T >= threshold
    if right is left:
        np.fill_diagonal(linked, False)
    left, right, linked = (left[r := linked.any(1)], right[c := linked.any(0)], linked[np.ix_(r, c)])
    counted = linked & ~_met_before([r[4] for r in rows], rows[0][5], left, right) if len(left) else linked
    gain = np.zeros(len(rows), np.int64)
    np.add.at(gain, left, counted @ weight[right])
    if side.any() or rows[0][6]:
        np.add.at(gain, right, counted.T @ weight[left])
    # the least number spreads along links until it rests
    lead, old = node.copy(), None
    while old is None or (lead != old).any():
        old = lead.copy()
        if len(left):
            big = np.iinfo(np.int64).max
            np.minimum.at(lead, left, np.where(linked, lead[right], big).min(1))
            np.minimum.at(lead, right, np.where(linked, lead[left][:, None], big).min(0))
    some = np.unique(np.concatenate([left, right]))
    return pa.RecordBatch.from_arrays(
        [pa.array(node[some]), pa.array(gain[some]), pa.array(lead[some])], ["node", "gain", "lead"])


def _verifier(kind: str, threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows = None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for tile_, side, node, weight, v, filters, filter_, crossed in zip(*columns):
                if tile_ != tile:
                    if len(rows) > 1:
                        yield _tile(rows, kind, threshold)
                    tile, rows = tile_, []
                rows.append((side, node, weight, v, filters, filter_, crossed))
        if len(rows) > 1:
            yield _tile(rows, kind, threshold)
    return verify


def _balls(filed: DataFrame, hot: DataFrame, kind: str, threshold: float) -> DataFrame:
    """(node, ball) for vectors in large balls: any two of a ball are linked."""
    crowded = filed.join(hot.select("size", "filter"), ["size", "filter"], "left_semi")
    first = crowded.groupBy("size", "filter").agg(F.min(F.struct("node", "v")).alias("m")).select(
        "size", "filter", F.col("m.node").alias("ball"), F.col("m.v").alias("center"))
    half = math.cos(math.acos(threshold) / 2) + SLACK
    near = crowded.join(first, ["size", "filter"]).select("node", "ball", "v", "center").mapInArrow(
        _within(kind, half), "node long, ball long")
    member = written(near.groupBy("node").agg(F.min("ball").alias("ball")), "members")
    large = member.groupBy("ball").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= ROWS // 8)
    return member.join(large.select("ball"), "ball", "left_semi").select("node", "ball")


def _tiles(filed: DataFrame, hot: DataFrame, balls: DataFrame) -> DataFrame:
    """Vectors of each tile. A filter of usual size is one tile.

    In a crowded one, each ball and the vectors outside of balls are groups cut into blocks. Two
    blocks are a tile, except of the same ball.
    """
    placed = filed.join(balls, "node", "left").withColumn("ball", F.coalesce("ball", F.lit(-1).cast("long")))
    key = ["size", "filter"]
    groups = placed.join(hot.select(*key), key, "left_semi").groupBy(*key, "ball").agg(
        F.ceil(F.count(F.lit(1)) / ROWS).alias("k"))
    groups = written(groups, "groups")
    others = groups.select(*key, F.col("ball").alias("other"), F.col("k").alias("k_other"))
    meet = groups.join(others, key).where("ball <> other or ball = -1")
    met = placed.join(meet, [*key, "ball"], "left")
    alone = placed.join(hot.select(*key), key, "left_anti").select(
        *key, "node", "weight", "v", "filters", F.lit(0).alias("side"), F.lit(False).alias("crossed"),
        *[F.lit(-1).cast("long").alias(c) for c in ("low", "high")],
        *[F.lit(0).cast("long").alias(c) for c in ("i", "j")])
    mine = F.pmod(F.xxhash64("node"), F.col("k"))
    spread = met.where("k is not null").select("*", mine.alias("x"), F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("k_other") - 1)).alias("y"))
    same = F.col("ball") == F.col("other")
    first = F.when(same, F.col("x") <= F.col("y")).otherwise(F.col("ball") < F.col("other"))
    both = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    dealt = spread.select(
        *key, "node", "weight", "v", "filters", F.when(first, 0).otherwise(1).alias("side"),
        (~same | (F.col("x") != F.col("y"))).alias("crossed"), both("ball", "other").alias("low"),
        both("other", "ball").alias("high"), both("x", "y").alias("i"), both("y", "x").alias("j"))
    return alone.unionByName(dealt)


def linked(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
           keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: struct ``row``, ``n_links``, ``component_id`` and ``kept``.

    ``n_links`` is the number of other rows whose vector has a cosine of ``threshold`` or more
    with this one, equal vectors included; ``component_id`` the least key that links lead to,
    null keys last; ``kept`` whether that is the row's own key. A pair exactly at the threshold
    is found with a chance of some 0.98 or more, pairs above it more surely, none below it is. A
    vector that is null, empty or zero, or holds a null or an infinite or undefined number, is
    linked with nothing, and vectors of different length are not linked. Repeated rows are
    linked as equal vectors. An empty table gives no rows; columns of any name stay in ``row``.
    """
    keep = vectors.columns if keep is None else keep
    exact = vectors.schema[vector].dataType.simpleString() == "array<float>"
    kind = "<f4" if exact else "<f8"
    plain = vectors.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col(key).cast("long").alias("key"),
                           F.col(vector).cast("array<float>" if exact else "array<double>").alias("v"))
    packed = written(plain.mapInArrow(
        _packer(kind), f"row {plain.schema['row'].dataType.simpleString()}, key long, v binary"), "packed")
    nodes = written(packed.where("v is not null").groupBy("v").agg(
        F.count(F.lit(1)).alias("weight"), F.min("key").alias("key")).select(
        F.monotonically_increasing_id().alias("node"), "*"), "nodes")
    # one row per length of vector
    counts = nodes.groupBy(F.length("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()
    bytes_each = np.dtype(kind).itemsize
    plans = {r["size"] // bytes_each: plan(width_of(r["size"] // bytes_each), r["n"], threshold) for r in counts}
    filed = written(nodes.select("node", "v", "weight").mapInArrow(
        _decoder(plans, kind), "size int, filter long, node long, weight long, v binary, filters binary"), "filed")
    hot = written(filed.groupBy("size", "filter").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") > ROWS), "hot")
    balls = written(_balls(filed, hot, kind, threshold), "balls")
    tile = F.struct("size", "filter", "low", "high", "i", "j")
    tiles = _tiles(filed, hot, balls).select(tile.alias("tile"), "side", "node", "weight", "v", "filters",
                                             "filter", "crossed")
    found = written(tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(
        _verifier(kind, threshold), "node long, gain long, lead long"), "found")
    inside = balls.join(nodes.select("node", "weight"), "node").groupBy("ball").agg(
        F.sum("weight").alias("all"), F.min("node").alias("lead"))
    in_ball = balls.join(inside, "ball").join(nodes.select("node", "weight"), "node").select(
        "node", (F.col("all") - F.col("weight")).alias("gain"), "lead")
    every = found.unionByName(in_ball)
    gains = every.groupBy("node").agg(F.sum("gain").alias("gain"))
    edges = written(every.where("node <> lead").select(
        F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "edges")
    roots = components(edges).toDF("node", "root")
    told = written(nodes.join(gains, "node", "left").join(roots, "node", "left").select(
        "v", "key", F.coalesce("root", "node").alias("root"),
        (F.col("weight") - 1 + F.coalesce("gain", F.lit(0))).alias("n_links")), "told")
    least = told.groupBy("root").agg(F.min("key").alias("component_id"))
    out = packed.join(told.join(least, "root").select("v", "n_links", "component_id"), "v", "left")
    component: Column = F.when(F.col("v").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return out.select("row", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                      component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))
