"""Similarity join on word shingles with a forest of MinHash signatures.

Texts with the same set of shingles are one class of copies and go on as one. A signature is cut
into trees; in each tree the classes are the leaves of a prefix trie of their hash values, and
classes below one node are candidates of each other. The prefix is shortened from the full depth
until a pair at the threshold meets in some tree with at least the target probability. This
depth follows from threshold, trees and target alone and is the same for all classes: a longer
prefix for some of them would lose pairs at the threshold, a shorter one adds none that the
target asks for. So a tree is kept as one key per class, the node it lies under.

Candidates are never written as pairs. Classes that share nodes, directly or over a few others,
get one home and are laid into the blocks that this home fills; blocks that meet under a node
make a tile. A tile finds its candidates by their keys and verifies them exactly on their
shingles (64-bit hashes of five words). It returns one row per class: the number of rows it links
to and the least class that its links within the tile reach.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarlens.llm.common import WORD, text_of
from scholarlens.llm.decontaminate import lowered
from scholarlens.session import written

SHINGLE = 5
THRESHOLD = 0.8
TREES = 32
DEEPEST = 12
#: Chance that a pair exactly at the threshold becomes a candidate.
TARGET_RECALL = 0.9999
#: Shingles a block of classes holds on average; a tile holds two blocks.
BLOCK_SHINGLES = 1_000_000
#: What a class counts beside its shingles, so that a block of short texts has few classes too.
CLASS_SHINGLES = 200
#: Rounds in which a class takes over the least home of the classes it shares a node with.
HOME_ROUNDS = 4
#: Shingles whose signature is computed at once.
CHUNK = 4096
WORDS = re.compile(WORD)
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x + np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


def shingles_of(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words, A-Z lower-cased.

    A text of fewer words is one shingle, a text without words has none.
    """
    words = WORDS.findall(lowered(text))
    n = min(size, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    ids = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    runs = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        runs = mixed(runs * np.uint64(31) + ids[i:len(words) - n + 1 + i])
    return np.unique(runs)


def recall(similarity: float, depth: int, trees: int) -> float:
    return 1 - (1 - similarity ** depth) ** trees


def depth_for(similarity: float, trees: int, deepest: int, target: float) -> int:
    """The longest prefix that meets the target, shortening from the full depth."""
    depth = deepest
    while depth > 1 and recall(similarity, depth, trees) < target:
        depth -= 1
    return depth


def prefixes(shingles: np.ndarray, depth: int, trees: int) -> np.ndarray:
    """Per tree, the first ``depth`` values of its part of the signature as one number."""
    seeds = np.random.default_rng(1).integers(0, 2 ** 63, (trees * depth, 1), np.uint64)
    least = np.full(trees * depth, 2 ** 64 - 1, np.uint64)
    for at in range(0, len(shingles), CHUNK):
        part = shingles[at:at + CHUNK] ^ seeds
        least = np.minimum(least, (part * np.uint64(MIX[1]) ^ (part >> np.uint64(29))).min(1))
    key = np.arange(trees, dtype=np.uint64)
    for column in least.reshape(trees, depth).T:
        key = mixed(key ^ column)
    return key.view(np.int64)


def _features(body: int | None, depth: int, trees: int, size: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            texts = row.field("text") if body is None else row.field("kept").field(body)
            sets, sizes, keys = [], [], []
            for text in texts:
                found = shingles_of(text.as_py() or "", size)
                sets.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                            if len(found) else None)
                sizes.append(len(found))
                keys.append(prefixes(found, depth, trees) if len(found) else [])
            yield pa.RecordBatch.from_arrays([
                row, pa.array(sets, pa.binary()), pa.array(sizes, pa.int32()),
                pa.array(keys, pa.list_(pa.int64()))], ["row", "set_id", "n", "keys"])
    return add


def _verify(threshold: float, size: int):
    def verify(tile: pa.Table) -> pa.Table:
        """Per linked class of a tile: the rows it links to, and the first class it reaches."""
        tile = tile.sort_by("block")
        ids, blocks = tile["set_id"], tile["block"].to_numpy()
        copies, m = tile["copies"].to_numpy(), len(blocks)
        keys = tile["keys"].combine_chunks().flatten().to_numpy().reshape(m, -1)
        sets = [shingles_of(t.as_py() or "", size) for t in tile["text"]]
        sizes = np.array([len(x) for x in sets])
        values, flat = np.unique(np.concatenate(sets), return_inverse=True)
        sets = np.split(flat, np.cumsum(sizes)[:-1])
        here, linked, root = np.zeros(len(values), np.uint8), np.zeros(m, np.int64), np.arange(m)
        cut = int(np.searchsorted(blocks, blocks[-1]))  # 0 where a block meets itself
        for i in range(cut or m):
            at = cut or i + 1
            near = (keys[at:] == keys[i]).any(1)
            near &= np.minimum(sizes[at:], sizes[i]) >= threshold * np.maximum(sizes[at:], sizes[i]) - 1e-9
            near = at + np.flatnonzero(near)
            if not len(near):
                continue
            here[sets[i]] = 1
            starts = np.cumsum(sizes[near]) - sizes[near]
            common = np.add.reduceat(here[np.concatenate([sets[j] for j in near])], starts, dtype=np.int64)
            here[sets[i]] = 0
            alike = near[common >= threshold * (sizes[i] + sizes[near] - common) - 1e-9]
            if len(alike):
                linked[i] += copies[alike].sum()
                linked[alike] += copies[i]
                met = np.unique(np.append(root[alike], root[i]))
                root[np.isin(root, met)] = met[0]
        out = np.flatnonzero(linked)
        return pa.table({"a": ids.take(pa.array(out)), "b": ids.take(pa.array(root[out])),
                         "linked": pa.array(linked[out])})
    return verify


def _links(classes: DataFrame, texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """(a, b, linked) per tile and linked class: a class it reaches, maybe itself, and its rows."""
    keys = classes.select("set_id", F.explode("keys").alias("k"))
    nodes = keys.groupBy("k").agg(F.min("set_id").alias("home"), F.count(F.lit(1)).alias("met"))
    shared = written(keys.join(nodes.where("met > 1").select("k", "home"), "k"), "shared")
    homes = written(shared.groupBy("set_id").agg(F.min("home").alias("home")), "homes")
    for _ in range(HOME_ROUNDS - 1):  # a loose group would else have many small homes that all meet
        least = shared.select("set_id", "k").join(homes, "set_id").groupBy("k").agg(
            F.min("home").alias("home"))
        homes = written(shared.select("set_id", "k").join(least, "k").groupBy("set_id").agg(
            F.min("home").alias("home")), "homes")
    homes = homes.join(classes, "set_id")
    room = homes.groupBy(F.col("home").alias("h")).agg(
        F.ceil(F.sum(F.col("n") + CLASS_SHINGLES) / BLOCK_SHINGLES).alias("blocks"))
    placed = written(homes.join(room, F.col("home") == F.col("h")).select(
        "set_id", "ticket", "copies", "keys", F.xxhash64(
            "home", F.pmod(F.xxhash64("set_id"), F.col("blocks"))).alias("block")), "blocks")
    # the blocks under a node; it has as many as its classes fill
    under = shared.join(placed.select("set_id", "block"), "set_id").groupBy("k", "block").agg(
        F.count(F.lit(1)).alias("met"))
    low = under.select("k", F.col("block").alias("low"), "met")
    high = under.select(F.col("k").alias("k2"), F.col("block").alias("high"))
    tiles = written(low.join(high, (F.col("k") == F.col("k2")) & (F.col("low") <= F.col("high"))).where(
        "low < high or met > 1").select("low", "high").distinct(), "tiles")
    sides = tiles.select("low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
    members = sides.join(placed.join(texts, "ticket"), "block").select(
        "low", "high", "set_id", "block", "copies", "keys", "text")
    return written(members.groupBy("low", "high").applyInArrow(
        _verify(threshold, size), "a binary, b binary, linked long"), "links")


def _components(links: DataFrame) -> DataFrame:
    """(set_id, root) of all linked classes, by contracting every class into a neighbour.

    Neighbours are chosen by a fresh random order each round, so long chains shrink by a
    constant factor a round. Every round is written; the loop ends when no link is left.
    """
    edges, roots, turn = links, None, 0
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c, t=turn: F.struct(F.xxhash64(F.lit(t), F.col(c)).alias("r"), F.col(c).alias("v"))
        # a class points to its first neighbour or stays; pointers never form a ring
        step = written(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(
            F.col("a").alias("node"), F.least(rank("a"), F.col("m"))["v"].alias("to")), "step")
        if roots is None:
            roots = step.select(F.col("node").alias("set_id"), F.col("to").alias("root"))
        else:
            roots = written(roots.join(step, F.col("root") == F.col("node"), "left").select(
                "set_id", F.coalesce("to", "root").alias("root")), "roots")
        to = lambda c: step.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))
        edges = written(edges.join(to("a"), "a").join(to("b"), "b").where("a_to <> b_to").select(
            F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(),
            "edges")
        turn += 1
    return roots if roots is not None else links.select(F.col("a").alias("set_id"), F.col("b").alias("root"))


def _joined(docs: DataFrame, key: str, text: str, keep: list[str] | None, threshold: float, size: int,
            trees: int, deepest: int, target: float) -> tuple[DataFrame, DataFrame]:
    """Rows with their set of shingles, and per set its root, first row and number of links."""
    keep = docs.columns if keep is None else keep
    depth = depth_for(threshold, trees, deepest, target)
    # a text that is kept anyway is carried once
    body = keep.index(text) if text in keep and dict(docs.dtypes)[text] == "string" else None
    parts: list[Column] = [F.struct(*[F.col(c) for c in keep]).alias("kept"),
                           F.col(key).cast("long").alias("key")]
    parts += [text_of(text).alias("text")] if body is None else []
    plain = docs.select(F.struct(*parts).alias("row"))
    kind = f"row {plain.schema['row'].dataType.simpleString()}, set_id binary, n int, keys array<long>"
    features = written(plain.mapInArrow(_features(body, depth, trees, size), kind).select(
        F.monotonically_increasing_id().alias("ticket"), "*"), "features")
    order = F.struct(F.col("row.key").isNull().alias("none"), F.col("row.key").alias("key"), "ticket")
    classes = written(features.where("set_id is not null").groupBy("set_id").agg(
        F.count(F.lit(1)).alias("copies"), F.min(order).alias("least"),
        F.min(F.struct("ticket", "keys", "n")).alias("m")).select(
        "set_id", "copies", "least", "m.ticket", "m.keys", "m.n"), "classes")
    said = F.col("row.text") if body is None else F.col("row.kept")[text]
    links = _links(classes.drop("least"), features.select("ticket", said.alias("text")), threshold, size)
    roots = _components(links.where("a <> b").select("a", "b"))
    linked = links.groupBy(F.col("a").alias("set_id")).agg(F.sum("linked").alias("linked"))
    rooted = classes.join(roots, "set_id", "left").join(linked, "set_id", "left").select(
        "set_id", F.coalesce("root", "set_id").alias("root"), "least",
        (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    return features, written(rooted, "rooted")


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text",
           keep: list[str] | None = None, threshold: float = THRESHOLD, size: int = SHINGLE,
           trees: int = TREES, deepest: int = DEEPEST, target: float = TARGET_RECALL) -> DataFrame:
    """Per row: struct ``row``, ``class_id``, ``n_links`` and ``first`` (one row of each class).

    A class is all rows that links connect, directly or through others; its id is the least key
    in it. ``n_links`` is the number of other rows at ``threshold`` or more, copies included.
    Rows without words are not linked and each is a class by itself; null keys count as last,
    and ``class_id`` is null if all keys of a class are. Repeated rows are copies of each other.
    ``first`` marks the row with the least key, any one of them if several have it. Columns of
    any name stay inside ``row``; an empty table gives no rows.
    """
    features, rooted = _joined(docs, key, text, keep, threshold, size, trees, deepest, target)
    ids = rooted.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("head"))
    sets = rooted.join(ids, F.col("root") == F.col("r")).select("set_id", "n_links", "head")
    out = features.select("ticket", "row", "set_id").join(sets, "set_id", "left")
    return out.select(
        F.col("row.kept").alias("row"),
        F.when(F.col("set_id").isNull(), F.col("row.key")).otherwise(F.col("head.key")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        (F.col("set_id").isNull() | (F.col("ticket") == F.col("head.ticket"))).alias("first"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The ``first`` row of each class (see ``joined``), with the columns of ``docs``."""
    features, rooted = _joined(docs, key, text, None, THRESHOLD, SHINGLE, TREES, DEEPEST, TARGET_RECALL)
    heads = rooted.groupBy("root").agg(F.min("least").alias("head")).select("head.ticket")
    rows = features.select("ticket", "row.kept", "set_id")
    kept = rows.where("set_id is not null").join(heads, "ticket", "left_semi").select("kept.*")
    return rows.where("set_id is null").select("kept.*").unionAll(kept)
