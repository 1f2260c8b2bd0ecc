"""Removal of bytes that repeat an earlier document, by merged Burrows-Wheeler transforms.

Suffixes are dealt so that equal ``span``-byte windows always meet: the smallest hash among the
``KMER``-byte strings of a window names its bucket, and neighbouring windows with the same smallest
hash travel as one piece. A bucket in which a common string has gathered far more than its share
is dealt again by the hash of each whole window. In a bucket, equal pieces are one piece that
carries its smallest document; pieces whose smallest hash occurs in one document only have no
partner. What is left is cut into shards, each shard gets its Burrows-Wheeler transform, and the
transforms are merged by refining their interleave, one symbol a round. After ``span`` rounds the
blocks of the interleave are the windows that are equal, and the smallest document of each block
decides which of its windows are repeats. Only the merge looks across shards; no suffix is sorted
against those of another shard.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlens.llm.common import text_of
from scholarlens.session import written

SPAN = 50
KMER = 20
#: Bytes of pieces that a bucket is meant to hold, and how many times that makes it hot.
BUCKET_BYTES = 1 << 25
HOT = 4
#: Bytes of texts cut and hashed at a time, windows of a piece at most, bytes of a merge and of its shards.
CUT_BYTES, HASHED_BYTES = 1 << 23, 1 << 17
PIECE = 1024
MERGE_BYTES, SHARD_BYTES = 1 << 18, 1 << 16
#: A null id counts as smaller than every other.
NULL_KEY = -(1 << 63)
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
FOUND = pa.schema([("key", pa.int64()), ("crc", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= ODD[0]
    x ^= x >> np.uint64(29)
    return x


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` for every start, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def pieces(data: bytes, sizes: np.ndarray, span: int, hot: np.ndarray,
           buckets: int) -> tuple[np.ndarray, ...]:
    """(start, windows, document, bucket, tag) of every piece of the texts joined in ``data``."""
    ends = np.cumsum(sizes)
    found, at = [], 0
    while at < len(sizes) or not found:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + HASHED_BYTES, "right")))
        stop = int(ends[min(to, len(sizes)) - 1]) if len(sizes) else 0
        start, windows, doc, bucket, tag = _pieces(data[before:stop], sizes[at:to], span, hot, buckets)
        found.append((start + before, windows, doc + at, bucket, tag))
        at = to
    return tuple(map(np.concatenate, zip(*found)))


def _pieces(data: bytes, sizes: np.ndarray, span: int, hot: np.ndarray,
            buckets: int) -> tuple[np.ndarray, ...]:
    """The same at once, with arrays of several times the size of ``data``."""
    offsets = np.cumsum(sizes) - sizes
    long = sizes >= span
    if not long.any():
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    n, kmer = len(data), min(KMER, span)
    padded = data + bytes(2 * span + 16)
    word = np.ndarray((n + span + 8,), "<u8", padded, strides=(1,))
    if kmer >= 8:
        h = sum((word[o:o + n + 1] * c for o, c in zip((0, (kmer - 8) // 2, kmer - 8), ODD)),
                np.zeros(n + 1, np.uint64))
    else:
        h = (word[:n + 1] & np.uint64((1 << 8 * kmer) - 1)) * ODD[1]
    h = _mixed(h)
    low, have, width = h, 1, span - kmer + 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:len(low) - step], low[step:])
        have += step
    first, stop = offsets[long], (offsets + sizes)[long] - span + 1
    edge = np.zeros(n + 1, np.int8)
    edge[first] += 1
    edge[stop] -= 1
    begins = np.cumsum(edge[:len(low)], dtype=np.int8).astype(bool)
    change = np.ones(len(low), bool)
    change[1:] = low[1:] != low[:-1]
    change[first] = True
    starts = np.flatnonzero(begins & change)
    doc = np.searchsorted(first, starts, "right") - 1
    ends = np.minimum(np.append(starts[1:], n), stop[doc])
    parts = -(-(ends - starts) // PIECE)
    if parts.max() > 1:
        base = np.repeat(starts, parts)
        ends, doc = np.repeat(ends, parts), np.repeat(doc, parts)
        starts = base + PIECE * _ranges(np.zeros(len(parts), np.int64), parts)
        ends = np.minimum(ends, starts + PIECE)
    name = low[starts]
    bucket = (name % np.uint64(buckets)).astype(np.int64)
    if len(hot):
        again = np.isin(bucket, hot)
        windows = _ranges(starts[again], (ends - starts)[again])
        whole = sum((h[np.minimum(windows + o, n)] * c for o, c in zip(
            (0, (span - kmer) // 2, span - kmer), ODD)), np.zeros(len(windows), np.uint64))
        if span > 3 * kmer:  # three strings do not cover a longer window, which only spreads less
            whole += low[windows]
        whole = _mixed(whole)
        doc = np.concatenate([doc[~again], np.repeat(doc[again], (ends - starts)[again])])
        starts, ends = (np.concatenate([starts[~again], windows]),
                        np.concatenate([ends[~again], windows + 1]))
        name = np.concatenate([name[~again], whole])
        bucket = np.concatenate([bucket[~again], (whole % np.uint64(buckets)).astype(np.int64)])
    tag = (_mixed(name * ODD[2]) >> np.uint64(40)).astype(np.int64)
    return starts, ends - starts, np.flatnonzero(long)[doc], bucket, tag


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    keys, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            keys.append(key)
            texts.append(text.encode())
            size += len(texts[-1])
            if size >= CUT_BYTES:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def _weigher(span: int, buckets: int) -> Callable[[Iterator], Iterator]:
    """Bytes that this task would send to each bucket."""
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _texts(batches):
            sizes = np.array([len(t) for t in texts], np.int64)
            _, windows, _, bucket, _ = pieces(b"".join(texts), sizes, span, np.zeros(0), buckets)
            to, at = np.unique(bucket, return_inverse=True)
            sums = np.bincount(at, windows + span - 1, len(to)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(sums, pa.int64())],
                                             ["bucket", "size"])
    return weigh


def _cutter(span: int, buckets: int, hot: list[int]) -> Callable[[Iterator], Iterator]:
    """Pieces of the texts, those of one bucket in one compressed row."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for keys, texts in _texts(batches):
            sizes = np.array([len(t) for t in texts], np.int64)
            data = b"".join(texts)
            raw = np.frombuffer(data, np.uint8)
            key = np.array(keys, np.int64)
            crc = np.array([zlib.crc32(t) for t in texts], np.uint32)
            offsets = np.cumsum(sizes) - sizes
            starts, windows, doc, bucket, tag = pieces(data, sizes, span, np.array(hot), buckets)
            order = np.lexsort((starts, bucket))
            bounds = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist() + [len(order)]
            for a, b in zip(bounds[:-1], bounds[1:]):
                at = order[a:b]
                docs, local = np.unique(doc[at], return_inverse=True)
                body = b"".join((
                    np.array([len(docs), len(at)], np.int64).tobytes(), key[docs].tobytes(),
                    crc[docs].tobytes(), local.astype(np.int32).tobytes(),
                    (starts[at] - offsets[doc[at]]).astype(np.int32).tobytes(),
                    windows[at].astype(np.int32).tobytes(), tag[at].astype(np.int32).tobytes(),
                    raw[_ranges(starts[at], windows[at] + span - 1)].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(bucket[at[0]])], pa.int64()), pa.array([packer.compress(body)])],
                    ["bucket", "packed"])
    return cut


def shard_order(text: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Suffixes of one shard in order. ``text`` holds 0 at the end of each string; these ends are
    smaller than every byte and differ by place. ``first`` marks where strings begin."""
    ends = text == 0
    rank = np.where(ends, np.cumsum(ends), int(ends.sum()) + text.astype(np.int64))
    n, top = len(text), int(rank.max()) + 1

    def behind(step: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[:max(0, n - step)] = rank[step:]
        return out

    key, step = (rank * top + behind(1)) * top + behind(2), 3  # a shard has too few ends to overflow
    while True:
        order = np.argsort(key)  # any order among equals: they share a rank until all differ
        new = np.cumsum(np.diff(key[order], prepend=-1) != 0)
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n:
            return order
        key = rank * (int(new[-1]) + 1) + behind(step)
        step *= 2


def merged_blocks(strings: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge the transforms of the shards of ``strings``; no string may hold the byte 255.

    Returns the places of all suffixes (in the strings joined, each with an end mark) in the
    order of their first ``span`` symbols, and their block: two suffixes share a block if and
    only if these symbols are equal. End marks all differ.
    """
    sizes = np.array([len(s) + 1 for s in strings], np.int64)
    text = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8) + np.uint8(1)
    begin = np.cumsum(sizes) - sizes
    first = np.zeros(len(text), bool)
    first[begin] = True
    shard = begin // SHARD_BYTES
    cuts = begin[np.flatnonzero(np.diff(shard, prepend=-1))].tolist() + [len(text)]
    place = np.concatenate([a + shard_order(text[a:b], first[a:b])
                            for a, b in zip(cuts[:-1], cuts[1:])]).astype(np.int32)
    where = np.empty(len(text), np.int32)
    where[place] = np.arange(len(text), dtype=np.int32)
    before = np.arange(-1, len(text) - 1)
    before[begin] = begin + sizes - 1
    symbol = text[before][place]        # the transforms, shard after shard
    step = where[before][place]         # where the suffix that is one symbol longer stands
    marks = where[begin + sizes - 1]
    order = np.arange(len(text), dtype=np.int32)
    block = np.zeros(len(text), np.int32)
    new = np.ones(len(text), bool)
    for _ in range(span):
        # all places are inside; "clip" only saves looking at each of them beforehand
        front = symbol.take(order, mode="clip")
        by = np.argsort(front, kind="stable")
        front, under = front.take(by, mode="clip"), block.take(by, mode="clip")
        order = step.take(order.take(by, mode="clip"), mode="clip")
        np.not_equal(front[1:], front[:-1], out=new[1:])
        new[1:] |= under[1:] != under[:-1]
        order[:len(marks)] = marks
        new[:len(marks) + 1] = True
        block = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return place[order], block


def least_by_window(strings: list[bytes], least: np.ndarray, span: int) -> list[np.ndarray]:
    """Smallest document of every window of every string, over all strings."""
    places, block = merged_blocks(strings, span)
    sizes = np.array([len(s) + 1 for s in strings], np.int64)
    owner = np.repeat(np.arange(len(strings)), sizes)
    bounds = np.flatnonzero(np.diff(block, prepend=-1))
    of_block = np.minimum.reduceat(least[owner[places]], bounds)
    found = np.empty(len(places), np.int64)
    found[places] = of_block[block]
    begin = np.cumsum(sizes) - sizes
    return [found[b:b + n - span] for b, n in zip(begin.tolist(), sizes.tolist())]


def _repeats_in(rows: list[bytes], span: int) -> pa.Table:
    """Covered stretches (key, crc, s, e) that the pieces of one bucket give."""
    unpack = zstandard.ZstdDecompressor()
    cols: list[list] = [[] for _ in range(5)]
    chosen: list[bytes] = []
    bodies = []
    for row in rows:
        body = unpack.decompress(row)
        d, n = np.frombuffer(body, np.int64, 2).tolist()
        key = np.frombuffer(body, np.int64, d, 16)
        crc = np.frombuffer(body, np.uint32, d, 16 + 8 * d)
        local, start, windows, tag = np.frombuffer(body, np.int32, 4 * n, 16 + 12 * d).reshape(4, n)
        for c, x in zip(cols, (key[local], crc[local].astype(np.int64), start, windows, tag)):
            c.append(x)
        bodies.append((body, 16 + 12 * d + 16 * n, windows))
    key, crc, start, windows, tag = (np.concatenate(c) for c in cols)
    _, group = np.unique(tag, return_inverse=True)
    by = np.argsort(group, kind="stable")
    bounds = np.flatnonzero(np.diff(group[by], prepend=-1))
    several = (np.minimum.reduceat(key[by], bounds) < np.maximum.reduceat(key[by], bounds))[group]
    if not several.any():
        return FOUND.empty_table()
    at = 0
    for body, data, size in bodies:
        sizes = size.astype(np.int64) + span - 1
        ends = data + np.cumsum(sizes)
        take = np.flatnonzero(several[at:at + len(size)])
        chosen.extend(body[e - n:e] for e, n in zip(ends[take].tolist(), sizes[take].tolist()))
        at += len(size)
    del bodies
    key, crc, start, windows, group = (x[several] for x in (key, crc, start, windows, group))
    ids: dict[bytes, int] = {}
    uid = np.array([ids.setdefault(s, len(ids)) for s in chosen], np.int64)
    strings = list(ids)
    least = np.full(len(strings), np.iinfo(np.int64).max)
    np.minimum.at(least, uid, key)
    of = np.empty(len(strings), np.int64)
    of[uid] = group
    order = np.argsort(of, kind="stable")
    bounds = np.flatnonzero(np.diff(of[order], prepend=-1)).tolist() + [len(order)]
    windows_of: list = [None] * len(strings)

    def settle(members: list[int]) -> None:
        for u, found in zip(members, least_by_window([strings[u] for u in members],
                                                     least[members], span)):
            windows_of[u] = found

    waiting, size = [], 0
    for a, b in zip(bounds[:-1], bounds[1:]):
        members = order[a:b].tolist()
        if len(members) == 1:  # all pieces of this name are equal
            u = members[0]
            windows_of[u] = np.full(len(strings[u]) - span + 1, least[u])
            continue
        waiting += members
        size += sum(len(strings[u]) + 1 for u in members)
        if size >= MERGE_BYTES:
            settle(waiting)
            waiting, size = [], 0
    if waiting:
        settle(waiting)
    flat = np.concatenate(windows_of)
    base = np.cumsum([0] + [len(w) for w in windows_of[:-1]])
    size = windows.astype(np.int64)
    hit = flat[_ranges(base[uid], size)] < np.repeat(key, size)
    head = np.cumsum(size) - size
    prev, nxt = np.roll(hit, 1), np.roll(hit, -1)
    prev[head] = False
    nxt[head + size - 1] = False
    s, e = np.flatnonzero(hit & ~prev), np.flatnonzero(hit & ~nxt)
    row = np.searchsorted(head, s, "right") - 1
    return pa.table([pa.array(key[row]), pa.array(crc[row]),
                     pa.array((s - head[row] + start[row]).astype(np.int32)),
                     pa.array((e - head[row] + start[row] + span).astype(np.int32))], schema=FOUND)


def covered(docs: DataFrame, span: int = SPAN, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(key, crc, s, e): stretches of bytes that repeat a document of smaller id; they may overlap.

    ``docs`` has ``key`` (long, not null) and ``text`` (not null).
    """
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    grown = 1 + 2 * (span - 1) / max(2, span - min(KMER, span) + 2)
    buckets = max(2 * spark.sparkContext.defaultParallelism, int(total * grown / bucket_bytes) + 1)
    weights = docs.mapInArrow(_weigher(span, buckets), "bucket long, size long")
    limit = HOT * max(total * grown / buckets, bucket_bytes / 16)
    hot = sorted(r[0] for r in weights.groupBy("bucket").agg(F.sum("size").alias("size")).where(
        F.col("size") > limit).select("bucket").collect())  # at most buckets / HOT of them
    rows = docs.mapInArrow(_cutter(span, buckets, hot), "bucket long, packed binary")

    def repeats(table: pa.Table) -> pa.Table:
        return _repeats_in(table.column("packed").to_pylist(), span)

    return rows.groupBy("bucket").applyInArrow(repeats, "key long, crc long, s int, e int")


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            data, at, kept, removed, runs = text.encode(), 0, hashlib.sha256(), 0, 0
            parts = []
            for x in sorted((x["s"], x["e"]) for x in spans or ()):
                if parts and x[0] <= parts[-1][1]:
                    parts[-1][1] = max(parts[-1][1], x[1])
                else:
                    parts.append(list(x))
            for s, e in parts:
                kept.update(data[at:s])
                removed, runs, at = removed + e - s, runs + 1, e
            kept.update(data[at:])
            out.append((len(data), removed, runs, kept.hexdigest(), parts))
        cols = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), *(pa.array(c, pa.int64()) for c in cols[:3]),
             pa.array(cols[3], pa.string()), pa.array(cols[4], pa.list_(pa.list_(pa.int64())))],
            ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 span: int = SPAN) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, kept_sha256 and ``removed``, the runs of bytes.

    A byte goes if a ``span``-byte string that covers it also starts in a document of smaller id.
    A null text is empty; a null id is smaller than every other. Rows of equal id are not
    partners; equal rows each get a row. Texts shorter than ``span`` stay whole. An empty table
    gives no rows, and other columns are not read.
    """
    plain = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("key"),
                        text_of(text).alias("text"))
    spans = written(covered(plain, span), "covered").groupBy("key", "crc").agg(
        F.collect_list(F.struct("s", "e")).alias("spans"))
    found = plain.withColumn("crc", F.crc32(F.col("text").cast("binary"))).join(
        spans, ["key", "crc"], "left").select("key", "text", "spans")
    out = found.mapInArrow(_measure, "key long, n_bytes long, n_removed long, n_spans long, "
                                     "kept_sha256 string, removed array<array<long>>")
    return out.select(F.when(F.col("key") != NULL_KEY, F.col("key")).alias(key), "n_bytes",
                      "n_removed", "n_spans", "kept_sha256", "removed")
