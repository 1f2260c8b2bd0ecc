"""Token ids in fixed-width bit packing.

A store is a table of blocks. A block holds consecutive whole documents: the ids of all of them
in one bit string, each id in the fewest bits that the vocabulary needs, most significant bit
first, and per document its key and the position of its first id. Id ``i`` of a block sits at bit
``i * width``, so numpy unpacks any slice at once without reading what lies before it. Blocks are
numbered within a shard and shards follow the order of the keys; the sizes of the shards give
every block its place in the whole stream.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholarlens.llm.common import text_of
from scholarlens.session import written

END_ID = 2
#: Ids after which a block is closed; a longer document is a block of its own.
BLOCK_IDS = 1 << 16
#: Texts encoded at a time, by bytes, whole and by words.
BATCH_BYTES = 1 << 18
WORDS_BYTES = 1 << 24
#: Distinct pieces of words encoded as one text, and the word put after those whose ends do not show.
JOINED = 1 << 7
MARK = "\x01"
#: Plain words are a run of letters that no normal form changes, and a run of signs after it.
LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
SIGNS = ".,;:!?"
BLOCKS = ("shard int, block int, first long, width int, n_ids int, keys array<long>, "
          "starts array<int>, packed binary")


def width_of(vocabulary: int) -> int:
    """Bits that the largest id of a vocabulary needs, at least one."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids below ``2**width`` as one bit string, padded with zeros to a whole byte."""
    if width == 16:  # whole bytes: the same string without touching single bits
        return ids.astype(">u2").tobytes()
    shifts = np.arange(width - 1, -1, -1, dtype=np.uint32)
    return np.packbits((ids.astype(np.uint32)[:, None] >> shifts) & 1).tobytes()


def unpack(packed: bytes | pa.Buffer, width: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from position ``start``; only the bytes that hold them are looked at."""
    if width == 16:
        return np.frombuffer(packed, ">u2", count=count, offset=2 * start).astype(np.uint32)
    low, high = start * width, (start + count) * width
    raw = np.frombuffer(packed, np.uint8, count=(high + 7) // 8 - low // 8, offset=low // 8)
    bits = np.unpackbits(raw)[low % 8:low % 8 + count * width].reshape(count, width)
    return bits @ (1 << np.arange(width - 1, -1, -1, dtype=np.uint32))


def slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together, or of one longer text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield at, to
        at = to


def _gathered(ids: np.ndarray, sizes: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """The ids of the picked pieces, one after the other; ``ids`` holds those of all pieces."""
    n = sizes[picked]
    shift = (np.cumsum(sizes) - sizes)[picked] - np.cumsum(n) + n
    return ids[np.repeat(shift, n) + np.arange(n.sum())]


def word_encoder(tokenizer) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """What encodes words: the ids of all, one after the other, and how many each word has.

    Signs are cut off plain words, whose letters count in lower case, and what is equal then is
    encoded once, many pieces as one text. A run of letters ends in a token that bears the suffix
    of ends of words, so the ends of such pieces show in the ids. Each other piece is followed by
    ``MARK`` as a word; pieces that hold that character are encoded one by one.
    """
    suffix = tokenizer.model.end_of_word_suffix
    mark = np.zeros(tokenizer.get_vocab_size(), bool)
    mark[tokenizer.encode(MARK, add_special_tokens=False).ids[-1]] = True
    closing = np.zeros_like(mark)
    closing[[i for token, i in tokenizer.get_vocab().items() if suffix and token.endswith(suffix)]] = True

    def matched(words: pa.Array, pattern: str) -> np.ndarray:
        return pc.match_substring_regex(words, pattern).to_numpy(zero_copy_only=False)

    def joined(pieces: pa.Array, between: str) -> np.ndarray:
        texts = ["".join(w + between for w in pieces.slice(at, JOINED).to_pylist())
                 for at in range(0, len(pieces), JOINED)]
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return np.concatenate([np.array(e.ids, np.uint32) for e in found])

    def encode_pieces(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        alone = matched(pieces, MARK)
        letters = matched(pieces, f"^{LETTERS}$") & bool(suffix)
        ids, order, sizes = [np.empty(0, np.uint32)], [], np.zeros(len(pieces), np.int64)
        for chosen, between, ends in ((letters, " ", closing), (~(letters | alone), f" {MARK} ", mark)):
            places = np.flatnonzero(chosen)
            if len(places):
                found = joined(pieces.take(pa.array(places)), between)
                sizes[places] = np.diff(np.flatnonzero(ends[found]), prepend=-1) - (ends is mark)
                ids.append(found[~mark[found]])
                order.append(places)
        for i in np.flatnonzero(alone):
            ids.append(np.array(tokenizer.encode(pieces[int(i)].as_py(), add_special_tokens=False).ids, np.uint32))
            sizes[i] = len(ids[-1])
            order.append([i])
        order = np.concatenate([np.empty(0, np.int64), *order]).astype(np.int64)
        return _gathered(np.concatenate(ids), sizes[order], np.argsort(order)), sizes

    def encode(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain = pa.array(matched(words, f"^{LETTERS}[{SIGNS}]*$"))
        stems = pc.if_else(plain, pc.ascii_lower(pc.ascii_rtrim(words, SIGNS)), words)
        signs = pc.if_else(plain, pc.replace_substring_regex(words, f"^{LETTERS}", ""), "")
        coded = pa.concat_arrays([stems, signs]).dictionary_encode()
        ids, sizes = encode_pieces(coded.dictionary)
        parts = coded.indices.to_numpy().reshape(2, -1)  # the stem and the signs of every word
        return _gathered(ids, sizes, parts.T.ravel()), sizes[parts].sum(axis=0)
    return encode


def ids_by_words(texts: pa.Array, encode: Callable, end_id: int) -> Iterator[np.ndarray]:
    """Ids of every text and its end; each distinct word of the texts is encoded once."""
    words = pc.ascii_split_whitespace(texts)
    coded = words.flatten().dictionary_encode()
    ids, sizes = encode(coded.dictionary)
    first = np.cumsum(sizes) - sizes
    word, of_text = coded.indices.to_numpy(), words.offsets.to_numpy()
    for a, b in zip(of_text[:-1], of_text[1:]):
        w = word[a:b]
        n = sizes[w]
        out = np.full(n.sum() + 1, end_id, np.uint32)
        out[:-1] = ids[np.repeat(first[w] - np.cumsum(n) + n, n) + np.arange(len(out) - 1)]
        yield out


def _encoder(path: str, width: int, end_id: int, by_words: bool) -> Callable[[Iterator], Iterator]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Spark gives a task one core; the tokenizer goes when the task ends
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        words = word_encoder(tokenizer) if by_words else None

        def whole(texts: pa.Array) -> Iterator[np.ndarray]:
            for e in tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False):
                yield np.array(e.ids + [end_id], np.uint32)

        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at, to in slices(texts, WORDS_BYTES if by_words else BATCH_BYTES):
                part = texts.slice(at, to - at)
                found = ids_by_words(part, words, end_id) if by_words else whole(part)
                sizes, packed = [], []
                for x in found:
                    sizes.append(len(x))
                    packed.append(pack(x, width))
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(at, to - at), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary())],
                    ["key", "n", "packed"])
    return encode


def _blocks(width: int, block_ids: int) -> Callable[[Iterator], Iterator]:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        keys, starts, parts, size = [], [], [], 0

        def closed() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            return pa.RecordBatch.from_pylist([{
                "shard": shard, "block": block, "first": first, "width": width, "n_ids": size,
                "keys": keys, "starts": starts, "packed": pack(ids, width)}], SCHEMA)

        for batch in batches:
            given, sizes, bits = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for i, (key, n) in enumerate(zip(given, sizes)):
                packed = bits[i].as_buffer()
                if size and size + n > block_ids:
                    yield closed()
                    block, first, keys, starts, parts, size = block + 1, first + size, [], [], [], 0
                keys.append(key)
                starts.append(size)
                parts.append(unpack(packed, width, 0, n))
                size += n
        if size:
            yield closed()
    return build


SCHEMA = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("width", pa.int32()),
    ("n_ids", pa.int32()), ("keys", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())),
    ("packed", pa.binary())])


def store(docs: DataFrame, tokenizer: str, vocabulary: int, key: str = "doc_id",
          text: str = "text", end_id: int = END_ID, block_ids: int = BLOCK_IDS,
          by_words: bool = False) -> DataFrame:
    """Encode every whole text, write the blocks in ascending order of the key, return the table.

    A null text is empty and gives the end id alone; a null key comes first. Rows of equal key
    are kept, in the order of their packed ids. An empty table gives an empty store. Other
    columns are not read, so their names do not matter.

    ``by_words`` is for tokenizers that drop white space and let no token cross it: the ids of a
    text are then those of its words in order, and a batch encodes each distinct word once.
    """
    width = width_of(max(vocabulary, end_id + 1))
    plain = docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text"))
    ids = written(plain.mapInArrow(_encoder(tokenizer, width, end_id, by_words),
                                   "key long, n int, packed binary"), "ids")
    tie = F.xxhash64("packed")
    ordered = ids.repartitionByRange(F.col("key"), tie).sortWithinPartitions("key", tie, "packed")
    return written(ordered.mapInArrow(_blocks(width, block_ids), BLOCKS), "blocks")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            row = batch.slice(i, 1).to_pylist()[0]
            starts = row["starts"]
            sizes = np.diff([*starts, row["n_ids"]])
            ids = [unpack(row["packed"], row["width"], s, int(n)) for s, n in zip(starts, sizes)]
            yield pa.RecordBatch.from_arrays([
                pa.array([row["shard"]] * len(ids), pa.int32()),
                pa.array(row["keys"], pa.int64()),
                pa.array([row["first"] + s for s in starts], pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())],
                ["shard", "key", "at", "n_tokens", "ids_crc32"])


def documents_of(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per stored document: key, ``start`` in the whole stream, ``n_tokens``, ``ids_crc32``."""
    sizes = blocks.groupBy(F.col("shard").alias("s_shard")).agg(F.sum("n_ids").alias("size"))
    before = Window.orderBy("s_shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    offsets = sizes.select("s_shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    read = blocks.mapInArrow(_read, "shard int, key long, at long, n_tokens long, ids_crc32 long")
    return read.join(offsets, F.col("shard") == F.col("s_shard")).select(
        F.col("key").alias(key), (F.col("offset") + F.col("at")).alias("start"),
        "n_tokens", "ids_crc32")
