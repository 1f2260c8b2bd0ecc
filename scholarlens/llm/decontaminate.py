"""Benchmark decontamination with an Aho-Corasick automaton.

Test items are normalised to words and cut into windows; the automaton holds every window with
blanks around its words. A document is normalised the same way and scanned once. Matches in the
normalised text lead back to word numbers, and these to offsets in the original text. The
items are a stated query set: they are taken in blocks of a fixed number of characters, one
automaton each, and documents go through the blocks one after the other without a shuffle.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlens.llm.common import free_name, text_of

WINDOW = 10
#: Characters of windows in one automaton: about 100 MB of states.
BLOCK_CHARS = 1 << 21
# Fixed value: a word, after A-Z are lower-cased.
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text: str) -> str:
    """A-Z in lower case and nothing else, so every offset stays."""
    return text.encode().lower().decode()


def windows_of(text: str | None, size: int = WINDOW) -> list[str]:
    """Distinct windows of an item; the whole item if it has fewer words, none without words."""
    words = WORDS.findall(lowered(text or ""))
    runs = range(max(1, len(words) - size + 1)) if words else ()
    return list(dict.fromkeys(f" {' '.join(words[i:i + size])} " for i in runs))


def blocks_of(items: DataFrame, key: str, text: str, size: int = WINDOW,
              limit: int = BLOCK_CHARS) -> Iterator[list[tuple[str, str | None]]]:
    """(window, item) pairs in blocks of at most ``limit`` characters, item by item."""
    block, chars = [], 0
    rows = items.select(F.col(key).cast("string"), text_of(text)).toLocalIterator()
    for name, content in rows:
        for window in windows_of(content, size):
            if block and chars + len(window) > limit:
                yield block
                block, chars = [], 0
            block.append((window, name))
            chars += len(window)
    if block:
        yield block


_BUILT: dict[str, object] = {}


def _automaton(name: str, block: list[tuple[str, str | None]]):
    if name not in _BUILT:
        import ahocorasick
        _BUILT.clear()  # one block at a time in a worker
        owners: dict[str, list] = {}
        for window, item in block:
            owners.setdefault(window, []).append(item)
        built = ahocorasick.Automaton()
        for window, items in owners.items():
            built.add_word(window, (window.count(" ") - 1, len(window), items))
        built.make_automaton()
        _BUILT[name] = built
    return _BUILT[name]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch or overlap as one, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


SPAN = pa.struct([("s", pa.int32()), ("e", pa.int32())])
FOUND = pa.struct([("n_words", pa.int32()), ("words", pa.list_(SPAN)), ("chars", pa.list_(SPAN)),
                   ("items", pa.list_(pa.string()))])
FOUND_SQL = ("struct<n_words:int,words:array<struct<s:int,e:int>>,"
             "chars:array<struct<s:int,e:int>>,items:array<string>>")


def _scanner(name: str, shared) -> Callable[[Iterator], Iterator]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = _automaton(name, shared.value)
        for batch in batches:
            out = []
            for text, old in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = WORDS.findall(lowered(text))
                hits, items = [(x["s"], x["e"]) for x in old["words"]], set(old["items"])
                plain = f" {' '.join(words)} "
                starts = None
                for last, (n, length, names) in built.iter(plain) if words else ():
                    if starts is None:
                        starts, at = [], 0
                        for w in words:
                            starts.append(at)
                            at += len(w) + 1
                    first = bisect_left(starts, last - length + 1)
                    hits.append((first, first + n))
                    items.update(names)
                hits = merged(hits)
                chars = []
                if hits:
                    places = [m.span() for m in WORDS.finditer(lowered(text))]
                    chars = [(places[s][0], places[e - 1][1]) for s, e in hits]
                spans = lambda rows: [{"s": s, "e": e} for s, e in rows]
                out.append({"n_words": len(words), "words": spans(hits), "chars": spans(chars),
                            "items": sorted(x for x in items if x is not None)})
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, FOUND)], ["row", "text", "found"])
    return scan


def scan(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id",
         item_text: str = "text", keep: list[str] | None = None, size: int = WINDOW,
         limit: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: struct ``row`` of the ``keep`` columns and struct ``found``.

    ``found`` has the number of words, the hit word ranges and the ranges in the original text
    (code points, end exclusive), and the names of the items found, sorted as strings. Null text
    has no words; items without words match nothing; items without name hit but are not listed;
    equal names are one item. Without items nothing is hit, an empty table gives no rows.
    """
    keep = docs.columns if keep is None else keep
    spark = docs.sparkSession
    row = free_name(docs, "_row")
    df = docs.select(F.struct(*[F.col(c) for c in keep]).alias(row), text_of(text).alias("text"))
    df = df.select(F.col(row).alias("row"), "text", F.struct(
        F.lit(0).alias("n_words"), F.array().cast("array<struct<s:int,e:int>>").alias("words"),
        F.array().cast("array<struct<s:int,e:int>>").alias("chars"),
        F.array().cast("array<string>").alias("items")).alias("found"))
    kind = f"row {df.schema['row'].dataType.simpleString()}, text string, found {FOUND_SQL}"
    for block in [*blocks_of(items, item_key, item_text, size, limit)] or [[]]:
        shared = spark.sparkContext.broadcast(block or [("\0", None)])
        df = df.mapInArrow(_scanner(uuid.uuid4().hex, shared), kind)
    return df.select("row", "found")


def measured(found: DataFrame) -> DataFrame:
    """``row`` with the counts, the digest of the items and the verdict."""
    n_hit = F.aggregate("found.words", F.lit(0), lambda a, x: a + x["e"] - x["s"])
    return found.select(
        "row", F.col("found.n_words").cast("long").alias("n_words"),
        n_hit.cast("long").alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), F.col("found.chars").alias("spans"))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item, with their columns."""
    return scan(docs, items).where(F.size("found.words") == 0).select("row.*")
