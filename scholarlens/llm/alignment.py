"""Alignment of two tokenizations of the same text by divide and conquer at shared cuts.

Both token sequences of a text cover the same bytes, so a byte offset where a token of each side
ends cuts the pair of sequences into two smaller problems. The ends of words are such cuts on
either side, which makes each distinct word a problem of its own, solved once a task. An interval
of tokens is cut at a common end near its middle, found by bisecting the other side's ends, and
both halves are cut again; an interval without a common end is a leaf group. All intervals of a
batch are cut together, level by level, so the recursion is a few array operations a level.

Two tokens are linked where their bytes overlap. How many documents hold a pair of ids linked is
counted over the whole corpus from inverted rows: per batch of texts and pair of ids one row with
the documents that hold it, so neither count nor lookup moves a row per document and pair.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlens.llm.common import text_of
from scholarlens.session import written

#: Characters of the texts that are aligned together; a longer text is aligned by itself.
BATCH_CHARS = 1 << 21
#: Aligned words that a task remembers; with more, the next batch begins the memory anew.
REMEMBERED = 1 << 18
#: How the left tokenizer parts a text before it merges bytes; a fixed value of its kind.
WORD_PATTERN = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"""
                r"""|\s+(?!\S)|\s+""")
#: What the right tokenizer writes for a space.
SPACE = "▁"
#: Places where neither tokenizer joins what stands on both sides: a space after a visible sign.
#: A single space at the end stays with its word: alone, it would leave the right side nothing.
PARTS = re.compile(r"(?<=\S)(?= )(?! \Z)")
#: Words that are encoded laid end to end.
TOGETHER = 64
HALF = 32


class Coder:
    """Ids of words that begin with a space, and the bytes that each id stands for."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], pieces: list[bytes]):
        self._encode, self.pieces = encode, pieces
        self.sizes = np.array([len(p) for p in pieces], np.int64)

    def _alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = self._encode(words) if words else []
        ok = [b"".join(map(self.pieces.__getitem__, x)) == w.encode() for w, x in zip(words, found)]
        return *_flat([x if good else [] for x, good in zip(found, ok)]), np.array(ok, bool)

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lines = ["".join(words[i:i + TOGETHER]) for i in range(0, len(words), TOGETHER)]
        ids, _ = _flat(self._encode(lines) if lines else [])
        raw = [w.encode() for w in words]
        stops = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        ends = np.append(0, np.cumsum(self.sizes[ids]))
        at = np.searchsorted(ends, stops)
        if (ends[np.minimum(at, len(ids))] == stops).all() and b"".join(
                map(self.pieces.__getitem__, ids.tolist())) == b"".join(raw):
            return ids, np.append(0, at), np.ones(len(words), bool)
        return self._alone(words)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words, where each word's begin and the last end, and whether they spell it.

        Words without white space at their end are encoded laid end to end, since a token never
        reaches from one into the next. A word that is not spelled has no ids.
        """
        open_ = np.array([w[-1].isspace() for w in words], bool)
        plain = self._together([w for w, x in zip(words, open_.tolist()) if not x])
        other = self._alone([w for w, x in zip(words, open_.tolist()) if x])
        order = np.argsort(np.argsort(open_, kind="stable"), kind="stable")
        flat, at = _picked(np.concatenate([plain[0], other[0]]),
                           np.concatenate([plain[1], other[1][1:] + plain[1][-1]]), order)
        return flat, at, np.concatenate([plain[2], other[2]])[order]


def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """The elements of all lists, and where each list begins and the last ends."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, sizes.sum()), np.append(
        0, np.cumsum(sizes))


def _picked(flat: np.ndarray, at: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists named by ``order``, one after the other, in the same form."""
    size = at[order + 1] - at[order]
    ends = np.cumsum(size)
    take = np.arange(size.sum()) + np.repeat(at[order] - (ends - size), size)
    return flat[take], np.append(0, ends)


def byte_level(path: str) -> Coder:
    """Byte-level BPE from its JSON file; strings of special tokens are ordinary text.

    Ids follow the order of the merges, so they serve as merge ranks.
    """
    import tiktoken
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    special = {x["content"] for x in told["added_tokens"]}
    vocab = {k: v for k, v in told["model"]["vocab"].items() if k not in special}
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))]
              for m in told["model"]["merges"]]
    if merged != sorted(merged):
        raise ValueError("ids do not follow the order of the merges")
    # printable bytes stand for themselves, the others are shifted beyond them in order
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}
    coder = tiktoken.Encoding("left", pat_str=WORD_PATTERN, mergeable_ranks=ranks,
                              special_tokens={})
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a byte without an id")
    pieces = [b""] * (max(vocab.values()) + 1)
    for raw, i in ranks.items():
        pieces[i] = raw
    return Coder(lambda texts: list(map(coder.encode_ordinary, texts)), pieces)


def sentence_pieces(path: str) -> Coder:
    """Sentence pieces; the model puts the leading space itself.

    No piece may go on with a space after another sign, so that words are encoded alike alone
    and in a text.
    """
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def raw(piece: str) -> bytes:
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace(SPACE, " ").encode()

    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(SPACE in name.lstrip(SPACE) for name in names):
        raise ValueError("a piece reaches over a space")
    return Coder(lambda texts: model.encode([t[1:] for t in texts], num_threads=1),
                 [raw(name) for name in names])


class _Numbered(dict):
    """Numbers for words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def shared_cuts(a: np.ndarray, b: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Whether each end in ``a`` is also an end in ``b``, by divide and conquer.

    Both hold ascending ends. Interval ``i`` has the ends ``starts[i]`` to ``stops[i]`` of ``a``,
    the last of which is known to be common. Near the middle of an interval, one end is tried
    first, then two, four and so on around it; the common end nearest to the middle cuts it.
    """
    cut = np.zeros(len(a), bool)
    cut[stops[stops > starts] - 1] = True
    lo, hi = starts.copy(), stops - 1
    while len(lo := lo[keep := lo < hi]):
        hi = hi[keep]
        mid, found = (lo + hi) // 2, np.full(len(lo), -1, np.int64)
        open_, near, far = np.arange(len(lo)), 0, 1
        while len(open_):
            away = np.arange(near, far)
            away = np.concatenate([-away, away]) if near else away
            away = away[np.argsort(np.abs(away), kind="stable")]
            at = mid[open_, None] + away
            inside = (at >= lo[open_, None]) & (at < hi[open_, None])
            values = a[np.where(inside, at, lo[open_, None])]
            hit = inside & (b[np.minimum(np.searchsorted(b, values), len(b) - 1)] == values)
            first = hit.argmax(1)
            got = hit[np.arange(len(open_)), first]
            found[open_[got]] = at[got, first[got]]
            open_ = open_[~got]
            near, far = far, 2 * far
            open_ = open_[(mid[open_] - near >= lo[open_]) | (mid[open_] + near < hi[open_])]
        got = found >= 0
        lo, hi, mid, found = lo[got], hi[got], mid[got], found[got]
        cut[found] = True
        # what lies nearer to the middle than the cut has been tried
        far = np.abs(found - mid)
        left_hi = np.where(found > mid, mid - far + 1, found)
        right_lo = np.where(found < mid, mid + far, found + 1)
        lo, hi = np.concatenate([lo, right_lo]), np.concatenate([left_hi, hi])
        order = np.argsort(lo, kind="stable")
        lo, hi = lo[order], hi[order]
    return cut


class Aligned:
    """Token ends of strings laid end to end, cut into groups and linked."""

    def __init__(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray],
                 left: Coder, right: Coder):
        (self.a, self.a_at), (self.b, self.b_at) = a, b
        self.a_ends, self.b_ends = np.cumsum(left.sizes[self.a]), np.cumsum(right.sizes[self.b])
        self.cut = shared_cuts(self.a_ends, self.b_ends, self.a_at[:-1], self.a_at[1:])
        #: Last token of every group, on either side.
        self.a_last = np.flatnonzero(self.cut)
        self.b_last = np.searchsorted(self.b_ends, self.a_ends[self.a_last])
        #: Where the groups of each string begin, and the last end.
        self.groups_at = np.searchsorted(self.a_last, self.a_at)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """String, left id and right id of every overlapping pair of tokens."""
        ends = np.sort(np.concatenate([self.a_ends, self.b_ends]), kind="stable")
        ends = ends[np.append(ends[1:] != ends[:-1], True)] if len(ends) else ends
        sides = []
        for mine in (self.a_ends, self.b_ends):
            mark = np.zeros(len(ends), np.int64)
            mark[np.searchsorted(ends, mine)] = 1
            sides.append(np.cumsum(mark) - mark)
        owner = np.searchsorted(self.a_at, sides[0], side="right") - 1
        return owner, self.a[sides[0]], self.b[sides[1]]

    def spelled(self, a_words: list[str], b_words: list[str]) -> list[str]:
        """Per string its groups: ids by commas, sides by a bar, groups by semicolons.

        ``a_words`` holds every id followed by a comma, then every id followed by a bar;
        ``b_words`` every id followed by a comma, by a semicolon, and by the end of a line.
        """
        sizes_a, sizes_b = (np.diff(np.append(-1, x)) for x in (self.a_last, self.b_last))
        before_a = np.repeat(np.append(0, self.b_last[:-1] + 1)[:len(sizes_a)], sizes_a)
        before_b = np.repeat(self.a_last + 1, sizes_b)
        some = np.diff(self.a_at) > 0
        code = np.empty(len(self.a) + len(self.b), np.int64)
        code[np.arange(len(self.a)) + before_a] = self.a + self.cut * (len(a_words) // 2)
        step = len(b_words) // 3
        b_code = self.b + len(a_words)
        b_code[self.b_last] += step
        b_code[self.b_at[1:][some] - 1] += step
        code[np.arange(len(self.b)) + before_b] = b_code
        said = "".join(map((a_words + b_words).__getitem__, code.tolist())).split("\n")
        out = np.full(len(some), "", object)
        out[some] = said[:-1]
        return out.tolist()


class Words:
    """Aligned words of the texts of a task; a word that has been met is not aligned again.

    Neither tokenizer joins a space to what stands before it, so both sides end at the end of a
    word, and a text's alignment is that of its words, one after the other.
    """

    def __init__(self, left: Coder, right: Coder):
        self.left, self.right = left, right
        self.a_words, self.b_words = (
            [f"{i}{end}" for end in ends for i in range(len(side.pieces))]
            for side, ends in ((left, ",|"), (right, ",;\n")))
        self._forget()

    def _forget(self) -> None:
        self.number, self.spelled = _Numbered(), np.zeros(0, bool)
        self.said: list[str] = []
        #: Per kind the values of all words, and where each word's begin and the last end.
        self.table = {kind: (np.zeros(0, np.int64), np.zeros(1, np.int64))
                      for kind in ("a", "b", "a_sizes", "b_sizes", "links")}

    def _learn(self, known: int) -> None:
        new = list(islice(self.number, known, None))
        if not new:
            return
        sides, spelled = [], np.ones(len(new), bool)
        for coder in (self.left, self.right):
            ids, at, ok = coder.encode(new)
            sides.append((ids, at))
            spelled &= ok
        if not spelled.all():
            # a word that one side does not spell has no tokens on the other either
            sides = [_flat([ids[x:y] if ok else [] for x, y, ok in zip(at, at[1:], spelled)])
                     for ids, at in sides]
        x = Aligned(*sides, self.left, self.right)
        owner, a, b = x.links()
        sizes = [np.diff(np.append(-1, last)) for last in (x.a_last, x.b_last)]
        for kind, values, at in (
                ("a", x.a, x.a_at), ("b", x.b, x.b_at), ("a_sizes", sizes[0], x.groups_at),
                ("b_sizes", sizes[1], x.groups_at),
                ("links", a * len(self.right.pieces) + b, np.searchsorted(owner, np.arange(len(new) + 1)))):
            old, old_at = self.table[kind]
            self.table[kind] = (np.concatenate([old, values]),
                                np.concatenate([old_at, at[1:] + len(old)]))
        self.said += x.spelled(self.a_words, self.b_words)
        self.spelled = np.concatenate([self.spelled, spelled])

    def of(self, texts: list[str]) -> "Texts":
        parts = [PARTS.split(" " + t) if t else [] for t in texts]
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        if len(self.number) > REMEMBERED:
            self._forget()
        known = len(self.number)
        number = np.fromiter(map(self.number.__getitem__, chain.from_iterable(parts)), np.int64,
                             n.sum())
        self._learn(known)
        ends = np.cumsum(n)
        wrong = np.append(0, np.cumsum(~self.spelled[number]))
        whole = wrong[ends] == wrong[ends - n]
        return Texts(self, number[np.repeat(whole, n)], np.append(0, np.cumsum(n * whole)))


class Texts:
    """Texts as the numbers of their words; a text that a side does not spell has no words."""

    def __init__(self, words: Words, number: np.ndarray, at: np.ndarray):
        self.words, self.number, self.at = words, number, at

    def sizes(self, kind: str) -> np.ndarray:
        """How many values of a kind each text has."""
        at = self.words.table[kind][1]
        return np.diff(np.append(0, np.cumsum(np.diff(at)[self.number]))[self.at])

    def values(self, kind: str) -> np.ndarray:
        """The values of a kind of all texts, in order."""
        return _picked(*self.words.table[kind], self.number)[0]

    def lists(self, kind: str) -> pa.Array:
        return _lists(self.values(kind), np.append(0, np.cumsum(self.sizes(kind))), pa.int32())

    def digests(self) -> list[str]:
        """SHA-256 of the groups of each text, empty for a text without tokens."""
        said, number = self.words.said, self.number.tolist()
        return [hashlib.sha256(";".join(map(said.__getitem__, number[x:y])).encode()).hexdigest()
                if y > x else "" for x, y in zip(self.at[:-1].tolist(), self.at[1:].tolist())]


def _batches(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Kept columns and texts, a bounded number of characters at a time."""
    for batch in rows:
        sizes = batch.column(2).to_numpy()
        at = 0
        while at < len(batch):
            total = np.cumsum(sizes[at:])
            to = at + max(1, int(np.searchsorted(total, BATCH_CHARS, side="right")))
            yield batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at).to_pylist()
            at = to


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _grouper(left: str, right: str):
    def align(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(byte_level(left), sentence_pieces(right))
        for kept, texts in _batches(rows):
            x = words.of(texts)
            yield pa.RecordBatch.from_arrays(
                [kept, *map(x.lists, ("a", "b", "a_sizes", "b_sizes"))],
                ["row", "a_ids", "b_ids", "a_sizes", "b_sizes"])
    return align


def _measurer(left: str, right: str, kind: pa.DataType):
    def measure(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(byte_level(left), sentence_pieces(right))
        width, block = len(words.right.pieces), TaskContext.get().partitionId() << HALF
        for kept, texts in _batches(rows):
            x, n = words.of(texts), len(texts)
            n_links = x.sizes("links")
            # one sort brings the texts of a pair of ids together, and repeated links of a text
            key = np.sort(x.values("links") * n + np.repeat(np.arange(n), n_links))
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
            times = np.diff(np.append(first, len(key)))
            pair, doc = np.divmod(key[first], n)
            start = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[:len(pair)])
            yield _rows(block, n, kind, **{
                "doc": np.arange(n), "row": kept, "n_a": x.sizes("a"), "n_b": x.sizes("b"),
                "n_groups": x.sizes("a_sizes"), "n_links": n_links, "groups_sha256": x.digests()})
            yield _rows(block, len(start), kind, a=pair[start] // width, b=pair[start] % width,
                        held=_lists((doc << HALF) + times, np.append(start, len(pair)), pa.int64()))
            block += 1
    return measure


def _rows(block: int, n: int, kept: pa.DataType, **given) -> pa.RecordBatch:
    kinds = {"block": pa.int64(), "doc": pa.int64(), "row": kept, "n_a": pa.int64(),
             "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(),
             "groups_sha256": pa.string(), "a": pa.int32(), "b": pa.int32(),
             "held": pa.list_(pa.int64())}
    given["block"] = np.full(n, block)
    return pa.RecordBatch.from_arrays([
        x if isinstance(x := given.get(k), pa.Array) else pa.nulls(n, kind) if x is None
        else pa.array(x, kind) for k, kind in kinds.items()], [*kinds])


def _plain(docs: DataFrame, text: str, keep: list[str] | None) -> DataFrame:
    keep = docs.columns if keep is None else keep
    return docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), text_of(text).alias("text"),
                       F.char_length(text_of(text)).alias("size"))


def groups(docs: DataFrame, left: str, right: str, text: str = "text",
           keep: list[str] | None = None) -> DataFrame:
    """Per row: struct ``row``, ids of both sides, and per group how many tokens of each it has.

    ``left`` is the path of a byte-level BPE in JSON, ``right`` that of a sentence-piece model.
    A null or empty text, and one whose joined tokens of a side are not the bytes of a space and
    the text, has no tokens and no groups. Repeated rows stay; an empty table gives no rows;
    columns of any name stay inside ``row``. A text must fit in a task.
    """
    plain = _plain(docs, text, keep)
    kind = (f"row {plain.schema['row'].dataType.simpleString()}, a_ids array<int>, "
            "b_ids array<int>, a_sizes array<int>, b_sizes array<int>")
    return plain.mapInArrow(_grouper(left, right), kind)


def measured(docs: DataFrame, left: str, right: str, text: str = "text",
             keep: list[str] | None = None) -> DataFrame:
    """Per row: struct ``row``, the sizes of its alignment and how its links stand in the corpus.

    ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256`` describe the text alone.
    ``count_sum`` adds, over its links, the number of rows that hold the same pair of ids linked;
    ``n_best`` counts the links whose number is the highest of all pairs of their left id, ties
    included. Texts, repeated rows and names are treated as in :func:`groups`.
    """
    plain = _plain(docs, text, keep)
    row = plain.schema["row"].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    kind = (f"block long, doc long, row {row.simpleString()}, n_a long, n_b long, n_groups long, "
            "n_links long, groups_sha256 string, a int, b int, held array<long>")
    both = written(plain.mapInArrow(_measurer(left, right, to_arrow_type(row)), kind), "aligned")
    held = both.where("a is not null").select("block", "a", "b", "held")
    # at most as many rows as there are pairs of ids, whatever the corpus
    counted = written(held.groupBy("a", "b").agg(
        F.sum(F.size("held").cast("long")).alias("n")), "counted")
    best = counted.groupBy("a").agg(F.max("n").alias("most"))
    known = counted.join(best, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))
    # merged at any size: how many pairs of ids a corpus holds is not known beforehand
    each = held.join(known.hint("merge"), ["a", "b"]).select("block", "n", "best", F.explode("held").alias("x"))
    times = F.col("x").bitwiseAND((1 << HALF) - 1)
    sums = each.groupBy("block", F.shiftright("x", HALF).alias("doc")).agg(
        F.sum(times * F.col("n")).alias("count_sum"),
        F.sum(F.when(F.col("best"), times).otherwise(F.lit(0))).alias("n_best"))
    whole = both.where("a is null").drop("a", "b", "held").join(sums, ["block", "doc"], "left")
    zero = F.lit(0).cast("long")
    return whole.select("row", "n_a", "n_b", "n_groups", "n_links",
                        F.coalesce("n_best", zero).alias("n_best"),
                        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
