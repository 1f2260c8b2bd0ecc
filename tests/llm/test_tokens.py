"""Bit packing by round trip, decontamination against a plain statement."""

import hashlib
import re
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scholarlens.llm import decontaminate, packing, queries

KIND = "doc_id long, text string, row string, found string, key string"
SF = "/root/testdata/sf0.01"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 17).flatmap(lambda w: st.tuples(
    st.just(w), st.lists(st.integers(0, 2 ** w - 1), min_size=1, max_size=80))))
def test_packing_round_trip(case):
    width, ids = case
    packed = packing.pack(np.array(ids), width)
    assert len(packed) == -(-len(ids) * width // 8)
    for start in range(len(ids)):
        assert packing.unpack(packed, width, start, len(ids) - start).tolist() == ids[start:]
    assert packing.unpack(packed, width, 0, len(ids) // 2).tolist() == ids[:len(ids) // 2]


def plain_tokens(rows):
    tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows]
    starts = [0, *accumulate(map(len, ids))]
    return [(k, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
            for (k, _), s, x in zip(rows, starts, ids)]


def test_tokens_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = sorted((tuple(r) for r in docs.collect()), key=lambda r: r[0])
    got = queries.op2_bit_packing(spark, SF).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == plain_tokens(rows)


def odd(spark):
    rows = [(5, None), (2, ""), (9, "long words " * 30000), (2, ""), (7, "a"), (7, "é 😀 <|endoftext|>"),
            (None, "x")]
    return spark.createDataFrame([(k, t, "r", "f", "k") for k, t in rows], KIND)


def test_tokens_of_odd_rows(spark):
    blocks = packing.store(odd(spark), path("word_bpe_49k.json"), 49408, block_ids=3)
    got = packing.documents_of(blocks).collect()
    assert len(got) == 7 and {r["start"] for r in got if r["doc_id"] is None} == {0}
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in got)
    assert all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [None, 2, 2, 5, 7, 7, 9]
    assert packing.documents_of(packing.store(
        odd(spark).limit(0), path("word_bpe_49k.json"), 49408)).count() == 0


PIECES = [*"aB1'StreEVdé.,;:!?JÀßΣσ×İſK字ก\x00\x01\x1c\x0b\x0c\t\n\r   -_<|>", "\x85", "\xa0", "\u2028", "\u200b",
          "\u0301", "J\u030c", "e\u0315\u0300", "<|endoftext|>", "<|EndOfText|>", "'s", "'re", "</w>", "ﬁ", "😀", "tion"]


@pytest.fixture(scope="module")
def coded():
    tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
    return tokenizer, packing.word_encoder(tokenizer)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES) | st.characters(exclude_categories=["Cs"]), max_size=25)
                .map("".join), max_size=6))
def test_ids_by_words(coded, texts):
    tokenizer, encode = coded
    got = list(packing.ids_by_words(pa.array(texts, pa.string()), encode, 2))
    assert [x.tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_words_are_encoded_once():
    """The ids of many copies of a text cost one encoding of each of its words."""
    given = []

    class Counted:
        def __init__(self, tokenizer):
            self.of = tokenizer

        def __getattr__(self, name):
            return getattr(self.of, name)

        def encode_batch_fast(self, texts, **options):
            given.extend(w for t in texts for w in t.split())
            return self.of.encode_batch_fast(texts, **options)

    tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
    texts = ["One two, two. three 3"] * 50
    got = list(packing.ids_by_words(pa.array(texts), packing.word_encoder(Counted(tokenizer)), 2))
    assert [x.tolist() for x in got] == [tokenizer.encode(texts[0]).ids + [2]] * 50
    assert sorted(w for w in given if w != packing.MARK) == [",", ".", "3", "one", "three", "two"]


def test_tokens_of_odd_rows_by_words(spark):
    whole, by_words = ([tuple(r) for r in packing.documents_of(packing.store(
        odd(spark), path("word_bpe_49k.json"), 49408, block_ids=3, by_words=x)).orderBy("start").collect()]
        for x in (False, True))
    assert whole == by_words


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_hits(texts, items):
    """Per text: words, hit words, items, digest; windows of 10 compared one by one."""
    windows = {}
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i:i + 10]), set()).add(name)
    lengths = {len(w) for w in windows}
    for text in texts:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                names = windows.get(tuple(w[i:i + n]))
                if names is not None:
                    hit.update(range(i, i + n))
                    found |= names
        named = sorted(str(x) for x in found if x is not None)
        yield (len(w), len(hit), len(named),
               hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit))


def test_decontamination_of_all_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r[0]: tuple(r[1:]) for r in queries.op6_decontamination(spark, SF).collect()}
    assert got == dict(zip(docs, plain_hits(docs.values(), items)))
    assert any(x[4] for x in got.values())


@pytest.mark.parametrize("limit", [60, 1 << 21])
def test_decontamination_of_odd_rows(spark, limit):
    items = [(1, "Aa bb CC"), (2, None), (3, "..."), (None, "q1 q2"), (1, "zz"),
             (10, " ".join(f"w{i}" for i in range(25))), (10, "aa bb"), (4, "é😀 É")]
    texts = [None, "", "AA-bb, cc; aa", "aab b cc bb", "q1 Q2", "x " * 50000 + "zz",
             " ".join(f"w{i}" for i in range(3, 14)), " ".join(f"w{i}" for i in range(3, 12)),
             "é😀 É é😀 é", "aa bb cc aa bb"]
    docs = spark.createDataFrame([(i, t, "r", "f", "k") for i, t in enumerate(texts + texts)], KIND)
    table = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.scan(docs, table, limit=limit)
    got = {r["row"]["doc_id"]: r for r in decontaminate.measured(out).collect()}
    for i, plain in enumerate(plain_hits(texts + texts, items)):
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == plain
    assert [texts[2][x["s"]:x["e"]] for x in got[2]["spans"]] == ["AA-bb, cc"]
    assert decontaminate.keep_clean(docs, table).columns == docs.columns
    assert decontaminate.scan(docs, table.limit(0)).where(F.size("found.words") > 0).count() == 0
    assert decontaminate.scan(docs.limit(0), table).count() == 0
