"""Removal of repeated bytes against a plain statement."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from scholarlens.llm import queries, repeats

KIND = "doc_id long, text string, key string, crc string, spans string"


def plain(rows, span=50):
    """Every window's smallest document, from a table of all windows."""
    rows = [(k, (t or "").encode()) for k, t in rows]
    least = {}
    low = -(1 << 63)
    for k, d in rows:
        for i in range(len(d) - span + 1):
            w = d[i:i + span]
            least[w] = min(least.get(w, 1 << 63), low if k is None else k)
    out = []
    for k, d in rows:
        gone = bytearray(len(d))
        for i in range(len(d) - span + 1):
            if least[d[i:i + span]] < (low if k is None else k):
                gone[i:i + span] = b"\1" * span
        kept = bytes(c for c, g in zip(d, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((k, len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def got(df):
    return Counter(tuple(r) for r in df.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def test_all_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = got(queries.op3_merged_transforms(spark, sf))
    assert found == plain(rows) and any(r[2] for r in found)


@pytest.mark.parametrize("bucket", [repeats.BUCKET_BYTES, 4000])
def test_small_alphabet_and_edges(spark, monkeypatch, bucket):
    """Runs of one letter, short texts, nulls, repeated rows and ids, hot buckets, small shards."""
    monkeypatch.setattr(repeats, "MERGE_BYTES", 3000)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 500)
    monkeypatch.setattr(repeats, "HOT", 0.5 if bucket == 4000 else 4)
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ü") for _ in range(120))
    rows = [(None, passage[20:90]), (None, None), (7, None), (8, ""), (9, passage[:49]), (10, "x" * 3000),
            (11, "x" * 2500 + "y" + "x" * 60), (11, "x" * 50), (11, "x" * 50), (5, "x" * 51)]
    for i in range(60):
        a, b = sorted(rng.randrange(121) for _ in range(2))
        noise = "".join(rng.choice("ab") for _ in range(rng.randrange(80)))
        rows.append((rng.randrange(40), noise + passage[a:b] + noise[::-1]))
    df = spark.createDataFrame([(k, t, "k", "c", "s") for k, t in rows], KIND)
    assert got(repeats.deduplicated(df)) == plain(rows)


def test_merge_orders_all_suffixes():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(10, 40))).encode() for _ in range(50)]
    repeats.SHARD_BYTES, before = 100, repeats.SHARD_BYTES
    places, block = repeats.merged_blocks(texts, 6)
    repeats.SHARD_BYTES = before
    whole = b"\0".join(texts) + b"\0"
    heads = [whole[p:p + 6].split(b"\0")[0] for p in places]
    assert heads == sorted(heads)
    for i in range(1, len(heads)):
        assert (block[i] == block[i - 1]) == (len(heads[i]) == 6 and heads[i] == heads[i - 1])


def test_shard_order_sorts_ties_to_the_end():
    rng = random.Random(2)
    for n in (1, 2, 3, 60):
        strings = [bytes(rng.choices((1, 2, 255), k=rng.randrange(0, 30))) for _ in range(n)] + [b"\1" * 25] * 2
        text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        marks = np.cumsum(text == 0)
        # an end mark is smaller than every byte, and marks differ by place
        said = [[(x > 0, x or m) for x, m in zip(text[i:].tolist(), marks[i:].tolist())] for i in range(len(text))]
        first = np.append(True, text[:-1] == 0)
        assert repeats.shard_order(text, first).tolist() == sorted(range(len(text)), key=said.__getitem__)


def test_pieces_do_not_depend_on_what_is_hashed_together(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab c", k=rng.choice((0, 10, 49, 50, 51, 300, 3000)))).encode() for _ in range(60)]
    sizes, hot = np.array([len(t) for t in texts]), np.array([1, 2])

    def found(limit):
        monkeypatch.setattr(repeats, "HASHED_BYTES", limit)
        return sorted(zip(*(x.tolist() for x in repeats.pieces(b"".join(texts), sizes, 50, hot, 5))))

    assert found(1) == found(500) == found(1 << 20) != []
    assert [len(x) for x in repeats.pieces(b"", np.zeros(0, np.int64), 50, hot, 5)] == [0] * 5


def test_empty_table(spark):
    assert got(repeats.deduplicated(spark.createDataFrame([], KIND))) == Counter()
