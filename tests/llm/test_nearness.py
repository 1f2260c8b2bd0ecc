"""The similarity join against all pairs, on small tables."""

import random
import re
from collections import Counter

import numpy as np
from scholarlens.llm import nearness, queries

KIND = "doc_id long, text string, row string, keys string, first string"


def sets_of(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        out.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def plain(rows):
    """(class, links) per row: every two texts with a common shingle are compared."""
    sets = sets_of([t for _, t in rows])
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in where[x] if j < i).items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return [(k, least[find(i)], links[i]) for i, (k, _) in enumerate(rows)]


def test_all_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in queries.op4_jaccard_join(spark, sf).select(
        "doc_id", "class_id", "n_links").collect())
    assert got == sorted(plain(rows)) and any(r[2] for r in got)


def test_group_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(nearness, "BLOCK_SHINGLES", 2000)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(120)] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
    # a chain, each like the next one only
    rows += [(1000 + i, " ".join(f"c{j}" for j in range(i * 5, i * 5 + 100))) for i in range(12)]
    docs = spark.createDataFrame([(k, t, "r", "k", "f") for k, t in rows], KIND)
    got = sorted((r["row"]["doc_id"], r["class_id"], r["n_links"]) for r in nearness.joined(docs).collect())
    assert got == sorted(plain(rows))
    kept = nearness.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for _, c, _ in got}


def test_loose_group_has_few_tiles(spark, monkeypatch):
    counted, real = {}, nearness.written
    monkeypatch.setattr(nearness, "written", lambda df, label: counted.setdefault(label, []).append(
        real(df, label)) or counted[label][-1])
    rng = random.Random(6)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(200)]
    rows = []
    for i in range(300):  # like the base, hardly any two alike enough to be linked
        w = list(base)
        for j in rng.sample(range(200), 6):
            w[j] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame([(k, t, "r", "k", "f") for k, t in rows], KIND)
    got = sorted((r["row"]["doc_id"], r["class_id"], r["n_links"]) for r in nearness.joined(docs).collect())
    assert got == sorted(plain(rows))
    # one row a class and tile: as many tiles as one home fills, not one for each two classes
    assert counted["tiles"][-1].count() <= 10 and counted["links"][-1].count() <= 2 * len(rows)


def test_odd_rows(spark):
    texts = [None, "", " \n", "one", "ONE", "a b c d", "a b c d e", "long " * 60000, "long " * 70000, "é 😀 b c d e"]
    rows = [(i, t, "r", "k", "f") for i, t in enumerate(texts)]
    rows += [(3, "one", None, None, None), (None, "one", "", "", ""), (None, None, "", "", "")]
    docs = spark.createDataFrame(rows, KIND)
    got = [(r["row"]["doc_id"], r["class_id"], r["n_links"], r["first"]) for r in nearness.joined(docs).collect()]
    assert len(got) == len(rows)
    assert sorted((str(a), c, n) for a, c, n, _ in got if c == 3) == [("3", 3, 3), ("3", 3, 3), ("4", 3, 3), ("None", 3, 3)]
    assert sum(f for a, c, n, f in got if c == 3) == 1 and (8, 7, 1, False) in got
    assert all(n == 0 and f for a, c, n, f in got if a in (0, 1, 2, 5, 6, 9))
    assert nearness.joined(docs.limit(0)).count() == 0


def test_candidates_meet_the_target():
    rng = np.random.default_rng(2)
    depth = nearness.depth_for(0.8, nearness.TREES, nearness.DEEPEST, nearness.TARGET_RECALL)
    assert nearness.recall(0.8, depth, nearness.TREES) >= nearness.TARGET_RECALL
    met = 0
    for _ in range(300):
        x = rng.integers(0, 2 ** 63, 900, np.uint64)
        a, b = (nearness.prefixes(y, depth, nearness.TREES) for y in (x[:810], x[90:]))
        met += bool((a == b).any())  # similarity 0.8
    assert met >= 298


def test_one_of_each_class_whatever_the_columns(spark):
    kind = "doc_id long, text string, ticket string, kept string, set_id string, head string, n string"
    rows = [(2, "a b c d e f", "t", "k", "s", "h", "n"), (1, "A b c d e f", "t", "k", "s", "h", "n"),
            (None, "a b c d e f", None, None, None, None, None), (4, None, "", "", "", "", ""),
            (5, "", "", "", "", "", ""), (5, "", "", "", "", "", ""), (6, "other words", "", "", "", "", "")]
    docs = spark.createDataFrame(rows, kind)
    kept = nearness.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted((rows[i] for i in (1, 3, 4, 5, 6)), key=str)
    assert nearness.keep_one(docs.limit(0)).count() == 0
    numbers = spark.createDataFrame([(1, 77), (2, 77), (3, 78), (4, None)], "doc_id long, text int")
    assert sorted(r["doc_id"] for r in nearness.keep_one(numbers).collect()) == [1, 3, 4]
