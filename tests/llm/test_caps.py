"""Links among embeddings against all pairs."""

import duckdb
import numpy as np
import pytest

from scholarlens.llm import caps
from scholarlens.llm.queries import ORACLES, op13_embedding_links

SCHEMA = "vec_id long, embedding array<float>"


def brute(ids, vectors, threshold=0.95):
    """Number of links and least id of the component of every row."""
    usable = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
              for v in vectors]
    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if ok else None
            for v, ok in zip(vectors, usable)]
    n = len(ids)
    linked = [[j for j in range(n) if j != i and usable[i] and usable[j] and len(unit[i]) == len(unit[j])
               and unit[i] @ unit[j] >= threshold] for i in range(n)]
    lead = list(range(n))

    def root(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i, partners in enumerate(linked):
        for j in partners:
            lead[root(i)] = root(j)
    least = {}
    for i in range(n):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [len(x) for x in linked], [least[root(i)] for i in range(n)]


def planted(seed, d, spread, n=300):
    """Far vectors, a large group around one, a chain, equal copies, and shorter and longer ones."""
    rng = np.random.default_rng(seed)
    near = lambda c, s: c + s * rng.standard_normal(d) * np.linalg.norm(c) / np.sqrt(d)
    out = list(rng.standard_normal((n, d)))
    out += [near(out[0], spread) for _ in range(n // 2)]
    at = out[1]
    for _ in range(12):
        at = near(at, 0.25)
        out.append(at)
    out += [out[2]] * 40 + [3 * out[3], -out[4], out[5] * 1e-6]
    order = rng.permutation(len(out))
    return [[float(np.float32(x)) for x in out[i]] for i in order]


@pytest.mark.parametrize("d,spread,rows", [(64, 0.05, 2048), (64, 0.05, 32), (64, 0.2, 32), (16, 0.15, 16)])
def test_planted_groups(spark, monkeypatch, d, spread, rows):
    monkeypatch.setattr(caps, "ROWS", rows)
    vectors = planted(d, d, spread)
    ids = list(range(1000, 1000 + len(vectors)))
    n_links, component = brute(ids, vectors)
    found = {r.row.vec_id: r for r in caps.linked(
        spark.createDataFrame([*zip(ids, vectors)], SCHEMA)).collect()}
    assert len(found) == len(ids)
    got = [found[i].n_links for i in ids]
    assert all(a <= b for a, b in zip(got, n_links))
    assert sum(got) >= 0.98 * sum(n_links)
    same = [found[i].component_id == c for i, c in zip(ids, component)]
    assert np.mean(same) >= 0.98
    assert all(found[i].kept == (found[i].component_id == i) for i in ids)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((600, 64))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.9501 * x + np.sqrt(1 - 0.9501 ** 2) * z
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    found = caps.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert found.where("n_links > 0").count() >= 0.98 * 1200


def test_vectors_that_link_with_nothing(spark):
    bad = [None, [], [0.0, 0.0], [1.0, None], [1.0, float("nan")], [float("inf"), 1.0]]
    rows = [(i, v, i, "x") for i, v in enumerate(bad + bad)]
    rows += [(100, [1.0, 2.0], 1, "x"), (101, [2.0, 4.0], 1, "x"), (101, [2.0, 4.0], 1, "x"),
             (102, [1.0, 2.0, 0.0], 1, "x"), (None, [5.0, 10.0], 1, "x")]
    frame = spark.createDataFrame(rows, "key long, v array<double>, node long, ball string")
    found = caps.linked(frame, "key", "v").collect()
    got = sorted((-1 if r.row.key is None else r.row.key, r.n_links,
                  -1 if r.component_id is None else r.component_id, r.kept) for r in found)
    assert got == sorted([(i, 0, i, True) for i in range(12)] + [
        (100, 3, 100, True), (101, 3, 100, False), (101, 3, 100, False), (102, 0, 102, True),
        (-1, 3, 100, False)])


def test_integers_and_empty_table(spark):
    frame = spark.createDataFrame([(1, [1, 2]), (2, [10, 20]), (3, [-1, 2])], "vec_id long, embedding array<int>")
    assert sorted((r.row.vec_id, r.n_links) for r in caps.linked(frame).collect()) == [(1, 1), (2, 1), (3, 0)]
    assert caps.linked(frame.limit(0)).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{sf}/embeddings.parquet'")
    want = con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({ORACLES['op13_embedding_links']})")
    assert sorted(map(tuple, op13_embedding_links(spark, sf).collect())) == sorted(want.fetchall())


def test_sql_equals_brute_force():
    vectors = planted(9, 8, 0.1, 40)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [*enumerate(vectors)])
    want = [*zip(*brute([*range(len(vectors))], vectors))]
    got = con.execute(f"SELECT n_links, component_id FROM ({ORACLES['op13_embedding_links']}) ORDER BY vec_id")
    assert [tuple(r) for r in got.fetchall()] == want
