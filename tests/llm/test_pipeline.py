"""Each stage of the pipeline against what it must keep of its own input."""

import os
from collections import Counter

import brute
from test_nearness import plain
from test_tokens import plain_hits, plain_tokens

import corpus_pipeline
from scholarlens import session
from scholarlens.llm import mixing
from scholarlens.session import written

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows, steps = docs.columns, [docs.collect()], [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(written(stage(spark, steps[-1], SF), name))
        rows.append(steps[-1].collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert steps[-1].columns == columns
    raw, good, single, clean, mixed, packed = rows
    assert {r["doc_id"] for r in good} <= {r["doc_id"] for r in raw if not brute.quality(r["text"])[5]}
    assert all(r in raw for r in good) and len(good) > len(raw) / 2
    classes = plain([(r["doc_id"], r["text"]) for r in good])
    assert sorted(r["doc_id"] for r in single) == sorted({c for _, c, _ in classes})
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = [x[4] for x in plain_hits([r["text"] for r in single], items)]
    assert sorted(r["doc_id"] for r in clean) == sorted(r["doc_id"] for r, h in zip(single, hit) if not h)
    copies = {r["row"]["doc_id"]: r["n_copies"] for r in mixing.planned(steps[3]).collect()}
    assert Counter(r["doc_id"] for r in mixed) == copies and min(copies.values()) >= 1
    ordered = sorted(((r["doc_id"], r["text"]) for r in mixed), key=lambda r: r[0])
    assert sorted(tuple(r) for r in packed) == sorted(plain_tokens(ordered))


def test_empty_table_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300).selectExpr(
        "*", "doc_id as row", "lang as m", "text as text_", "source as found", "n_chars as key")
    odd = docs.limit(2).selectExpr(*[f"cast(null as {t}) as {c}" for c, t in docs.dtypes])
    for rows in (docs.unionAll(odd), docs.limit(0)):
        step = written(rows, "docs")
        for name, stage in corpus_pipeline.STAGES:
            before, step = step, written(stage(spark, step, SF), name)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert step.columns == docs.columns
        assert before.count() == step.count() and (step.count() > 0) == (rows.count() > 0)


def test_stages_free_the_scratch_of_the_one_before(spark):
    docs, left = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = written(stage(spark, docs, SF), name)
        left.append([p for (_, scope), paths in session._SCOPES.items() if scope == name for p in paths])
    root = "file:" if left[0][0].startswith("file:") else ""
    on_disk = lambda paths: [os.path.exists(p.removeprefix(root).replace("//", "/")) for p in paths]
    assert not any(on_disk(left[0])) and not any(on_disk(left[1]))
