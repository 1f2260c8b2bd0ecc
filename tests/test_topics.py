import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholarlens.operators import gram as GR
from scholarlens.operators import text as X
from scholarlens.operators import topic_fit as TF
from scholarlens.operators import topic_quality as Q
from scholarlens.operators import topic_tables as T


def planted(spark, n_docs=240, k=3, words=12, seed=1):
    """Documents that draw most words from one of k separate word lists."""
    rng = random.Random(seed)
    rows = []
    for d in range(n_docs):
        main = d % k
        counts = {}
        for _ in range(60):
            topic = main if rng.random() < 0.9 else rng.randrange(k)
            word = f"t{topic}w{min(int(rng.expovariate(0.3)), words - 1):02d}"
            counts[word] = counts.get(word, 0) + 1
        rows += [(d, 2000 + main * 5, w, c) for w, c in counts.items()]
    return spark.createDataFrame(rows, "doc_id long, year int, term string, cnt long")


@pytest.fixture(scope="module")
def fitted(spark):
    corpus = TF.build_corpus(planted(spark))
    return corpus, TF.fit_models(corpus, [3, 4], max_em_its=60)


def test_tokens_cover_the_whole_text(spark):
    docs = spark.createDataFrame([(1, "The Äpfel, x1 ab-cde!\nEND of FILE"), (2, "a 12")],
                                 "doc_id long, text string")
    words = sorted(r.term for r in X.tokens(docs, "text").collect())
    assert words == ["cde", "end", "file", "the", "äpfel"]
    kept = X.without_stopwords(X.tokens(docs, "text"), custom=("end",))
    assert sorted(r.term for r in kept.collect()) == ["cde", "file", "äpfel"]


def test_pruning_is_strict_and_reports_lost_documents(spark):
    rows = [(d, "common", 1) for d in range(11)] + [(d, "ten", 1) for d in range(10)]
    rows += [(99, "rare", 4)]
    counts = spark.createDataFrame(rows, "doc_id long, term string, cnt long")
    pruned = X.prune(counts, 10)
    assert {r.term for r in pruned.collect()} == {"common"}
    assert [r.doc_id for r in X.removed_documents(counts, pruned).collect()] == [99]
    sweep = {r.threshold: (r.docs_removed, r.words_removed, r.tokens_removed)
             for r in X.threshold_sweep(counts, 1, 21, 10).collect()}
    assert sweep == {1: (1, 1, 4), 11: (12, 3, 25), 21: (12, 3, 25)}


def test_stemmed_counts_keep_tokens(spark):
    counts = spark.createDataFrame([(1, "plants", 2), (1, "planted", 3), (2, "plant", 1)],
                                   "doc_id long, term string, cnt long")
    out = {(r.doc_id, r.term): r.cnt for r in X.stemmed(counts).collect()}
    assert out == {(1, "plant"): 5, (2, "plant"): 1}


def test_vocabulary_is_dense_and_ordered(spark):
    vocab = X.vocabulary(planted(spark, 30)).orderBy("term_id").collect()
    assert [r.term_id for r in vocab] == list(range(1, len(vocab) + 1))
    assert [r.term for r in vocab] == sorted(r.term for r in vocab)


def gram_of(counts, vocab):
    """The mean co-occurrence matrix, document by document."""
    n, local = vocab.count(), counts.join(vocab, "term").toPandas()
    docs = [(d.term_id.to_numpy() - 1, d.cnt.to_numpy()) for _, d in local.groupby("doc_id")]
    docs = [(i, c) for i, c in docs if c.sum() >= 2]
    out = np.zeros((n, n))
    for i, c in docs:
        h = np.zeros(n)
        h[i] = c
        out += (np.outer(h, h) - np.diag(h)) / (h.sum() * (h.sum() - 1)) / len(docs)
    return out


def rows_of(corpus, blocks):
    n, size = corpus.n_terms, corpus.block_terms
    out = {r.block: np.frombuffer(r.v) for r in blocks.where("block >= 0").collect()}
    return np.concatenate([out[b].reshape(min(size, n - b * size), -1) for b in sorted(out)])


@pytest.mark.parametrize("tile,cells", [(512, 1 << 21), (7, 100)])
def test_gram_equals_brute_force(spark, tile, cells):
    counts = planted(spark, 40).union(spark.createDataFrame([(99, 2000, "single", 1)], "a long, b int, c string, d long"))
    corpus = TF.build_corpus(counts, shard_cells=cells)
    want = gram_of(counts, corpus.vocab)
    rows = GR.cooccurrences(corpus, tile).collect()
    got = np.zeros(want.shape)
    for r in rows:
        got[r.row, r.col] += r.value
    assert np.allclose(got, want)
    assert len({(r.row, r.col) for r in rows}) == len(rows) == np.count_nonzero(want)


@pytest.mark.parametrize("held,room", [(GR.HELD_CELLS, GR.ROW_BYTES), (300, 2000)])
def test_row_summaries_equal_brute_force(spark, held, room):
    counts = planted(spark, 40).union(spark.createDataFrame([(99, 2000, "single", 1)], "a long, b int, c string, d long"))
    corpus = TF.build_corpus(counts)
    want = gram_of(counts, corpus.vocab)
    got = {r.row: r for r in GR.row_summaries(corpus, held, room).collect()}
    assert sorted(got) == np.flatnonzero(want.any(1)).tolist()
    for i, r in got.items():
        assert r.partners == np.count_nonzero(want[i])
        assert np.allclose([r.weight, r.strongest], [want[i].sum(), want[i].max()])


def test_start_uses_exact_products_of_all_words(spark):
    counts = planted(spark, 60)
    corpus = TF.build_corpus(counts, block_terms=10)
    want = gram_of(counts, corpus.vocab)
    products = rows_of(corpus, GR.anchor_products(corpus, [3, 17]))
    weight = want.sum(1)
    assert np.allclose(products[:, -1] / 60, weight)
    assert np.allclose(products[:, :2] / 60 ** 2, want @ want[:, [3, 17]])


def greedy(rows, k):
    """Indexes of k rows, each farthest from the span of those before."""
    basis, out = np.zeros((0, rows.shape[1])), []
    for _ in range(k):
        left = (rows ** 2).sum(1) - ((rows @ basis.T) ** 2).sum(1)
        left[out] = -1
        out.append(int(left.argmax()))
        rest = rows[out[-1]] - basis.T @ (basis @ rows[out[-1]])
        basis = np.vstack([basis, rest / np.linalg.norm(rest)])
    return out


def test_anchors_are_greedy_on_the_projected_rows(spark):
    counts = planted(spark, 120)
    corpus = TF.build_corpus(counts)
    gram = gram_of(counts, corpus.vocab)
    n, width = corpus.n_terms, 128
    projected = rows_of(corpus, GR.projected_rows(corpus, width))
    marks = GR.signs(np.arange(n), width) / np.sqrt(width)
    assert np.allclose(projected / 120, np.hstack([gram @ marks, gram.sum(1, keepdims=True)]))
    scaled = gram / gram.sum(1, keepdims=True)
    anchors = TF.anchors_of(corpus, 3)
    assert anchors == greedy(scaled @ marks, 3)
    topic = [r.term[:2] for r in corpus.vocab.orderBy("term_id").collect()]
    assert len({topic[a] for a in anchors}) == 3


def test_projected_rows_in_slices(spark, monkeypatch):
    corpus = TF.build_corpus(planted(spark, 60), shard_cells=100, block_terms=5)
    want = rows_of(corpus, GR.projected_rows(corpus, 20))
    passes, run = [], GR.shard_pass
    monkeypatch.setattr(GR, "shard_pass", lambda *a: (passes.append(a), run(*a))[1])
    got = rows_of(corpus, GR.projected_rows(corpus, 20, slice_bytes=1))
    assert len(passes) > 2 and got.shape == (corpus.n_terms, 21) and np.allclose(got, want)


def test_anchors_reach_rare_words_of_a_large_vocabulary(spark):
    """Two words beyond the 10,000 most frequent part their documents from all others."""
    rows = [(d, 2000, f"w{(d * 40 + i) % 12_000:05d}", 2) for d in range(600) for i in range(40)]
    rows += [(1000 + d, 2000, w, 1) for d in range(2) for w in ("zrare", "ztwin")]
    corpus = TF.build_corpus(spark.createDataFrame(rows, "doc_id long, year int, term string, cnt long"))
    ids = {r.term_id - 1 for r in corpus.vocab.where("term in ('zrare', 'ztwin')").collect()}
    assert corpus.n_terms == 12_002 and set(TF.anchors_of(corpus, 2)) & ids


def test_fit_does_not_depend_on_the_layout(spark, fitted):
    counts = planted(spark)
    whole = TF.fit_models(TF.build_corpus(counts), [3], max_em_its=4, tol=0)[3]
    corpus = TF.build_corpus(counts, shard_cells=200, block_terms=5)
    assert len(corpus.shards) > 8
    cut = TF.fit_models(corpus, [3], max_em_its=4, tol=0)[3]
    assert np.allclose(whole.bounds, cut.bounds)
    assert np.allclose(whole.bounds, fitted[1][3].bounds[:4])
    theta = [TF.model_theta(c, [m]).orderBy("doc_id", "topic").toPandas().theta
             for c, m in ((fitted[0], whole), (corpus, cut))]
    assert np.allclose(*theta)


def test_a_fit_ends_when_its_bound_settles(fitted):
    _, models = fitted
    for m in models.values():
        last = abs(m.bounds[-1] - m.bounds[-2]) < 1e-5 * abs(m.bounds[-2])
        assert m.converged == last and len(m.bounds) <= 60
    assert models[3].converged and models[3].unsettled == 0


def test_residuals_equal_brute_force(fitted):
    corpus, models = fitted
    shares = TF.doc_shares(corpus, list(models.values()))
    got = {r.k: r for r in TF.residual_dispersion(
        corpus, shares, TF.share_blocks(list(models.values())), {k: m.totals for k, m in models.items()}).collect()}
    local = corpus.counts.join(corpus.vocab, "term").toPandas()
    for k, m in models.items():
        b = rows_of(corpus, m.shares) / m.totals
        ss, cells = 0.0, 0
        theta = {r.doc_id: np.array(r.shares) for r in shares.where(F.col("k") == k).collect()}
        for d, doc in local.groupby("doc_id"):
            h = np.zeros(corpus.n_terms)
            h[doc.term_id - 1] = doc.cnt
            n, q = h.sum(), b @ theta[d]
            ss += ((h - n * q) ** 2 / (n * q * (1 - q))).sum()
            cells += (n * q > 0.01).sum()
        free = cells - len(theta) * (k - 1) - k * (corpus.n_terms - 1)
        assert got[k].docs == len(theta) and got[k].df == free
        assert got[k].ss == pytest.approx(ss)


def test_modes_lay_out_only_what_is_still_open(monkeypatch):
    rng = np.random.default_rng(3)
    beta, sizes = rng.dirichlet(np.full(500, 0.2), 5).T, rng.integers(1, 200, 60)
    cells = np.concatenate([rng.choice(500, n, replace=True) for n in sizes])
    chunk = TF._DocumentChunk(np.repeat(np.arange(60), sizes), rng.integers(1, 4, len(cells)) * 1.0,
                              beta[cells], np.zeros((60, 4)), np.eye(4) / 20)
    laid, weights = [], TF._DocumentChunk.weights
    monkeypatch.setattr(TF._DocumentChunk, "weights", lambda c, s: (laid.append(len(c.cnt)), weights(c, s))[1])
    eta, late = chunk.modes()
    assert late == 0
    # the step to the mode is evaluated once and read again by the next round
    assert sum(n == len(cells) for n in laid) <= 12 and sum(laid) < 20 * len(cells)
    share = chunk.shares(eta)
    topics, counted = chunk.word_topics(*weights(chunk, share))
    assert np.allclose(topics.sum(0), 1)
    assert np.abs((chunk.size[:, None] * share - counted)[:, :-1] + eta / 20).max() < 1e-3


@pytest.mark.parametrize("k", [5, 20])
def test_residual_sums_of_a_block(k, monkeypatch):
    monkeypatch.setattr(TF, "DENSE_CELLS", 5000)
    rng = np.random.default_rng(k)
    b = rng.dirichlet(0.5 / np.arange(1, 4001) ** 0.8, k).T
    shares, size = rng.dirichlet(np.ones(k), 200), rng.integers(1, 20_000, 200).astype(float)
    size[:3] = 1, 2, 1e6
    q = shares @ b.T
    m = size[:, None]
    assert math.isclose(TF._odds_sum(size, shares, b), (m * q / (1 - q)).sum(), rel_tol=1e-12)
    assert TF._cells_over(size, shares, b) == (m * q > 0.01).sum()
    seen = []
    monkeypatch.setattr(TF.np, "clip", lambda x, *_: (seen.append(x.size), np.minimum(x, 1))[1])
    TF._cells_over(size, shares, b)
    assert sum(seen) < 0.5 * q.size  # most answers need no product


def test_fit_recovers_planted_topics(spark, fitted):
    corpus, models = fitted
    model = models[3]
    assert len(set(model.anchors)) == 3
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(model.bounds, model.bounds[1:]))
    assert np.allclose(rows_of(corpus, model.shares).sum(axis=0), model.totals)
    theta = TF.model_theta(corpus, [model]).toPandas().pivot(
        index="doc_id", columns="topic", values="theta")
    assert len(theta) == 240 and np.allclose(theta.sum(axis=1), 1, atol=1e-6)
    best = theta.idxmax(axis=1)
    groups = best.groupby(best.index % 3).agg(lambda s: s.mode()[0])
    assert groups.nunique() == 3
    assert (best == (best.index % 3).map(groups)).mean() > 0.97
    lists = T.word_lists(TF.model_beta(corpus, [model]), 4, keys=("k", "topic")).collect()
    assert {tuple({w[:2] for w in r.top_words.split(",")}) for r in lists} == {
        ("t0",), ("t1",), ("t2",)}


def test_held_out_mask_is_stable_and_partial(spark):
    counts = planted(spark)
    a, b = (Q.held_out_mask(counts, seed=1).where("hidden") for _ in range(2))
    assert a.exceptAll(b).count() == 0
    assert 0 < a.select("doc_id").distinct().count() < 80
    assert a.exceptAll(Q.held_out_mask(counts, seed=2).where("hidden")).count() > 0


def test_masked_score_reads_every_word_and_the_hidden_ones_apart(spark):
    masked = spark.createDataFrame(
        [(1, "a", 2, False), (1, "b", 1, True), (2, "a", 3, False), (2, "b", 1, False)],
        "doc_id long, term string, cnt long, hidden boolean")
    theta = spark.createDataFrame([(d, t, 0.5) for d in (1, 2) for t in (1, 2)],
                                  "doc_id long, topic int, theta double")
    beta = spark.createDataFrame(
        [(t, w, math.log(p)) for t, ps in ((1, (.5, .5)), (2, (.3, .7))) for w, p in zip("ab", ps)],
        "topic int, term string, logbeta double")
    a, b = math.log(.4), math.log(.6)
    row, = Q.masked_score(masked, theta, beta).collect()
    assert (row.docs, row.tokens, row.hidden_docs, row.hidden_tokens) == (2, 7, 1, 1)
    assert math.isclose(row.score, ((2 * a + b) / 3 + (3 * a + b) / 4) / 2)
    assert math.isclose(row.heldout, b)
    row, = Q.masked_score(masked.withColumn("hidden", F.lit(False)), theta, beta).collect()
    assert (row.hidden_docs, row.hidden_tokens, row.heldout) == (0, 0, None)


def test_scores_in_shards_equal_those_of_long_tables(spark):
    masked = Q.held_out_mask(planted(spark, 90), 0.5, 0.5, seed=1).select("doc_id", "term", "cnt", "hidden")
    theta = spark.createDataFrame([(d, [0.2, 0.5, 0.3]) for d in range(90)], "doc_id long, shares array<double>")
    terms = [r.term for r in masked.select("term").distinct().collect()]
    rows = [(k, t, w, 1.0 / (3 + t * i % 7)) for k in (1, 2) for t in (1, 2, 3) for i, w in enumerate(terms) if k == 1 or i % 3]
    beta = spark.createDataFrame(rows, "k int, topic int, term string, beta double")
    got = TF.shard_scores(masked, theta, {k: beta.where(F.col("k") == k) for k in (1, 2)}, 3)
    want = Q.masked_score(masked, theta.select("doc_id", F.posexplode("shares").alias("topic", "theta")).select(
        F.explode(F.array(F.lit(1), F.lit(2))).alias("k"), "doc_id", F.col("topic") + 1, "theta").toDF(
        "k", "doc_id", "topic", "theta"), beta.withColumn("logbeta", F.log("beta")), ("k",))
    want = {r.k: r for r in want.collect()}
    for r in got.collect():
        assert r[:3] == want[r.k][:3] and r[4:6] == want[r.k][4:6] and r.hidden_tokens > 0
        assert math.isclose(r.score, want[r.k].score) and math.isclose(r.heldout, want[r.k].heldout)
    assert len(want) == 2


def test_heldout_query_scores_all_words(spark, sf):
    from scholarlens.plans.topics import tm_heldout
    from scholarlens.sources import testviews as v
    counts, levels = v.stored_tok(spark, sf), (1, 2)
    known = v.beta(spark, sf, counts).select("level", "term").distinct()
    want = {r.level: r.n for r in counts.join(known, "term").groupBy("level").agg(
        F.sum("cnt").alias("n")).collect()}
    rows = {r.level: r for r in tm_heldout(spark, sf).collect()}
    assert {k: rows[k].tokens for k in levels} == want
    assert all(0 < rows[k].hidden_tokens < rows[k].tokens for k in levels)


def test_coherence_by_hand(spark):
    counts = spark.createDataFrame(
        [(1, "a", 1), (1, "b", 1), (2, "a", 2), (3, "b", 1), (3, "c", 1), (4, "a", 1)],
        "doc_id long, term string, cnt long")
    beta = spark.createDataFrame([(1, "a", -0.1), (1, "b", -0.2), (1, "c", -0.3)],
                                 "topic int, term string, logbeta double")
    want = math.log(2 / 3) + math.log(1 / 3) + math.log(2 / 2)
    assert Q.semantic_coherence(counts, beta, 3).first().coherence == pytest.approx(want)


def test_front_index_and_graph(spark):
    metrics = spark.createDataFrame(
        [(1, 5.0, 1.0), (2, 4.0, 2.0), (3, 4.0, 1.5), (4, 4.0, 2.0), (5, 3.0, 2.0)],
        "k int, exclusivity double, coherence double")
    assert sorted(r.k for r in T.pareto_front(metrics).collect()) == [1, 2, 4]
    changes = spark.createDataFrame([(1, 0.5), (2, -1.0), (3, 0.25)], "topic int, change double")
    own = {r.topic: r.change_index for r in T.change_index(changes).collect()}
    assert own == {1: 500, 2: 500, 3: 250}
    ref = {r.topic: r.change_index for r in T.change_index(changes, reference_scale=True).collect()}
    assert ref == {1: 500, 2: 1000, 3: 250}
    rng = np.random.default_rng(0)
    shares = rng.dirichlet([1, 1, 3], 200)
    shares[:, 1] = shares[:, 0] * 0.8 + 0.05
    rows = [(d, t + 1, float(v)) for d, doc in enumerate(shares) for t, v in enumerate(doc)]
    theta = spark.createDataFrame(rows, "doc_id long, topic int, theta double")
    edges = {(r.src, r.dst): r["corr"] for r in T.topic_correlations(theta).collect()}
    want = np.corrcoef(shares.T)
    assert set(edges) == {(1, 2)} and edges[(1, 2)] == pytest.approx(want[0, 1])
