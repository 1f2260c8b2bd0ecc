"""Topic tables and quality metrics on fixed theta and beta."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholarlens.functions import columns as C
from scholarlens.operators import topic_quality as Q
from scholarlens.operators import topic_tables as T
from scholarlens.operators.text import prune
from scholarlens.operators.topic_fit import build_corpus, residual_dispersion, shard_scores, word_blocks
from scholarlens.plans.registry import query, r6
from scholarlens.session import scratch_path, written
from scholarlens.sources import readers, writers
from scholarlens.sources import testviews as v

CUT = v.RECENT_DOC
JUNK = (2,)
BOTH = ("level", "topic")
_PREV = f"""
    WITH prev AS (SELECT topic, avg(theta) AS theta_all,
                         avg(theta) FILTER (WHERE year > {CUT}) AS theta_recent,
                         avg(theta) FILTER (WHERE year <= {CUT}) AS theta_pre
                  FROM v_theta GROUP BY 1)
"""
_WORDS = """
    words AS (SELECT level, topic, term, logbeta, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY level, topic ORDER BY logbeta DESC, term) AS rank
        FROM {source}) WHERE rank <= {n}),
    lists AS (SELECT level, topic, string_agg(term, '{sep}' ORDER BY rank) AS top_words
              FROM words GROUP BY 1, 2)
"""


def words_sql(n: int, sep: str = ",", source: str = "v_beta") -> str:
    return _WORDS.format(n=n, sep=sep, source=source)


#: Word shares of the whole corpus as the only level.
_ALL = "(SELECT 1 AS level, * FROM v_beta_all)"


def prev(spark, sf):
    return T.prevalence(v.theta(spark, sf), CUT)


# --- top documents and words -----------------------------------------------------------------

_TOP_DOCS = """
    SELECT topic, doc_id, year, rank, theta FROM (
        SELECT *, row_number() OVER (PARTITION BY topic ORDER BY theta DESC, doc_id) AS rank
        FROM v_theta) WHERE rank <= 25
"""


@query("win_top_docs", "v_theta", f"""
    SELECT topic, doc_id, CAST(rank AS INTEGER) AS rank, round(theta, 6) AS theta
    FROM ({_TOP_DOCS})""")
def win_top_docs(spark, sf):
    return T.top_documents(v.theta(spark, sf)).select("topic", "doc_id", "rank",
                                                      r6("theta", "theta"))


@query("win_top_words", "v_beta", "WITH " + words_sql(15).strip() + """
    SELECT level, topic, term, CAST(rank AS INTEGER) AS rank, round(logbeta, 6) AS logbeta
    FROM words""")
def win_top_words(spark, sf):
    return T.top_words(v.beta(spark, sf), 15, keys=BOTH).select(
        "level", "topic", "term", "rank", r6("logbeta", "logbeta"))


@query("fn_unite", "v_beta", "WITH " + words_sql(10, ", ").strip() + """
    SELECT level, topic, top_words FROM lists""")
def fn_unite(spark, sf):
    return T.word_lists(v.beta(spark, sf), 10, ", ", keys=BOTH)


@query("fn_format_label", "v_beta", "WITH " + words_sql(3, ", ").strip() + """
    SELECT level, topic, 'Topic ' || topic || ': ' || top_words AS label FROM lists""")
def fn_format_label(spark, sf):
    lists = T.word_lists(v.beta(spark, sf), 3, ", ", keys=BOTH)
    return lists.select("level", "topic", C.topic_label("topic", "top_words").alias("label"))


@query("gen_topic_labels", "v_theta", f"""
    SELECT topic, count(*) AS documents FROM ({_TOP_DOCS}) GROUP BY 1""")
def gen_topic_labels(spark, sf):
    """Topic id repeated per top document, as a key of the ranked table."""
    return T.top_documents(v.theta(spark, sf)).groupBy("topic").agg(
        F.count("*").alias("documents"))


@query("fn_row_ordinal", "v_theta", """
    SELECT doc_id, topic, round(theta, 6) AS theta FROM v_theta""")
def fn_row_ordinal(spark, sf):
    """Position in a share vector as topic id."""
    return v.theta_vectors(spark, sf).select("doc_id", F.posexplode("shares").alias("pos", "theta")).select(
        "doc_id", (F.col("pos") + 1).alias("topic"), r6("theta", "theta"))


@query("fn_round2", "v_theta", "SELECT doc_id, topic, round(theta, 2) AS theta FROM v_theta")
def fn_round2(spark, sf):
    return v.theta(spark, sf).select("doc_id", "topic", F.round("theta", 2).alias("theta"))


@query("join_theta_lookup", "v_theta", f"""
    SELECT topic, doc_id, round(theta, 6) AS theta FROM ({_TOP_DOCS})""")
def join_theta_lookup(spark, sf):
    """Share of given (document, topic) pairs by an equality join."""
    theta = v.theta(spark, sf)
    pairs = T.top_documents(theta).select("doc_id", "topic")
    return theta.join(F.broadcast(pairs), ["doc_id", "topic"]).select("topic", "doc_id", r6("theta", "theta"))


@query("join_doc_meta", "v_theta v_doc", f"""
    SELECT t.topic, t.rank::INTEGER AS rank, d.id AS doc_id, d.year, d.source, d.lang
    FROM ({_TOP_DOCS}) t JOIN v_doc d ON t.doc_id = d.id""")
def join_doc_meta(spark, sf):
    best = T.top_documents(v.theta(spark, sf)).select("topic", "rank", "doc_id")
    meta = v.doc(spark, sf).select(F.col("id").alias("doc_id"), "year", "source", "lang")
    return meta.join(F.broadcast(best), "doc_id")


@query("join_topic_words", "v_theta v_beta_all", "WITH " + words_sql(15, source=_ALL).strip() + f"""
    SELECT t.topic, t.doc_id, l.top_words FROM ({_TOP_DOCS}) t
    LEFT JOIN lists l ON t.topic = l.topic""")
def join_topic_words(spark, sf):
    words = v.stored_tok(spark, sf)
    best = T.top_documents(v.theta(spark, sf, words)).select("topic", "doc_id")
    return best.join(T.word_lists(v.beta_all(spark, sf, words), 15), "topic", "left")


_REPORT = f"""
    SELECT t.topic, CAST(t.rank AS INTEGER) AS rank, t.doc_id, d.year, d.source, d.keywords,
           d.title, round(t.theta, 2) AS theta, l.top_words
    FROM ({_TOP_DOCS}) t JOIN v_doc d ON t.doc_id = d.id
    JOIN lists l ON t.topic = l.topic"""
REPORT_COLUMNS = ("year", "source", "keywords", "title")


def report(spark, sf):
    """Reports of models of several sizes in one job."""
    words = v.stored_tok(spark, sf)
    beta = v.beta_k(spark, sf, words).where("run = 1").drop("run")
    docs = v.doc(spark, sf).withColumnRenamed("id", "doc_id")
    return T.topic_report(v.theta_k(spark, sf, words), beta, docs, keys=("k", "topic"),
                          doc_columns=REPORT_COLUMNS)


_REPORT_K = """
    WITH words AS (SELECT k, topic, term, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY k, topic ORDER BY logbeta DESC, term) AS rank
        FROM v_beta_k WHERE run = 1) WHERE rank <= 15),
    lists AS (SELECT k, topic, string_agg(term, ',' ORDER BY rank) AS top_words FROM words GROUP BY 1, 2),
    best AS (SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY k, topic ORDER BY theta DESC, doc_id) AS rank
        FROM v_theta_k) WHERE rank <= 25)
    SELECT t.k, t.topic, CAST(t.rank AS INTEGER) AS rank, t.doc_id, d.year, d.source, d.keywords,
           d.title, round(t.theta, 2) AS theta, l.top_words
    FROM best t JOIN v_doc d ON t.doc_id = d.id JOIN lists l ON t.k = l.k AND t.topic = l.topic"""


@query("tm_topic_report", "v_theta_k v_beta_k v_doc", _REPORT_K)
def tm_topic_report(spark, sf):
    return report(spark, sf)


@query("prj_select_named", "v_theta v_beta_all v_doc",
       "WITH " + words_sql(15, source=_ALL).strip() + _REPORT)
def prj_select_named(spark, sf):
    words = v.stored_tok(spark, sf)
    docs = v.doc(spark, sf).withColumnRenamed("id", "doc_id")
    return T.topic_report(v.theta(spark, sf, words), v.beta_all(spark, sf, words), docs,
                          doc_columns=REPORT_COLUMNS)


@query("sink_csv_report", "v_theta_k v_beta_k v_doc", _REPORT_K)
def sink_csv_report(spark, sf):
    """The report written as headed CSV in one folder per model and read back."""
    table = report(spark, sf)
    path = scratch_path(spark, "report")
    writers.write_report(table, path, "k")
    return readers.read_csv(spark, path, table.schema).select(*table.columns)


# --- prevalence and change -------------------------------------------------------------------

@query("agg_topic_prevalence", "v_theta", _PREV + """
    SELECT topic, round(theta_all, 6) AS theta_all, round(theta_recent, 6) AS theta_recent,
           round(theta_pre, 6) AS theta_pre FROM prev""")
def agg_topic_prevalence(spark, sf):
    return prev(spark, sf).select("topic", *[r6(c, c) for c in
                                             ("theta_all", "theta_recent", "theta_pre")])


@query("agg_topic_group_sum", "v_theta", _PREV + """
    SELECT round(sum(theta_all), 6) AS theta_all, round(sum(theta_recent), 6) AS theta_recent
    FROM prev WHERE topic IN (3, 5)""")
def agg_topic_group_sum(spark, sf):
    return T.group_prevalence(prev(spark, sf), (3, 5)).select(
        r6("theta_all", "theta_all"), r6("theta_recent", "theta_recent"))


@query("agg_topic_change", "v_theta", _PREV + """
    SELECT topic, round((theta_recent - theta_pre) / theta_pre, 6) AS change FROM prev""")
def agg_topic_change(spark, sf):
    return T.topic_change(prev(spark, sf)).select("topic", r6("change", "change"))


@query("flt_exclude_topics", "v_theta", """
    SELECT topic, round(avg(theta), 6) AS theta_all FROM v_theta WHERE topic NOT IN (2)
    GROUP BY 1""")
def flt_exclude_topics(spark, sf):
    kept = T.without_topics(v.theta(spark, sf), JUNK)
    return T.prevalence(kept, CUT).select("topic", r6("theta_all", "theta_all"))


@query("agg_theta_hist", "v_theta", """
    SELECT topic, CAST(least(floor(theta * 20) + 1, 20) AS INTEGER) AS bin, count(*) AS docs
    FROM v_theta GROUP BY 1, 2""")
def agg_theta_hist(spark, sf):
    return T.theta_histogram(v.theta(spark, sf))


@query("agg_theta_median", "v_theta", """
    SELECT topic, round(median(theta), 6) AS median FROM v_theta GROUP BY 1""")
def agg_theta_median(spark, sf):
    from scholarlens.operators.ranks import quantiles
    return quantiles(v.theta(spark, sf), "theta", {"median": 0.5}, ["topic"]).select(
        "topic", r6("median", "median"))


@query("win_prevalence_rank", "v_theta", _PREV + """
    SELECT topic, CAST(row_number() OVER (ORDER BY theta_all DESC, topic DESC) AS INTEGER) AS rank
    FROM prev""")
def win_prevalence_rank(spark, sf):
    return T.prevalence_rank(prev(spark, sf)).select("topic", "rank")


_INDEX = _PREV.rstrip() + """,
    ch AS (SELECT topic, theta_all, (theta_recent - theta_pre) / theta_pre AS change FROM prev
           {where}),
    ix AS (SELECT *, CAST(sign(change) AS INTEGER) AS direction,
                  CAST(round(abs(change) / CASE WHEN change < 0 THEN max(-change) OVER ()
                                               ELSE max(change) OVER () END * 500) AS INTEGER)
                  AS change_index,
                  CAST(row_number() OVER (ORDER BY theta_all, topic) AS INTEGER) AS ord FROM ch)
"""


@query("win_max_normalise", "v_theta", _INDEX.format(where="") + """
    SELECT topic, round(change, 6) AS change, direction, change_index FROM ix""")
def win_max_normalise(spark, sf):
    return T.change_index(T.topic_change(prev(spark, sf))).select(
        "topic", r6("change", "change"), "direction", "change_index")


@query("tm_temporal_index", "v_theta", _INDEX.format(where="WHERE topic <> 2") + """
    SELECT topic, round(theta_all, 6) AS theta_all, round(change, 6) AS change, direction,
           change_index, ord FROM ix""")
def tm_temporal_index(spark, sf):
    return T.temporal_index(v.theta(spark, sf), CUT, JUNK).select(
        "topic", r6("theta_all", "theta_all"), r6("change", "change"), "direction",
        "change_index", "ord")


@query("ord_by_other", "v_theta", _INDEX.format(where="") + """
    SELECT topic, round(theta_all, 6) AS theta_all, change_index, ord FROM ix""")
def ord_by_other(spark, sf):
    """Change index in order of prevalence."""
    return T.temporal_index(v.theta(spark, sf), CUT).select(
        "topic", r6("theta_all", "theta_all"), "change_index", "ord").orderBy("ord")


@query("tm_topic_vertices", "v_theta", _INDEX.format(where="WHERE topic <> 2") + """
    SELECT topic, round(theta_all * 500, 6) AS size, change_index, direction FROM ix""")
def tm_topic_vertices(spark, sf):
    return T.topic_vertices(v.theta(spark, sf), CUT, JUNK).withColumn("size", r6("size", "size"))


@query("tm_prevalence_report", "v_theta v_beta_all", _PREV.rstrip() + "," + words_sql(15, source=_ALL) + """
    SELECT p.topic, top_words, round(theta_all, 6) AS theta_all,
           round(theta_recent, 6) AS theta_recent, round(theta_pre, 6) AS theta_pre
    FROM prev p JOIN lists l ON p.topic = l.topic""")
def tm_prevalence_report(spark, sf):
    words = v.stored_tok(spark, sf)
    beta = v.beta_all(spark, sf, words)
    return T.prevalence_report(v.theta(spark, sf, words), beta, CUT).select(
        "topic", "top_words", *[r6(c, c) for c in ("theta_all", "theta_recent", "theta_pre")])


@query("tm_summary_table", "v_theta v_beta_all", _PREV.rstrip() + "," + words_sql(3, ", ", _ALL) + """
    SELECT p.topic, CAST(row_number() OVER (ORDER BY theta_all DESC, p.topic DESC) AS INTEGER)
               AS rank, round(theta_all, 6) AS theta_all,
           'Topic ' || p.topic || ': ' || top_words AS label,
           round(least(max(theta_all) OVER () * 2, 1), 6) AS axis_bound
    FROM prev p JOIN lists l ON p.topic = l.topic""")
def tm_summary_table(spark, sf):
    words = v.stored_tok(spark, sf)
    beta = v.beta_all(spark, sf, words)
    return T.summary_table(v.theta(spark, sf, words), beta, CUT).select(
        "topic", "rank", r6("theta_all", "theta_all"), "label", r6("axis_bound", "axis_bound"))


@query("tm_topic_corr", "v_theta", """
    WITH e AS (SELECT a.topic AS src, b.topic AS dst, corr(a.theta, b.theta) AS corr
               FROM v_theta a JOIN v_theta b ON a.doc_id = b.doc_id AND a.topic < b.topic
               GROUP BY 1, 2)
    SELECT src, dst, round(corr, 6) AS corr FROM e WHERE corr > 0.01""")
def tm_topic_corr(spark, sf):
    return T.topic_correlations(v.theta(spark, sf)).withColumn("corr", r6("corr", "corr"))


@query("set_union_all", "v_theta", """
    SELECT topic, 'recent' AS part, count(*) AS n, round(avg(theta), 6) AS theta FROM v_theta
    WHERE year > 2009 GROUP BY 1
    UNION ALL SELECT topic, 'pre', count(*), round(avg(theta), 6) FROM v_theta
    WHERE year <= 2009 GROUP BY 1""")
def set_union_all(spark, sf):
    theta = v.theta(spark, sf)

    def part(name, rows):
        return rows.groupBy("topic").agg(F.count("*").alias("n"), r6(F.avg("theta"), "theta")
                                         ).withColumn("part", F.lit(name))

    recent = F.col("year") > CUT
    return part("recent", theta.where(recent)).unionByName(part("pre", theta.where(~recent)))


# --- word contrasts --------------------------------------------------------------------------

_CONTRAST = """
    WITH l AS (SELECT term, logbeta FROM {l}),
    r AS (SELECT term, logbeta FROM {r}),
    tops AS (SELECT term, 'l' AS s FROM l ORDER BY logbeta DESC, term LIMIT 12),
    topr AS (SELECT term, 'r' AS s FROM r ORDER BY logbeta DESC, term LIMIT 12),
    w AS (SELECT term FROM tops UNION SELECT term FROM topr),
    j AS (SELECT w.term, coalesce(exp(l.logbeta), 0) AS pl, coalesce(exp(r.logbeta), 0) AS pr
          FROM w LEFT JOIN l ON w.term = l.term LEFT JOIN r ON w.term = r.term),
    m AS (SELECT max(pl + pr) AS mb, max(abs(pl - pr)) AS mg FROM j)
"""
_CONTRAST_OUT = """
    SELECT term, round(asinh((pl + pr) / mb * 4), 6) AS scale, round((pl - pr) / mg, 6) AS diff,
           CASE WHEN (pl - pr) / mg < -0.1 THEN 'right' WHEN (pl - pr) / mg > 0.1 THEN 'left'
                ELSE 'middle' END AS side FROM j, m"""


_TOPICS_1_4 = _CONTRAST.format(l="v_beta_all WHERE topic = 1", r="v_beta_all WHERE topic = 4")


def two_topics(spark, sf):
    """Words of topics 1 and 4 over the whole corpus."""
    beta = v.beta_all(spark, sf, v.stored_tok(spark, sf))
    return [beta.where(F.col("topic") == t).select("term", "logbeta") for t in (1, 4)]


def contrast(left, right):
    return T.contrast_words(left, right, n=25).select(
        "term", r6("scale", "scale"), r6("diff", "diff"), "side")


@query("tm_perspectives", "v_beta_all", _TOPICS_1_4 + _CONTRAST_OUT)
def tm_perspectives(spark, sf):
    """Two topics of one model."""
    return contrast(*two_topics(spark, sf))


@query("tm_perspectives_levels", "v_beta", _CONTRAST.format(
    l="v_beta WHERE level = 1 AND topic = 2", r="v_beta WHERE level = 2 AND topic = 2") + _CONTRAST_OUT)
def tm_perspectives_levels(spark, sf):
    """One topic at two covariate levels."""
    beta = v.beta(spark, sf, v.stored_tok(spark, sf)).where(F.col("topic") == 2)
    return contrast(*[beta.where(F.col("level") == i).select("term", "logbeta") for i in (1, 2)])


@query("fn_diff_class", "v_beta_all", _TOPICS_1_4 + f"""
    SELECT side, count(*) AS words FROM ({_CONTRAST_OUT}) GROUP BY 1""")
def fn_diff_class(spark, sf):
    return contrast(*two_topics(spark, sf)).groupBy("side").agg(F.count("*").alias("words"))


@query("topk_terms_two_topics", "v_beta_all", _TOPICS_1_4 + """
    SELECT term, s AS side FROM tops UNION ALL SELECT term, s FROM topr""")
def topk_terms_two_topics(spark, sf):
    left, right = two_topics(spark, sf)
    both = left.withColumn("side", F.lit("l")).unionByName(right.withColumn("side", F.lit("r")))
    return T.top_per_topic(both, "logbeta", "term", 12, ["side"]).select("term", "side")


@query("set_union_distinct", "v_beta_all", _TOPICS_1_4 + """
    SELECT term FROM w""")
def set_union_distinct(spark, sf):
    return contrast(*two_topics(spark, sf)).select("term")


@query("fn_math", "v_beta", """
    SELECT level, topic, round(max(exp(logbeta)), 6) AS top_share,
           round(max(asinh(exp(logbeta) * 4)), 6) AS top_scaled,
           CAST(floor(min(logbeta)) AS BIGINT) AS floor_log,
           CAST(ceil(sqrt(count(*))) AS BIGINT) AS panel_root,
           round(greatest(max(abs(logbeta)), 1), 6) AS widest
    FROM v_beta GROUP BY 1, 2""")
def fn_math(spark, sf):
    logb = F.col("logbeta")
    return v.beta(spark, sf).groupBy("level", "topic").agg(
        r6(F.max(F.exp(logb)), "top_share"), r6(F.max(F.asinh(F.exp(logb) * 4)), "top_scaled"),
        F.floor(F.min(logb)).alias("floor_log"),
        F.ceil(F.sqrt(F.count("*"))).alias("panel_root"),
        r6(F.greatest(F.max(F.abs(logb)), F.lit(1.0)), "widest"))


_MARGINAL = f"""
    WITH wt AS (SELECT level, n / CAST(sum(n) OVER () AS DOUBLE) AS weight FROM (
        SELECT CASE WHEN year > {CUT} THEN 2 ELSE 1 END AS level, count(*) AS n
        FROM v_doc WHERE abstract IS NOT NULL GROUP BY 1)),
    mb AS (SELECT topic, term, sum(weight * exp(logbeta)) AS beta
           FROM v_beta JOIN wt USING (level) GROUP BY 1, 2)
"""


def marginal(spark, sf):
    level = F.when(F.col("year") > CUT, 2).otherwise(1)
    docs = v.doc(spark, sf).where(F.col("abstract").isNotNull())
    return T.marginal_beta(v.beta(spark, sf), T.covariate_weights(docs, level))


@query("agg_covariate_mix", "v_beta v_doc", _MARGINAL + """
    SELECT topic, count(*) AS words, round(sum(beta), 6) AS total, round(max(beta), 6) AS top
    FROM mb GROUP BY 1""")
def agg_covariate_mix(spark, sf):
    return marginal(spark, sf).groupBy("topic").agg(
        F.count("*").alias("words"), r6(F.sum("beta"), "total"), r6(F.max("beta"), "top"))


@query("tm_covariate_labels", "v_beta v_doc", _MARGINAL + """
    SELECT topic, CAST(rank AS INTEGER) AS rank, term, round(beta, 6) AS beta FROM (
        SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(beta, 12) DESC, term) AS rank
        FROM mb) WHERE rank <= 20""")
def tm_covariate_labels(spark, sf):
    words = marginal(spark, sf).withColumn("key", F.round("beta", 12))
    return T.top_words(words, 20, score="key").select("topic", "rank", "term", r6("beta", "beta"))


# --- model selection metrics -----------------------------------------------------------------

_COHERENCE = "WITH " + words_sql(10).strip() + """,
    d AS (SELECT term, count(*) AS df FROM v_tok GROUP BY 1),
    pr AS (SELECT w.level, w.topic, w.term AS wi, x.term AS wj FROM words w
           JOIN words x ON w.level = x.level AND w.topic = x.topic AND w.rank < x.rank),
    co AS (SELECT pr.level, pr.topic, wi, wj, count(b.doc_id) AS docs_both
           FROM pr JOIN v_tok a ON a.term = wi
           LEFT JOIN v_tok b ON b.term = wj AND b.doc_id = a.doc_id GROUP BY 1, 2, 3, 4)
"""


@query("join_cooccurrence", "v_tok v_beta", _COHERENCE + """
    SELECT co.level, co.topic, CAST(w.rank AS INTEGER) AS hi, CAST(x.rank AS INTEGER) AS lo, docs_both
    FROM co JOIN words w ON co.level = w.level AND co.topic = w.topic AND co.wi = w.term
    JOIN words x ON co.level = x.level AND co.topic = x.topic AND co.wj = x.term
    WHERE docs_both > 0""")
def join_cooccurrence(spark, sf):
    words = v.stored_tok(spark, sf)
    pairs = Q.cooccurrence(words, v.beta(spark, sf, words), 10, BOTH)
    return pairs.where(F.col("hi") < F.col("lo"))


@query("tm_semantic_coherence", "v_tok v_beta", _COHERENCE + """
    SELECT level, topic, round(sum(ln((docs_both + 1) / df)), 6) AS coherence
    FROM co JOIN d ON wi = d.term GROUP BY 1, 2""")
def tm_semantic_coherence(spark, sf):
    words = v.stored_tok(spark, sf)
    return Q.semantic_coherence(words, v.beta(spark, sf, words), 10, BOTH).withColumn(
        "coherence", r6("coherence", "c"))


def sig(x: str) -> str:
    """Rounded to nine significant digits, as the operators rank."""
    size = f"pow(10.0, 8 - floor(log10(abs({x}))))"
    return f"CASE WHEN {x} = 0 THEN {x} ELSE round({x} * {size}) / {size} END"


_FREX = """
    fx AS (SELECT *, 1 / ({w} / (cume_dist() OVER (PARTITION BY level, topic ORDER BY excl))
                      + (1 - {w}) / (cume_dist() OVER (PARTITION BY level, topic ORDER BY lb)))
                  AS frex
           FROM (SELECT *, {lb} AS lb, {ex} AS excl FROM (
               SELECT level, topic, term, logbeta, exp(logbeta) AS beta,
                      exp(logbeta) / sum(exp(logbeta)) OVER (PARTITION BY level, term) AS e
               FROM v_beta)))
"""


def frex_sql(weight: float) -> str:
    return _FREX.format(w=weight, lb=sig("logbeta"), ex=sig("e"))


@query("tm_exclusivity", "v_beta", "WITH " + words_sql(10).strip() + "," + frex_sql(0.7) + """
    SELECT level, topic, round(sum(frex), 6) AS exclusivity
    FROM fx JOIN words USING (level, topic, term) GROUP BY 1, 2""")
def tm_exclusivity(spark, sf):
    return Q.exclusivity(v.beta(spark, sf), 10, keys=BOTH).withColumn(
        "exclusivity", r6("exclusivity", "e"))


@query("tm_label_words", "v_beta v_tok", "WITH " + frex_sql(0.5).strip() + """,
    f AS (SELECT term, sum(cnt) / CAST((SELECT sum(cnt) FROM v_tok) AS DOUBLE) AS share
          FROM v_tok GROUP BY 1),
    ml AS (SELECT level, term, avg(logbeta) AS ml FROM v_beta GROUP BY 1, 2),
    sc AS (SELECT level, topic, term, beta, frex, beta / share AS lift, beta * (logbeta - ml) AS score
           FROM fx JOIN f USING (term) JOIN ml USING (level, term)),
    lg AS (SELECT level, topic, term, 'prob' AS label, beta AS value FROM sc
           UNION ALL SELECT level, topic, term, 'frex', frex FROM sc
           UNION ALL SELECT level, topic, term, 'lift', lift FROM sc
           UNION ALL SELECT level, topic, term, 'score', score FROM sc)
    SELECT level, topic, label, term, CAST(rank AS INTEGER) AS rank, round(value, 6) AS value FROM (
        SELECT *, row_number() OVER (PARTITION BY level, topic, label
                                     ORDER BY """ + sig("value") + """ DESC, term) AS rank FROM lg)
    WHERE rank <= 10""")
def tm_label_words(spark, sf):
    words = v.stored_tok(spark, sf)
    return Q.label_words(v.beta(spark, sf, words), words, keys=BOTH).select(
        "level", "topic", "label", "term", "rank", r6("value", "value"))


@query("tm_heldout", "v_tok v_theta v_beta", f"""
    WITH m AS (SELECT *, substr(md5('1:' || doc_id), 1, 8) < '{Q.hidden_limit(0.1)}'
                 AND substr(md5('1:' || doc_id || ':' || term), 1, 8) < '{Q.hidden_limit(0.5)}' AS hidden
               FROM v_tok),
    ll AS (SELECT level, t.doc_id, t.term, any_value(hidden) AS hidden, any_value(cnt) AS cnt,
                       sum(theta * exp(logbeta)) AS p
                FROM m t JOIN v_beta b USING (term)
                JOIN v_theta h ON h.doc_id = t.doc_id AND h.topic = b.topic GROUP BY 1, 2, 3),
    per AS (SELECT level, doc_id, sum(cnt) AS n, sum(cnt * ln(p)) AS s,
                   sum(cnt) FILTER (hidden) AS hn, sum(cnt * ln(p)) FILTER (hidden) AS hs
            FROM ll GROUP BY 1, 2)
    SELECT level, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens, round(avg(s / n), 6) AS score,
           count(hn) AS hidden_docs, CAST(coalesce(sum(hn), 0) AS BIGINT) AS hidden_tokens,
           round(avg(hs / hn), 6) AS heldout FROM per GROUP BY 1""")
def tm_heldout(spark, sf):
    """Score of all words under fixed shares and that of the hidden ones, one row per covariate level."""
    words = v.stored_tok(spark, sf)
    masked = Q.held_out_mask(words, seed=1).select("doc_id", "term", "cnt", "hidden")
    beta = written(v.beta(spark, sf, words).select("level", "topic", "term", F.exp("logbeta").alias("beta")), "beta")
    scores = shard_scores(masked, v.theta_vectors(spark, sf, words),
                          {k: beta.where(F.col("level") == k) for k in (1, 2)}, v.TOPICS)
    return scores.withColumnRenamed("k", "level").withColumns({
        "score": r6("score", "s"), "heldout": r6("heldout", "h")})


@query("tm_residuals", "v_tok v_theta v_beta", """
    WITH df AS (SELECT term FROM v_tok GROUP BY 1 HAVING count(*) > 10),
    p AS (SELECT t.doc_id, t.term, t.cnt FROM v_tok t JOIN df USING (term)),
    n AS (SELECT doc_id, CAST(sum(cnt) AS DOUBLE) AS m FROM p GROUP BY 1),
    b AS (SELECT topic, term, beta / sum(beta) OVER (PARTITION BY topic) AS beta
          FROM (SELECT topic, term, sum(exp(logbeta)) AS beta
                FROM v_beta JOIN df USING (term) GROUP BY 1, 2)),
    q AS (SELECT n.doc_id, b.term, any_value(m) AS m, sum(theta * beta) AS q
          FROM n JOIN v_theta h ON n.doc_id = h.doc_id JOIN b ON b.topic = h.topic GROUP BY 1, 2),
    r AS (SELECT sum(m * q.q / (1 - q.q)
                     + coalesce((cnt * cnt - 2 * cnt * m * q.q) / (m * q.q * (1 - q.q)), 0)) AS ss,
                 count(*) FILTER (WHERE m * q.q > 0.01) AS cells
          FROM q LEFT JOIN p ON q.doc_id = p.doc_id AND q.term = p.term)
    SELECT (SELECT count(*) FROM n) AS docs, round(ss, 1) AS ss,
           cells - (SELECT count(*) FROM n) * 4 - 5 * ((SELECT count(*) FROM df) - 1) AS df,
           round(ss / (cells - (SELECT count(*) FROM n) * 4
                       - 5 * ((SELECT count(*) FROM df) - 1)), 6) AS dispersion
    FROM r""")
def tm_residuals(spark, sf):
    """Residual dispersion of the fixed shares, both levels together, over the pruned vocabulary."""
    words = v.stored_tok(spark, sf)
    corpus = build_corpus(prune(words, 10))
    joined = written(v.beta(spark, sf, words).join(corpus.vocab.select("term"), "term").groupBy(
        "topic", "term").agg(F.sum(F.exp("logbeta")).alias("beta")), "beta")
    total = joined.groupBy("topic").agg(F.sum("beta").alias("tot"))
    beta = joined.join(F.broadcast(total), "topic").select(
        "topic", "term", (F.col("beta") / F.col("tot")).alias("beta"))
    shares = v.theta_vectors(spark, sf, words).select(F.lit(v.TOPICS).alias("k"), "doc_id", "shares")
    result = residual_dispersion(corpus, shares, word_blocks(corpus, beta, v.TOPICS))
    return result.select("docs", F.round("ss", 1).alias("ss"), "df",
                         r6("dispersion", "dispersion"))


_METRICS = """
    WITH words AS (SELECT run, k, topic, term, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY run, k, topic ORDER BY logbeta DESC, term) AS rank
        FROM v_beta_k) WHERE rank <= 10),
    fx AS (SELECT *, 1 / (0.7 / (cume_dist() OVER (PARTITION BY run, k, topic ORDER BY excl))
                      + 0.3 / (cume_dist() OVER (PARTITION BY run, k, topic ORDER BY lb))) AS frex
           FROM (SELECT *, """ + sig("logbeta") + " AS lb, " + sig("e") + """ AS excl FROM (
               SELECT *, exp(logbeta) / sum(exp(logbeta)) OVER (PARTITION BY run, k, term) AS e
               FROM v_beta_k))),
    ex AS (SELECT run, k, topic, sum(frex) AS exclusivity FROM fx JOIN words USING (run, k, topic, term)
           GROUP BY 1, 2, 3),
    d AS (SELECT term, count(*) AS df FROM v_tok GROUP BY 1),
    tt AS (SELECT doc_id, term FROM v_tok WHERE term IN (SELECT term FROM words)),
    pt AS (SELECT DISTINCT w.term AS wi, x.term AS wj FROM words w JOIN words x
           ON w.run = x.run AND w.k = x.k AND w.topic = x.topic AND w.rank < x.rank),
    co AS (SELECT wi, wj, count(b.doc_id) AS docs_both FROM pt JOIN tt a ON a.term = wi
           LEFT JOIN tt b ON b.term = wj AND b.doc_id = a.doc_id GROUP BY 1, 2),
    ch AS (SELECT w.run, w.k, w.topic, sum(ln((docs_both + 1) / df)) AS coherence FROM words w
           JOIN words x ON w.run = x.run AND w.k = x.k AND w.topic = x.topic AND w.rank < x.rank
           JOIN co ON co.wi = w.term AND co.wj = x.term JOIN d ON d.term = w.term GROUP BY 1, 2, 3),
    m AS (SELECT run, k, round(avg(exclusivity), 6) AS exclusivity, round(avg(coherence), 6) AS coherence
          FROM ex JOIN ch USING (run, k, topic) GROUP BY 1, 2)
"""


def metrics(spark, sf):
    """Coherence and exclusivity of each model of two runs, keyed by its number of topics."""
    words = v.stored_tok(spark, sf)
    beta = written(v.beta_k(spark, sf, words), "beta")
    return written(Q.model_metrics(words, beta, 10, ("run", "k", "topic")).select(
        "run", "k", r6("exclusivity", "exclusivity"), r6("coherence", "coherence")), "metrics")


@query("tm_model_metrics", "v_tok v_beta_k", _METRICS + "SELECT * FROM m")
def tm_model_metrics(spark, sf):
    return metrics(spark, sf)


@query("tm_frontier", "v_tok v_beta_k", _METRICS + """
    SELECT run * 100 + k AS model, exclusivity, coherence FROM m WHERE NOT EXISTS (
        SELECT 1 FROM m o WHERE o.exclusivity >= m.exclusivity AND o.coherence >= m.coherence
        AND (o.exclusivity > m.exclusivity OR o.coherence > m.coherence))""")
def tm_frontier(spark, sf):
    """Models of both runs that no other beats on both measures."""
    models = metrics(spark, sf).withColumn("model", F.col("run") * 100 + F.col("k"))
    return T.pareto_front(models, "model").select("model", "exclusivity", "coherence")


@query("join_model_runs", "v_tok v_beta_k", _METRICS + """
    SELECT a.k, a.coherence AS coherence_1, a.exclusivity AS exclusivity_1,
           b.coherence AS coherence_2, b.exclusivity AS exclusivity_2,
           round(b.coherence - a.coherence, 6) AS coherence_diff,
           round(b.exclusivity - a.exclusivity, 6) AS exclusivity_diff
    FROM m a JOIN m b ON a.k = b.k AND a.run = 1 AND b.run = 2""")
def join_model_runs(spark, sf):
    """Two result tables side by side by number of topics."""
    table = metrics(spark, sf)
    runs = [table.where(F.col("run") == r).drop("run") for r in v.RUNS]
    return T.compare_runs(*runs).withColumns({c: F.round(c, 6) for c in (
        "coherence_diff", "exclusivity_diff")})
