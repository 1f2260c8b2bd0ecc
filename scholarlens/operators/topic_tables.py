"""Reports on document-topic shares (theta) and topic-word shares (beta), both in long form.

theta: (doc_id, year, topic, theta). beta: ([level,] topic, term, logbeta).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarlens.functions.columns import contrast_side, topic_label


def top_per_topic(df: DataFrame, score: str, tie: str, n: int,
                  keys: Sequence[str] = ("topic",)) -> DataFrame:
    """The n best rows per topic with their rank; each task keeps n per topic before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def top_documents(theta: DataFrame, n: int = 25, keys: Sequence[str] = ("topic",)) -> DataFrame:
    return top_per_topic(theta, "theta", "doc_id", n, keys)


def top_words(beta: DataFrame, n: int = 15, score: str = "logbeta",
              keys: Sequence[str] = ("topic",)) -> DataFrame:
    return top_per_topic(beta, score, "term", n, keys)


def word_lists(beta: DataFrame, n: int = 15, sep: str = ",", score: str = "logbeta",
               keys: Sequence[str] = ("topic",)) -> DataFrame:
    """Top words of a topic as one text, best word first."""
    ranked = top_words(beta, n, score, keys).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("ranked"))
    return ranked.select(*keys, F.array_join(F.col("ranked.term"), sep).alias("top_words"))


def prevalence(theta: DataFrame, recent_after: int, keys: Sequence[str] = ("topic",)) -> DataFrame:
    """Mean share of each topic over all, recent and earlier documents, in one pass."""
    recent = F.col("year") > recent_after
    return theta.groupBy(*keys).agg(
        F.avg("theta").alias("theta_all"),
        F.avg(F.when(recent, F.col("theta"))).alias("theta_recent"),
        F.avg(F.when(~recent, F.col("theta"))).alias("theta_pre"))


def prevalence_rank(prev: DataFrame) -> DataFrame:
    """Topics numbered by falling prevalence, ties by falling topic id (one row per topic)."""
    return prev.withColumn("rank", F.row_number().over(
        Window.orderBy(F.desc("theta_all"), F.desc("topic"))))


def group_prevalence(prev: DataFrame, topics: Sequence[int]) -> DataFrame:
    """Combined prevalence of chosen topics."""
    chosen = F.col("topic").isin(*topics)
    return prev.agg(F.sum(F.when(chosen, F.col("theta_all"))).alias("theta_all"),
                    F.sum(F.when(chosen, F.col("theta_recent"))).alias("theta_recent"))


def topic_change(prev: DataFrame) -> DataFrame:
    """Relative change from earlier to recent years; null where the earlier share is zero."""
    change = (F.col("theta_recent") - F.col("theta_pre")) / F.nullif("theta_pre", F.lit(0.0))
    return prev.withColumn("change", change)


def without_topics(df: DataFrame, topics: Sequence[int]) -> DataFrame:
    return df.where(~F.col("topic").isin(*topics))


def change_index(changes: DataFrame, steps: int = 500, reference_scale: bool = False) -> DataFrame:
    """Integer strength of change, each sign scaled by its own extreme.

    ``reference_scale`` divides both signs by the largest positive change instead, in which
    case a negative index may pass ``steps``. One row per topic.
    """
    every = Window.partitionBy()
    up = F.max("change").over(every)
    down = F.max(-F.col("change")).over(every)
    scale = up if reference_scale else F.when(F.col("change") < 0, down).otherwise(up)
    return changes.withColumn("direction", F.signum("change").cast("int")).withColumn(
        "change_index", F.round(F.abs("change") / F.nullif(scale, F.lit(0.0)) * steps)
        .cast("int"))


def theta_histogram(theta: DataFrame, bins: int = 20) -> DataFrame:
    """Documents per topic in equal bins of [0, 1]; empty bins are absent."""
    bin_no = F.least(F.floor(F.col("theta") * bins) + 1, F.lit(bins)).cast("int")
    return theta.groupBy("topic", bin_no.alias("bin")).agg(F.count("*").alias("docs"))


def covariate_weights(docs: DataFrame, level: Column) -> DataFrame:
    """Share of documents at each covariate level."""
    per = docs.groupBy(level.alias("level")).agg(F.count("*").alias("n"))
    return per.select("level", (F.col("n") / per.agg(F.sum("n")).scalar()).alias("weight"))


def marginal_beta(beta: DataFrame, weights: DataFrame) -> DataFrame:
    """Word shares averaged over covariate levels by their document shares."""
    return beta.join(weights, "level").groupBy("topic", "term").agg(
        F.sum(F.col("weight") * F.exp("logbeta")).alias("beta"))


def topic_report(theta: DataFrame, beta: DataFrame, docs: DataFrame, n_docs: int = 25,
                 n_words: int = 15, keys: Sequence[str] = ("topic",),
                 doc_columns: Sequence[str] = ()) -> DataFrame:
    """Best documents per topic with rounded share, metadata and the topic's word list.

    ``docs`` is keyed by ``doc_id``. Best documents are found first: n_docs rows per topic, which
    are broadcast to the document table so that it is scanned in place.
    """
    best = top_documents(theta.select(*keys, "doc_id", "theta"), n_docs, keys)
    words = word_lists(beta, n_words, keys=keys)
    return (docs.select("doc_id", *doc_columns).join(F.broadcast(best), "doc_id")
            .join(F.broadcast(words), list(keys), "left")
            .select(*keys, "rank", "doc_id", *doc_columns, F.round("theta", 2).alias("theta"),
                    "top_words"))


def prevalence_report(theta: DataFrame, beta: DataFrame, recent_after: int,
                      n_words: int = 15) -> DataFrame:
    return word_lists(beta, n_words).join(prevalence(theta, recent_after), "topic")


def summary_table(theta: DataFrame, beta: DataFrame, recent_after: int, n_words: int = 3,
                  exclude: Sequence[int] = ()) -> DataFrame:
    """Topics by prevalence with label text and the upper bound of a share axis."""
    prev = prevalence_rank(prevalence(without_topics(theta, exclude), recent_after))
    bound = F.least(F.max("theta_all").over(Window.partitionBy()) * 2, F.lit(1.0))
    return prev.join(word_lists(beta, n_words, ", "), "topic").select(
        "topic", "rank", "theta_all", topic_label("topic", "top_words").alias("label"),
        bound.alias("axis_bound"))


def temporal_index(theta: DataFrame, recent_after: int, exclude: Sequence[int] = ()) -> DataFrame:
    """Change and change index of each topic, in order of rising prevalence."""
    changes = topic_change(prevalence(without_topics(theta, exclude), recent_after))
    order = F.row_number().over(Window.orderBy("theta_all", "topic"))
    return change_index(changes).select("topic", "theta_all", "change", "direction",
                                        "change_index", order.alias("ord"))


def topic_correlations(theta: DataFrame, cutoff: float = 0.01) -> DataFrame:
    """Edges (src, dst, corr) of topics whose document shares correlate above the cutoff.

    A document's shares meet once; its pairs of topics are read off and summed up inside the
    task, so what is moved has a row per pair of topics. Over documents that hold both topics; a
    topic with one and the same share everywhere has no edge.
    """
    shares = theta.groupBy("doc_id").agg(F.collect_list(F.struct("topic", "theta")).alias("t"))
    pairs = shares.select("t", F.explode("t").alias("a")).select("a", F.explode("t").alias("b")).where(
        F.col("a.topic") < F.col("b.topic"))
    sums = pairs.groupBy(F.col("a.topic").alias("src"), F.col("b.topic").alias("dst")).agg(
        F.try_divide(F.covar_pop("a.theta", "b.theta"),
                     F.stddev_pop("a.theta") * F.stddev_pop("b.theta")).alias("corr"))
    return sums.where((F.col("corr") > cutoff) & ~F.isnan("corr"))


def topic_vertices(theta: DataFrame, recent_after: int, exclude: Sequence[int] = (),
                   size: float = 500.0) -> DataFrame:
    """Vertex size and change index of each topic of the correlation graph."""
    return temporal_index(theta, recent_after, exclude).select(
        "topic", (F.col("theta_all") * size).alias("size"), "change_index", "direction")


def contrast_words(left: DataFrame, right: DataFrame, n: int = 25) -> DataFrame:
    """Words that tell two word distributions apart.

    The union of each side's best n/2 words, with the difference scaled to [-1, 1], a text size
    and the side the word leans to. ``left`` and ``right``: (term, logbeta).
    """
    sides = left.select("term", "logbeta", F.lit("l").alias("at")).unionByName(
        right.select("term", "logbeta", F.lit("r").alias("at")))
    words = top_per_topic(sides, "logbeta", "term", n // 2, ["at"]).select("term").distinct()

    def share(at: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("at") == at, F.exp("logbeta"))), F.lit(0.0))

    joined = sides.join(F.broadcast(words), "term", "left_semi").groupBy("term").agg(
        (share("l") + share("r")).alias("both"), (share("l") - share("r")).alias("gap"))
    # At most n rows from here on.
    every = Window.partitionBy()
    diff = F.col("gap") / F.max(F.abs("gap")).over(every)
    return joined.select(
        "term", F.asinh(F.col("both") / F.max("both").over(every) * 4).alias("scale"),
        diff.alias("diff"), contrast_side(diff).alias("side"))


def pareto_front(metrics: DataFrame, keep: str = "k",
                 better: Sequence[str] = ("exclusivity", "coherence")) -> DataFrame:
    """Rows no other row beats on both metrics. One row per fitted model comes in."""
    a, b = better
    # Best second metric among rows at least as good on the first: a running maximum, no pairs.
    order = Window.orderBy(F.desc(a), F.desc(b))
    earlier = F.max(b).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ties = Window.partitionBy(a, b)
    ranked = metrics.withColumn("_n", F.count("*").over(ties)).withColumn(
        "_first", F.row_number().over(ties.orderBy(keep)))
    distinct = ranked.where(F.col("_first") == 1).withColumn("_earlier", earlier)
    front = distinct.where(F.col("_earlier").isNull() | (F.col(b) > F.col("_earlier")))
    return metrics.join(front.select(a, b), [a, b], "left_semi")


def compare_runs(first: DataFrame, second: DataFrame, key: str = "k",
                 metrics: Sequence[str] = ("coherence", "exclusivity")) -> DataFrame:
    """Two sweeps side by side with the difference of each metric."""
    left = first.select(key, *[F.col(m).alias(f"{m}_1") for m in metrics])
    right = second.select(key, *[F.col(m).alias(f"{m}_2") for m in metrics])
    return left.join(right, key).select("*", *[
        (F.col(f"{m}_2") - F.col(f"{m}_1")).alias(f"{m}_diff") for m in metrics])
