"""Quality rules whose thresholds adapt to each language and source.

Every document is measured in the JVM. The measures of the documents that pass the two fixed
rules are counted into logarithmic bins per language and source: a quantile sketch with a
bounded relative error that merges by adding counts, so it is the same whatever the order of
the tasks. Quantiles read off the bins give fences, and documents join the fences of their
language and source. Each language's counts are shrunk toward those of all documents, and each
source's toward its language, by the number of documents. Only the lower half of a group sets
its fence: junk cannot move it while it is less than half of the group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarlens.llm.common import BLANKS, WORD, free_name, text_of
from scholarlens.session import written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Ratio of neighbouring bin bounds; a quantile is off by at most half a bin.
GROWTH = 1.04
#: Measures with an upper fence: third quartile plus ``REACH`` times the spread, both mirrored from
#: the lower half of the group, at least a floor.
#: A floor keeps a fence from closing on a group whose documents are all alike.
REACH = 6.0
FLOORS = {"symbol_rate": 0.25, "repeat_rate": 0.4, "dup_line_rate": 0.5, "mark_rate": 0.5,
          "upper_rate": 0.3}
#: Documents that the wider group counts for in each group.
PRIOR = 100.0


def _repeats(words: str) -> tuple[Column, ...]:
    """Steps to count the words that lie in a three-word window found twice or more."""
    n = F.size(words)
    hashes = F.transform(
        F.slice(F.col(words), F.lit(1), F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get(F.col(words), i + 1), F.get(F.col(words), i + 2))
                              .alias("h"), i.alias("i")))
    return F.sort_array(hashes)


def measure(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) and a struct column ``m`` of measures per row.

    Row by row: repeated rows are each measured, a null or empty text has no words and zero
    measures. Windows are compared by a 64-bit hash of their three words.
    """
    keep = docs.columns if keep is None else keep
    row, t, words, runs, idx = (free_name(docs, c) for c in ("_row", "_t", "_w", "_s", "_i"))
    df = docs.select(F.struct(*[F.col(c) for c in keep]).alias(row), text_of(text).alias(t))
    df = df.withColumn(words, F.regexp_extract_all(F.col(t), F.lit(WORD), F.lit(0)))
    df = df.withColumn(runs, _repeats(words))
    same = lambda x, j: F.coalesce(F.get(F.col(runs), j)["h"] == x["h"], F.lit(False))
    df = df.withColumn(idx, F.sort_array(F.transform(
        F.filter(F.col(runs), lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])))
    repeat = F.aggregate(
        F.col(idx), F.struct(F.lit(-3).alias("p"), F.lit(0).alias("n")),
        lambda a, x: F.struct(x.alias("p"), (a["n"] + F.least(F.lit(3), x - a["p"])).alias("n")),
        lambda a: a["n"])
    lines = F.filter(F.split(F.col(t), "\n", -1),
                     lambda s: F.length(F.translate(s, BLANKS, "")) > 0)
    chars = F.length(t)
    counts = df.select(
        row, t, F.size(words).cast("long").alias("n_words"),
        F.length(F.translate(F.col(t), BLANKS, "")).cast("long").alias("word_chars"),
        (chars - F.length(F.translate(F.col(t), "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        repeat.cast("long").alias("n_repeat_words"), lines.alias("_lines"),
        (chars - F.length(F.translate(F.col(t), "!?;:{}[]=_~^\\", ""))).cast("long").alias("n_marks"),
        (chars - F.length(F.translate(F.col(t), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")))
        .cast("long").alias("n_upper"))
    counts = counts.withColumns({
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")})
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
             "n_marks", "n_upper")
    return counts.select(f"{row}.*", F.struct(*names).alias(free_name(docs, "m")))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (
        100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def rates(m: Column) -> dict[str, Column]:
    words, lines = F.greatest(m["n_words"], F.lit(1)), F.greatest(m["n_lines"], F.lit(1))
    chars = F.greatest(m["word_chars"], F.lit(1))
    return {"symbol_rate": m["n_symbols"] / words, "repeat_rate": m["n_repeat_words"] / words,
            "dup_line_rate": m["n_dup_lines"] / lines, "mark_rate": m["n_marks"] / words,
            "upper_rate": m["n_upper"] / chars}


def sketch(measured: DataFrame, m: str, lang: str, source: str) -> DataFrame:
    """Counts per (lang, source, measure, bin); bin null holds the zeros. Merges by adding."""
    x = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("value"))
                            for k, v in rates(F.col(m)).items()]))
    rows = measured.where(~base_failed(F.col(m))).select(
        F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"),
        x.alias("x"))
    index = F.when(F.col("x.value") > 0, F.floor(
        F.round(F.log(F.col("x.value")) / math.log(GROWTH), 6)).cast("int"))
    return rows.groupBy("lang", "source", F.col("x.measure").alias("measure"),
                        index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _shrunk(bins: DataFrame, keys: list[str], wider: DataFrame, prior: float) -> DataFrame:
    """Counts of each group with the distribution of the ``wider`` group added as ``prior`` documents.

    The weight of a group's own documents grows with their number, without a step.
    """
    own = bins.groupBy(*keys, "measure", "bin").agg(F.sum("n").cast("double").alias("n"))
    shares = wider.groupBy(*keys[:-1], "measure").agg(F.sum("n").alias("_total")).select(
        *[F.col(k).alias(f"_{k}") for k in keys[:-1]], F.col("measure").alias("_measure"), "_total")
    match = lambda left: [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in left]
    added = wider.join(shares, match([*keys[:-1], "measure"])).select(
        *[F.col(k).alias(f"_{k}") for k in (*keys[:-1], "measure")], "bin",
        (prior * F.col("n") / F.col("_total")).alias("n"))
    groups = own.select(*keys, "measure").distinct()
    lent = groups.join(added, match([*keys[:-1], "measure"])).select(*keys, "measure", "bin", "n")
    return own.unionByName(lent).groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))


def _fences(bins: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """Median and lower quartile of each group's sketch as an upper fence.

    The part above the median is taken as the mirror of the part below, so what is above it,
    up to half of the group, does not move the fence; on symmetric measures the mirrored
    third quartile is the third quartile.
    """
    group = Window.partitionBy(*keys, "measure")
    order = group.orderBy(F.col("bin").asc_nulls_first())  # at most some hundred bins a group
    placed = bins.select("*", F.sum("n").over(group).alias("total"), F.sum("n").over(
        order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    value = F.coalesce(F.pow(F.lit(GROWTH), F.col("bin") + 0.5), F.lit(0.0))
    # counts hold fractions: a rank is met up to rounding
    at = lambda q: F.min(F.when(F.col("upto") >= (q - 1e-9) * F.col("total"), value))
    return placed.groupBy(*keys, "measure").agg(at(0.25).alias("q1"), at(0.5).alias("q2")).select(
        *keys, "measure",
        (F.col("q2") + (1 + 2 * reach) * (F.col("q2") - F.col("q1"))).alias("fence"))


def thresholds(bins: DataFrame, reach: float = REACH, prior: float = PRIOR) -> DataFrame:
    """One row per (lang, source) with a fence for every measure, never below its floor."""
    every = bins.groupBy("measure", "bin").agg(F.sum("n").alias("n"))
    tongue = _shrunk(bins, ["lang"], every, prior)
    fences = _fences(_shrunk(bins, ["lang", "source"], tongue, prior), ["lang", "source"], reach)
    return fences.groupBy("lang", "source").agg(*[
        F.greatest(F.max(F.when(F.col("measure") == k, F.col("fence"))), F.lit(v)).alias(f"max_{k}")
        for k, v in FLOORS.items()])


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
           keep: list[str] | None = None, codec: str | None = None) -> DataFrame:
    """``keep`` columns of every row with ``m`` (measures), ``base_failed`` and ``kept``.

    Rows with null language or source form groups of their own. An empty table gives no rows.
    Columns of these names in ``docs`` do not clash: they stay inside the struct ``row``.
    """
    keep = docs.columns if keep is None else keep
    inner = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col(text).alias("text"),
                        F.col(lang).cast("string").alias("lang"),
                        F.col(source).cast("string").alias("source"))
    measured = written(measure(inner, keep=["row", "lang", "source"]), "quality", codec)
    fences = thresholds(sketch(measured, "m", "lang", "source")).withColumnsRenamed(
        {"lang": "f_lang", "source": "f_source"})
    joined = measured.join(fences, F.col("lang").eqNullSafe(F.col("f_lang"))
                           & F.col("source").eqNullSafe(F.col("f_source")), "left")
    within = F.lit(True)
    for k, v in rates(F.col("m")).items():
        within = within & F.coalesce(v <= F.col(f"max_{k}"), F.lit(True))
    failed = base_failed(F.col("m"))
    return joined.select("row", "m", failed.alias("base_failed"),
                         (~failed & within).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns."""
    return judged(docs, codec="zstd").where("kept").select("row.*")
