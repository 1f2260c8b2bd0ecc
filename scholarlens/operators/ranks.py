"""Ranks, quantiles and rank tests without a single-task sort.

Everything rests on :func:`cumulative_counts`: rows are first aggregated to distinct values,
the values are range-partitioned, partition sums give offsets, and a running sum inside a
partition gives the exact number of rows below each value. The range bounds decide only how
work is spread; the counts are exact for any bounds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from scholarlens.session import written


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str],
                    how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other."""
    if not keys:
        raise ValueError("at least one key is needed")
    renamed = right.select(*[F.col(c).alias(f"_k_{c}") if c in keys else F.col(c)
                             for c in right.columns])
    cond = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return left.join(renamed, cond, how).drop(*[f"_k_{k}" for k in keys])


def cumulative_counts(df: DataFrame, value: str, groups: Sequence[str] = (),
                      extra: Mapping[str, Column] | None = None,
                      weight: str | None = None) -> DataFrame:
    """One row per group and distinct non-null value.

    Columns: groups, value, ``n_rows`` (rows with the value), ``before`` (rows of the group
    below it), ``total`` (rows of the group) and the ``extra`` aggregates. With ``weight`` an
    input row stands for that many rows.
    """
    groups = list(groups)
    rows = F.count("*") if weight is None else F.sum(weight)
    distinct = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(
        rows.alias("n_rows"), *[c.alias(n) for n, c in (extra or {}).items()])
    # Written, so that every reader below sees the same partition number on a row.
    ranged = written(distinct.repartitionByRange(*groups, value)
                     .withColumn("_part", F.spark_partition_id()), "ranged")
    # One row per group and range partition from here to the offsets.
    in_group = Window.partitionBy(*groups)
    sizes = ranged.groupBy(*groups, "_part").agg(F.sum("n_rows").alias("_size"))
    sizes = sizes.select(
        *groups, "_part",
        (F.sum("_size").over(in_group.orderBy("_part")) - F.col("_size")).alias("_offset"),
        F.sum("_size").over(in_group).alias("total"))
    placed = _join_null_safe(ranged, sizes, [*groups, "_part"])
    in_part = Window.partitionBy(*groups, "_part").orderBy(value)
    below = F.sum("n_rows").over(in_part) - F.col("n_rows")
    return placed.withColumn("before", F.col("_offset") + below).drop("_part", "_offset")


def mid_rank() -> Column:
    """Average rank of tied rows, on the output of :func:`cumulative_counts`."""
    return F.col("before") + (F.col("n_rows") + 1) / 2


def mid_ranks(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Distinct values with their number of rows and average rank."""
    return cumulative_counts(df, value, groups).select(
        *groups, value, "n_rows", mid_rank().alias("mid_rank"))


def stack_measures(df: DataFrame, measures: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Long form (groups, measure, value) so that several measures share one pass."""
    return df.select(*groups, F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value"))
        for m in measures])).alias("_m")).select(*groups, "_m.measure", "_m.value")


def quantiles(df: DataFrame, value: str, probs: Mapping[str, float],
              groups: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Exact quantiles by linear interpolation between order statistics.

    Also yields ``n``, ``minimum``, ``maximum`` and ``mean`` of the non-null values.
    """
    ranked = cumulative_counts(df, value, groups, weight=weight)
    last = F.col("before") + F.col("n_rows")
    aggs = [F.max("total").alias("n"), F.min(value).alias("minimum"), F.max(value).alias("maximum"),
            (F.sum(F.col(value) * F.col("n_rows")) / F.max("total")).alias("mean")]
    outs = []
    for name, p in probs.items():
        at = (F.col("total") - 1) * F.lit(float(p))
        low = F.floor(at)
        high = F.least(low + 1, F.col("total") - 1)
        aggs += [
            F.max(F.when((F.col("before") <= low) & (low < last), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when((F.col("before") <= high) & (high < last), F.col(value))).alias(f"_hi_{name}"),
            F.max(at - low).alias(f"_fr_{name}")]
        outs.append((F.col(f"_lo_{name}") + F.col(f"_fr_{name}")
                     * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))).alias(name))
    return ranked.groupBy(*groups).agg(*aggs).select(
        *groups, "n", "minimum", "maximum", "mean", *outs)


def six_numbers(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Minimum, quartiles, mean, maximum and missing values of each measure."""
    long = stack_measures(df, measures)
    q = quantiles(long, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["measure"])
    missing = long.groupBy("measure").agg(F.count_if(F.col("value").isNull()).alias("n_missing"))
    return missing.join(q, "measure", "left").select(
        "measure", "minimum", "q1", "median", "mean", "q3", "maximum", "n_missing")


def median_iqr(df: DataFrame, group: str, measures: Sequence[str]) -> DataFrame:
    """Rows per group (nulls included), and median and IQR of each measure."""
    long = stack_measures(df, measures, [group])
    q = quantiles(long, "value", {"q1": 0.25, "med": 0.5, "q3": 0.75}, [group, "measure"])
    rows = long.groupBy(group, "measure").agg(F.count("*").alias("count"))
    return _join_null_safe(rows, q, [group, "measure"], "left").select(
        group, "measure", "count", F.col("med").alias("median"),
        (F.col("q3") - F.col("q1")).alias("iqr"))


def box_stats(df: DataFrame, value: str, reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (extremes inside the fences) and number of outliers."""
    counted = written(df.where(F.col(value).isNotNull()).groupBy(value).agg(
        F.count("*").alias("n")), "values")
    q = _quartiles(counted, value)
    low, high = _fences(q, reach)
    inside = F.col(value).between(low, high)
    return counted.agg(
        F.sum("n").alias("n"), F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.lit(q["q1"]).alias("q1"), F.lit(q["median"]).alias("median"), F.lit(q["q3"]).alias("q3"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("n_outliers"))


def box_outliers(df: DataFrame, value: str, reach: float = 1.5) -> DataFrame:
    """Rows outside the fences."""
    counted = df.groupBy(value).agg(F.count("*").alias("n"))
    low, high = _fences(_quartiles(counted, value), reach)
    return df.where(~F.col(value).between(low, high))


def _quartiles(counted: DataFrame, value: str) -> Row:
    """The three quartiles: one row of numbers on the driver."""
    return quantiles(counted, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, weight="n").first()


def _fences(q: Row, reach: float) -> tuple[float, float]:
    width = (q["q3"] - q["q1"]) * reach
    return q["q1"] - width, q["q3"] + width


def rank_sum_test(df: DataFrame, value: str, group: str, first) -> DataFrame:
    """Two-sample rank-sum test: W of the first level, z with tie and continuity correction.

    Rows with a null value or group drop out. Only one row leaves the last aggregate.
    """
    known = df.where(F.col(group).isNotNull())
    ranked = cumulative_counts(known, value,
                               extra={"n_first": F.count_if(F.col(group) == F.lit(first))})
    n = F.col("n_rows").cast("double")
    sums = ranked.agg(
        F.sum(F.col("n_first") * mid_rank()).alias("rank_sum"),
        F.sum("n_first").cast("double").alias("n1"),
        F.max("total").cast("double").alias("n_all"),
        F.sum(n * n * n - n).alias("ties"))
    n1, n_all = F.col("n1"), F.col("n_all")
    n2 = n_all - n1
    w = F.col("rank_sum") - n1 * (n1 + 1) / 2
    centred = w - n1 * n2 / 2
    spread = F.sqrt(n1 * n2 / 12 * ((n_all + 1) - F.col("ties") / (n_all * (n_all - 1))))
    return sums.select(
        n1.cast("bigint").alias("n1"), n2.cast("bigint").alias("n2"), w.alias("w"),
        ((centred - F.signum(centred) * 0.5) / spread).alias("z"))


def rank_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman's rho with S, t and degrees of freedom, over rows where both are known.

    Rows are counted per (x, y) pair before ranks are joined on, so a value shared by a third
    of the rows is one row per partner value by then.
    """
    pairs = written(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(
        F.count("*").alias("n_pair")), "pairs")

    def ranked(col: str) -> DataFrame:
        counted = cumulative_counts(pairs, col, weight="n_pair")
        return counted.select(col, mid_rank().alias(f"r_{col}"))

    both = pairs.join(ranked(x), x).join(ranked(y), y)
    n = F.col("n_pair")
    centre = (pairs.agg(F.sum("n_pair")).scalar() + 1) / 2
    dx, dy = F.col(f"r_{x}") - centre, F.col(f"r_{y}") - centre
    sums = both.agg(F.sum(n).cast("double").alias("n"), F.sum(n * dx * dy).alias("xy"),
                    F.sum(n * dx * dx).alias("xx"), F.sum(n * dy * dy).alias("yy"))
    rho = sums.select("n", (F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("rho"))
    size = F.col("n")
    return rho.select(
        size.cast("bigint").alias("n"), "rho",
        ((size * size * size - size) / 6 * (1 - F.col("rho"))).alias("s"),
        (F.col("rho") * F.sqrt((size - 2) / (1 - F.col("rho") * F.col("rho")))).alias("t"),
        (size - 2).cast("bigint").alias("df"))
