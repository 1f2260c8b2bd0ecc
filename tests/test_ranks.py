import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scholarlens.functions.tails import normal_two_sided, student_two_sided
from scholarlens.operators import citations as D
from scholarlens.operators import ranks as R


def frame(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "x double")


def skewed(spark, n=4000):
    """A third of the rows share one value; two groups, some nulls."""
    rng = random.Random(7)
    rows = [(0.0 if rng.random() < 0.34 else round(rng.gauss(0, 5), 1) if rng.random() < 0.95
             else None, rng.choice(["a", "a", "b", None])) for _ in range(n)]
    return spark.createDataFrame(rows, "x double, g string")


def test_mid_ranks_of_ties(spark):
    out = {r.x: r.mid_rank for r in R.mid_ranks(frame(spark, [5, 5, 7]), "x").collect()}
    assert out == {5.0: 1.5, 7.0: 3.0}


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_ranks_equal_a_plain_window_for_any_partitioning(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = skewed(spark)
        got = {(r.g, r.x): r.mid_rank for r in R.mid_ranks(df, "x", ["g"]).collect()}
        w = Window.partitionBy("g").orderBy("x")
        plain = df.where("x is not null").select("g", "x", (
            F.rank().over(w) + (F.count("*").over(Window.partitionBy("g", "x")) - 1) / 2)
            .alias("r")).distinct()
        assert got == {(r.g, r.x): r.r for r in plain.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_quantiles_interpolate(spark):
    q = R.quantiles(frame(spark, [1, 2, 3, 10]), "x", {"q1": .25, "med": .5}).first()
    assert (q.q1, q.med, q.n) == (1.75, 2.5, 4)


def test_grouped_quantiles_match_numpy(spark):
    df = skewed(spark)
    local = df.toPandas()
    probs = {"a": 0.1, "b": 0.5, "c": 0.99}
    for r in R.quantiles(df, "x", probs, ["g"]).collect():
        mine = local[local.g.isna() if r.g is None else local.g == r.g].x.dropna()
        assert np.allclose([r.a, r.b, r.c], np.quantile(mine, [0.1, 0.5, 0.99]))


def test_rank_sum_small_case_and_symmetry(spark):
    rows = [(False, 1), (False, 2), (False, 2), (True, 2), (True, 3), (None, 9), (True, None)]
    df = spark.createDataFrame(rows, "g boolean, x int")
    first = R.rank_sum_test(df, "x", "g", False).first()
    second = R.rank_sum_test(df, "x", "g", True).first()
    assert (first.w, second.w) == (1.0, 5.0)
    assert first.w + second.w == first.n1 * first.n2
    assert first.z == pytest.approx(-second.z)


def test_rank_correlation_ignores_monotone_change(spark):
    rng = random.Random(3)
    rows = [(x, x + rng.gauss(0, 2)) for x in (rng.randint(0, 20) for _ in range(500))]
    df = spark.createDataFrame(rows, "x int, y double")
    a = R.rank_correlation(df, "x", "y").first()
    b = R.rank_correlation(df.withColumn("y", F.exp("y")), "x", "y").first()
    local = df.toPandas().rank().corr().iloc[0, 1]
    assert a.rho == pytest.approx(local, abs=1e-12) and b.rho == pytest.approx(a.rho, abs=1e-12)
    assert a.df == 498


def test_tails(spark):
    row = spark.createDataFrame([(1.959963985, 2.0, 10.0)], "z double, t double, df double").select(
        normal_two_sided("z").alias("p"), student_two_sided("t", "df").alias("q"),
        student_two_sided(F.lit(2.0), F.lit(4000.0)).alias("r")).first()
    assert row.p == pytest.approx(0.05, abs=1e-9)
    assert row.q == pytest.approx(0.0733880, abs=1e-7)
    assert row.r == pytest.approx(0.0455674, abs=1e-5)


def test_box_stats_find_the_outlier(spark):
    df = frame(spark, [1, 2, 3, 4, 5, 100])
    box = R.box_stats(df, "x").first()
    assert (box.whisker_low, box.whisker_high, box.n_outliers) == (1.0, 5.0, 1)
    assert [r.x for r in R.box_outliers(df, "x").collect()] == [100.0]


def test_group_totals_keep_rows(spark):
    rows = spark.createDataFrame([("d", 3, 5), ("d", 7, 5), ("e", 2, None)],
                                 "datasetkey string, occurrence_count bigint, citations bigint")
    out = D.with_group_totals(rows, ["datasetkey", "citations"]).where("datasetkey = 'd'").collect()
    assert [(r.total_occurrences, r.citations_per_record) for r in out] == [(10, 0.5)] * 2
    assert D.with_group_totals(rows, ["datasetkey", "citations"]).count() == 3
    assert D.with_group_totals(rows, ["datasetkey", "citations"], collapse=True).count() == 2
