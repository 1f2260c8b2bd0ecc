from pyspark.sql import functions as F

from scholarlens.operators import citations as D
from scholarlens.operators import counts as N
from scholarlens.operators import topic_quality as Q
from scholarlens.operators import topic_tables as T
from scholarlens.sources import readers
from scholarlens.sources.schemas import DATASET_SNAPSHOTS

KEYS = ["datasetkey", "citations"]
ROWS = [("a", 6, "spec", 3), ("a", 6, "spec", 1), ("a", 6, "obs", 2), ("b", None, "obs", 5),
        ("b", None, None, 5), (None, 4, "obs", 8)]


def cited(spark):
    return spark.createDataFrame(ROWS, "datasetkey string, citations long, basis string, occurrence_count long")


def test_totals_under_two_groupings_keep_every_row(spark):
    out = D.with_both_totals(cited(spark), KEYS, "basis").collect()
    got = sorted((str(r.datasetkey), str(r.basis), r.occurrence_count, r.total_occurrences,
                  r.part_occurrences, r.citations_per_record, r.citations_per_part_record) for r in out)
    assert got == sorted([
        ("a", "spec", 3, 6, 4, 1.0, 1.5), ("a", "spec", 1, 6, 4, 1.0, 1.5), ("a", "obs", 2, 6, 2, 1.0, 3.0),
        ("b", "obs", 5, 10, 5, None, None), ("b", "None", 5, 10, 5, None, None),
        ("None", "obs", 8, 8, 8, 0.5, 0.5)])


def test_collapsed_totals_with_and_without_citations_as_key(spark):
    for keys in (KEYS, ["datasetkey"]):
        out = D.with_group_totals(cited(spark), keys, collapse=True).collect()
        assert {(r.datasetkey, r.citations, r.total_occurrences, r.citations_per_record) for r in out} == {
            ("a", 6, 6, 1.0), ("b", None, 10, None), (None, 4, 8, 0.5)}


def test_pairs_are_completed_with_zeros(spark):
    counts = spark.createDataFrame([(1, "x", 4), (2, "y", 1), (None, "y", 7)], "k int, c string, n long")
    dim = spark.createDataFrame([("x",), ("y",), ("z",)], "c string")
    out = {(r.k, r.c): r.n for r in N.complete_pairs(counts.where("k is not null"), "k", "c", dim).collect()}
    assert out == {(1, "x"): 4, (1, "y"): 0, (1, "z"): 0, (2, "x"): 0, (2, "y"): 1, (2, "z"): 0}
    assert N.complete_pairs(counts.limit(0), "k", "c", dim).count() == 0


def test_checked_read_parts_rows_and_rejects(spark, tmp_path):
    (tmp_path / "s.csv").write_text(
        "snapshot_date,datasetkey,basis_of_record,tagged_citizen_science,occurrence_count\n"
        "7/1/20,d1,OBSERVATION,true,5\n7/1/20,d2,,false,\n7/1/20,d3,OBSERVATION,true,many\n"
        "soon,d4,OBSERVATION,true,5\n7/1/20,d5\n7/1/20,d6,OBSERVATION,true,5,more\n")
    rows, rejects = readers.read_checked(spark, str(tmp_path), DATASET_SNAPSHOTS, ["snapshot_date"])
    assert sorted((r.datasetkey, r.occurrence_count) for r in rows.collect()) == [("d1", 5), ("d2", None)]
    assert rows.agg(F.count("datasetkey")).first()[0] == 2  # pruned columns reject alike
    assert sorted((r.line.split(",")[1], r.reason) for r in rejects.collect()) == [
        ("d3", "malformed"), ("d4", "date"), ("d5", "malformed"), ("d6", "malformed")]


def test_significant_digits(spark):
    xs = [0.0, 1.23456789049e-9, -1.23456789051e-9, 123456.789012, 1.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(
        Q.significant("x")).collect()]
    assert [f"{x:.9g}" for x in got] == [f"{x:.9g}" for x in xs]


def test_exclusivity_by_thresholds_equals_ranked(spark):
    rows = [(t, f"w{i}", -1.0 - ((i * 7 + t * 3) % 11) / 3) for t in (1, 2, 3) for i in range(30)]
    beta = spark.createDataFrame(rows, "topic int, term string, logbeta double")
    want = T.top_words(Q.frex(beta, 0.7), 4).groupBy("topic").agg(F.sum("frex").alias("e"))
    got = Q.exclusivity(beta, 4)
    a, b = ({r[0]: round(r[1], 9) for r in x.collect()} for x in (want, got))
    assert a == b


def test_correlations_of_equal_and_missing_shares(spark):
    rows = [(d, 1, 0.1 * d) for d in range(5)] + [(d, 2, 0.2 * d + 0.1) for d in range(5)]
    rows += [(d, 3, 0.5) for d in range(5)]
    theta = spark.createDataFrame(rows, "doc_id long, topic int, theta double")
    edges = T.topic_correlations(theta).collect()
    assert [(r.src, r.dst, round(r["corr"], 9)) for r in edges] == [(1, 2, 1.0)]
    assert T.topic_correlations(theta.limit(0)).count() == 0
