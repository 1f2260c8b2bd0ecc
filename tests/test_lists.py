from pyspark.sql import functions as F

from scholarlens.functions.fixed import SENTINEL, UNMATCHED_REGION
from scholarlens.operators import counts as N
from scholarlens.operators import multivalue as M


def studies(spark):
    return spark.createDataFrame(
        [(1, None), (2, ""), (3, "US,NA"), (4, "US,US"), (5, SENTINEL), (6, "ZZ")],
        "id int, countries_coverage string")


def dimension(spark):
    return spark.createDataFrame([("US", "NORTH"), ("NA", "AFRICA"), ("FR", "EUROPE")],
                                 "iso2 string, region string")


def test_separate_rows_keeps_nulls_blanks_and_repeats(spark):
    rows = M.separate_rows(studies(spark), "countries_coverage").orderBy("id").collect()
    got = {}
    for r in rows:
        got.setdefault(r.id, []).append(r.countries_coverage)
    assert got[1] == [None] and got[2] == [""]
    assert sorted(got[3]) == ["NA", "US"] and got[4] == ["US", "US"]
    once = M.separate_rows(studies(spark), "countries_coverage", distinct=True)
    assert once.where("id = 4").count() == 1


def test_code_na_joins_and_null_does_not(spark):
    rows = M.separate_rows(studies(spark), "countries_coverage", out="code")
    joined = M.attach_region(rows, "code", dimension(spark))
    assert joined.where("code = 'NA'").first().region == "AFRICA"
    assert joined.where("id = 1").first().region is None
    null_dim = spark.createDataFrame([(None, "NOWHERE")], "iso2 string, region string")
    assert M.attach_region(rows, "code", null_dim, null_safe=True).where(
        "id = 1").first().region == "NOWHERE"


def test_region_coverage_counts_and_percents(spark):
    out = {r.region: r for r in M.region_coverage(studies(spark), dimension(spark)).collect()}
    assert (out["NORTH"].n, out["NORTH"].n_studies) == (3, 2)
    rest = out[UNMATCHED_REGION]
    assert (rest.n, rest.n_no_list, rest.n_global, rest.n_unknown_code) == (4, 1, 1, 2)
    assert abs(out["AFRICA"].prop_all - 100 / 6) < 1e-9
    assert abs(out["AFRICA"].prop_single - 100 / 5) < 1e-9
    assert rest.prop_single is None


def test_authorship_covers_every_region(spark):
    table = spark.createDataFrame([("single", "US,FR"), ("global", "US"), ("global", None)],
                                  "part string, countries_researcher string")
    out = {(r.part, r.region): (r.n, r.prop_all) for r in M.region_authorship(
        table, dimension(spark), by=F.col("part")).collect()}
    assert out[("single", "AFRICA")] == (0, 0.0) and out[("global", "EUROPE")] == (0, 0.0)
    assert out[("single", "NORTH")] == (1, 50.0)
    assert out[("global", UNMATCHED_REGION)] == (1, 50.0)


def test_complete_domain_and_spine(spark):
    counts = spark.createDataFrame([("a", 2)], "k string, n bigint")
    domain = spark.createDataFrame([("a",), ("b",)], "k string")
    assert dict(N.complete_domain(counts, "k", domain).collect()) == {"a": 2, "b": 0}
    years = spark.createDataFrame([(2003, 5)], "year int, papers bigint")
    assert dict(N.with_year_spine(years, 2001, 2003).collect()) == {2001: 0, 2002: 0, 2003: 5}


def test_unmapped_journals_are_counted(spark):
    journals = spark.createDataFrame([("a", 3), ("b", 2)], "journal string, n bigint")
    mapping = spark.createDataFrame([("a", "X", 0.5), ("a", "Y", 0.5)],
                                    "journal string, discipline string, weight double")
    out = {r.discipline: r.papers for r in N.disciplines(journals, mapping).collect()}
    assert out == {"X": 1.5, "Y": 1.5, "unmapped": 2.0}


def test_factor_summary_folds_the_tail(spark):
    rows = spark.range(250).select(F.concat(F.lit("v"), F.col("id") % 120).alias("g"))
    out = N.factor_summary(rows, "g", 100)
    assert out.count() == 100
    assert out.agg(F.sum("n")).first()[0] == 250
    assert N.factor_summary(rows.where("g < 'v11'"), "g", 100).where("g = '(Other)'").count() == 0


def test_open_access_null_rule(spark):
    rows = spark.createDataFrame([("j", True), ("j", False), ("j", None)],
                                 "source string, openaccess boolean")
    assert N.journal_open_access(rows).first().no_open == 1
    assert N.journal_open_access(rows, r_na=True).first().no_open == 2
