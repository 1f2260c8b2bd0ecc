"""Journal, year and taxon summaries, data growth and dataset citations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scholarlens.functions import columns as C
from scholarlens.functions.tails import normal_two_sided, student_two_sided
from scholarlens.operators import citations as D
from scholarlens.operators import counts as N
from scholarlens.operators import growth as G
from scholarlens.operators import ranks as R
from scholarlens.plans.registry import query, r6
from scholarlens.session import written
from scholarlens.sources import testviews as v

CUT = v.RECENT_STUDY


def snap(spark, sf):
    return v.snap(spark, sf).withColumn("basis2", C.basis_class("basis_of_record"))


_SNAP = f"WITH s AS (SELECT *, {v.basis_sql()} AS basis2 FROM v_snap) "
_LATEST = ("WITH s AS (SELECT * FROM v_snap WHERE snapshot_date = "
           "(SELECT max(snapshot_date) FROM v_snap)) ")


# --- counts ----------------------------------------------------------------------------------

@query("agg_count", "v_bib", "SELECT count(*) AS n FROM v_bib")
def agg_count(spark, sf):
    return v.bib_core(spark, sf).agg(F.count("*").alias("n"))


@query("agg_count_if", "v_bib", f"""
    SELECT count(*) FILTER (WHERE year > {CUT}) AS n_recent,
           count(*) FILTER (WHERE n_downloads > 0) AS n_doi,
           count(*) FILTER (WHERE countries_researcher IS NOT NULL) AS n_affiliated FROM v_bib""")
def agg_count_if(spark, sf):
    return v.studies(spark, sf).agg(
        F.count_if(F.col("year") > CUT).alias("n_recent"),
        F.count_if(F.col("n_downloads") > 0).alias("n_doi"),
        F.count_if(F.col("countries_researcher").isNotNull()).alias("n_affiliated"))


@query("agg_share_if", "v_cite", """
    SELECT round(avg(CASE WHEN citations > 0 THEN 1.0 ELSE 0.0 END), 6) AS share FROM v_cite""")
def agg_share_if(spark, sf):
    return N.share_if(v.cite(spark, sf), F.col("citations") > 0).select(r6("share", "share"))


@query("agg_group_count", "v_bib", "SELECT openaccess, count(*) AS n FROM v_bib GROUP BY 1")
def agg_group_count(spark, sf):
    return N.group_count(v.bib_core(spark, sf), "openaccess")


@query("agg_journal_open", "v_bib", """
    SELECT source, count(*) AS no, count(*) FILTER (WHERE openaccess) AS no_open
    FROM v_bib GROUP BY 1""")
def agg_journal_open(spark, sf):
    return N.journal_open_access(v.bib_core(spark, sf)).orderBy(F.desc("no"), "source")


@query("agg_journal_open_na", "v_bib", """
    SELECT source, count(*) AS no, count(*) FILTER (WHERE openaccess OR openaccess IS NULL)
           AS no_open FROM v_bib GROUP BY 1""")
def agg_journal_open_na(spark, sf):
    """Unknown access counted as met, as a logical subscript with missing values does."""
    return N.journal_open_access(v.bib_core(spark, sf), r_na=True)


@query("agg_ratio_of_sums", "v_bib", f"""
    SELECT count(*) AS no, count(*) FILTER (WHERE openaccess) AS no_open,
           round(count(*) FILTER (WHERE openaccess) / count(*), 6) AS ratio
    FROM v_bib WHERE year > {CUT}""")
def agg_ratio_of_sums(spark, sf):
    recent = v.bib_core(spark, sf).where(F.col("year") > CUT)
    return N.open_access_share(recent).withColumn("ratio", r6("ratio", "ratio"))


@query("agg_open_share_all_years", "v_bib", """
    SELECT count(*) AS no, count(*) FILTER (WHERE openaccess) AS no_open,
           round(count(*) FILTER (WHERE openaccess) / CAST(count(*) AS DOUBLE), 6) AS ratio FROM v_bib""")
def agg_open_share_all_years(spark, sf):
    return N.open_access_share(v.bib_core(spark, sf)).withColumn("ratio", r6("ratio", "ratio"))


@query("agg_year_abstracts", "v_doc", """
    SELECT year, count(*) AS papers, count(abstract) AS with_abstract FROM v_doc GROUP BY 1""")
def agg_year_abstracts(spark, sf):
    """Papers per year, and those that have an abstract."""
    return v.doc(spark, sf).groupBy("year").agg(
        F.count("*").alias("papers"), F.count("abstract").alias("with_abstract"))


@query("agg_factor_summary", "v_bib", f"""
    SELECT tracking_source, count(*) AS n FROM v_bib WHERE year > {CUT} GROUP BY 1""")
def agg_factor_summary(spark, sf):
    recent = v.bib_core(spark, sf).where(F.col("year") > CUT)
    return N.factor_summary(recent, "tracking_source").orderBy("n")


@query("agg_factor_summary_other", "v_snap", """
    WITH c AS (SELECT datasetkey, count(*) AS n FROM v_snap GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY n DESC, datasetkey) AS k,
                 count(*) OVER () AS levels FROM c)
    SELECT CASE WHEN levels <= 100 OR k <= 99 THEN datasetkey ELSE '(Other)' END AS datasetkey,
           CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""")
def agg_factor_summary_other(spark, sf):
    """More levels than the summary shows: the tail folds into one row."""
    return N.factor_summary(v.snap(spark, sf), "datasetkey")


@query("agg_year_pubs", "v_bib", """
    SELECT year, count(*) AS papers, CAST(sum(CASE WHEN n_downloads > 0 THEN 1 ELSE 0 END)
           AS BIGINT) AS papers_doi FROM v_bib GROUP BY 1""")
def agg_year_pubs(spark, sf):
    return N.papers_per_year(v.studies(spark, sf), C.flag_positive("n_downloads"))


@query("agg_taxon_share", "v_bib", f"""
    SELECT taxonomic_group, count(*) AS n,
           round(count(*) / (SELECT count(taxonomic_group) FROM v_bib), 6) AS proportion
    FROM v_bib WHERE year > {CUT} GROUP BY 1""")
def agg_taxon_share(spark, sf):
    """Recent counts over the known values of all years."""
    studies = v.bib_taxa(spark, sf)
    return N.group_shares_of_known(studies.where(F.col("year") > CUT), "taxonomic_group",
                                   studies).withColumn("proportion", r6("proportion", "p"))


@query("agg_taxon_buckets", "v_occ", """
    WITH b AS (SELECT CASE WHEN kingdom = 1 AND phylum = 44 THEN 'Vertebrates'
                           WHEN kingdom = 1 THEN 'Invertebrates' WHEN kingdom = 5 THEN 'Fungi'
                           WHEN kingdom IN (2, 3, 4, 7, 8) THEN 'Other'
                           WHEN kingdom = 6 THEN 'Plants' END AS taxon, occurrence_count FROM v_occ)
    SELECT taxon, CAST(sum(occurrence_count) AS BIGINT) AS n,
           round(sum(occurrence_count) / sum(sum(occurrence_count)) OVER (), 6) AS prop
    FROM b WHERE taxon IS NOT NULL GROUP BY 1""")
def agg_taxon_buckets(spark, sf):
    return N.bucket_shares(v.occ(spark, sf), C.taxon_bucket("kingdom", "phylum"),
                           "occurrence_count").withColumn("prop", r6("prop", "p"))


@query("agg_split_apply", "v_bib", """
    SELECT source, year, count(*) AS n, round(avg(n_downloads), 6) AS mean_downloads,
           max(n_records) AS max_records FROM v_bib GROUP BY 1, 2""")
def agg_split_apply(spark, sf):
    """Several summaries per group; native aggregates keep groups spread and pre-aggregated."""
    return v.studies(spark, sf).groupBy("source", "year").agg(
        F.count("*").alias("n"), r6(F.avg("n_downloads"), "mean_downloads"),
        F.max("n_records").alias("max_records"))


@query("ord_desc_count", "v_bib", """
    SELECT source, count(*) AS no, rank() OVER (ORDER BY count(*) DESC) AS rank
    FROM v_bib GROUP BY 1""")
def ord_desc_count(spark, sf):
    journals = N.group_count(v.bib_core(spark, sf), "source", name="no")
    return N.with_count_rank(journals, "no").select("source", "no", "rank").orderBy(
        F.desc("no"), "source")


@query("fn_journal_norm", "v_bib", """
    SELECT lower(trim(source)) AS journal, count(*) AS n FROM v_bib GROUP BY 1""")
def fn_journal_norm(spark, sf):
    return N.normalised_journals(v.bib_core(spark, sf))


@query("map_journal_discipline", "v_bib", """
    WITH j AS (SELECT lower(trim(source)) AS journal, count(*) AS n FROM v_bib GROUP BY 1),
    m AS (SELECT lower(trim(o_orderpriority)) AS journal, c_mktsegment AS discipline,
                 count(*) / sum(count(*)) OVER (PARTITION BY lower(trim(o_orderpriority))) AS weight
          FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
    SELECT discipline, round(sum(n * weight), 6) AS papers, count(*) AS journals,
           round(sum(n * weight) / (SELECT sum(n) FROM j) * 100, 6) AS share
    FROM j JOIN m USING (journal) GROUP BY 1""")
def map_journal_discipline(spark, sf):
    """Papers per discipline through a weighted journal-to-discipline table."""
    journals = N.normalised_journals(v.bib_core(spark, sf))
    orders = v.table(spark, sf, "orders")
    buyers = v.table(spark, sf, "customer")
    mapping = orders.join(buyers, orders.o_custkey == buyers.c_custkey).groupBy(
        F.lower(F.trim("o_orderpriority")).alias("journal"),
        F.col("c_mktsegment").alias("discipline")).agg(F.count("*").alias("links"))
    # One row per journal and discipline by now.
    mapping = mapping.withColumn("weight", F.col("links") / F.sum("links").over(
        Window.partitionBy("journal"))).drop("links")
    return N.disciplines(journals, mapping).select(
        "discipline", r6("papers", "papers"), "journals", r6("share", "share"))


# --- growth ----------------------------------------------------------------------------------

@query("prj_parse_date", "v_snap", """
    SELECT DISTINCT month(snapshot_date) || '/' || day(snapshot_date) || '/'
           || lpad(CAST(year(snapshot_date) % 100 AS VARCHAR), 2, '0') AS text, snapshot_date
    FROM v_snap""")
def prj_parse_date(spark, sf):
    """Month/day/two-digit-year texts back to dates."""
    texts = v.snap(spark, sf).select(
        F.date_format("snapshot_date", "M/d/yy").alias("text")).distinct()
    return texts.withColumn("snapshot_date", C.parse_month_day_year("text"))


@query("prj_recode_basis", "v_snap", _SNAP + """
    SELECT basis_of_record, basis2, count(*) AS n FROM s GROUP BY 1, 2""")
def prj_recode_basis(spark, sf):
    return N.group_count(snap(spark, sf), "basis_of_record", "basis2")


@query("prj_literal_col", "v_snap", """
    SELECT snapshot_date, CAST(sum(occurrence_count) AS BIGINT) AS total, 'total' AS basis2
    FROM v_snap GROUP BY 1""")
def prj_literal_col(spark, sf):
    return G.totals(v.snap(spark, sf), "occurrence_count", "snapshot_date").withColumn(
        "basis2", F.lit("total"))


@query("prj_growth_pct", "v_snap", """
    WITH t AS (SELECT snapshot_date, sum(occurrence_count) AS total FROM v_snap GROUP BY 1)
    SELECT CAST(arg_min(total, snapshot_date) AS BIGINT) AS first_total,
           CAST(arg_max(total, snapshot_date) AS BIGINT) AS last_total,
           round((arg_max(total, snapshot_date) - arg_min(total, snapshot_date))
                 / CAST(arg_min(total, snapshot_date) AS DOUBLE) * 100, 6) AS growth_pct FROM t""")
def prj_growth_pct(spark, sf):
    per_date = G.totals(v.snap(spark, sf), "occurrence_count", "snapshot_date")
    return G.growth_percent(per_date).withColumn("growth_pct", r6("growth_pct", "g"))


@query("prj_share_of_bounds", "v_snap", _SNAP + """
    SELECT round(sum(occurrence_count) / 1e6, 6) AS share_of_low,
           round(sum(occurrence_count) / 2e6, 6) AS share_of_high
    FROM s WHERE basis2 = 'Specimen-based'
    AND snapshot_date = (SELECT max(snapshot_date) FROM v_snap)""")
def prj_share_of_bounds(spark, sf):
    latest = G.latest_snapshot(snap(spark, sf), "snapshot_date")
    total = G.totals(latest.where(F.col("basis2") == "Specimen-based"), "occurrence_count")
    low, high = G.share_of_bounds(F.col("total"), 1e6, 2e6)
    return total.select(low, high).select(r6("share_of_low", "share_of_low"),
                                          r6("share_of_high", "share_of_high"))


@query("prj_scale_millions", "v_snap", """
    SELECT snapshot_date, round(sum(occurrence_count) / 1e6, 6) AS millions
    FROM v_snap GROUP BY 1""")
def prj_scale_millions(spark, sf):
    per_date = G.totals(v.snap(spark, sf), "occurrence_count", "snapshot_date")
    return per_date.select("snapshot_date", r6(C.millions("total"), "millions"))


@query("flt_snapshot", "v_snap", _LATEST + """
    SELECT datasetkey, basis_of_record, tagged_citizen_science, occurrence_count FROM s""")
def flt_snapshot(spark, sf):
    return G.latest_snapshot(v.snap(spark, sf), "snapshot_date").drop("snapshot_date")


@query("flt_category", "v_snap", _SNAP + """
    SELECT basis2, count(*) AS n FROM s WHERE basis2 <> 'Unknown' GROUP BY 1""")
def flt_category(spark, sf):
    return N.group_count(snap(spark, sf).where(F.col("basis2") != "Unknown"), "basis2")


@query("agg_group_distinct_verb", "v_snap", _LATEST + """
    SELECT tagged_citizen_science, count(*) AS n FROM s GROUP BY 1""")
def agg_group_distinct_verb(spark, sf):
    return N.group_count(G.latest_snapshot(v.snap(spark, sf), "snapshot_date"),
                         "tagged_citizen_science")


@query("agg_count_distinct", "v_snap", _LATEST + """
    SELECT count(DISTINCT datasetkey) AS n_keys,
           count(DISTINCT datasetkey) FILTER (WHERE tagged_citizen_science) AS n_citizen,
           count(DISTINCT datasetkey) FILTER (WHERE NOT tagged_citizen_science) AS n_other,
           round(count(DISTINCT datasetkey) FILTER (WHERE tagged_citizen_science)
                 / count(DISTINCT datasetkey), 6) AS share FROM s""")
def agg_count_distinct(spark, sf):
    latest = G.latest_snapshot(v.snap(spark, sf), "snapshot_date")
    tagged = F.col("tagged_citizen_science")
    return G.distinct_keys(latest, "datasetkey", n_citizen=tagged, n_other=~tagged).withColumn(
        "share", r6(F.col("n_citizen") / F.col("n_keys"), "s"))


@query("set_distinct", "v_snap", "SELECT DISTINCT datasetkey FROM v_snap")
def set_distinct(spark, sf):
    return v.snap(spark, sf).select("datasetkey").distinct()


@query("agg_sum_by_date", "v_snap", """
    SELECT snapshot_date, CAST(sum(occurrence_count) AS BIGINT) AS total FROM v_snap GROUP BY 1""")
def agg_sum_by_date(spark, sf):
    return G.totals(v.snap(spark, sf), "occurrence_count", "snapshot_date")


@query("agg_sum_by_date_cat", "v_snap", _SNAP + """
    SELECT snapshot_date, basis2, CAST(sum(occurrence_count) AS BIGINT) AS total
    FROM s GROUP BY 1, 2""")
def agg_sum_by_date_cat(spark, sf):
    return G.totals(snap(spark, sf), "occurrence_count", "snapshot_date", "basis2")


@query("agg_total_and_parts", "v_snap", _SNAP + """
    SELECT snapshot_date, CASE WHEN grouping(basis2) = 1 THEN 'total' ELSE basis2 END AS basis2,
           CAST(grouping(basis2) AS INTEGER) AS is_total,
           CAST(sum(occurrence_count) AS BIGINT) AS total
    FROM s GROUP BY GROUPING SETS ((snapshot_date, basis2), (snapshot_date))""")
def agg_total_and_parts(spark, sf):
    return G.totals_and_parts(snap(spark, sf), "snapshot_date", "basis2", "occurrence_count")


@query("win_share_in_group", "v_snap", _SNAP + """
    SELECT snapshot_date, basis2, CAST(sum(occurrence_count) AS BIGINT) AS total,
           round(sum(occurrence_count) / CAST(sum(sum(occurrence_count))
                 OVER (PARTITION BY snapshot_date) AS DOUBLE), 6) AS prop
    FROM s GROUP BY 1, 2""")
def win_share_in_group(spark, sf):
    return G.shares_by_date(snap(spark, sf), "snapshot_date", "basis2", "occurrence_count"
                            ).withColumn("prop", r6("prop", "p"))


@query("win_share_by_tag", "v_snap", """
    SELECT snapshot_date, tagged_citizen_science, CAST(sum(occurrence_count) AS BIGINT) AS total,
           round(sum(occurrence_count) / CAST(sum(sum(occurrence_count)) OVER (
               PARTITION BY snapshot_date) AS DOUBLE), 6) AS prop
    FROM v_snap GROUP BY 1, 2""")
def win_share_by_tag(spark, sf):
    """Records per date and citizen-science tag, with the tag's share of the date."""
    return G.shares_by_date(v.snap(spark, sf), "snapshot_date", "tagged_citizen_science",
                            "occurrence_count").withColumn("prop", r6("prop", "p"))


# --- dataset citations and rank statistics ---------------------------------------------------

@query("join_left_citations", "v_snap v_cite", _LATEST + """
    SELECT s.*, citations FROM s LEFT JOIN v_cite c ON s.datasetkey = c.datasetkey""")
def join_left_citations(spark, sf):
    latest = G.latest_snapshot(v.snap(spark, sf), "snapshot_date")
    return D.with_citations(latest, v.cite(spark, sf))


@query("win_group_sum_keep_rows", "v_dsum", """
    SELECT datasetkey, basis_of_record, tagged_citizen_science, citations, total_occurrences,
           round(citations_per_record, 6) AS citations_per_record, basis2, part_occurrences,
           round(citations_per_part_record, 6) AS citations_per_part_record FROM v_dsum""")
def win_group_sum_keep_rows(spark, sf):
    return v.dsum(spark, sf).select(
        "datasetkey", "basis_of_record", "tagged_citizen_science", "citations",
        "total_occurrences", r6("citations_per_record", "citations_per_record"), "basis2",
        "part_occurrences", r6("citations_per_part_record", "citations_per_part_record"))


@query("win_midrank", "v_dsum", """
    SELECT DISTINCT citations, count(*) OVER (PARTITION BY citations) AS n_rows,
           rank() OVER (ORDER BY citations)
           + (count(*) OVER (PARTITION BY citations) - 1) / 2 AS mid_rank
    FROM v_dsum WHERE citations IS NOT NULL""")
def win_midrank(spark, sf):
    return R.mid_ranks(v.dsum(spark, sf), "citations")


@query("agg_six_number", "v_bib", """
    WITH l AS (SELECT 'n_downloads' AS measure, CAST(n_downloads AS DOUBLE) AS x FROM v_bib
               UNION ALL SELECT 'n_records', CAST(n_records AS DOUBLE) FROM v_bib)
    SELECT measure, min(x) AS minimum, round(quantile_cont(x, 0.25), 6) AS q1,
           round(median(x), 6) AS median, round(avg(x), 6) AS mean,
           round(quantile_cont(x, 0.75), 6) AS q3, max(x) AS maximum,
           count(*) FILTER (WHERE x IS NULL) AS n_missing FROM l GROUP BY 1""")
def agg_six_number(spark, sf):
    table = R.six_numbers(v.studies(spark, sf), ["n_downloads", "n_records"])
    return table.select("measure", "minimum", r6("q1", "q1"), r6("median", "median"),
                        r6("mean", "mean"), r6("q3", "q3"), "maximum", "n_missing")


@query("agg_median_iqr", "v_dsum", """
    WITH l AS (SELECT tagged_citizen_science, 'citations' AS measure,
                      CAST(citations AS DOUBLE) AS x FROM v_dsum
               UNION ALL SELECT tagged_citizen_science, 'citations_per_record',
                                citations_per_record FROM v_dsum)
    SELECT tagged_citizen_science, measure, count(*) AS count, round(median(x), 6) AS median,
           round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr
    FROM l GROUP BY 1, 2""")
def agg_median_iqr(spark, sf):
    return R.median_iqr(v.dsum(spark, sf), "tagged_citizen_science",
                        ["citations", "citations_per_record"]).withColumn(
        "median", r6("median", "m")).withColumn("iqr", r6("iqr", "i"))


@query("agg_median_iqr_basis", "v_dsum", """
    WITH l AS (SELECT basis2, 'citations' AS measure, CAST(citations AS DOUBLE) AS x FROM v_dsum
               UNION ALL SELECT basis2, 'citations_per_part_record',
                                citations_per_part_record FROM v_dsum)
    SELECT basis2, measure, count(*) AS count, round(median(x), 6) AS median,
           round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr
    FROM l GROUP BY 1, 2""")
def agg_median_iqr_basis(spark, sf):
    """Per class of record, over the records of that class alone."""
    return R.median_iqr(v.dsum(spark, sf), "basis2",
                        ["citations", "citations_per_part_record"]).withColumn(
        "median", r6("median", "m")).withColumn("iqr", r6("iqr", "i"))


@query("agg_boxplot_stats", "v_dsum", """
    WITH q AS (SELECT quantile_cont(total_occurrences, 0.25) AS q1,
                      median(total_occurrences) AS med,
                      quantile_cont(total_occurrences, 0.75) AS q3 FROM v_dsum),
    f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
    SELECT count(total_occurrences) AS n,
           min(total_occurrences) FILTER (WHERE total_occurrences BETWEEN lo AND hi) AS whisker_low,
           round(any_value(q1), 6) AS q1, round(any_value(med), 6) AS median,
           round(any_value(q3), 6) AS q3,
           max(total_occurrences) FILTER (WHERE total_occurrences BETWEEN lo AND hi) AS whisker_high,
           count(*) FILTER (WHERE total_occurrences NOT BETWEEN lo AND hi) AS n_outliers
    FROM v_dsum, f""")
def agg_boxplot_stats(spark, sf):
    box = R.box_stats(v.dsum(spark, sf), "total_occurrences")
    return box.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


_WILCOXON = """
    WITH r AS (SELECT g, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS mr,
                      x FROM ({rows}) WHERE g IS NOT NULL AND x IS NOT NULL),
    t AS (SELECT sum(CAST(c AS DOUBLE) * c * c - c) AS ties
          FROM (SELECT count(*) AS c FROM r GROUP BY x)),
    s AS (SELECT sum(mr) FILTER (WHERE g = {first}) AS rs,
                 CAST(count(*) FILTER (WHERE g = {first}) AS DOUBLE) AS n1,
                 CAST(count(*) AS DOUBLE) AS n FROM r),
    w AS (SELECT *, rs - n1 * (n1 + 1) / 2 AS w, n - n1 AS n2 FROM s, t)
    SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, w,
           round((w - n1 * n2 / 2 - sign(w - n1 * n2 / 2) * 0.5)
                 / sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))), 6) AS z FROM w"""


@query("stat_wilcoxon", "v_dsum", _WILCOXON.format(
    rows="SELECT tagged_citizen_science AS g, citations AS x FROM v_dsum", first="false"))
def stat_wilcoxon(spark, sf):
    return R.rank_sum_test(v.dsum(spark, sf), "citations", "tagged_citizen_science", False
                           ).withColumn("z", r6("z", "z"))


@query("stat_wilcoxon_per_record", "v_dsum", _WILCOXON.format(
    rows="SELECT tagged_citizen_science AS g, citations_per_record AS x FROM v_dsum",
    first="false"))
def stat_wilcoxon_per_record(spark, sf):
    return R.rank_sum_test(v.dsum(spark, sf), "citations_per_record", "tagged_citizen_science",
                           False).withColumn("z", r6("z", "z"))


@query("stat_wilcoxon_basis", "v_dsum", _WILCOXON.format(
    rows="SELECT nullif(basis2, 'Unknown') AS g, citations AS x FROM v_dsum",
    first="'Observation-based'"))
def stat_wilcoxon_basis(spark, sf):
    return R.rank_sum_test(v.dsum(spark, sf).where(F.col("basis2") != "Unknown"), "citations",
                           "basis2", "Observation-based").withColumn("z", r6("z", "z"))


@query("stat_wilcoxon_basis_per_record", "v_dsum", _WILCOXON.format(
    rows="SELECT nullif(basis2, 'Unknown') AS g, citations_per_part_record AS x FROM v_dsum",
    first="'Observation-based'"))
def stat_wilcoxon_basis_per_record(spark, sf):
    return R.rank_sum_test(
        v.dsum(spark, sf).where(F.col("basis2") != "Unknown"), "citations_per_part_record",
        "basis2", "Observation-based").withColumn("z", r6("z", "z"))


@query("agg_boxplot_outliers", "v_dsum", """
    WITH q AS (SELECT quantile_cont(citations, 0.25) AS q1, quantile_cont(citations, 0.75) AS q3
               FROM v_dsum)
    SELECT datasetkey, basis_of_record, citations, total_occurrences FROM v_dsum, q
    WHERE citations NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""")
def agg_boxplot_outliers(spark, sf):
    """Rows whose citations lie outside the fences."""
    return R.box_outliers(written(v.dsum(spark, sf), "cited"), "citations").select(
        "datasetkey", "basis_of_record", "citations", "total_occurrences")


@query("agg_cited_boxplot", "v_dsum", """
    WITH q AS (SELECT quantile_cont(citations, 0.25) AS q1, median(citations) AS med,
                      quantile_cont(citations, 0.75) AS q3 FROM v_dsum),
    f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
    SELECT count(citations) AS n, min(citations) FILTER (WHERE citations BETWEEN lo AND hi) AS whisker_low,
           round(any_value(q1), 6) AS q1, round(any_value(med), 6) AS median, round(any_value(q3), 6) AS q3,
           max(citations) FILTER (WHERE citations BETWEEN lo AND hi) AS whisker_high,
           count(*) FILTER (WHERE citations NOT BETWEEN lo AND hi) AS n_outliers
    FROM v_dsum, f""")
def agg_cited_boxplot(spark, sf):
    box = R.box_stats(v.dsum(spark, sf), "citations")
    return box.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query("stat_wilcoxon_p", "v_dsum", "WITH t AS (" + _WILCOXON.format(
    rows="SELECT tagged_citizen_science AS g, citations AS x FROM v_dsum", first="false") + """),
    i AS (SELECT unnest(range(0, 4001)) AS i)
    SELECT n1, n2, w, z, round(1 - 2 / sqrt(pi()) * sum(
        exp(-power(abs(z) / sqrt(2) * i / 4000, 2))
        * CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
        * abs(z) / sqrt(2) / 4000 / 3, 6) AS p
    FROM t, i GROUP BY 1, 2, 3, 4""")
def stat_wilcoxon_p(spark, sf):
    """Two-sided p value, worked out on the single result row."""
    return R.rank_sum_test(v.dsum(spark, sf), "citations", "tagged_citizen_science", False
                           ).withColumn("z", r6("z", "z")).withColumn(
        "p", r6(normal_two_sided("z"), "p"))


_SPEARMAN = """
    WITH r AS (SELECT rank() OVER (ORDER BY total_occurrences)
                      + (count(*) OVER (PARTITION BY total_occurrences) - 1) / 2 AS rx,
                      rank() OVER (ORDER BY citations)
                      + (count(*) OVER (PARTITION BY citations) - 1) / 2 AS ry
               FROM v_dsum WHERE citations IS NOT NULL AND total_occurrences IS NOT NULL),
    c AS (SELECT corr(rx, ry) AS rho, CAST(count(*) AS DOUBLE) AS n FROM r),
    t AS (SELECT n, rho, rho * sqrt((n - 2) / (1 - rho * rho)) AS t, n - 2 AS df FROM c)
"""


@query("stat_spearman", "v_dsum", _SPEARMAN + """
    SELECT CAST(n AS BIGINT) AS n, round(rho, 6) AS rho,
           round((n * n * n - n) / 6 * (1 - rho), 2) AS s, round(t, 6) AS t,
           CAST(df AS BIGINT) AS df FROM t""")
def stat_spearman(spark, sf):
    result = R.rank_correlation(v.dsum(spark, sf), "total_occurrences", "citations")
    return result.select("n", r6("rho", "rho"), F.round("s", 2).alias("s"), r6("t", "t"), "df")


@query("stat_spearman_p", "v_dsum", _SPEARMAN + """,
    i AS (SELECT unnest(range(0, 4001)) AS i)
    SELECT CAST(n AS BIGINT) AS n, round(rho, 6) AS rho, round(1 - 2 * sum(
        exp(lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * ln(df * pi())
            - (df + 1) / 2 * ln(1 + power(abs(t) * i / 4000, 2) / df))
        * CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
        * abs(t) / 4000 / 3, 6) AS p
    FROM t, i GROUP BY n, rho, t, df""")
def stat_spearman_p(spark, sf):
    result = R.rank_correlation(v.dsum(spark, sf), "total_occurrences", "citations")
    return result.select("n", r6("rho", "rho"),
                         r6(student_two_sided("t", F.col("df").cast("double")), "p"))
