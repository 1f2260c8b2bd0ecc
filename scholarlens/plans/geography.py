"""Sources, flags, multi-value lists and region coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholarlens.functions import columns as C
from scholarlens.functions.fixed import SENTINEL, UNMATCHED_REGION
from scholarlens.operators import counts as N
from scholarlens.operators import multivalue as M
from scholarlens.plans.registry import query, r6
from scholarlens.session import scratch_path
from scholarlens.sources import readers, writers
from scholarlens.sources import testviews as v

CUT = v.RECENT_STUDY
BIB_FIELDS = ("id", "year", "source", "openaccess", "tracking_source", "taxonomic_group",
              "n_downloads", "n_records", "countries_researcher", "countries_coverage")
# Presentation order of the regions of the test tables.
REGION_ORDER = ("MIDDLE EAST", "EUROPE", "AFRICA", "ASIA", "AMERICA")
REGION_LABELS = {"AFRICA": "Africa", "AMERICA": "America", "ASIA": "Asia", "EUROPE": "Europe",
                 "MIDDLE EAST": "Middle East"}
_ORDER_SQL = "(VALUES " + ", ".join(
    f"('{r}', {i})" for i, r in enumerate(REGION_ORDER, 1)) + ") AS o(region, ord)"
_LABEL_SQL = "(VALUES " + ", ".join(
    f"('{k}', '{t}')" for k, t in REGION_LABELS.items()) + ") AS l(region, label)"


def recent(df):
    return df.where(F.col("year") > CUT)


# --- sources and sinks -----------------------------------------------------------------------

@query("src_csv_bib", "v_bib", "SELECT * FROM v_bib")
def src_csv_bib(spark, sf):
    """The bibliographic table through CSV and back, with a declared schema."""
    table = v.bib(spark, sf).select(*BIB_FIELDS)
    path = scratch_path(spark, "bib_csv")
    table.write.csv(path, header=True, escape='"')
    return readers.read_csv(spark, path, table.schema)


def snapshot_file(spark, sf):
    """Snapshots as a CSV; sizes of the basis ``OTHER`` are written as a text that is no number."""
    rows = v.snap(spark, sf).select(
        F.date_format("snapshot_date", "M/d/yy").alias("snapshot_date"), "datasetkey",
        "basis_of_record", "tagged_citizen_science",
        F.when(F.col("basis_of_record") == "OTHER", F.lit("not counted")).otherwise(
            F.col("occurrence_count").cast("string")).alias("occurrence_count"))
    path = scratch_path(spark, "snapshots_csv")
    rows.write.csv(path, header=True, escape='"')
    return path


@query("src_csv_snapshots", "v_snap", "SELECT * FROM v_snap WHERE basis_of_record <> 'OTHER'")
def src_csv_snapshots(spark, sf):
    """Dated dataset sizes out of a CSV, typed; lines that do not fit are not among them."""
    return readers.read_snapshots(spark, snapshot_file(spark, sf))[0]


@query("src_csv_rejects", "v_snap", """
    SELECT 'malformed' AS reason, count(*) AS lines, count(DISTINCT datasetkey) AS datasets
    FROM v_snap WHERE basis_of_record = 'OTHER'""")
def src_csv_rejects(spark, sf):
    """Rejected lines of the same CSV."""
    rejects = readers.read_snapshots(spark, snapshot_file(spark, sf))[1]
    return rejects.groupBy("reason").agg(
        F.count("*").alias("lines"), F.count_distinct(F.split_part("line", F.lit(","), F.lit(2))).alias("datasets"))


@query("src_csv_citations", "v_cite", "SELECT * FROM v_cite")
def src_csv_citations(spark, sf):
    path = scratch_path(spark, "citations_csv")
    v.cite(spark, sf).write.csv(path, header=True)
    return readers.read_citations(spark, path)[0]


@query("src_csv_occurrences", "v_occ", """
    SELECT CAST(kingdom AS VARCHAR) AS kingdom, CAST(sum(occurrence_count) AS BIGINT) AS occurrences
    FROM v_occ GROUP BY 1""")
def src_csv_occurrences(spark, sf):
    """Occurrences per kingdom out of a CSV with a date text."""
    path = scratch_path(spark, "occurrences_csv")
    v.occ(spark, sf).select(
        F.lit("7/1/20").alias("snapshot"), F.col("kingdom").cast("string"), F.lit(None).cast("string").alias(
            "basisOfRecord"), F.col("occurrence_count").alias("occurrenceCount")).write.csv(path, header=True)
    rows = readers.read_occurrence_counts(spark, path)[0].where(F.col("snapshot") == F.make_date(
        F.lit(2020), F.lit(7), F.lit(1)))
    return rows.groupBy("kingdom").agg(F.sum("occurrenceCount").alias("occurrences"))


@query("src_country_dim", "v_country", "SELECT * FROM v_country")
def src_country_dim(spark, sf):
    path = scratch_path(spark, "countries")
    v.country(spark, sf).write.csv(path, header=True)
    return readers.read_countries(spark, path)


def map_counts(spark, sf):
    """Countries studied and author countries with centroids, as two map layers."""
    dim = v.country(spark, sf)
    studies = v.studies(spark, sf)
    layers = F.array(F.struct(F.lit("coverage").alias("layer"),
                              F.col("countries_coverage").alias("list")),
                     F.struct(F.lit("authors").alias("layer"),
                              F.col("countries_researcher").alias("list")))
    lists = studies.select(F.explode(layers).alias("m")).select("m.*")
    counts = N.group_count(M.separate_rows(lists, "list", out="code"), "layer", "code",
                           name="count")
    return counts.join(dim, F.col("code") == F.col("iso2")).select(
        "layer", "code", "count", "lat", "lon", F.col("iso2").alias("name"))


_MAP_SQL = """
    WITH lists AS (SELECT 'coverage' AS layer, countries_coverage AS list FROM v_bib
                   UNION ALL SELECT 'authors', countries_researcher FROM v_bib),
    codes AS (SELECT layer, unnest(string_split(list, ',')) AS code FROM lists),
    per AS (SELECT layer, code, count(*) AS count FROM codes GROUP BY 1, 2),
    placed AS (SELECT layer, code, count, lat, lon, iso2 AS name
               FROM per JOIN v_country ON code = iso2)
"""


@query("src_map_json", "v_bib v_country", _MAP_SQL + " SELECT * FROM placed")
def src_map_json(spark, sf):
    path = scratch_path(spark, "map")
    writers.write_map(map_counts(spark, sf), path)
    return readers.read_map(spark, path)


@query("sink_map_json", "v_bib v_country", _MAP_SQL + """
    SELECT layer, CAST(to_json(list([to_json(code), to_json(count), to_json(lat), to_json(lon),
                                     to_json(name)] ORDER BY count DESC, code)) AS VARCHAR)
           AS all_data FROM placed GROUP BY layer""")
def sink_map_json(spark, sf):
    return writers.map_documents(map_counts(spark, sf))


@query("src_taxon_counts", "v_occ", """
    SELECT CAST(sum(occurrence_count) AS BIGINT) AS total, count(DISTINCT kingdom) AS n_keys
    FROM v_occ WHERE kingdom IN (2, 3, 4, 7, 8)""")
def src_taxon_counts(spark, sf):
    per_key = readers.taxon_count(v.occ(spark, sf), (2, 3, 4, 7, 8))
    return per_key.agg(F.sum("occurrence_count").alias("total"), F.count("*").alias("n_keys"))


# --- projections -----------------------------------------------------------------------------

@query("prj_cast", "v_bib", """
    SELECT CAST(id AS VARCHAR) AS id, CAST(year AS INTEGER) AS year,
           TRY_CAST(n_records AS DOUBLE) AS n_records,
           TRY_CAST(tracking_source AS INTEGER) AS bad_number FROM v_bib""")
def prj_cast(spark, sf):
    return v.studies(spark, sf).select(
        F.col("id").cast("string").alias("id"), F.col("year").cast("int").alias("year"),
        F.col("n_records").try_cast("double").alias("n_records"),
        F.col("tracking_source").try_cast("int").alias("bad_number"))


@query("prj_flag_positive", "v_bib", """
    SELECT id, CASE WHEN n_downloads > 0 THEN 1 ELSE 0 END AS cite_doi FROM v_bib""")
def prj_flag_positive(spark, sf):
    return v.studies(spark, sf).select("id", C.flag_positive("n_downloads").alias("cite_doi"))


@query("prj_flag_sentinel", "v_bib", f"""
    SELECT id, CASE WHEN countries_coverage = '{SENTINEL}' THEN 1 ELSE 0 END AS multiple_regions
    FROM v_bib WHERE year > {CUT}""")
def prj_flag_sentinel(spark, sf):
    return recent(v.studies(spark, sf)).select(
        "id", C.flag_equals("countries_coverage", SENTINEL).alias("multiple_regions"))


_COVERAGE_SQL = f"""
    WITH recent AS (SELECT * FROM v_bib WHERE year > {CUT}),
    tot AS (SELECT count(*) AS n_all, count(*) FILTER (
                WHERE countries_coverage IS DISTINCT FROM '{SENTINEL}') AS n_single FROM recent),
    rows AS (SELECT id, unnest(coalesce(string_split(countries_coverage, ','), [null])) AS code
             FROM recent),
    cov AS (SELECT r.region, count(*) AS n, count(DISTINCT id) AS n_studies,
                   count(*) FILTER (WHERE code IS NULL) AS n_no_list,
                   count(*) FILTER (WHERE code = '{SENTINEL}') AS n_global,
                   count(*) FILTER (WHERE region IS NULL AND code <> '{SENTINEL}')
                       AS n_unknown_code
            FROM rows LEFT JOIN v_country r ON code = iso2 GROUP BY 1)
"""


def coverage(spark, sf):
    return M.region_coverage(recent(v.studies(spark, sf)), v.country(spark, sf))


@query("region_coverage", "v_bib v_country", _COVERAGE_SQL + f"""
    SELECT coalesce(region, '{UNMATCHED_REGION}') AS region, n, n_studies, n_no_list, n_global,
           n_unknown_code, round(n / n_all * 100, 6) AS prop_all,
           round(CASE WHEN region IS NOT NULL THEN n / n_single * 100 END, 6) AS prop_single
    FROM cov, tot""")
def region_coverage(spark, sf):
    """Flagship: region coverage of recent studies, unmatched groups told apart."""
    return coverage(spark, sf).withColumn("prop_all", r6("prop_all", "p")).withColumn(
        "prop_single", r6("prop_single", "p"))


@query("prj_percent", "v_bib v_country", _COVERAGE_SQL + """
    SELECT n, round(n / n_all * 100, 6) AS prop_all,
           round(n / n_single * 100, 6) AS prop_single FROM cov, tot WHERE region IS NOT NULL""")
def prj_percent(spark, sf):
    return coverage(spark, sf).where(F.col("region") != UNMATCHED_REGION).select(
        "n", r6("prop_all", "prop_all"), r6("prop_single", "prop_single"))


@query("prj_null_out", "v_bib v_country", _COVERAGE_SQL + """
    SELECT n, round(CASE WHEN region IS NOT NULL THEN n / n_single * 100 END, 6) AS prop_single
    FROM cov, tot""")
def prj_null_out(spark, sf):
    return coverage(spark, sf).select("n", r6("prop_single", "prop_single"))


@query("prj_label_null_group", "v_bib v_country", _COVERAGE_SQL + f"""
    SELECT coalesce(region, '{UNMATCHED_REGION}') AS region, n FROM cov""")
def prj_label_null_group(spark, sf):
    return coverage(spark, sf).select("region", "n")


@query("prj_display_names", "v_country", f"""
    SELECT c.iso2, l.label, CAST(CASE (row_number() OVER (ORDER BY c.region, c.iso2) - 1) % 3
               WHEN 0 THEN 'red' WHEN 1 THEN 'green' ELSE 'blue' END AS VARCHAR) AS recycled
    FROM v_country c JOIN {_LABEL_SQL} ON c.region = l.region""")
def prj_display_names(spark, sf):
    """Code to label through a label table, and a short label list used over and over."""
    from pyspark.sql import Window
    labels = spark.createDataFrame(list(REGION_LABELS.items()), "region string, label string")
    # One row per country of the dimension.
    place = F.row_number().over(Window.orderBy("region", "iso2"))
    return v.country(spark, sf).withColumn("place", place).join(labels, "region").select(
        "iso2", "label", C.recycled(("red", "green", "blue"), "place").alias("recycled"))


@query("prj_select_reorder", "v_snap", """
    SELECT snapshot_date, 'total' AS basis2, CAST(sum(occurrence_count) AS BIGINT) AS total
    FROM v_snap GROUP BY 1""")
def prj_select_reorder(spark, sf):
    from scholarlens.operators.growth import totals
    per = totals(v.snap(spark, sf), "occurrence_count", "snapshot_date").withColumn(
        "basis2", F.lit("total"))
    return per.select("snapshot_date", "basis2", "total")


# --- filters ---------------------------------------------------------------------------------

@query("flt_recent", "v_bib", f"SELECT id, year, source FROM v_bib WHERE year > {CUT}")
def flt_recent(spark, sf):
    return recent(v.bib_core(spark, sf)).select("id", "year", "source")


@query("flt_not_null", "v_doc", "SELECT id, year FROM v_doc WHERE abstract IS NOT NULL")
def flt_not_null(spark, sf):
    return v.doc(spark, sf).where(F.col("abstract").isNotNull()).select("id", "year")


@query("flt_exclude_id", "v_doc", """
    SELECT id, year FROM v_doc WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def flt_exclude_id(spark, sf):
    """Drop the documents of an exclusion table."""
    listed = v.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return v.doc(spark, sf).join(listed, "id", "left_anti").select("id", "year")


@query("flt_flag_partition", "v_bib", f"""
    SELECT CASE WHEN countries_coverage = '{SENTINEL}' THEN 1 ELSE 0 END AS multiple_regions,
           count(*) AS n FROM v_bib WHERE year > {CUT} GROUP BY 1""")
def flt_flag_partition(spark, sf):
    flagged = recent(v.studies(spark, sf)).withColumn(
        "multiple_regions", C.flag_equals("countries_coverage", SENTINEL))
    return N.group_count(flagged, "multiple_regions")


# --- multi-value lists and joins -------------------------------------------------------------

@query("gen_separate_rows", "v_bib", """
    SELECT id, unnest(coalesce(string_split(countries_researcher, ','), [null])) AS country
    FROM v_bib""")
def gen_separate_rows(spark, sf):
    return M.separate_rows(v.studies(spark, sf), "countries_researcher", out="country").select(
        "id", "country")


@query("gen_year_spine", "v_bib", """
    SELECT CAST(y AS INTEGER) AS year, coalesce(papers, 0) AS papers
    FROM (SELECT unnest(range(1990, 2004)) AS y)
    LEFT JOIN (SELECT year, count(*) AS papers FROM v_bib GROUP BY 1) ON y = year""")
def gen_year_spine(spark, sf):
    per_year = N.group_count(v.bib_core(spark, sf), "year", name="papers")
    return N.with_year_spine(per_year, 1990, 2003)


@query("join_left_region", "v_bib v_country", """
    SELECT id, code, region
    FROM (SELECT id, unnest(coalesce(string_split(countries_coverage, ','), [null])) AS code
          FROM v_bib) LEFT JOIN v_country ON code = iso2""")
def join_left_region(spark, sf):
    rows = M.separate_rows(v.studies(spark, sf), "countries_coverage", out="code").select("id", "code")
    return M.attach_region(rows, "code", v.country(spark, sf).select("iso2", "region"))


_AUTHOR_SQL = f"""
    WITH parts AS (SELECT CASE WHEN countries_coverage = '{SENTINEL}' THEN 'global'
                               ELSE 'single' END AS part, countries_researcher AS list
                   FROM v_bib WHERE year > {CUT}),
    rows AS (SELECT part, unnest(coalesce(string_split(list, ','), [null])) AS code FROM parts),
    counts AS (SELECT part, region, count(*) AS n FROM rows LEFT JOIN v_country ON code = iso2
               GROUP BY 1, 2),
    whole AS (SELECT part, sum(n) AS n_part FROM counts GROUP BY 1),
    spine AS (SELECT part, n_part, region FROM whole,
                     (SELECT DISTINCT region FROM v_country))
    SELECT s.part, s.region, coalesce(n, 0) AS n,
           round(coalesce(n, 0) / n_part * 100, 6) AS prop_all
    FROM spine s LEFT JOIN counts c ON s.part = c.part AND s.region = c.region
    UNION ALL
    SELECT c.part, '{UNMATCHED_REGION}', n, round(n / n_part * 100, 6)
    FROM counts c JOIN whole w ON c.part = w.part WHERE region IS NULL
"""


@query("region_authorship", "v_bib v_country", _AUTHOR_SQL)
def region_authorship(spark, sf):
    """Author countries per region for single-region and global studies, one pass for both."""
    part = F.when(F.col("countries_coverage") == SENTINEL, "global").otherwise("single")
    return M.region_authorship(recent(v.studies(spark, sf)), v.country(spark, sf), by=part).withColumn(
        "prop_all", r6("prop_all", "p"))


@query("region_authorship_all", "v_bib v_country", f"""
    WITH rows AS (SELECT unnest(coalesce(string_split(countries_researcher, ','), [null])) AS code
                  FROM v_bib WHERE year > {CUT}),
    counts AS (SELECT region, count(*) AS n FROM rows LEFT JOIN v_country ON code = iso2 GROUP BY 1),
    every AS (SELECT DISTINCT region FROM v_country UNION SELECT NULL FROM counts WHERE region IS NULL)
    SELECT coalesce(e.region, '{UNMATCHED_REGION}') AS region, coalesce(n, 0) AS n,
           round(coalesce(n, 0) / CAST((SELECT sum(n) FROM counts) AS DOUBLE) * 100, 6) AS prop_all
    FROM every e LEFT JOIN counts c ON e.region IS NOT DISTINCT FROM c.region""")
def region_authorship_all(spark, sf):
    """Author countries per region over all recent studies."""
    found = M.region_authorship(recent(v.studies(spark, sf)), v.country(spark, sf))
    return found.select("region", "n", r6("prop_all", "prop_all"))


@query("agg_country_recent", "v_bib", f"""
    WITH rows AS (SELECT 'coverage' AS layer, unnest(coalesce(string_split(countries_coverage, ','), [null])) AS code
                  FROM v_bib WHERE year > {CUT}
                  UNION ALL SELECT 'authors', unnest(coalesce(string_split(countries_researcher, ','), [null]))
                  FROM v_bib WHERE year > {CUT})
    SELECT layer, code, count(*) AS n FROM rows GROUP BY 1, 2""")
def agg_country_recent(spark, sf):
    """Recent studies per country studied and per author country, null lists as a group."""
    layers = F.array(*[F.struct(F.lit(name).alias("layer"), F.col(column).alias("list")) for name, column in (
        ("coverage", "countries_coverage"), ("authors", "countries_researcher"))])
    lists = recent(v.studies(spark, sf)).select(F.explode(layers).alias("m")).select("m.*")
    return N.group_count(M.separate_rows(lists, "list", out="code"), "layer", "code")


@query("join_domain_complete", "v_bib v_country", """
    WITH rows AS (SELECT n_downloads, unnest(string_split(countries_coverage, ',')) AS code
                  FROM v_bib WHERE n_downloads IS NOT NULL),
    counts AS (SELECT n_downloads, iso2, count(*) AS n FROM rows JOIN v_country ON code = iso2
               GROUP BY 1, 2)
    SELECT d.n_downloads, c.iso2, coalesce(n, 0) AS n
    FROM (SELECT DISTINCT n_downloads FROM counts) d CROSS JOIN v_country c
    LEFT JOIN counts USING (n_downloads, iso2)""")
def join_domain_complete(spark, sf):
    """Studies of every country by number of downloads, absent pairs as zero."""
    dim = v.country(spark, sf).select("iso2")
    studies = v.studies(spark, sf).where(F.col("n_downloads").isNotNull())
    rows = M.separate_rows(studies, "countries_coverage", out="iso2").join(
        dim, "iso2", "left_semi")
    counts = rows.groupBy("n_downloads", "iso2").agg(F.count("*").alias("n"))
    return N.complete_pairs(counts, "n_downloads", "iso2", dim)


@query("join_complement", "v_occ", """
    SELECT CAST(sum(occurrence_count) FILTER (WHERE kingdom = 1) AS BIGINT) AS parent,
           CAST(sum(occurrence_count) FILTER (WHERE phylum = 44) AS BIGINT) AS child,
           CAST(sum(occurrence_count) FILTER (WHERE kingdom = 1)
                - sum(occurrence_count) FILTER (WHERE phylum = 44) AS BIGINT) AS complement
    FROM v_occ""")
def join_complement(spark, sf):
    """A parent group less its child group by conditional sums in one pass."""
    n = F.col("occurrence_count")
    return v.occ(spark, sf).agg(
        F.sum(F.when(F.col("kingdom") == 1, n)).alias("parent"),
        F.sum(F.when(F.col("phylum") == 44, n)).alias("child")).withColumn(
            "complement", F.col("parent") - F.col("child"))


# --- order, sets and display -----------------------------------------------------------------

@query("ord_custom", "v_bib v_country", _COVERAGE_SQL + f"""
    SELECT cov.region, n, CAST(ord AS INTEGER) AS ord FROM cov
    JOIN {_ORDER_SQL} ON cov.region = o.region""")
def ord_custom(spark, sf):
    """Regions in a given order, carried as an ordinal."""
    order = spark.createDataFrame(list(zip(REGION_ORDER, range(1, 6))), "region string, ord int")
    return coverage(spark, sf).select("region", "n").join(order, "region").orderBy("ord")


@query("ord_asc", "v_bib v_country", _COVERAGE_SQL + """
    SELECT region, n, rank() OVER (ORDER BY n) AS rank FROM cov WHERE region IS NOT NULL""")
def ord_asc(spark, sf):
    known = coverage(spark, sf).where(F.col("region") != UNMATCHED_REGION).select("region", "n")
    return N.with_count_rank(known, descending=False).select("region", "n", "rank").orderBy("rank")


@query("set_union_literal", "v_bib v_country", _COVERAGE_SQL + """
    SELECT region, n FROM cov WHERE region IS NOT NULL UNION ALL SELECT 'ANTARCTICA', 0""")
def set_union_literal(spark, sf):
    extra = spark.createDataFrame([("ANTARCTICA", 0)], "region string, n bigint")
    return coverage(spark, sf).where(F.col("region") != UNMATCHED_REGION).select(
        "region", "n").unionByName(extra)


@query("fn_null_test", "v_bib", """
    SELECT count(*) AS n, count(countries_researcher) AS n_known,
           count(*) FILTER (WHERE countries_researcher IS NULL) AS n_missing FROM v_bib""")
def fn_null_test(spark, sf):
    lists = F.col("countries_researcher")
    return v.studies(spark, sf).agg(F.count("*").alias("n"), F.count_if(lists.isNotNull())
                                .alias("n_known"), F.count_if(lists.isNull()).alias("n_missing"))


@query("fn_size_scale", "v_bib v_country", _MAP_SQL + """
    SELECT layer, code, round(21 + (130 - 21) * (sqrt(count) - sqrt(lo))
                              / (sqrt(hi) - sqrt(lo)), 6) AS radius
    FROM placed JOIN (SELECT layer, min(count) AS lo, max(count) AS hi FROM placed GROUP BY 1)
    USING (layer)""")
def fn_size_scale(spark, sf):
    """Symbol radius by square-root scale within each layer."""
    rows = map_counts(spark, sf)
    ends = rows.groupBy("layer").agg(F.min("count").alias("lo"), F.max("count").alias("hi"))
    radius = C.sqrt_scale("count", "lo", "hi", 21, 130)
    return rows.join(ends, "layer").select("layer", "code", r6(radius, "radius"))
