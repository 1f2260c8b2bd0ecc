"""The domain tables, projected from the star-schema and document test tables.

Each function takes ``(spark, sf_dir)`` and returns a lazy DataFrame. ``VIEW_SQL`` states the
same projections as SQL text for the side-by-side check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlens.functions.columns import basis_class, paste
from scholarlens.functions.fixed import BASIS_CLASSES, SENTINEL
from scholarlens.operators.citations import with_both_totals, with_citations
from scholarlens.operators.text import doc_terms, tokens
from scholarlens.session import widen, written

RECENT_STUDY = 1998
RECENT_DOC = 2009
TOPICS = 5
#: Models of several sizes, and how much a topic favours its own words in each of two runs.
KS = (3, 4, 5)
RUNS = {1: 10, 2: 4}
#: Returned lines that a dataset needs to be in the citation table.
LEAST_RETURNED = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country dimension: code, region and a made-up centroid."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("iso2"),
        F.col("r_name").alias("region"),
        (F.col("n_nationkey") * 5 - 60).cast("double").alias("lat"),
        (F.col("n_nationkey") * 10 - 120).cast("double").alias("lon"),
    )


def bib_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Study columns that need no line items."""
    orders = table(spark, sf_dir, "orders")
    year = F.year("o_orderdate")
    status = F.col("o_orderstatus")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        "o_custkey",
        year.alias("year"),
        F.col("o_orderpriority").alias("source"),
        F.when(status == "O", True).when(status == "F", False).alias("openaccess"),
        status.alias("tracking_source"),
    )


def bib_taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies with their taxonomic group, complete for recent years only."""
    customer = table(spark, sf_dir, "customer")
    core = bib_core(spark, sf_dir)
    return core.join(customer, core.o_custkey == customer.c_custkey, "left").select(
        *[c for c in core.columns if c != "o_custkey"],
        F.when((F.col("year") > RECENT_STUDY) & (F.col("c_acctbal") > 0), F.col("c_mktsegment"))
        .alias("taxonomic_group"),
    )


def _study_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per study: comma-packed country list and download measures, one aggregate pass."""
    lineitem = table(spark, sf_dir, "lineitem")
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    returned = F.col("l_returnflag") == "R"
    return (
        lineitem.join(supplier, lineitem.l_suppkey == supplier.s_suppkey)
        .join(nation, F.col("s_nationkey") == nation.n_nationkey)
        .groupBy("l_orderkey")
        .agg(
            F.sort_array(F.collect_set("n_name")).alias("nations"),
            F.count_if(returned).alias("downloads"),
            F.sum(F.when(returned, F.col("l_quantity"))).cast("bigint").alias("records"),
        )
    )


def _with_lists(core: DataFrame, lists: DataFrame) -> DataFrame:
    joined_list = F.array_join("nations", ",")
    return core.join(lists, core.id == lists.l_orderkey, "left").select(
        *core.columns,
        F.when(F.col("downloads") > 0, F.col("downloads")).alias("n_downloads"),
        F.col("records").alias("n_records"),
        joined_list.alias("countries_researcher"),
        F.when(F.size("nations") >= 4, F.lit(SENTINEL))
        .otherwise(joined_list).alias("countries_coverage"),
    )


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bibliographic table without taxonomic groups, which need one more join."""
    return _with_lists(bib_core(spark, sf_dir).drop("o_custkey"), _study_lists(spark, sf_dir))


def bib(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole bibliographic table."""
    return _with_lists(bib_taxa(spark, sf_dir), _study_lists(spark, sf_dir))


def snapshot_date(shipped: str) -> Column:
    """Day of the snapshot that a shipped line belongs to."""
    return F.make_date(F.year(shipped) + 12, F.lit(1), F.lit(1))


def snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset sizes per snapshot, basis of record and citizen-science tag."""
    lineitem = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")
    code = F.concat("l_returnflag", "l_linestatus")
    basis = (
        F.when(code == "AF", "PRESERVED_SPECIMEN").when(code == "AO", "FOSSIL_SPECIMEN")
        .when(code == "NF", "HUMAN_OBSERVATION").when(code == "NO", "MACHINE_OBSERVATION")
        .when(code == "RF", "UNKNOWN").otherwise("OTHER")
    )
    return (
        lineitem.join(part, lineitem.l_partkey == part.p_partkey)
        .groupBy(
            F.col("l_partkey").cast("string").alias("datasetkey"),
            snapshot_date("l_shipdate").alias("snapshot_date"),
            basis.alias("basis_of_record"),
            (F.col("p_type") == "ECONOMY").alias("tagged_citizen_science"),
        )
        .agg(F.sum("l_quantity").cast("bigint").alias("occurrence_count"))
    )


def cite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations per dataset from all its lines; datasets with few returned lines are absent."""
    returned = F.col("l_returnflag") == "R"
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").cast("string").alias("datasetkey"))
        .agg(F.count_if(returned & (F.col("l_quantity") > 40)).alias("citations"),
             F.count_if(returned).alias("n_returned"))
        .where(F.col("n_returned") >= LEAST_RETURNED).drop("n_returned")
    )


def latest_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest snapshot with citations, stored.

    The last date is found on the ship dates alone, so that only its lines are summed up.
    """
    parts = table(spark, sf_dir, "part").select("p_partkey")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", snapshot_date("l_shipdate").alias("d"))
    last = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi").agg(F.max("d")).scalar()
    latest = snap(spark, sf_dir).where(F.col("snapshot_date") == last)
    return written(with_citations(latest, cite(spark, sf_dir)), "cited")


def dsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest snapshot with citations and their class of record, totals of both groupings on
    every input row."""
    rows = latest_cited(spark, sf_dir).withColumn("basis2", basis_class("basis_of_record"))
    return with_both_totals(
        rows, ["datasetkey", "snapshot_date", "tagged_citizen_science", "citations"], "basis2")


def occ(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrence counts by kingdom and phylum key."""
    kingdom = (F.col("p_size") % 9).cast("int")
    return table(spark, sf_dir, "part").select(
        kingdom.alias("kingdom"),
        F.when((kingdom == 1) & F.col("p_type").isin("ECONOMY", "SMALL"), 44).alias("phylum"),
        F.floor("p_retailprice").cast("bigint").alias("occurrence_count"),
    )


def doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers: first line is the title, the rest the abstract (null if none)."""
    cut = F.instr("text", "\n")
    return widen(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("id"),
        (F.expr("substr(source, 4)").cast("int") + 2000).alias("year"),
        "source",
        "lang",
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.when(cut > 0, F.substring("text", cut + 1, F.length("text"))).alias("abstract"),
        F.when(F.col("lang") == "en", F.col("source")).alias("keywords"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modelled papers: whole text pasted from its fields, papers without abstract left out."""
    return doc(spark, sf_dir).where(F.col("abstract").isNotNull()).select(
        F.col("id").alias("doc_id"), "year", paste("title", "abstract", "keywords").alias("text"))


def tok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, year, term, cnt) over every modelled paper."""
    return doc_terms(tokens(corpus(spark, sf_dir), "text", keep=["doc_id", "year"]),
                     ["doc_id", "year"])


def stored_tok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document-term table written once, for callers that read it more than once."""
    return written(tok(spark, sf_dir), "counts")


def term_topic(term: str | Column) -> Column:
    return F.length(term) % TOPICS + 1


def theta_vectors(spark: SparkSession, sf_dir: str, words: DataFrame | None = None) -> DataFrame:
    """Fixed document-topic shares as lists: (doc_id, year, shares).

    ``words`` is the document-term table, if the caller has it stored.
    """
    words = tok(spark, sf_dir) if words is None else words
    own = [F.sum(F.when(term_topic("term") == k, F.col("cnt")).otherwise(0)).alias(f"t{k}")
           for k in range(1, TOPICS + 1)]
    per_doc = words.groupBy("doc_id", "year").agg(F.sum("cnt").alias("n"), *own)
    return per_doc.select("doc_id", "year", F.array(*[
        (F.col(f"t{k}") + 1) / (F.col("n") + TOPICS) for k in range(1, TOPICS + 1)]).alias("shares"))


def theta(spark: SparkSession, sf_dir: str, words: DataFrame | None = None) -> DataFrame:
    """Fixed document-topic shares (doc_id, year, topic, theta) in long form."""
    return theta_vectors(spark, sf_dir, words).select(
        "doc_id", "year", F.posexplode("shares").alias("pos", "theta")).select(
        "doc_id", "year", (F.col("pos") + 1).alias("topic"), "theta")


def beta(spark: SparkSession, sf_dir: str, words: DataFrame | None = None) -> DataFrame:
    """Fixed word shares (level, topic, term, logbeta); level 1 is before the recent years."""
    per_term = (
        (tok(spark, sf_dir) if words is None else words)
        .groupBy(F.when(F.col("year") > RECENT_DOC, 2).otherwise(1).alias("level"), "term")
        .agg(F.sum("cnt").alias("cnt"))
    )
    weighted = per_term.select(
        "level", "term", "cnt",
        F.explode(F.sequence(F.lit(1), F.lit(TOPICS))).alias("topic"),
    ).select(
        "level", "topic", "term",
        (F.col("cnt") * F.when(F.col("topic") == term_topic("term"), 10).otherwise(1)).alias("w"),
    )
    totals = weighted.groupBy("level", "topic").agg(F.sum("w").alias("tot"))
    return weighted.join(totals, ["level", "topic"]).select(
        "level", "topic", "term", F.log(F.col("w") / F.col("tot")).alias("logbeta"))


def beta_all(spark: SparkSession, sf_dir: str, words: DataFrame | None = None) -> DataFrame:
    """Fixed word shares of the whole corpus (topic, term, logbeta)."""
    per_term = (tok(spark, sf_dir) if words is None else words).groupBy("term").agg(
        F.sum("cnt").alias("cnt"))
    weighted = per_term.select(
        "term", "cnt", F.explode(F.sequence(F.lit(1), F.lit(TOPICS))).alias("topic")).select(
        "topic", "term",
        (F.col("cnt") * F.when(F.col("topic") == term_topic("term"), 10).otherwise(1)).alias("w"))
    totals = weighted.groupBy("topic").agg(F.sum("w").alias("tot"))
    return weighted.join(totals, "topic").select(
        "topic", "term", F.log(F.col("w") / F.col("tot")).alias("logbeta"))


def theta_k(spark: SparkSession, sf_dir: str, words: DataFrame) -> DataFrame:
    """Fixed shares of models of several sizes: (k, doc_id, year, topic, theta)."""
    own = [F.sum(F.when(F.length("term") % k + 1 == t, F.col("cnt")).otherwise(0)).alias(f"t{k}_{t}")
           for k in KS for t in range(1, k + 1)]
    per_doc = words.groupBy("doc_id", "year").agg(F.sum("cnt").alias("n"), *own)
    rows = F.array(*[F.struct(
        F.lit(k).alias("k"), F.lit(t).alias("topic"),
        ((F.col(f"t{k}_{t}") + 1) / (F.col("n") + k)).alias("theta")) for k in KS for t in range(1, k + 1)])
    return per_doc.select("doc_id", "year", F.explode(rows).alias("x")).select("doc_id", "year", "x.*")


def beta_k(spark: SparkSession, sf_dir: str, words: DataFrame) -> DataFrame:
    """Fixed word shares of two runs of several sizes: (run, k, topic, term, logbeta)."""
    per_term = words.groupBy("term").agg(F.sum("cnt").alias("cnt"))
    keys = F.array(*[F.struct(F.lit(r).alias("run"), F.lit(k).alias("k"), F.lit(t).alias("topic"),
                              F.lit(w).alias("weight"))
                     for r, w in RUNS.items() for k in KS for t in range(1, k + 1)])
    weighted = per_term.select("term", "cnt", F.explode(keys).alias("x")).select("term", "cnt", "x.*").select(
        "run", "k", "topic", "term", (F.col("cnt") * F.when(
            F.length("term") % F.col("k") + 1 == F.col("topic"), F.col("weight")).otherwise(1)).alias("w"))
    totals = weighted.groupBy("run", "k", "topic").agg(F.sum("w").alias("tot"))
    return weighted.join(totals, ["run", "k", "topic"]).select(
        "run", "k", "topic", "term", F.log(F.col("w") / F.col("tot")).alias("logbeta"))


_K_TOPICS = ", ".join(f"({k}, {t})" for k in KS for t in range(1, KS[-1] + 1) if t <= k)
_K_RUNS = ", ".join(f"({r}, {w})" for r, w in RUNS.items())


def basis_sql(column: str = "basis_of_record") -> str:
    """The class of a basis of record as SQL."""
    cases = " ".join(
        f"WHEN {column} IN ({', '.join(repr(m) for m in members)}) THEN '{name}'"
        for name, members in BASIS_CLASSES.items())
    return f"CASE {cases} END"


VIEW_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "v_country": ((), """
        SELECT n_name AS iso2, r_name AS region,
               CAST(n_nationkey * 5 - 60 AS DOUBLE) AS lat,
               CAST(n_nationkey * 10 - 120 AS DOUBLE) AS lon
        FROM nation JOIN region ON n_regionkey = r_regionkey"""),
    "v_bib": ((), f"""
        SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INTEGER) AS year,
               o_orderpriority AS source,
               CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END AS openaccess,
               o_orderstatus AS tracking_source,
               CASE WHEN year(o_orderdate) > {RECENT_STUDY} AND c_acctbal > 0
                    THEN c_mktsegment END AS taxonomic_group,
               CASE WHEN downloads > 0 THEN downloads END AS n_downloads,
               records AS n_records,
               nations AS countries_researcher,
               CASE WHEN n_nations >= 4 THEN '{SENTINEL}' ELSE nations END AS countries_coverage
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey
        LEFT JOIN (
            SELECT l_orderkey, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS nations,
                   count(DISTINCT n_name) AS n_nations,
                   count(*) FILTER (WHERE l_returnflag = 'R') AS downloads,
                   CAST(sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS records
            FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
            JOIN nation ON s_nationkey = n_nationkey GROUP BY l_orderkey
        ) ON o_orderkey = l_orderkey"""),
    "v_snap": ((), """
        SELECT CAST(l_partkey AS VARCHAR) AS datasetkey,
               make_date(year(l_shipdate) + 12, 1, 1) AS snapshot_date,
               CASE l_returnflag || l_linestatus
                   WHEN 'AF' THEN 'PRESERVED_SPECIMEN' WHEN 'AO' THEN 'FOSSIL_SPECIMEN'
                   WHEN 'NF' THEN 'HUMAN_OBSERVATION' WHEN 'NO' THEN 'MACHINE_OBSERVATION'
                   WHEN 'RF' THEN 'UNKNOWN' ELSE 'OTHER' END AS basis_of_record,
               p_type = 'ECONOMY' AS tagged_citizen_science,
               CAST(sum(l_quantity) AS BIGINT) AS occurrence_count
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4"""),
    "v_cite": ((), f"""
        SELECT CAST(l_partkey AS VARCHAR) AS datasetkey,
               count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 40) AS citations
        FROM lineitem GROUP BY 1
        HAVING count(*) FILTER (WHERE l_returnflag = 'R') >= {LEAST_RETURNED}"""),
    "v_dsum": (("v_snap", "v_cite"), f"""
        SELECT *, citations / CAST(total_occurrences AS DOUBLE) AS citations_per_record,
               citations / CAST(part_occurrences AS DOUBLE) AS citations_per_part_record
        FROM (SELECT *, CAST(sum(occurrence_count) OVER g AS BIGINT) AS total_occurrences,
                     CAST(sum(occurrence_count) OVER p AS BIGINT) AS part_occurrences
              FROM (SELECT s.*, citations, {basis_sql()} AS basis2
                    FROM v_snap s LEFT JOIN v_cite c ON s.datasetkey = c.datasetkey
                    WHERE snapshot_date = (SELECT max(snapshot_date) FROM v_snap))
              WINDOW g AS (PARTITION BY datasetkey, snapshot_date, tagged_citizen_science, citations),
                     p AS (PARTITION BY datasetkey, snapshot_date, tagged_citizen_science, citations, basis2))"""),
    "v_occ": ((), """
        SELECT p_size % 9 AS kingdom,
               CASE WHEN p_size % 9 = 1 AND p_type IN ('ECONOMY', 'SMALL') THEN 44 END AS phylum,
               CAST(floor(p_retailprice) AS BIGINT) AS occurrence_count
        FROM part"""),
    "v_doc": ((), """
        SELECT doc_id AS id, 2000 + CAST(substr(source, 4) AS INTEGER) AS year, source, lang,
               split_part(text, chr(10), 1) AS title,
               CASE WHEN position(chr(10) IN text) > 0
                    THEN substr(text, position(chr(10) IN text) + 1) END AS abstract,
               CASE WHEN lang = 'en' THEN source END AS keywords
        FROM documents"""),
    "v_tok": (("v_doc",), r"""
        SELECT doc_id, year, term, count(*) AS cnt
        FROM (SELECT id AS doc_id, year, unnest(regexp_extract_all(
                  lower(concat_ws('. ', title, abstract, keywords)), '\p{L}+')) AS term
              FROM v_doc WHERE abstract IS NOT NULL)
        WHERE length(term) >= 3 GROUP BY 1, 2, 3"""),
    "v_theta": (("v_tok",), f"""
        SELECT doc_id, year, topic,
               (sum(CASE WHEN length(term) % {TOPICS} + 1 = topic THEN cnt ELSE 0 END) + 1)
               / CAST(sum(cnt) + {TOPICS} AS DOUBLE) AS theta
        FROM v_tok, (SELECT CAST(unnest(range(1, {TOPICS + 1})) AS INTEGER) AS topic) GROUP BY 1, 2, 3"""),
    "v_beta": (("v_tok",), f"""
        SELECT level, topic, term, ln(w / CAST(sum(w) OVER (PARTITION BY level, topic) AS DOUBLE))
                   AS logbeta
        FROM (SELECT level, topic, term,
                     cnt * CASE WHEN length(term) % {TOPICS} + 1 = topic THEN 10 ELSE 1 END AS w
              FROM (SELECT CASE WHEN year > {RECENT_DOC} THEN 2 ELSE 1 END AS level, term,
                           CAST(sum(cnt) AS BIGINT) AS cnt FROM v_tok GROUP BY 1, 2),
                   (SELECT CAST(unnest(range(1, {TOPICS + 1})) AS INTEGER) AS topic))"""),
    "v_beta_all": (("v_tok",), f"""
        SELECT topic, term, ln(w / CAST(sum(w) OVER (PARTITION BY topic) AS DOUBLE)) AS logbeta
        FROM (SELECT topic, term,
                     cnt * CASE WHEN length(term) % {TOPICS} + 1 = topic THEN 10 ELSE 1 END AS w
              FROM (SELECT term, CAST(sum(cnt) AS BIGINT) AS cnt FROM v_tok GROUP BY 1),
                   (SELECT CAST(unnest(range(1, {TOPICS + 1})) AS INTEGER) AS topic))"""),
    "v_theta_k": (("v_tok",), f"""
        SELECT k, doc_id, year, topic,
               (sum(CASE WHEN length(term) % k + 1 = topic THEN cnt ELSE 0 END) + 1)
               / CAST(sum(cnt) + k AS DOUBLE) AS theta
        FROM v_tok, (VALUES {_K_TOPICS}) AS g(k, topic) GROUP BY 1, 2, 3, 4"""),
    "v_beta_k": (("v_tok",), f"""
        SELECT run, k, topic, term,
               ln(w / CAST(sum(w) OVER (PARTITION BY run, k, topic) AS DOUBLE)) AS logbeta
        FROM (SELECT run, k, topic, term,
                     cnt * CASE WHEN length(term) % k + 1 = topic THEN weight ELSE 1 END AS w
              FROM (SELECT term, CAST(sum(cnt) AS BIGINT) AS cnt FROM v_tok GROUP BY 1),
                   (VALUES {_K_TOPICS}) AS g(k, topic), (VALUES {_K_RUNS}) AS r(run, weight))"""),
}


def oracle(views: str, body: str) -> str:
    """SQL text: the named views and those they need as common tables, then ``body``."""
    ordered: list[str] = []

    def need(name: str) -> None:
        if name not in ordered:
            for parent in VIEW_SQL[name][0]:
                need(parent)
            ordered.append(name)

    for name in views.split():
        need(name)
    tables = ",\n".join(f"{name} AS ({VIEW_SQL[name][1]})" for name in ordered)
    body = body.strip()
    if body.startswith("WITH "):
        return f"WITH {tables},\n{body[5:]}"
    return f"WITH {tables}\n{body}"
