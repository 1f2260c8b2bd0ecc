"""Counts and shares of a bibliographic table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarlens.functions.columns import condition_holds, percent
from scholarlens.operators.ranks import cumulative_counts
from scholarlens.session import written


def group_count(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Rows per key; nulls form a group of their own."""
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def share_if(df: DataFrame, cond: Column, name: str = "share") -> DataFrame:
    """Share of rows for which the condition is known to hold."""
    return df.agg(F.avg(condition_holds(cond).cast("double")).alias(name))


def journal_open_access(df: DataFrame, journal: str = "source", open_access: str = "openaccess",
                        r_na: bool = False) -> DataFrame:
    """Papers and open papers per journal; ``r_na`` counts unknown access as open."""
    return df.groupBy(journal).agg(
        F.count("*").alias("no"),
        F.count_if(condition_holds(F.col(open_access), r_na)).alias("no_open"))


def open_access_share(df: DataFrame, open_access: str = "openaccess",
                      r_na: bool = False) -> DataFrame:
    return df.agg(F.count_if(condition_holds(F.col(open_access), r_na)).alias("no_open"),
                  F.count("*").alias("no")).select("no", "no_open", (
                      F.col("no_open") / F.col("no")).alias("ratio"))


def with_count_rank(counts: DataFrame, count: str = "n", descending: bool = True,
                    out: str = "rank") -> DataFrame:
    """Position of each row by count, ties sharing the best position.

    Works on distinct counts with distributed prefix sums, so a long list of keys never meets
    in one task.
    """
    ranks = cumulative_counts(counts, count)
    position = (F.col("total") - F.col("before") - F.col("n_rows") if descending
                else F.col("before")) + 1
    return counts.join(ranks.select(count, position.alias(out)), count)


def factor_summary(df: DataFrame, column: str, max_levels: int = 100) -> DataFrame:
    """Level frequencies; past ``max_levels`` the rarest fold into ``(Other)``."""
    counts = written(group_count(df.where(F.col(column).isNotNull()), column), "levels")
    if_few = counts.agg(F.count("*") <= max_levels).scalar()
    lead = counts.orderBy(F.desc("n"), column)
    top = lead.limit(max_levels - 1).select(F.col(column).alias("top_level"))
    level = F.when(if_few | F.col("top_level").isNotNull(), F.col(column)).otherwise("(Other)")
    return (counts.join(top, F.col(column) == F.col("top_level"), "left")
            .groupBy(level.alias(column)).agg(F.sum("n").alias("n")))


def complete_pairs(counts: DataFrame, key: str, dim_key: str, dim: DataFrame) -> DataFrame:
    """Counts for every seen ``key`` and every entry of the dimension, absent pairs as zero.

    The entries of the dimension travel as one list and are opened per distinct key, so neither
    the data nor the counts are multiplied out.
    """
    entries = dim.agg(F.array_sort(F.collect_set(dim_key))).scalar()
    spine = counts.select(key).distinct().withColumn(dim_key, F.explode(entries))
    return spine.join(counts, [key, dim_key], "left").select(
        key, dim_key, F.coalesce("n", F.lit(0)).alias("n"))


def papers_per_year(df: DataFrame, cites_doi: Column) -> DataFrame:
    return df.groupBy("year").agg(F.count("*").alias("papers"),
                                  F.sum(cites_doi).alias("papers_doi"))


def with_year_spine(per_year: DataFrame, first: int, last: int) -> DataFrame:
    """Every year from first to last, absent years with zero in each measure."""
    spark = per_year.sparkSession
    spine = spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    measures = [c for c in per_year.columns if c != "year"]
    return spine.join(per_year, "year", "left").select(
        "year", *[F.coalesce(c, F.lit(0)).alias(c) for c in measures])


def group_shares_of_known(rows: DataFrame, column: str, reference: DataFrame) -> DataFrame:
    """Group counts of ``rows`` over the known values of a different row set."""
    known = reference.agg(F.count(column)).scalar()
    return group_count(rows, column).withColumn("proportion", F.col("n") / known)


def complete_domain(counts: DataFrame, key: str, domain: DataFrame,
                    measure: str = "n") -> DataFrame:
    """Every key of the domain, absent ones with zero; keys outside the domain are kept."""
    joined = domain.select(key).distinct().join(counts, key, "full")
    return joined.withColumn(measure, F.coalesce(measure, F.lit(0)))


def bucket_shares(rows: DataFrame, bucket: Column, measure: str, name: str = "taxon") -> DataFrame:
    """Sum of a measure per bucket and its share of all bucketed rows."""
    sums = (rows.select(bucket.alias(name), measure).where(F.col(name).isNotNull())
            .groupBy(name).agg(F.sum(measure).alias("n")))
    return sums.withColumn("prop", F.col("n") / sums.agg(F.sum("n")).scalar())


def disciplines(journals: DataFrame, mapping: DataFrame) -> DataFrame:
    """Papers per discipline through a weighted journal table; unmapped journals count apart.

    ``journals``: (journal, n). ``mapping``: (journal, discipline, weight).
    """
    joined = journals.join(mapping, "journal", "left")
    return joined.groupBy(F.coalesce("discipline", F.lit("unmapped")).alias("discipline")).agg(
        F.sum(F.col("n") * F.coalesce("weight", F.lit(1.0))).alias("papers"),
        F.count("*").alias("journals")).withColumn(
            "share", percent("papers", journals.agg(F.sum("n")).scalar()))


def normalised_journals(df: DataFrame, column: str = "source") -> DataFrame:
    """One row per journal name in lower case without outer blanks."""
    return df.groupBy(F.lower(F.trim(column)).alias("journal")).agg(F.count("*").alias("n"))
