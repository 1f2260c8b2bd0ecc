"""Comma-packed lists to rows, and region coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarlens.functions.columns import flag_equals, percent
from scholarlens.functions.fixed import SENTINEL, UNMATCHED_REGION


def separate_rows(df: DataFrame, column: str, sep: str = ",", out: str | None = None,
                  distinct: bool = False) -> DataFrame:
    """One row per list element; a null list keeps one row with a null element.

    Elements are neither trimmed nor deduplicated, unless ``distinct`` asks for each element
    once per input row.
    """
    items = _items(column, sep)
    if distinct:
        items = F.array_distinct(items)
    out = out or column
    kept = [c for c in df.columns if c != out]
    return df.select(*kept, F.explode_outer(items).alias(out))


def _items(column: str, sep: str = ",") -> Column:
    return F.split(column, f"\\Q{sep}\\E", -1)


def attach_region(df: DataFrame, code: str, dim: DataFrame, dim_code: str = "iso2",
                  null_safe: bool = False) -> DataFrame:
    """Left join of a code column to the country dimension.

    No broadcast is forced: Spark broadcasts the dimension while its size is under the
    session's threshold, and sorts and merges (splitting skewed keys) beyond it.
    """
    left, right = F.col(f"l.{code}"), F.col(f"r.{dim_code}")
    cond = left.eqNullSafe(right) if null_safe else left == right
    return (df.alias("l").join(dim.alias("r"), cond, "left")
            .select("l.*", *[F.col(f"r.{c}") for c in dim.columns if c != dim_code]))


def region_coverage(studies: DataFrame, dim: DataFrame, study_id: str = "id",
                    coverage: str = "countries_coverage") -> DataFrame:
    """Study-by-country rows per region, with both percents and why rows stayed unmatched.

    Percents are over studies while counts are study-by-country rows, so they need not add up
    to 100. The percent over single-region studies is null for the unmatched group. Each study
    has one row at list position 0, so the study totals come out of the same pass.
    """
    rows = studies.select(study_id, F.posexplode_outer(_items(coverage)).alias("pos", "code"))
    code, region = F.col("code"), F.col("region")
    first = F.coalesce("pos", F.lit(0)) == 0
    counts = attach_region(rows, "code", dim.select("iso2", "region")).groupBy("region").agg(
        F.count("*").alias("n"),
        F.count_distinct(study_id).alias("n_studies"),
        F.count_if(code.isNull()).alias("n_no_list"),
        F.count_if(region.isNull() & (code == SENTINEL)).alias("n_global"),
        F.count_if(region.isNull() & (code != SENTINEL)).alias("n_unknown_code"),
        F.count_if(first).alias("_all"),
        F.count_if(first & (flag_equals("code", SENTINEL) == 0)).alias("_single"))
    # One row per region from here on.
    every = Window.partitionBy()
    return counts.select(
        F.coalesce(region, F.lit(UNMATCHED_REGION)).alias("region"),
        "n", "n_studies", "n_no_list", "n_global", "n_unknown_code",
        percent("n", F.sum("_all").over(every)).alias("prop_all"),
        F.when(region.isNotNull(), percent("n", F.sum("_single").over(every)))
        .alias("prop_single"))


def region_authorship(studies: DataFrame, dim: DataFrame, authors: str = "countries_researcher",
                      by: Column | None = None) -> DataFrame:
    """Affiliation rows per region of the whole dimension, absent regions as zero.

    ``by`` splits the counts in the same pass (single-region and global studies, say). Each
    percent is over the affiliation rows of its own split.
    """
    keyed = studies.select((by if by is not None else F.lit("all")).alias("part"), authors)
    counts = attach_region(separate_rows(keyed, authors), authors, dim.select("iso2", "region")
                           ).groupBy("part", "region").agg(F.count("*").alias("n"))
    # At most parts x regions rows from here on: gathered per part and opened over all regions.
    per_part = counts.groupBy("part").agg(
        F.sum("n").alias("n_part"),
        F.map_from_entries(F.collect_list(F.struct(
            F.coalesce("region", F.lit(UNMATCHED_REGION)).alias("region"), "n"))).alias("n"))
    regions = dim.agg(F.array_sort(F.collect_set("region"))).scalar()
    named = per_part.withColumn("regions", regions).select("part", "n_part", "n", F.explode(
        F.array_union("regions", F.map_keys("n"))).alias("region"))
    return named.select("part", "region", F.coalesce(F.col("n")[F.col("region")], F.lit(0))
                        .alias("n"), "n_part").withColumn("prop_all", percent("n", "n_part")
                                                          ).drop("n_part")
