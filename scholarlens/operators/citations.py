"""Dataset sizes joined to citation counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_citations(datasets: DataFrame, citations: DataFrame,
                   key: str = "datasetkey") -> DataFrame:
    """Left join of per-dataset citations; datasets without an entry keep a null."""
    return datasets.join(citations, key, "left")


def with_group_totals(rows: DataFrame, keys: Sequence[str], measure: str = "occurrence_count",
                      citations: str = "citations", collapse: bool = False) -> DataFrame:
    """Group total and citations per record on every input row.

    Input rows are kept: a group of two rows yields two equal results. ``collapse`` keeps one
    row per group. The totals are aggregated first and joined back on the group keys, so that
    a group holding much of the table is pre-aggregated and its rows stay spread over tasks
    (a window over the group would gather them in one).
    """
    sums = rows.groupBy(*keys).agg(
        F.sum(measure).alias("total_occurrences"), F.first(citations).alias("_citations"))
    if collapse:
        out = sums.withColumnRenamed("_citations", citations) if citations not in keys else sums
    else:
        out = _joined_back(rows, sums.drop("_citations"), keys)
    out = out.withColumn("citations_per_record", F.col(citations) / F.col("total_occurrences"))
    return out.drop("_citations")


def with_both_totals(rows: DataFrame, keys: Sequence[str], part: str,
                     measure: str = "occurrence_count", citations: str = "citations") -> DataFrame:
    """Totals under two groupings on every input row: by ``keys``, and by ``keys`` and ``part``.

    Adds ``total_occurrences`` and ``citations_per_record`` of the coarse groups, and
    ``part_occurrences`` and ``citations_per_part_record`` of the fine ones. One aggregate makes
    the fine totals; the coarse ones add them up, a row per part of a group by then.
    """
    fine = rows.groupBy(*keys, part).agg(F.sum(measure).alias("part_occurrences"))
    both = fine.withColumn("total_occurrences", F.sum("part_occurrences").over(
        Window.partitionBy(*keys)))
    out = _joined_back(rows, both, [*keys, part])
    return out.withColumn(
        "citations_per_record", F.col(citations) / F.col("total_occurrences")).withColumn(
        "citations_per_part_record", F.col(citations) / F.col("part_occurrences"))


def _joined_back(rows: DataFrame, sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums on every row of their group; null keys are a group too."""
    own = [c for c in sums.columns if c not in keys]
    renamed = sums.select(*[F.col(k).alias(f"_{k}") for k in keys], *own)
    return rows.join(renamed, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(
        *[f"_{k}" for k in keys])
