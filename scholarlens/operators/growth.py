"""Data growth by snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_snapshot(df: DataFrame, date: str) -> DataFrame:
    """Rows of the last date, found by one scalar aggregate."""
    return df.where(F.col(date) == df.agg(F.max(date)).scalar())


def totals(df: DataFrame, measure: str, *keys: str, name: str = "total") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(measure).alias(name))


def shares_by_date(df: DataFrame, date: str, category: str, measure: str) -> DataFrame:
    """Total per date and category, with its share of the date.

    The window sees one row per category of a date, already aggregated.
    """
    per = totals(df, measure, date, category)
    return per.withColumn(
        "prop", F.col("total") / F.sum("total").over(Window.partitionBy(date)))


def totals_and_parts(df: DataFrame, date: str, category: str, measure: str) -> DataFrame:
    """Per-category rows and per-date rows labelled ``total`` from one grouping pass.

    The grouping id tells the total row from rows whose category is null.
    """
    grouped = df.groupingSets([[F.col(date), F.col(category)], [F.col(date)]],
                              F.col(date), F.col(category)).agg(
        F.sum(measure).alias("total"), F.grouping(category).alias("is_total"))
    return grouped.select(
        date, F.when(F.col("is_total") == 1, "total").otherwise(F.col(category)).alias(category),
        F.col("is_total").cast("int").alias("is_total"), "total")


def growth_percent(per_date: DataFrame, date: str = "snapshot_date",
                   total: str = "total") -> DataFrame:
    """First and last total and their relative growth in percent."""
    return per_date.agg(
        F.min_by(total, date).alias("first_total"), F.max_by(total, date).alias("last_total"),
    ).withColumn("growth_pct", (F.col("last_total") - F.col("first_total"))
                 / F.nullif("first_total", F.lit(0)) * 100)


def share_of_bounds(total: Column, low: float, high: float) -> tuple[Column, Column]:
    """A total as a share of a low and of a high outside estimate."""
    return (total / low).alias("share_of_low"), (total / high).alias("share_of_high")


def distinct_keys(df: DataFrame, key: str, **conditions: Column) -> DataFrame:
    """Distinct keys overall and per condition, from one pass over (key, any-of) rows."""
    flags = {name: F.max(F.coalesce(cond, F.lit(False))) for name, cond in conditions.items()}
    per_key = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.lit(True).alias("n_keys"), *[f.alias(n) for n, f in flags.items()])
    return per_key.agg(*[F.count_if(name).alias(name) for name in ["n_keys", *flags]])
