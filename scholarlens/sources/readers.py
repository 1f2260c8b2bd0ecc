"""File readers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from scholarlens.functions.columns import parse_month_day_year
from scholarlens.sources import schemas


def read_csv(spark: SparkSession, path: str, schema: StructType,
             multiline: bool = True) -> DataFrame:
    """Headed CSV with a declared schema.

    ``multiline`` allows line breaks inside quoted fields; such a file is read by one task, so
    large tables should come as many files, or with ``multiline=False`` if no field has breaks.
    The text ``NA`` stays text: it is a country code.
    """
    return spark.read.schema(schema).csv(path, header=True, multiLine=multiline, escape='"')


def read_checked(spark: SparkSession, path: str, schema: StructType,
                 dates: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Typed rows of a headed CSV, and the lines that do not fit its schema.

    A line with too few or too many fields, or with a field that is not of its type, is rejected
    with the reason ``malformed``; one whose text in ``dates`` is no month/day/year with the
    reason ``date``. Missing fields are null and no reason. Rejects: (line, reason). Files begin
    with the schema's names; a field has no line breaks. Lines are parsed whole, whatever columns
    are asked for later, so that the same lines are rejected.
    """
    names = ",".join(f.name for f in schema.fields)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [
        *schema.fields, StructField("_line", StringType())])
    raw = spark.read.text(path).where((F.col("value") != names) & (F.col("value") != "")).select(
        F.from_csv("value", kinds, {"escape": '"', "mode": "PERMISSIVE",
                                    "columnNameOfCorruptRecord": "_line"}).alias("r")).select("r.*")
    undated = reduce(or_, [F.col(d).isNotNull() & parse_month_day_year(d).isNull() for d in dates],
                     F.lit(False))
    reason = F.when(F.col("_line").isNotNull(), "malformed").when(undated, "date")
    told = raw.withColumn("_reason", reason)
    fields = [parse_month_day_year(f.name).alias(f.name) if f.name in dates else F.col(f.name)
              for f in schema.fields]
    rejects = told.where(F.col("_reason").isNotNull()).select(F.coalesce(
        "_line", F.to_csv(F.struct(*[F.col(f.name) for f in schema.fields]))).alias("line"),
        F.col("_reason").alias("reason"))
    return told.where(F.col("_reason").isNull()).select(*fields), rejects


def read_studies(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.STUDY)


def read_citations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Citations per dataset, and rejected lines."""
    return read_checked(spark, path, schemas.DATASET_CITATIONS)


def read_snapshots(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Dataset sizes with the month/day/year text turned into a date, and rejected lines."""
    return read_checked(spark, path, schemas.DATASET_SNAPSHOTS, ["snapshot_date"])


def read_occurrence_counts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read_checked(spark, path, schemas.OCCURRENCE_COUNTS, ["snapshot"])


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.COUNTRY, multiline=False)


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a nested map document: (layer, code, count, lat, lon, name)."""
    data = spark.read.schema(schemas.MAP_DOCUMENT).json(path).select(
        F.explode("datasets").alias("d")).select("d.data.*")
    rows = data.select(F.col("label").alias("layer"), F.explode("allData").alias("r"))
    r = F.col("r")
    return rows.select("layer", r[0].alias("code"), r[1].cast("bigint").alias("count"),
                       r[2].cast("double").alias("lat"), r[3].cast("double").alias("lon"),
                       r[4].alias("name"))


def taxon_count(occurrences: DataFrame, keys: Sequence[int], key: str = "kingdom",
                measure: str = "occurrence_count") -> DataFrame:
    """Occurrences of a set of taxon keys, one count per key found."""
    return occurrences.where(F.col(key).isin(*keys)).groupBy(key).agg(
        F.sum(measure).alias(measure))
