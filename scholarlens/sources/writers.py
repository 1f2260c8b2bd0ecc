"""File sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarlens.functions.fixed import MAP_KEYS


def map_documents(counts: DataFrame) -> DataFrame:
    """One JSON text per layer from (layer, code, count, lat, lon, name).

    Rows run by falling count, then code. Inner rows mix texts and numbers, hence variants. A
    layer holds one row per country of the dimension, so the list is bounded by it.
    """
    ordered = counts.groupBy("layer").agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("count")).alias("order"), "code", "count", "lat", "lon", "name"))).alias("rows"))
    mixed = F.transform("rows", lambda r: F.array(*[
        r[c].cast(T.VariantType()) for c in ("code", "count", "lat", "lon", "name")]))
    return ordered.select("layer", F.to_json(mixed).alias("all_data"))


def write_map(counts: DataFrame, path: str) -> None:
    """Write one nested map document per layer, a text line each."""
    layer = F.regexp_extract(F.to_json(F.array("layer")), r"^\[(.*)\]$", 1)
    key = MAP_KEYS
    head = f'{{"{key["layers"]}":[{{"{key["version"]}":"v1","{key["layer"]}":{{"{key["id"]}":'
    map_documents(counts).select(F.concat(
        F.lit(head), layer, F.lit(f',"{key["label"]}":'), layer, F.lit(f',"{key["rows"]}":'),
        F.col("all_data"), F.lit("}}]}")).alias("value")).write.text(path)


def write_report(df: DataFrame, path: str, *partition: str) -> None:
    """Headed CSV, one folder per partition value."""
    df.write.partitionBy(*partition).csv(path, header=True, escape='"')
