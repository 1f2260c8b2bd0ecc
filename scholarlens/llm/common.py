"""Column selection, scopes of text and small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlens.session import ship_package

#: Characters that part words: U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: The same set inside a regular expression, and a word.
BLANK_SET = r"\x20\x09-\x0D"
WORD = rf"[^{BLANK_SET}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not hold."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def text_of(name: str) -> Column:
    """The text column with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


SPANS = "array<struct<s:int,e:int,v:string>>"


def spans_of(text: Column, pattern: str, guard: Column, group: int = 0) -> Column:
    """Array of (s, e, v): code-point offsets of every match, end exclusive, and a group's text.

    The pattern must be free of empty matches. The texts between matches and the matches, one
    after the other, give the offsets. ``guard`` is a cheap condition that every text with a
    match meets; texts that fail it are not scanned.
    """
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("g"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("h"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"))
    empty = F.array().cast(SPANS)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["g"])
        end = start + F.coalesce(F.char_length(x["h"]), F.lit(0))
        found = F.concat(acc["found"], F.array(F.struct(
            start.alias("s"), end.alias("e"), x["v"].alias("v"))))
        return F.struct(end.alias("at"), F.when(x["h"].isNotNull(), found).otherwise(
            acc["found"]).alias("found"))

    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("found")), step,
                        lambda acc: acc["found"])
    return F.when(guard, found).otherwise(empty)


def marked(spans: Column, kind: str, order: int) -> Column:
    """Spans with what they sort and print by."""
    return F.transform(spans, lambda x: F.struct(
        x["s"].alias("s"), F.lit(order).alias("o"), F.lit(kind).alias("k"), x["e"].alias("e")))


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, then end, comma-joined."""
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(
        ":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def overlapping(spans: Column, x: Column, reach: int = 0) -> Column:
    """Whether a span comes within ``reach`` characters of ``x``."""
    return F.exists(spans, lambda y: (y["s"] < x["e"] + reach) & (y["e"] > x["s"] - reach))


def batches_of(rows: Iterator, columns: int) -> Iterator[list[list]]:
    """Arrow record batches as lists of Python values, one list per column."""
    for batch in rows:
        yield [batch.column(i).to_pylist() for i in range(columns)]
