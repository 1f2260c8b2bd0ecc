"""Column expressions with explicit null rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholarlens.functions.fixed import (
    ANIMAL_KINGDOM, BASIS_CLASSES, KINGDOM_GROUPS, VERTEBRATE_PHYLUM)


def as_column(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def flag_positive(col: str | Column) -> Column:
    """1 where the value is above zero; 0 otherwise, nulls included."""
    return F.when(as_column(col) > 0, 1).otherwise(0)


def flag_equals(col: str | Column, value: str) -> Column:
    """1 where the text equals ``value``; 0 otherwise, nulls included."""
    return F.when(as_column(col) == value, 1).otherwise(0)


def condition_holds(cond: Column, r_na: bool = False) -> Column:
    """A never-null condition. ``r_na`` counts an unknown condition as met."""
    return F.coalesce(cond, F.lit(r_na))


def recode(col: str | Column, classes: Mapping[str, Sequence[str]]) -> Column:
    """Class whose member list holds the value; null where none does."""
    col = as_column(col)
    out: Column | None = None
    for name, members in classes.items():
        hit = col.isin(*members)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def basis_class(col: str | Column) -> Column:
    """Specimen-based, observation-based or unknown; null for any other basis."""
    return recode(col, BASIS_CLASSES)


def taxon_bucket(kingdom: str | Column, phylum: str | Column) -> Column:
    """Reporting group of an occurrence row; null kingdom or key 0 belongs to none."""
    kingdom, phylum = as_column(kingdom), as_column(phylum)
    animal = kingdom == ANIMAL_KINGDOM
    out = F.when(animal & F.coalesce(phylum == VERTEBRATE_PHYLUM, F.lit(False)), "Vertebrates")
    out = out.when(animal, "Invertebrates")
    for name, keys in KINGDOM_GROUPS.items():
        out = out.when(kingdom.isin(*keys), name)
    return out


def parse_month_day_year(col: str | Column) -> Column:
    """Date of a month/day/two-digit-year text; null for text of another shape."""
    return F.try_to_date(as_column(col), "M/d/yy")


def paste(*cols: str | Column, sep: str = ". ", na_text: str | None = None) -> Column:
    """Join texts. Nulls are skipped, or written as ``na_text`` when it is given."""
    parts = [as_column(c) for c in cols]
    if na_text is not None:
        parts = [F.coalesce(c, F.lit(na_text)) for c in parts]
    return F.concat_ws(sep, *parts)


def percent(part: str | Column, whole: str | Column) -> Column:
    """part / whole * 100; null where the whole is zero."""
    return as_column(part) / F.nullif(as_column(whole), F.lit(0)) * 100


def millions(col: str | Column) -> Column:
    return as_column(col) / 1_000_000


def topic_label(topic: str | Column, words: str | Column) -> Column:
    return F.format_string("Topic %d: %s", as_column(topic), as_column(words))


def recycled(labels: Sequence[str], position: str | Column) -> Column:
    """Label at a 1-based position, starting over when the list runs out."""
    choices = F.array(*[F.lit(label) for label in labels])
    return F.element_at(choices, ((as_column(position) - 1) % len(labels) + 1).cast("int"))


def contrast_side(diff: str | Column, width: float = 0.1) -> Column:
    """Which side a difference leans to; differences up to ``width`` are in the middle."""
    diff = as_column(diff)
    return F.when(diff < -width, "right").when(diff > width, "left").otherwise("middle")


def sqrt_scale(value: str | Column, low: str | Column, high: str | Column,
               size_min: float, size_max: float) -> Column:
    """Square-root size scale of ``value`` in [low, high] onto [size_min, size_max]."""
    root_low = F.sqrt(as_column(low))
    span = F.sqrt(as_column(high)) - root_low
    return F.when(span == 0, F.lit(float(size_min))).otherwise(
        size_min + (size_max - size_min) * (F.sqrt(as_column(value)) - root_low) / span)
