"""Mixing sources by temperature.

Source weights are the source's share of the tokens raised to an exponent and normalised. The
exponent is bisected between 1 (as found) and 0 (all sources alike): the smallest one whose
entropy stays under the target and whose repetition stays under the limit. The weights are then
realised with a budget in which the most over-represented source is read exactly once, so no
document is lost: every source is read a whole number of times plus a remainder, and the
remainder is a prefix of a seeded permutation of the source's blocks, cut inside one block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarlens.llm.common import WORD, text_of
from scholarlens.session import written

#: Target entropy, as the way from the entropy found to the largest possible one.
ENTROPY_GAIN = 0.5
MAX_REPEATS = 4.0
SEED = 7
#: Documents a block holds on average, whatever the size of the source.
BLOCK_DOCS = 1024
#: Exponents tried in one pass over the sources: one less than a power of two, so that a pass
#: stands for several bisections.
TRIED = 31
PASSES = 5


@dataclass(frozen=True)
class Mixture:
    exponent: float
    largest: int  # tokens of the largest source


def number(text: Column) -> Column:
    """32 bits of the md5 of a text as a number."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def source_tokens(light: DataFrame) -> DataFrame:
    """Tokens and documents per source; at most one row per source and task is shuffled."""
    return light.groupBy("source").agg(F.sum("n_tokens").alias("tokens"),
                                       F.count(F.lit(1)).alias("docs"))


def solve(sources: DataFrame, gain: float = ENTROPY_GAIN, repeats: float = MAX_REPEATS) -> Mixture:
    """The smallest exponent in [0, 1] that meets both limits, to six places.

    Each pass sums the powers of all shares for several exponents; only those sums reach the
    driver. Sources without tokens have no share. Without any tokens the exponent is 1.
    """
    some = sources.where("tokens > 0")
    total, low, high, n = some.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens"),
                                   F.count(F.lit(1))).first()
    if not n or low == high:
        return Mixture(1.0, high or 0)
    share = F.col("tokens") / F.lit(float(total))

    def entropies(exponents: list[float]) -> list[float]:
        sums = some.agg(*[F.sum(F.pow(share, F.lit(a))) for a in exponents],
                        *[F.sum(F.pow(share, F.lit(a)) * F.log(share)) for a in exponents]).first()
        k = len(exponents)
        return [math.log(sums[i]) - a * sums[k + i] / sums[i] for i, a in enumerate(exponents)]

    found, = entropies([1.0])
    target = found + gain * (math.log(n) - found)
    fits = lambda a, h: h <= target and (low / high) ** (a - 1) <= repeats
    left, right = 0.0, 1.0
    for _ in range(PASSES):
        grid = [left + (right - left) * i / (TRIED + 1) for i in range(TRIED + 2)]
        ok = [fits(a, h) for a, h in zip(grid[1:-1], entropies(grid[1:-1]))] + [True]
        first = ok.index(True)
        left, right = grid[first], grid[first + 1]
    return Mixture(round(right, 6), high)


def planned(docs: DataFrame, keep: list[str] | None = None, key: str = "doc_id",
            source: str = "source", text: str = "text", seed: int = SEED,
            gain: float = ENTROPY_GAIN, repeats: float = MAX_REPEATS) -> DataFrame:
    """Per row: struct ``row``, ``source``, ``n_tokens``, ``weight`` of the source, ``n_copies``.

    Tokens are the words of the whole text; a null text has none. Rows with null source form a
    source of their own, a source without tokens is read once with weight 0, an empty table
    gives no rows, and repeated rows are rows like others. Ties of the permutation are broken
    by the key, then by a hash of the text; rows of equal key and text count as alike, and any of
    them is read more often.
    """
    keep = docs.columns if keep is None else keep
    light = written(docs.select(
        F.struct(*[F.col(c) for c in keep]).alias("row"), F.col(source).cast("string").alias("source"),
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"),
        F.xxhash64(text_of(text)).alias("print"),
        F.size(F.regexp_extract_all(text_of(text), F.lit(WORD), F.lit(0))).cast("long")
        .alias("n_tokens")), "mixing")
    sources = written(source_tokens(light), "sources")
    mix = solve(sources, gain, repeats)
    power = F.pow(F.col("tokens") / F.lit(float(mix.largest or 1)), F.lit(mix.exponent))
    norm = sources.where("tokens > 0").agg(F.sum(power)).first()[0] or 1.0
    reads = F.when(F.col("tokens") > 0, F.round(
        F.pow(F.col("tokens") / F.lit(float(mix.largest or 1)), F.lit(mix.exponent - 1)), 9)
    ).otherwise(1.0)
    settings = sources.select(
        F.col("source").alias("s_source"),
        F.ceil(F.col("docs") / BLOCK_DOCS).alias("blocks"),
        F.when(F.col("tokens") > 0, F.round(power / norm, 9)).otherwise(0.0).alias("weight"),
        F.floor(reads).alias("whole"),
        F.floor((reads - F.floor(reads)) * F.col("tokens")).alias("rest"))
    dealt = light.join(settings, F.col("source").eqNullSafe(F.col("s_source"))).withColumn(
        "block", F.pmod(number(F.concat(F.lit(f"{seed}:block:"), F.col("key"))), F.col("blocks")))
    turn = lambda *c: number(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), *c))
    named = F.coalesce(F.col("s_source"), F.lit(""))
    blocks = dealt.groupBy("s_source", "block", "whole", "rest").agg(
        F.sum("n_tokens").alias("block_tokens"))
    order = Window.partitionBy("s_source").orderBy(
        turn(named, F.col("block").cast("string")), "block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(
        F.col("s_source").alias("b_source"), F.col("block").alias("b_block"),
        F.coalesce(F.sum("block_tokens").over(order), F.lit(0)).alias("before"))
    inside = Window.partitionBy("s_source", "block").orderBy(
        turn(F.lit("doc"), F.col("key")), "key", "print").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(before, F.col("s_source").eqNullSafe(F.col("b_source"))
                        & (F.col("block") == F.col("b_block")))
    upto = F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    extra = (upto < F.col("rest")).cast("long")
    return placed.select("row", "source", "n_tokens", "weight", "whole", extra.alias("extra")).select(
        "row", "source", "n_tokens", "weight", (F.col("whole") + F.col("extra")).alias("n_copies"))


def realised(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture reads it."""
    plan = planned(docs)
    return plan.select("row", F.explode(F.sequence(F.lit(1), F.col("n_copies")))).select("row.*")
