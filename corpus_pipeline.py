"""From raw documents to a store of token ids.

Quality rules drop documents, one document of each group of near copies stays, documents that
hold benchmark passages go, sources are mixed to their weights (a document may then occur
several times), and what is left is encoded and packed.

Each stage reads what the stage before it has stored. So when a stage starts, the scratch tables
of the stage before it have no reader left, and they are deleted; those of the last stage stay
for the reader of its result.

Null and empty texts have no words and are dropped by the quality rules; texts are read whole
whatever their length; of equal rows one stays; an empty table passes all stages and gives no
rows; further columns of any name are carried along up to the packed store.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession

from scholarlens.llm import decontaminate, mixing, nearness, packing, quality
from scholarlens.llm.common import table
from scholarlens.llm.queries import TOKENIZER, VOCABULARY
from scholarlens.session import release, scratch_scope, ship_package, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    ship_package(spark)
    return quality.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    ship_package(spark)
    return nearness.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture of its source reads it."""
    ship_package(spark)
    return mixing.realised(docs)


def token_store(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document read back from the packed store."""
    ship_package(spark)
    return packing.documents_of(packing.store(docs, tokenizer_path(TOKENIZER), VOCABULARY, by_words=True))


def _in_order(*stages: Stage) -> list[tuple[str, Stage]]:
    """The stages by name, each freeing what the one before it left in the scratch folder."""
    def framed(stage: Stage, before: str | None) -> Stage:
        @functools.wraps(stage)
        def start(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            if before:
                release(spark, before)
            with scratch_scope(stage.__name__):
                return stage(spark, docs, sf_dir)
        return start
    names = [None, *[stage.__name__ for stage in stages]]
    return [(stage.__name__, framed(stage, before)) for stage, before in zip(stages, names)]


STAGES: list[tuple[str, Stage]] = _in_order(
    quality_rules, near_copies, decontamination, mixture, token_store)

#: Near copies, windows and encoding have no SQL; tests compare each stage with a plain statement.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        result = stage(spark, docs, sf_dir)
        with scratch_scope(f"{name} result"):
            docs = written(result, name, "zstd")
        if before:
            release(spark, before)
        before = f"{name} result"
    return STAGES[-1][1](spark, docs, sf_dir)
