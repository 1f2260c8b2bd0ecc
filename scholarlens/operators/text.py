"""Text preparation: tokens, stopwords, stems, document-term counts and vocabulary pruning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholarlens.functions.fixed import STOPWORDS
from scholarlens.functions.stem import stem_words
from scholarlens.session import written


def tokens(docs: DataFrame, text: str, keep: Sequence[str] = ("doc_id",),
           min_length: int = 3) -> DataFrame:
    """One row per word of the whole text: lower case, letters only, short words dropped."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    long_enough = F.filter(words, lambda w: F.length(w) >= min_length)
    return docs.select(*keep, F.explode(long_enough).alias("term"))


def without_stopwords(words: DataFrame, stopwords: Sequence[str] = STOPWORDS,
                      custom: Sequence[str] = ()) -> DataFrame:
    """Drop listed words; the list is a literal set, so no join is needed."""
    return words.where(~F.col("term").isin(*stopwords, *custom))


def doc_terms(words: DataFrame, doc_keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Sparse document-term counts. A document's words meet before the shuffle."""
    return words.groupBy(*doc_keys, "term").agg(F.count("*").alias("cnt"))


def term_frequencies(counts: DataFrame) -> DataFrame:
    """Document frequency and token count of each term of (doc_id, term, cnt)."""
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("cnt").alias("tokens"))


def stem_map(counts: DataFrame) -> DataFrame:
    """(term, stem) for each distinct term: stems are worked out per word, not per token."""
    return stem_words(counts.select("term").distinct())


def stemmed(counts: DataFrame, doc_keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Counts with terms replaced by their stems and merged."""
    return (counts.join(stem_map(counts), "term")
            .groupBy(*doc_keys, F.col("stem").alias("term")).agg(F.sum("cnt").alias("cnt")))


def prune(counts: DataFrame, lower: int, upper: int | None = None) -> DataFrame:
    """Keep terms found in more than ``lower`` (and at most ``upper``) documents."""
    freq = term_frequencies(counts)
    keep = freq.where(F.col("df") > lower)
    if upper is not None:
        keep = keep.where(F.col("df") <= upper)
    return counts.join(keep.select("term"), "term", "left_semi")


def removed_documents(counts: DataFrame, pruned: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    """Documents that lost every term."""
    return counts.select(doc_key).distinct().join(
        pruned.select(doc_key).distinct(), doc_key, "left_anti")


def threshold_sweep(counts: DataFrame, first: int, last: int, step: int) -> DataFrame:
    """Documents, words and tokens lost at every lower threshold of a grid.

    Words and tokens are summed per document frequency first, and a document is lost once the
    threshold reaches its most widespread term. Both summaries become one row per frequency and
    are then summed up along the grid, so the corpus is read for all thresholds together.
    """
    spark = counts.sparkSession
    freq = term_frequencies(counts)
    per_df = freq.groupBy("df").agg(F.count("*").alias("words"), F.sum("tokens").alias("tokens"))
    top_df = counts.join(freq.select("term", "df"), "term").groupBy("doc_id").agg(
        F.max("df").alias("df"))
    lost_docs = top_df.groupBy("df").agg(F.count("*").alias("docs"))

    def first_lost_at(df: DataFrame) -> DataFrame:
        # Smallest grid value that reaches the frequency: the equality key of the join below.
        place = F.greatest(F.ceil((F.col("df") - first) / step), F.lit(0)) * step + first
        return df.withColumn("at", place)

    joined = (first_lost_at(per_df).groupBy("at").agg(F.sum("words").alias("words"),
                                                      F.sum("tokens").alias("tokens"))
              .join(first_lost_at(lost_docs).groupBy("at").agg(F.sum("docs").alias("docs")),
                    "at", "full"))
    grid = spark.range(first, last + 1, step).select(F.col("id").alias("threshold"))
    # One row per grid value.
    up_to = Window.orderBy("threshold")
    return grid.join(joined, F.col("threshold") == F.col("at"), "left").select(
        "threshold",
        *[F.coalesce(F.sum(c).over(up_to), F.lit(0)).alias(f"{c}_removed")
          for c in ("docs", "words", "tokens")])


def vocabulary(counts: DataFrame) -> DataFrame:
    """Dense term ids from 1 in term order, with document frequency and tokens.

    Terms are range-partitioned and written with their partition number; a term's id is the
    size of the earlier partitions plus its place in its own.
    """
    ranged = written(term_frequencies(counts).repartitionByRange("term")
                     .withColumn("_part", F.spark_partition_id()), "terms")
    # One row per range partition.
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
                         .alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("term"))
    return ranged.join(sizes, "_part").select(
        (F.col("_offset") + place).cast("int").alias("term_id"), "term", "df", "tokens")
