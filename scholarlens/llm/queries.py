"""The registered query of each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from public_tokenizers import path as tokenizer_path

from scholarlens.llm import (
    alignment, caps, conversations, decontaminate, extraction, katz, mixing, nearness, packing, personal, quality, repeats,
    secrets)
from scholarlens.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


#: Tokenizer of the encoded corpus and the size of its vocabulary.
TOKENIZER = "word_bpe_49k.json"
VOCABULARY = 49_408


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extraction.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"]).select(
        "row.page_id", "row.url", "text", "n_chars")


def op2_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read back from the store of bit-packed ids."""
    blocks = packing.store(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER), VOCABULARY, by_words=True)
    return packing.documents_of(blocks)


def op3_merged_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat a document of smaller id, and what is kept."""
    return repeats.deduplicated(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return nearness.joined(table(spark, sf_dir, "documents"), keep=["doc_id"]).select(
        "row.doc_id", "class_id", "n_links")


def op5_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under the base and the backoff model."""
    return katz.scored(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows of benchmark items."""
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                               keep=["doc_id"])
    return decontaminate.measured(found).select(
        "row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document and the verdict of the adaptive rules."""
    found = quality.judged(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("row.doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines",
                        "m.n_repeat_words", "base_failed", "kept")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with parts of credentials that complete each other."""
    return secrets.scan(table(spark, sf_dir, "documents"), keep=["doc_id"]).select(
        "row.doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, accepted by a weakly supervised classifier."""
    return personal.scan(table(spark, sf_dir, "documents"), keep=["doc_id"]).select(
        "row.doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op10_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is read in the mixture of sources."""
    return mixing.planned(table(spark, sf_dir, "documents"), keep=["doc_id"]).select(
        "row.doc_id", "source", "n_tokens", "weight", "n_copies")


#: Tokenizers whose tokens are aligned.
LEFT_TOKENIZER = "byte_bpe_50k.json"
RIGHT_TOKENIZER = "piece_bpe_32k.model"


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers in every document."""
    found = alignment.measured(
        table(spark, sf_dir, "documents"), tokenizer_path(LEFT_TOKENIZER),
        tokenizer_path(RIGHT_TOKENIZER), keep=["doc_id"])
    return found.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                        "groups_sha256")


def op11_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix tree of all rebuilt conversations."""
    return conversations.prefix_tree(*conversations.rebuilt(table(spark, sf_dir, "conversations")))


def op13_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.95 or more."""
    return caps.linked(table(spark, sf_dir, "embeddings"), keep=["vec_id"]).select(
        "row.vec_id", "n_links", "component_id", "kept")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_html_extraction, op2_bit_packing, op3_merged_transforms, op4_jaccard_join, op5_katz_scores,
    op6_decontamination, op7_quality_rules, op8_secret_scan, op9_personal_data,
    op10_temperature_mixing, op11_prefix_tree, op12_tokenizer_alignment,
    op13_embedding_links)}

_TREE_SQL = """
    WITH o AS (
        SELECT conv_id AS c, row_number() OVER (
                   PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p,
               length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS s,
               length(coalesce(text, '')) AS len
        FROM conversations WHERE conv_id IS NOT NULL),
    h AS (
        SELECT c, c - c % 100 AS base, xor(4294967295, list_reduce(
                   list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
                   lambda acc, x: list_reduce(range(8), lambda v, i: xor(
                       v // 2, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END), xor(acc, x)),
                   4294967295)) % 6 AS h
        FROM (SELECT DISTINCT c FROM o)),
    r AS (
        SELECT h.c, 0 AS own, p, s, len FROM h JOIN o ON o.c = h.base AND o.p <= h.h
        UNION ALL SELECT h.c, 1, p, s, len FROM h JOIN o ON o.c = h.c AND o.p > h.h),
    seq AS (
        SELECT h.c, coalesce(list(s ORDER BY own, p) FILTER (s IS NOT NULL), []) AS s,
               list(len ORDER BY own, p) AS l
        FROM h LEFT JOIN r ON h.c = r.c GROUP BY 1),
    pre AS (SELECT c, d, s[1:d] AS k, CASE WHEN d = 0 THEN 0 ELSE l[d] END AS len, len(s) = d AS ended
            FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM seq)),
    node AS (
        SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, any_value(len) AS len,
               sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ended), '')) AS ends
        FROM pre GROUP BY k, d),
    kids AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY 1, 2),
    full_ AS (SELECT node.*, coalesce(n, 0) AS n_children
              FROM node LEFT JOIN kids ON node.k = kids.k AND node.d = kids.d)
    SELECT n.conv_id, n.d AS depth, any_value(p.conv_id) AS parent_conv_id, any_value(n.n_convs) AS n_convs,
           any_value(n.n_children) AS n_children, count(*) FILTER (m.n_children = 0) AS n_leaves,
           CAST(sum((m.n_convs - 1) * m.len) AS BIGINT) AS saved_tokens, any_value(n.ends) AS ends_sha256
    FROM full_ n JOIN full_ m ON m.d >= n.d AND m.k[1:n.d] = n.k
    LEFT JOIN node p ON p.d = n.d - 1 AND p.k = n.k[1:n.d - 1]
    GROUP BY n.k, n.d, n.conv_id"""


#: All pairs of vectors that are neither null nor zero nor hold anything but finite numbers.
_LINKS_SQL = """
    WITH RECURSIVE v AS (
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
              AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
          WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings
              UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
    SELECT e.vec_id, coalesce(n, 0) AS n_links, c AS component_id, e.vec_id = c AS kept
    FROM embeddings e JOIN (SELECT a, min(b) AS c FROM reach GROUP BY 1) r ON e.vec_id = r.a
    LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY 1) k ON e.vec_id = k.a"""

ORACLES: dict[str, str] = {"op11_prefix_tree": _TREE_SQL, "op13_embedding_links": _LINKS_SQL}
