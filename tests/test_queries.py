"""Registered queries against their SQL on the smallest tables.

A spread of families by default; ``ALL_QUERIES=1`` runs every query that has SQL.
"""

import math
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
SOME = (
    "src_csv_bib src_map_json sink_map_json region_coverage region_authorship "
    "agg_total_and_parts agg_count_distinct win_group_sum_keep_rows agg_median_iqr "
    "stat_wilcoxon_p txt_doc_term txt_threshold_sweep tm_topic_report tm_temporal_index "
    "tm_perspectives tm_label_words tm_residuals tm_gram tm_heldout tm_exclusivity tm_topic_corr "
    "tm_frontier join_model_runs join_domain_complete gen_threshold_grid agg_median_iqr_basis "
    "stat_wilcoxon_basis_per_record agg_boxplot_outliers map_journal_discipline "
    "txt_stem_counts src_csv_snapshots src_csv_rejects").split()
ORACLES = oracle_sql()
NAMES = sorted(ORACLES) if os.environ.get("ALL_QUERIES") else SOME


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if hasattr(value, "isoformat"):
        return value.isoformat()[:10]
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, sf, duck, name):
    df = queries()[name](spark, sf)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(queries())


def test_flagship(spark):
    assert entry(spark).count() == 6


def test_fitted_queries_hold_their_invariants(spark, sf):
    theta = queries()["tm_fit"](spark, sf).groupBy("doc_id").agg({"theta": "sum"}).collect()
    assert len(theta) > 100 and all(abs(r[1] - 1) < 1e-6 for r in theta)


def test_sweep_gives_every_measure_of_settled_models(spark, sf):
    rows = queries()["tm_search_k"](spark, sf).collect()
    assert sorted(r.k for r in rows) == [3, 4, 5] and all(r.converged for r in rows)
    assert all(math.isfinite(r[c]) for r in rows for c in (
        "coherence", "exclusivity", "heldout", "residual", "bound"))
