"""Spark result == DuckDB oracle result for registered queries (small SF).

Runs a representative subset by default; QUARRY_ALL_ORACLES=1 runs all.
"""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
SUBSET = ["numeric_profile_lineitem", "numeric_profile_with_nulls", "frequency_with_missing",
          "categorical_profile_labels_binary", "missing_report_lineitem_nulls", "dataset_summary_orders_dup",
          "quality_flags_part_const", "candidate_targets_part_const", "health_score_part_const",
          "clean_typed_orders_text", "clean_fill_values_median_lineitem_nulls", "clean_iqr_filter_lineitem",
          "pearson_lineitem_discount_tax", "spearman_min_rank_lineitem_quantity_tax", "chi_square_yates_labels",
          "pair_scan_part_const", "t_test_lineitem_quantity_by_status", "mann_whitney_lineitem_quantity_by_status",
          "kruskal_events_value_by_type", "levene_orders_price_by_priority", "normality_events_value",
          "histogram_events_value", "group_describe_orders", "chart_kde_events_by_type",
          "chart_box_orders_price_by_priority", "model_roc_preds", "model_auc_preds", "model_ols_one_predictor_lineitem",
          "model_split_sizes_lineitem", "route_intents_conversations", "route_answer_topics_conversations",
          "source_csv_roundtrip_orders", "source_json_unwrap_nation", "stream_daily_moments_events",
          "findings_test_recommendations_orders", "melt_lineitem_measures"]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("QUARRY_ALL_ORACLES") else SUBSET


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v + 0.0)
    if hasattr(v, "item"):
        return _norm(v.item())
    return repr(v)


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, sf_dir, con, name):
    df = entry.queries()[name](spark, sf_dir)
    s_cols, s_rows = _canon(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[name])
    d_cols, d_rows = _canon([d[0] for d in cur.description], cur.fetchall())
    assert s_cols == d_cols
    assert s_rows == d_rows


def test_every_query_has_a_callable_and_most_have_sql():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(sql) >= 0.8 * len(qs)


def test_entry_runs(spark):
    out = entry.entry(spark)
    assert out.count() >= 1
    assert "mean" in out.columns
