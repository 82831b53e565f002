"""Registered findings / report queries (R1-R15): codes, subjects and numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import findings as R
from quarry.plans import fixtures as FX
from quarry.plans.catalog import register, rounded, sql_rounded, table
from quarry.plans.q_quality import ORDERS_COLS, candidates_sql

_O = ["section", "ord", "code", "subject", "other"]


def _sql(section: str, rows: list[str]) -> str:
    """Oracle rows ``code, subject, other, value`` numbered in the order given (empty ones drop out)."""
    body = " UNION ALL ".join(f"SELECT {i} AS k, * FROM ({r})" for i, r in enumerate(rows))
    return sql_rounded(f"""SELECT '{section}' AS section, CAST(row_number() OVER (ORDER BY k, o) AS INT) AS ord, code, subject, other,
        CAST(value AS DOUBLE) AS value FROM ({body})""", ["value"], _O)


def _row(code: str, subject: str = "NULL::VARCHAR", other: str = "NULL::VARCHAR", value: str = "NULL::DOUBLE", tail: str = "") -> str:
    return f"SELECT 0 AS o, '{code}' AS code, {subject} AS subject, {other} AS other, CAST({value} AS DOUBLE) AS value {tail}"


def _pairs(src: str, cols: list[str]) -> str:
    """(l, r, c): every pair's correlation, to four places."""
    cols = sorted(cols)
    parts = [f"SELECT '{a}' AS l, '{b}' AS r, round(corr({a}, {b}), 4) AS c FROM {src} s" for i, a in enumerate(cols) for b in cols[i + 1:]]
    return f"(SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE c IS NOT NULL AND NOT isnan(c))"


_ORD_NUM = ["o_custkey", "o_orderkey", "o_totalprice"]
_TOP_PAIR = f"(SELECT * FROM {_pairs('orders', _ORD_NUM)} ORDER BY abs(c) DESC, l, r LIMIT 1)"
_CAND = f"(SELECT * FROM ({candidates_sql('orders', ORDERS_COLS)}) LIMIT 1)"
_ROWS = "(SELECT count(*) FROM orders)"


def _run(name: str, frame, fn):
    def run(spark, sf_dir):
        return rounded(fn(frame(spark, sf_dir)))
    return run


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


register("findings_test_recommendations_orders", _sql("tests", [
    _row("correlation_test", "l", "r", "c", f"FROM {_TOP_PAIR} t"),
    _row("k_group_test", "'o_custkey'", "'o_orderpriority'", "count(DISTINCT o_orderpriority)", "FROM orders HAVING count(DISTINCT o_orderpriority) > 2"),
    _row("independence_test", "'o_orderpriority'", "'o_orderstatus'"),
    _row("multiple_regression", '"column"', value="score", tail=f"FROM {_CAND} c")]))(_run("tests", _orders, R.test_recommendations))

register("findings_ml_strategy_orders", _sql("ml_strategy", [
    _row("linear_model_first", '"column"', "problem_type", "score", f"FROM {_CAND} c WHERE NOT starts_with(problem_type, 'classification')"),
    _row("report_errors_and_residuals", '"column"', "problem_type", "score", f"FROM {_CAND} c WHERE NOT starts_with(problem_type, 'classification')"),
    _row("scale_before_clustering", value="3"), _row("check_leakage", value=_ROWS), _row("cross_validate", value=_ROWS)]))(
        _run("ml", _orders, R.ml_strategy))

register("findings_business_questions_orders", _sql("business_questions", [
    _row("drivers_of_target", '"column"', "problem_type", "score", f"FROM {_CAND} c"),
    _row("groups_of_target", '"column"', "problem_type", "score", f"FROM {_CAND} c"),
    _row("relation_or_outliers", "l", "r", "c", f"FROM {_TOP_PAIR} t"),
    _row("dominant_categories", value="2"), _row("unusual_distributions", value="3")]))(_run("bq", _orders, R.business_questions))

register("findings_story_charts_orders", _sql("story_charts", [
    "SELECT * FROM (" + " UNION ALL ".join(_row("histogram", f"'{c}'", value=f"stddev_samp({c})", tail="FROM orders") for c in _ORD_NUM)
    + ") ORDER BY value DESC, subject DESC LIMIT 1",
    _row("regression_scatter", "l", "r", "c", f"FROM {_TOP_PAIR} t"), _row("correlation_heatmap", value="3"),
    _row("category_mix", "'o_orderpriority'", value="count(DISTINCT o_orderpriority)", tail="FROM orders")]))(_run("story", _orders, R.story_charts))

_LN_COLS = [("l_orderkey", "numeric"), ("l_partkey", "numeric"), ("l_suppkey", "numeric"), ("l_linenumber", "numeric"), ("l_quantity", "numeric"),
            ("l_extendedprice", "numeric"), ("l_discount", "numeric"), ("l_tax", "numeric"), ("l_returnflag", "categorical"),
            ("l_linestatus", "categorical"), ("l_shipdate", "datetime")]
_LN_NUM = [c for c, k in _LN_COLS if k == "numeric"]
_LN = FX.LINEITEM_NULLS_SQL
_LN_TOP = f"(SELECT * FROM {_pairs(_LN, _LN_NUM)} ORDER BY abs(c) DESC, l, r LIMIT 1)"


def _outliers_sql() -> str:
    return " UNION ALL ".join(
        f"""SELECT (SELECT count(*) FROM {_LN} x, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3,
            count(DISTINCT {c}) AS d FROM {_LN} y) f WHERE d > 2 AND q3 - q1 <> 0 AND
            (x.{c} < q1 - 1.5 * (q3 - q1) OR x.{c} > q3 + 1.5 * (q3 - q1))) AS k""" for c in _LN_NUM)


_LN_MISS = " + ".join(f"(count(*) - count({c}))" for c, _ in _LN_COLS)
_LN_CAND = f"(SELECT * FROM ({candidates_sql(_LN, _LN_COLS)}) LIMIT 1)"

register("findings_next_steps_lineitem_nulls", _sql("next_steps", [
    _row("choose_objective", value="count(*)", tail=f"FROM {_LN} z"),
    _row("missing_strategy", value=_LN_MISS, tail=f"FROM {_LN} z HAVING {_LN_MISS} > 0"),
    _row("inspect_outliers", value="sum(k)", tail=f"FROM ({_outliers_sql()}) HAVING sum(k) > 0"),
    _row("verify_correlations", "l", "r", "c", f"FROM {_LN_TOP} t"),
    _row("baseline_model", '"column"', "problem_type", "score", f"FROM {_LN_CAND} t"),
    _row("write_up", value="count(*)", tail=f"FROM {_LN} z")]))(_run("next", FX.lineitem_nulls, R.next_steps))


def _missing_rows(code: str, limit: str) -> str:
    parts = " UNION ALL ".join(_row(code, f"'{c}'", value=f"100.0 * (count(*) - count({c})) / count(*)", tail=f"FROM {_LN} z").replace("0 AS o", f"{i} AS o")
                               for i, (c, _) in enumerate(_LN_COLS))
    return f"SELECT row_number() OVER (ORDER BY value DESC, o, subject) AS o, code, subject, other, value FROM ({parts}) WHERE value > 0 ORDER BY value DESC, o {limit}"


register("findings_strongest_pairs_lineitem_nulls", _sql("key_findings", [
    _row("strongest_positive", "l", "r", "c", f"FROM (SELECT * FROM {_pairs(_LN, _LN_NUM)} WHERE c > 0 ORDER BY c DESC, l, r LIMIT 1) t"),
    _row("strongest_negative", "l", "r", "c", f"FROM (SELECT * FROM {_pairs(_LN, _LN_NUM)} WHERE c < 0 ORDER BY c, l, r LIMIT 1) t"),
    _missing_rows("most_missing", "LIMIT 1")]))(lambda spark, sf_dir: rounded(R.apply_rules(
        R.facts(R.Shared(FX.lineitem_nulls(spark, sf_dir))), "key_findings",
        [r for r in R.SECTIONS["key_findings"] if r.code in ("strongest_positive", "strongest_negative", "most_missing")])))


_LI_PAIRS = _pairs("lineitem", _LN_NUM)
register("findings_chart_recommendations_lineitem", _sql("charts", [
    _row("correlation_heatmap", value="8"),
    f"SELECT row_number() OVER (ORDER BY abs(c) DESC, l, r) AS o, 'scatter_with_line' AS code, l AS subject, r AS other, c AS value "
    f"FROM (SELECT * FROM {_LI_PAIRS} ORDER BY abs(c) DESC, l, r LIMIT 2)",
    "SELECT row_number() OVER (ORDER BY abs(value) DESC, subject) AS o, code, subject, other, value FROM (" + " UNION ALL ".join(
        _row("distribution", f"'{c}'", value=f"skewness({c})", tail="FROM lineitem") for c in _LN_NUM) + ") WHERE abs(value) >= 1 ORDER BY abs(value) DESC LIMIT 2",
    _row("category_counts", "'l_linestatus'", value="count(DISTINCT l_linestatus)", tail="FROM lineitem"),
    _row("box_by_category", "'l_discount'", "'l_linestatus'", "count(DISTINCT l_linestatus)", "FROM lineitem"),
    _row("scatter_matrix", value="8"), _row("line_over_time", "'l_discount'", "'l_shipdate'")]))(
        _run("charts", lambda s, d: table(s, d, "lineitem"), R.chart_recommendations))

_LN_SORTED = sorted(_LN_NUM)
_CELLS = f"(SELECT count(*) FROM {_LN} z)"


def _share_rows() -> str:
    """The most imbalanced category: share of its most frequent value (ties to the smaller value), by schema order."""
    parts = [f"""SELECT {i} AS o, '{c}' AS subject, v AS other, 100.0 * n / {_CELLS} AS value FROM
        (SELECT {c} AS v, count(*) AS n FROM {_LN} z WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, v LIMIT 1)"""
             for i, c in enumerate(("l_returnflag", "l_linestatus"))]
    return (f"SELECT o, 'most_imbalanced' AS code, subject, other, value FROM ({' UNION ALL '.join(parts)}) ORDER BY value DESC, o LIMIT 1")


def _variation_rows() -> str:
    parts = " UNION ALL ".join(_row("most_variable", f"'{c}'", value=f"stddev_samp({c}) / avg({c})", tail=f"FROM {_LN} z") for c in _LN_NUM)
    return f"SELECT * FROM ({parts}) ORDER BY abs(value) DESC LIMIT 1"


register("findings_key_findings_lineitem_nulls", _sql("key_findings", [
    _row("column_counts_numeric", value="8"), _row("column_counts_categorical", value="2"), _row("column_counts_datetime", value="1"),
    _row("strongest_positive", "l", "r", "c", f"FROM (SELECT * FROM {_pairs(_LN, _LN_NUM)} WHERE c > 0 ORDER BY c DESC, l, r LIMIT 1) t"),
    _row("strongest_negative", "l", "r", "c", f"FROM (SELECT * FROM {_pairs(_LN, _LN_NUM)} WHERE c < 0 ORDER BY c, l, r LIMIT 1) t"),
    _variation_rows(), _share_rows(), _missing_rows("most_missing", "LIMIT 1")]))(_run("key", FX.lineitem_nulls, R.key_findings))

_HOT = " UNION ALL ".join(f"""SELECT {i} AS o, 'outlier_hotspot' AS code, '{c}' AS subject, NULL::VARCHAR AS other, CAST((SELECT count(*) FROM {_LN} x,
    (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {_LN} y) f
    WHERE x.{c} < q1 - 1.5 * (q3 - q1) OR x.{c} > q3 + 1.5 * (q3 - q1)) AS DOUBLE) AS value""" for i, c in enumerate(_LN_SORTED))
register("findings_insights_lineitem_nulls", _sql("insights", [
    _row("rows", value=_CELLS), _row("columns", value="11"),
    _row("completeness", value=f"100 - 100.0 * ({_LN_MISS}) / (11 * count(*))", tail=f"FROM {_LN} z"),
    _missing_rows("missing_hotspot", "LIMIT 1"), f"SELECT * FROM ({_HOT}) ORDER BY value DESC, o LIMIT 1",
    _row("strongest_pair", "l", "r", "c", f"FROM {_LN_TOP} t")]))(_run("insights", FX.lineitem_nulls, R.insights))

register("findings_intelligence_orders", sql_rounded(f"""
    SELECT 'prediction_tasks' AS section, CAST(row_number() OVER () AS INT) AS ord, 'predict' AS code, "column" AS subject, problem_type AS other,
      CAST(score AS DOUBLE) AS value FROM ({candidates_sql('orders', ORDERS_COLS)})
    UNION ALL SELECT 'segmentation', CAST(row_number() OVER (ORDER BY p) AS INT), 'segment_by', c, NULL, CAST(d AS DOUBLE) FROM (
      SELECT 0 AS p, 'o_orderkey' AS c, count(DISTINCT o_orderkey) AS d FROM orders UNION ALL SELECT 1, 'o_custkey', count(DISTINCT o_custkey) FROM orders
      UNION ALL SELECT 2, 'o_totalprice', count(DISTINCT o_totalprice) FROM orders) WHERE d > 1""", ["value"], _O))(
        _run("intelligence", _orders, R.intelligence))
register("findings_quality_interpretation_part_const")(_run("quality", FX.part_const, R.quality_interpretation))
register("findings_descriptive_takeaways_lineitem_nulls")(_run("takeaways", FX.lineitem_nulls, R.descriptive_takeaways))
register("findings_summary_report_orders")(_run("report", _orders, R.summary_report))


@register("findings_report_text_orders")
def _text(spark, sf_dir):
    return R.as_text(R.summary_report(_orders(spark, sf_dir))).where(F.col("text").isNotNull())


@register("findings_metadata_package_customer")
def _pkg(spark, sf_dir):
    return R.metadata_package(table(spark, sf_dir, "customer"))


register("findings_suggested_actions_orders", f"""
 WITH best AS (SELECT l, r FROM (SELECT 'o_orderkey' AS l, 'o_custkey' AS r, corr(o_orderkey, o_custkey) AS c FROM orders
   UNION ALL SELECT 'o_orderkey', 'o_totalprice', corr(o_orderkey, o_totalprice) FROM orders
   UNION ALL SELECT 'o_custkey', 'o_totalprice', corr(o_custkey, o_totalprice) FROM orders) WHERE c IS NOT NULL ORDER BY abs(c) DESC, l, r LIMIT 1)
 SELECT 'suggested_actions' AS section, CAST(ord AS INT) AS ord, code, subject, other, NULL::DOUBLE AS value FROM (
   SELECT 1 AS ord, 'correlation_heatmap' AS code, NULL::VARCHAR AS subject, NULL::VARCHAR AS other
   UNION ALL SELECT 2, 'scatter', l, r FROM best
   UNION ALL SELECT * FROM (VALUES (3, 'regression', 'o_totalprice', NULL), (4, 'predictors', 'o_totalprice', NULL), (5, 'outliers', 'o_orderkey', NULL),
     (6, 'box', 'o_orderkey', 'o_orderstatus'), (7, 'anova', 'o_orderkey', 'o_orderstatus'), (8, 'chi_square', 'o_orderstatus', 'o_orderpriority'),
     (9, 'missing_report', NULL, NULL), (10, 'chart_recommendations', NULL, NULL)))
 WHERE (SELECT count(*) FROM orders) > 0""")(lambda spark, sf_dir: R.suggested_actions(_orders(spark, sf_dir)))


def _answers_sql(topics: dict[str, list[str]]) -> str:
    body = " UNION ALL ".join(f"SELECT '{t}' AS topic, {i} AS k, * FROM ({r})" for t, rows in topics.items() for i, r in enumerate(rows))
    return sql_rounded(f"""SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY k, o) AS INT) AS ord, code, subject, other,
        CAST(value AS DOUBLE) AS value FROM ({body})""", ["value"], ["topic", "ord", "code", "subject", "other"])


def _ranked(code: str, rows: str, order: str, keep: int) -> str:
    """The first ``keep`` of (o, subject, other, value) rows by ``order``, then by o and names."""
    by = f"{order}, o, subject, other"
    return f"SELECT row_number() OVER (ORDER BY {by}) AS o, '{code}' AS code, subject, other, value FROM ({rows}) ORDER BY {by} LIMIT {keep}"


def _each(cols: list[str], value: str, src: str, other: str = "NULL::VARCHAR") -> str:
    return " UNION ALL ".join(f"SELECT {i} AS o, '{c}' AS subject, {other} AS other, ({value.format(c=c)})::DOUBLE AS value FROM {src}" for i, c in enumerate(cols))


_OP = _pairs("orders", _ORD_NUM)
_PAIR_ROWS = f"SELECT 0 AS o, l AS subject, r AS other, c AS value FROM {_OP} p"
_PAIR6 = _ranked("pair", _PAIR_ROWS, "-abs(value)", 6)
_CANDIDATE5 = f"""SELECT row_number() OVER () AS o, 'candidate' AS code, "column" AS subject, problem_type AS other, score::DOUBLE AS value
    FROM (SELECT * FROM ({candidates_sql('orders', ORDERS_COLS)}) LIMIT 5)"""
_ORD_SCHEMA = ["o_orderkey", "o_custkey", "o_totalprice"]
_SKEW = "skewness({c})"
_KURT = "kurtosis({c})"
_OUT = """SELECT count(*) FROM orders x, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, count(DISTINCT {c}) AS d FROM orders y) f
    WHERE d > 2 AND q3 <> q1 AND (x.{c} < q1 - 1.5 * (q3 - q1) OR x.{c} > q3 + 1.5 * (q3 - q1))"""
_OUT_ROWS = f"SELECT * FROM ({_each(_ORD_SCHEMA, _OUT, '(SELECT 1)')}) WHERE value > 0"
_ORD_CATS = ["o_orderpriority", "o_orderstatus"]
_FREQ = " UNION ALL ".join(f"""SELECT {10 * i} + row_number() OVER (ORDER BY n DESC, v) AS o, 'frequency' AS code, '{c}' AS subject, v AS other, 100.0 * n / {_ROWS} AS value
    FROM (SELECT {c}::VARCHAR AS v, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, v LIMIT 3)""" for i, c in enumerate(_ORD_CATS))
_SHARES = " UNION ALL ".join(f"""SELECT {i} AS o, '{c}' AS subject, v AS other, 100.0 * n / {_ROWS} AS value FROM
    (SELECT {c} AS v, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, v LIMIT 1)""" for i, c in ((3, "o_orderstatus"), (5, "o_orderpriority")))
_TOP_TARGET = f"FROM {_CAND} c WHERE NOT starts_with(problem_type, 'classification')"
_ORD_MISS = " + ".join(f"(count(*) - count({c}))" for c in (*_ORD_SCHEMA, "o_orderstatus", "o_orderdate", "o_orderpriority"))

register("answers_to_all_topics_orders", _answers_sql({
    "missing": [_row("complete", value=_ORD_MISS, tail="FROM orders HAVING " + _ORD_MISS + " = 0")],
    "correlation": [_PAIR6],
    "visualization": [
        _row("correlation_heatmap", value="3"), _ranked("scatter_with_line", _PAIR_ROWS, "-abs(value)", 2),
        _ranked("distribution", f"SELECT * FROM ({_each(_ORD_SCHEMA, _SKEW, 'orders')}) WHERE abs(value) >= 1", "-abs(value)", 2),
        _row("category_counts", "'o_orderpriority'", value="count(DISTINCT o_orderpriority)", tail="FROM orders"),
        _row("box_by_category", "'o_custkey'", "'o_orderpriority'", "count(DISTINCT o_orderpriority)", "FROM orders"),
        _row("line_over_time", "'o_custkey'", "'o_orderdate'")],
    "statistical_tests": [
        _row("correlation_test", "l", "r", "c", f"FROM {_TOP_PAIR} t"),
        _row("k_group_test", "'o_custkey'", "'o_orderpriority'", "count(DISTINCT o_orderpriority)", "FROM orders HAVING count(DISTINCT o_orderpriority) > 2"),
        _row("independence_test", "'o_orderpriority'", "'o_orderstatus'"), _row("multiple_regression", '"column"', value="score", tail=f"FROM {_CAND} c")],
    "ml_strategy": [
        _CANDIDATE5, _row("linear_model_first", '"column"', "problem_type", "score", _TOP_TARGET), _row("report_errors_and_residuals", '"column"', "problem_type", "score", _TOP_TARGET),
        _row("scale_before_clustering", value="3"), _row("check_leakage", value=_ROWS), _row("cross_validate", value=_ROWS)],
    "predictive_variables": [_CANDIDATE5, _PAIR6],
    "columns": [
        _row("columns", value="6"), _ranked("numeric", _each(_ORD_SCHEMA, "count(DISTINCT {c})", "orders"), "o", 9),
        _ranked("categorical", _each(_ORD_CATS, "count(DISTINCT {c})", "orders"), "o", 9), _row("datetime", "'o_orderdate'")],
    "anomaly": [
        _ranked("outliers", _OUT_ROWS, "-value", 6),
        _ranked("skewed", f"SELECT * FROM ({_each(_ORD_SCHEMA, _SKEW, 'orders')}) WHERE abs(value) >= 1", "-abs(value)", 6),
        _ranked("heavy_tails", f"SELECT * FROM ({_each(_ORD_SCHEMA, _KURT, 'orders')}) WHERE abs(value) >= 3", "-abs(value)", 6),
        _ranked("imbalanced", f"SELECT * FROM ({_SHARES}) WHERE value >= 70", "-value", 6),
        _ranked("multicollinear", f"SELECT * FROM ({_PAIR_ROWS}) WHERE abs(value) >= 0.7", "-abs(value)", 6)],
    "business_insights": [
        _row("drivers_of_target", '"column"', "problem_type", "score", f"FROM {_CAND} c"), _row("groups_of_target", '"column"', "problem_type", "score", f"FROM {_CAND} c"),
        _row("relation_or_outliers", "l", "r", "c", f"FROM {_TOP_PAIR} t"), _row("dominant_categories", value="2"), _row("unusual_distributions", value="3"),
        _row("choose_objective", value=_ROWS), _row("inspect_outliers", value="sum(value)", tail=f"FROM ({_OUT_ROWS}) HAVING sum(value) > 0"),
        _row("verify_correlations", "l", "r", "c", f"FROM {_TOP_PAIR} t"), _row("baseline_model", '"column"', "problem_type", "score", f"FROM {_CAND} c"), _row("write_up", value=_ROWS)],
    "categorical_frequencies": [_FREQ],
    "summary": [
        _row("rows", value=_ROWS), _row("columns", value="6"), _row("column_counts_numeric", value="3"), _row("column_counts_categorical", value="2"),
        _row("column_counts_datetime", value="1"), _row("missing_cells", value=_ORD_MISS, tail="FROM orders"),
        _ranked("strongest_positive", f"SELECT * FROM ({_PAIR_ROWS}) WHERE value > 0", "-value", 1), _ranked("strongest_negative", f"SELECT * FROM ({_PAIR_ROWS}) WHERE value < 0", "value", 1),
        _ranked("most_variable", _each(_ORD_SCHEMA, "stddev_samp({c}) / avg({c})", "orders"), "-abs(value)", 1), _ranked("most_imbalanced", _SHARES, "-value", 1),
        _ranked("outliers", _OUT_ROWS, "-value", 3)]}))(lambda spark, sf_dir: rounded(R.topic_answers(_orders(spark, sf_dir))))

register("answers_missing_lineitem_nulls", _answers_sql({"missing": [_missing_rows("missing", "LIMIT 8")]}))(
    lambda spark, sf_dir: rounded(R.topic_answer(FX.lineitem_nulls(spark, sf_dir), "missing")))
