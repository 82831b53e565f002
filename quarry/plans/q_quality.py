"""Registered data-quality queries (Q1-Q18) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import profile as P
from quarry.operators import quality as Q
from quarry.operators import screen as SC
from quarry.operators import sketches as SK
from quarry.plans import fixtures as FX
from quarry.plans.catalog import register, rounded, sql_rounded, table
from quarry.plans.sqlgen import q

PART_CONST_COLS = [("p_partkey", "numeric"), ("p_name", "categorical"), ("p_brand", "categorical"),
                   ("p_type", "categorical"), ("p_size", "numeric"), ("p_retailprice", "numeric"),
                   ("p_const", "categorical"), ("p_mostly", "categorical"), ("p_empty", "categorical")]
ORDERS_COLS = [("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "categorical"),
               ("o_totalprice", "numeric"), ("o_orderdate", "datetime"), ("o_orderpriority", "categorical")]
CUSTOMER_COLS = [("c_custkey", "numeric"), ("c_name", "categorical"), ("c_nationkey", "numeric"),
                 ("c_acctbal", "numeric"), ("c_mktsegment", "categorical")]
LABELS_COLS = [("doc_id", "numeric"), ("quality", "numeric"), ("toxic", "numeric")]


def stats_sql(tbl: str, cols: list[tuple[str, str]]) -> str:
    parts = []
    for i, (c, kind) in enumerate(cols):
        parts.append(f"""SELECT {i} AS position, '{c}' AS "column", '{kind}' AS kind, a.nrows AS "rows",
          a.miss AS missing, a.d AS "distinct", coalesce(t.mx, 0) AS top_count, coalesce(t.mn, 0) AS min_count,
          t.tv AS top_value, a.nrows - a.miss AS present, a.d / greatest(a.nrows, 1) AS unique_ratio,
          (a.d = 2 AND '{kind}' <> 'datetime') AS is_binary
        FROM (SELECT count(*) AS nrows, count(*) - count({q(c)}) AS miss, count(DISTINCT {q(c)}) AS d FROM {tbl}) a,
             (SELECT max(n) AS mx, min(n) AS mn, arg_min(v, (-n, v)) AS tv FROM
                (SELECT {q(c)}::VARCHAR AS v, count(*) AS n FROM {tbl} WHERE {q(c)} IS NOT NULL GROUP BY 1)) t""")
    return "(" + " UNION ALL ".join(parts) + ")"


def _like_any(expr: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{w}')" for w in words) + ")"


def flags_sql(tbl, cols):
    name = 'lower("column")'
    return f"""SELECT "column", (unique_ratio >= 0.5 AND "distinct" > 20) AS high_cardinality,
      ("distinct" <= 1) AS constant,
      ("distinct" > 1 AND present > 0 AND top_count / present >= 0.95) AS near_constant,
      (unique_ratio >= 0.9 OR ({_like_any(name, Q.ID_KEYWORDS)} AND unique_ratio >= 0.5)) AS possible_id,
      {_like_any(name, Q.LEAKAGE_KEYWORDS)} AS leakage_risk
    FROM {stats_sql(tbl, cols)} s"""


@register("quality_flags_part_const", flags_sql(FX.PART_CONST_SQL, PART_CONST_COLS))
def _flags(spark, sf_dir):
    return Q.column_flags(Q.column_stats(FX.part_const(spark, sf_dir)))


@register("quality_flags_orders", flags_sql("orders", ORDERS_COLS))
def _flags_o(spark, sf_dir):
    return Q.column_flags(Q.column_stats(table(spark, sf_dir, "orders")))


for _name, _tbl, _cols, _frame in [("orders", "orders", ORDERS_COLS, lambda spark, sf_dir: table(spark, sf_dir, "orders")),
                                   ("part_const", FX.PART_CONST_SQL, PART_CONST_COLS, FX.part_const)]:
    def _mk(frame):
        return lambda spark, sf_dir: SC.column_flags(frame(spark, sf_dir))
    register(f"quality_flags_screened_{_name}", flags_sql(_tbl, _cols))(_mk(_frame))


@register("top_values_orders", " UNION ALL ".join(f"""(SELECT '{c}' AS "column", {c}::VARCHAR AS value, count(*) AS count,
    row_number() OVER (ORDER BY count(*) DESC, {c}::VARCHAR) AS rank FROM orders GROUP BY {c} ORDER BY rank LIMIT 5)""" for c in ("o_custkey", "o_orderstatus", "o_orderpriority", "o_orderkey")))
def _top_values(spark, sf_dir):
    """Counters for the skewed columns, full counts for the flat ones."""
    return SC.top_values(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority", "o_orderkey"], 5)


_KLL = ["l_quantity", "l_extendedprice", "l_discount", "l_orderkey"]
_PROBS = [0.01, 0.25, 0.5, 0.75, 0.99]


@register("kll_quantiles_merged_lineitem", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {p}::DOUBLE AS prob, count({c}) AS n, true AS within FROM lineitem""" for c in _KLL for p in _PROBS))
def _kll(spark, sf_dir):
    """Sketches of every return flag's rows, merged: is each quantile's true rank within the stated error?"""
    li = table(spark, sf_dir, "lineitem")
    got = SK.quantiles(SK.merge(SK.sketch(li, _KLL, ["l_returnflag"])), _PROBS).collect()  # a row for each column and share
    rank = [F.struct(F.lit(r["column"]).alias("column"), F.lit(r["prob"]).alias("prob"), F.lit(r["n"]).alias("n"),
                     ((F.count_if(F.col(r["column"]) < r["value"]) / r["n"] <= r["prob"] + SK.rank_error())
                      & (F.count_if(F.col(r["column"]) <= r["value"]) / r["n"] >= r["prob"] - SK.rank_error())).alias("within")) for r in got]
    return li.agg(F.array(*rank).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def targets_sql(tbl, cols):
    name = 'lower("column")'
    miss = 'missing / greatest("rows", 1)'
    return f"""SELECT "column", reason, missing_percent, unique_count, priority_score FROM (
      SELECT "column", position,
        CASE WHEN kind = 'numeric' AND "distinct" > 5 THEN 'numeric_outcome'
             WHEN "distinct" <= 10 OR is_binary THEN 'few_classes'
             ELSE 'many_classes' END AS reason,
        {miss} * 100 AS missing_percent, "distinct" AS unique_count,
        round((1 - {miss}) + least("distinct", 20) / 20.0 +
              CASE WHEN {_like_any(name, Q.LEAKAGE_KEYWORDS)} THEN 0.4 ELSE 0.0 END, 3) AS priority_score
      FROM {stats_sql(tbl, cols)} s
      WHERE NOT (unique_ratio >= 0.9 OR ({_like_any(name, Q.ID_KEYWORDS)} AND unique_ratio >= 0.5))
        AND "distinct" > 1 AND {miss} < 0.4
      ORDER BY priority_score DESC, position)"""


@register("target_suggestions_orders", sql_rounded(targets_sql("orders", ORDERS_COLS),
                                                   ["missing_percent", "priority_score"],
                                                   ["column", "reason", "unique_count"]))
def _targets(spark, sf_dir):
    return rounded(Q.target_suggestions(Q.column_stats(table(spark, sf_dir, "orders"))))


@register("target_suggestions_part_const", sql_rounded(targets_sql(FX.PART_CONST_SQL, PART_CONST_COLS),
                                                       ["missing_percent", "priority_score"],
                                                       ["column", "reason", "unique_count"]))
def _targets_p(spark, sf_dir):
    return rounded(Q.target_suggestions(Q.column_stats(FX.part_const(spark, sf_dir))))


def candidates_sql(tbl, cols):
    lower = 'lower("column")'
    num = "kind = 'numeric'"
    cat = "kind IN ('categorical', 'boolean')"
    terms = [
        (_like_any(lower, Q.TARGET_SIGNALS), 4, "outcome_name"),
        (f"{lower} IN ({', '.join(repr(x) for x in Q.FINAL_NAMES)})", 2, "final_name"),
        ("is_binary", 3, "binary"),
        (f'{num} AND "distinct" >= 5', 2, "numeric_5_or_more"),
        (f'{num} AND "distinct" <= 20', 1, "numeric_20_or_fewer"),
        (f'{cat} AND "distinct" <= 20', 2, "classes_20_or_fewer"),
        (f"{lower} IN ({', '.join(repr(x) for x in Q.IDENTIFIER_NAMES)}) OR suffix({lower}, 'id')", -5,
         "identifier_name"),
    ]
    score = " + ".join(f"(CASE WHEN {c} THEN {w} ELSE 0 END)" for c, w, _ in terms)
    why = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, _, t in terms) + \
        "], lambda x: x IS NOT NULL), '; ')"
    return f"""SELECT "column", score, problem_type, why FROM (
      SELECT "column", position, ({score})::INTEGER AS score,
        CASE WHEN is_binary OR ({cat} AND "distinct" <= 20) THEN 'classification'
             WHEN {num} AND "distinct" <= 20 THEN 'regression or ordinal classification' ELSE 'regression' END
          AS problem_type, {why} AS why
      FROM {stats_sql(tbl, cols)} s) WHERE score > 0 ORDER BY score DESC, position"""


@register("candidate_targets_orders", candidates_sql("orders", ORDERS_COLS))
def _cands(spark, sf_dir):
    return Q.candidate_targets(Q.column_stats(table(spark, sf_dir, "orders")))


@register("candidate_targets_labels", candidates_sql("labels", LABELS_COLS))
def _cands_l(spark, sf_dir):
    return Q.candidate_targets(Q.column_stats(table(spark, sf_dir, "labels")))


@register("candidate_targets_part_const", candidates_sql(FX.PART_CONST_SQL, PART_CONST_COLS))
def _cands_p(spark, sf_dir):
    return Q.candidate_targets(Q.column_stats(FX.part_const(spark, sf_dir)))


def imbalance_sql(tbl, cols):
    return f"""SELECT "column", top_value, round(top_count / present * 100, 1) AS top_percent,
      round(min_count / present * 100, 1) AS minority_percent FROM {stats_sql(tbl, cols)} s
    WHERE (kind IN ('categorical', 'boolean') OR is_binary) AND "distinct" >= 2
      AND (top_count / present * 100 >= 70 OR min_count / present * 100 <= 10)
    ORDER BY top_percent DESC, s."column" """


@register("imbalance_flags_part_const", sql_rounded(imbalance_sql(FX.PART_CONST_SQL, PART_CONST_COLS),
                                                    ["top_percent", "minority_percent"], ["column", "top_value"]))
def _imb(spark, sf_dir):
    return rounded(Q.imbalance_flags(Q.column_stats(FX.part_const(spark, sf_dir))))


@register("imbalance_flags_labels", sql_rounded(imbalance_sql("labels", LABELS_COLS),
                                                ["top_percent", "minority_percent"], ["column", "top_value"]))
def _imb_l(spark, sf_dir):
    return rounded(Q.imbalance_flags(Q.column_stats(table(spark, sf_dir, "labels"))))


@register("high_missing_part_const", sql_rounded(
    f"""SELECT "column", missing * 100.0 / "rows" AS percent, missing AS "count" FROM
        {stats_sql(FX.PART_CONST_SQL, PART_CONST_COLS)} s WHERE "rows" > 0 AND missing * 100.0 / "rows" >= 20
        ORDER BY percent DESC, position""", ["percent"], ["column", "count"]))
def _hm(spark, sf_dir):
    return rounded(Q.high_missing(Q.column_stats(FX.part_const(spark, sf_dir))))


def _outlier_sql(tbl, cols):
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS "column", lf AS lower_fence, uf AS upper_fence, q3 - q1 AS iqr,
          (SELECT count(*) FROM {tbl} WHERE lf IS NOT NULL AND ({q(c)} < lf OR {q(c)} > uf)) AS outlier_count,
          CASE WHEN n = 0 THEN 0.0 ELSE (SELECT count(*) FROM {tbl} WHERE lf IS NOT NULL AND
               ({q(c)} < lf OR {q(c)} > uf)) * 100.0 / n END AS outlier_percent
        FROM (SELECT *, CASE WHEN d > 2 AND q3 - q1 <> 0 THEN q1 - 1.5 * (q3 - q1) END AS lf,
                        CASE WHEN d > 2 AND q3 - q1 <> 0 THEN q3 + 1.5 * (q3 - q1) END AS uf
              FROM (SELECT quantile_cont({q(c)}, 0.25) AS q1, quantile_cont({q(c)}, 0.75) AS q3,
                           count(DISTINCT {q(c)}) AS d, count({q(c)}) AS n FROM {tbl}))""")
    return " UNION ALL ".join(parts)


OUT_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("outlier_report_lineitem", sql_rounded(_outlier_sql("lineitem", OUT_COLS),
                                                 ["lower_fence", "upper_fence", "iqr", "outlier_percent"],
                                                 ["column", "outlier_count"]))
def _outl(spark, sf_dir):
    return rounded(Q.outlier_report(P.numeric_profile(table(spark, sf_dir, "lineitem"), OUT_COLS)))


@register("outlier_report_customer", sql_rounded(_outlier_sql("customer", ["c_acctbal", "c_nationkey"]),
                                                 ["lower_fence", "upper_fence", "iqr", "outlier_percent"],
                                                 ["column", "outlier_count"]))
def _outl_c(spark, sf_dir):
    return rounded(Q.outlier_report(P.numeric_profile(table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"])))


def _z_sql(tbl, cols, fn):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE abs({q(c)} - m) / s > 3) AS zscore_outliers
        FROM {tbl}, (SELECT avg({q(c)}) AS m, {fn}({q(c)}) AS s FROM {tbl})""" for c in cols)


@register("zscore_outliers_lineitem", _z_sql("lineitem", OUT_COLS, "stddev_pop"))
def _z(spark, sf_dir):
    return Q.zscore_outliers(table(spark, sf_dir, "lineitem"), OUT_COLS, ddof=0)


@register("zscore_outliers_sample_events", _z_sql("events", ["value"], "stddev_samp"))
def _z2(spark, sf_dir):
    return Q.zscore_outliers(table(spark, sf_dir, "events"), ["value"], ddof=1)


@register("skew_kurtosis_flags_events", sql_rounded(
    """SELECT 'value' AS "column", round(skewness(value), 3) AS skewness, round(kurtosis(value), 3) AS kurtosis
       FROM events HAVING count(value) >= 8 AND count(DISTINCT value) > 2
         AND (abs(skewness(value)) >= 1 OR abs(kurtosis(value)) >= 3)""", ["skewness", "kurtosis"], ["column"]))
def _skf(spark, sf_dir):
    return rounded(Q.skew_kurtosis_flags(P.numeric_profile(table(spark, sf_dir, "events"), ["value"])))


def _theme_sql(cols):
    names = sorted({c.lower() for c in cols})
    joined = " ".join(names)
    arr = "[" + ", ".join(f"'{n}'" for n in names) + "]"
    expr = (f"CASE WHEN list_contains({arr}, 'school') AND list_contains({arr}, 'sex') AND list_contains({arr}, 'age')"
            f" AND (list_contains({arr}, 'g1') OR list_contains({arr}, 'g2') OR list_contains({arr}, 'g3'))"
            f" THEN '{Q.THEME_STUDENT}'")
    for label, words in Q.THEME_RULES:
        expr += f" WHEN {_like_any(repr(joined), words)} THEN '{label}'"
    return f"SELECT {expr} ELSE '{Q.THEME_DEFAULT}' END AS theme"


for _t, _cols in (("orders", ORDERS_COLS), ("customer", CUSTOMER_COLS), ("labels", LABELS_COLS)):
    def _mk(t):
        return lambda spark, sf_dir: Q.business_theme(table(spark, sf_dir, t))
    register(f"theme_{_t}", _theme_sql([c for c, _ in _cols]))(_mk(_t))


HEALTH_D = ["score", "missing_pct", "duplicate_pct", "constant_pct", "high_cardinality_pct", "outlier_pct"]


def _health_sql(tbl, cols, num_cols):
    st = stats_sql(tbl, cols)
    group = ", ".join(q(c) for c, _ in cols)
    outl = " + ".join(f"""(SELECT count(*) FROM {tbl}, (SELECT quantile_cont({q(c)}, 0.25) AS q1,
        quantile_cont({q(c)}, 0.75) AS q3, count(DISTINCT {q(c)}) AS d FROM {tbl}) f
        WHERE d > 2 AND q3 - q1 <> 0 AND ({q(c)} < q1 - 1.5 * (q3 - q1) OR {q(c)} > q3 + 1.5 * (q3 - q1)))"""
                      for c in num_cols)
    present = " + ".join(f"count({q(c)})" for c in num_cols)
    return f"""SELECT round(greatest(0.0, least(100.0, raw)), 1) AS score,
      CASE WHEN raw >= 90 THEN 'Excellent' WHEN raw >= 75 THEN 'Good' WHEN raw >= 60 THEN 'Needs review'
           ELSE 'High risk' END AS grade, missing_pct, duplicate_pct, constant_pct, high_cardinality_pct, outlier_pct
    FROM (SELECT *, 100 - least(35.0, missing_pct * 1.5) - least(20.0, duplicate_pct * 2) - least(15.0, constant_pct)
                   - least(15.0, high_cardinality_pct * 0.6) - least(15.0, outlier_pct * 1.2) AS raw
      FROM (SELECT
        CASE WHEN nrows = 0 THEN 0.0 ELSE miss * 100.0 / (nrows * {len(cols)}) END AS missing_pct,
        CASE WHEN nrows = 0 THEN 0.0 ELSE dup * 100.0 / nrows END AS duplicate_pct,
        nconst * 100.0 / {len(cols)} AS constant_pct, nhigh * 100.0 / {len(cols)} AS high_cardinality_pct,
        outl * 100.0 / greatest(npresent, 1) AS outlier_pct
        FROM (SELECT sum(missing) AS miss, max("rows") AS nrows, count(*) FILTER (WHERE "distinct" <= 1) AS nconst,
                     count(*) FILTER (WHERE unique_ratio >= 0.5 AND "distinct" > 20) AS nhigh FROM {st} s) a,
             (SELECT coalesce(sum(n - 1), 0) AS dup FROM (SELECT count(*) AS n FROM {tbl} GROUP BY {group})) d,
             (SELECT {outl} AS outl) o, (SELECT {present} AS npresent FROM {tbl}) p))"""


@register("health_score_orders_dup", sql_rounded(_health_sql(FX.ORDERS_DUP_SQL, ORDERS_COLS,
                                                             ["o_orderkey", "o_custkey", "o_totalprice"]),
                                                 HEALTH_D, ["grade"]))
def _health(spark, sf_dir):
    return rounded(Q.health_score(FX.orders_dup(spark, sf_dir)))


@register("health_score_part_const", sql_rounded(_health_sql(FX.PART_CONST_SQL, PART_CONST_COLS,
                                                             ["p_partkey", "p_size", "p_retailprice"]),
                                                 HEALTH_D, ["grade"]))
def _health_p(spark, sf_dir):
    return rounded(Q.health_score(FX.part_const(spark, sf_dir)))


@register("copilot_quality_score_part_const", sql_rounded(f"""
    SELECT greatest(0.0, round(100 - least(35.0, miss * 100.0 / (nrows * 9)) - least(20.0, dup * 100.0 / nrows)
             - least(20.0, nhm * 4.0) - least(15.0, nout * 2.0), 1)) AS quality_score,
           nhm AS n_high_missing, nout AS n_outlier_cols
    FROM (SELECT sum(missing) AS miss, max("rows") AS nrows,
                 count(*) FILTER (WHERE missing * 100.0 / "rows" >= 20) AS nhm
          FROM {stats_sql(FX.PART_CONST_SQL, PART_CONST_COLS)} s) a,
         (SELECT coalesce(sum(n - 1), 0) AS dup FROM (SELECT count(*) AS n FROM {FX.PART_CONST_SQL} x
            GROUP BY {', '.join(c for c, _ in PART_CONST_COLS)})) d,
         (SELECT count(*) FILTER (WHERE k > 0) AS nout FROM ({" UNION ALL ".join(
             f'''SELECT (SELECT count(*) FROM part, (SELECT quantile_cont({c}, 0.25) AS q1,
                 quantile_cont({c}, 0.75) AS q3, count(DISTINCT {c}) AS d FROM part) f WHERE d > 2 AND q3 - q1 <> 0
                 AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))) AS k'''
             for c in ["p_partkey", "p_size", "p_retailprice"])})) o""",
    ["quality_score"], ["n_high_missing", "n_outlier_cols"]))
def _copilot(spark, sf_dir):
    return rounded(Q.copilot_quality_score(FX.part_const(spark, sf_dir)))
