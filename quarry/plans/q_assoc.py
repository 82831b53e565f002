"""Registered association and hypothesis-test queries."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import functions as F

from quarry.functions import small
from quarry.operators import assoc as A
from quarry.operators import hypothesis as H
from quarry.plans import fixtures as FX
from quarry.plans import sqlgen as S
from quarry.plans.catalog import register, rounded, sql_rounded, table

P = ("p_value",)


def sig_text(p: str) -> str:
    return (f"CASE WHEN {p} IS NULL OR isnan({p}) THEN 'undefined' "
            f"WHEN {p} < 0.05 THEN 'significant' "
            f"ELSE 'not_significant' END")


def _corr_test_sql(src: str, method: str) -> str:
    p = S.t_two_sided_p("(r * sqrt((n - 2) / (1 - r * r)))", "(n - 2)")
    return f"""SELECT x, y, '{method}' AS method, n, CASE WHEN n >= 3 THEN r END AS statistic,
        CASE WHEN n >= 3 THEN (CASE WHEN abs(r) >= 1 THEN 0.0 ELSE {p} END) END AS p_value, n >= 3 AS valid,
        CASE WHEN n >= 3 THEN {sig_text(f"(CASE WHEN abs(r) >= 1 THEN 0.0 ELSE {p} END)")}
             ELSE 'needs_3_pairs' END AS interpretation
      FROM ({src})"""


def _pearson_src(tbl, x, y):
    return f"""SELECT '{x}' AS x, '{y}' AS y, count(*) AS n, corr({x}, {y}) AS r FROM {tbl}
               WHERE {x} IS NOT NULL AND {y} IS NOT NULL"""


def _avg_rank(col, part=""):
    return (f"(rank() OVER ({part} ORDER BY {col}) + (count(*) OVER ({part} PARTITION BY {col}) - 1) / 2.0)"
            if not part else
            f"(rank() OVER (ORDER BY {col}) + (count(*) OVER (PARTITION BY {col}) - 1) / 2.0)")


def _spearman_src(tbl, x, y, ties="average"):
    rx = _avg_rank(x) if ties == "average" else f"rank() OVER (ORDER BY {x})"
    ry = _avg_rank(y) if ties == "average" else f"rank() OVER (ORDER BY {y})"
    return f"""SELECT '{x}' AS x, '{y}' AS y, count(*) AS n, corr(rx, ry) AS r FROM (
        SELECT {rx} AS rx, {ry} AS ry FROM {tbl} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"""


CT_D = ["statistic", "p_value"]
CT_O = ["x", "y", "method", "n", "valid", "interpretation"]

for _name, _tbl, _x, _y in [("pearson_lineitem_discount_tax", "lineitem", "l_discount", "l_tax"),
                            ("pearson_orders_price_custkey", "orders", "o_totalprice", "o_custkey"),
                            ("pearson_lineitem_nulls_quantity_price", FX.LINEITEM_NULLS_SQL, "l_quantity",
                             "l_extendedprice")]:
    def _mk(t, x, y):
        def run(spark, sf_dir):
            df = FX.lineitem_nulls(spark, sf_dir) if t.startswith("(") else table(spark, sf_dir, t)
            return rounded(A.pearson_test(df, x, y), P)
        return run
    register(_name, sql_rounded(_corr_test_sql(_pearson_src(_tbl, _x, _y), "pearson"), CT_D, CT_O, P))(
        _mk(_tbl, _x, _y))

for _name, _tbl, _x, _y, _ties in [("spearman_lineitem_quantity_discount", "lineitem", "l_quantity", "l_discount",
                                    "average"),
                                   ("spearman_events_value_user", "events", "value", "user_id", "average"),
                                   ("spearman_min_rank_lineitem_quantity_tax", "lineitem", "l_quantity", "l_tax",
                                    "min")]:
    def _mk(t, x, y, ties):
        return lambda spark, sf_dir: rounded(A.spearman_test(table(spark, sf_dir, t), x, y, ties), P)
    register(_name, sql_rounded(_corr_test_sql(_spearman_src(_tbl, _x, _y, _ties),
                                               "spearman" if _ties == "average" else "spearman_min_rank"),
                                CT_D, CT_O, P))(_mk(_tbl, _x, _y, _ties))

LI = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _matrix_sql(tbl, cols):
    parts = []
    for a, b in combinations(cols, 2):
        for l, r in ((a, b), (b, a)):
            parts.append(f"""SELECT '{l}' AS "left", '{r}' AS "right", corr({a}, {b}) AS r,
                count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM {tbl}""")
    for c in cols:
        parts.append(f"""SELECT '{c}' AS "left", '{c}' AS "right", 1.0 AS r, count({c}) AS n FROM {tbl}""")
    return " UNION ALL ".join(parts)


@register("corr_matrix_lineitem", sql_rounded(_matrix_sql("lineitem", LI), ["r"], ["left", "right", "n"]))
def _matrix(spark, sf_dir):
    return rounded(A.corr_matrix(table(spark, sf_dir, "lineitem"), LI))


@register("spearman_matrix_lineitem", sql_rounded(" UNION ALL ".join(
    [f"""SELECT '{l}' AS "left", '{r}' AS "right", coalesce(corr(ra, rb), 0.0) AS r, count(*) AS n FROM (
        SELECT {_avg_rank(a)} AS ra, {_avg_rank(b)} AS rb FROM lineitem)"""
     for a, b in combinations(LI, 2) for l, r in ((a, b), (b, a))] +
    [f"""SELECT '{c}' AS "left", '{c}' AS "right", 1.0 AS r, count({c}) AS n FROM lineitem""" for c in LI]),
    ["r"], ["left", "right", "n"]))
def _smatrix(spark, sf_dir):
    return rounded(A.spearman_matrix(table(spark, sf_dir, "lineitem"), LI))


def _pairs_src(tbl, cols):
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS "left", '{b}' AS "right", corr({a}, {b}) AS r,
            count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM {tbl}""" for a, b in
        combinations(cols, 2))


def _ranked_sql(tbl, cols, limit):
    p = S.t_two_sided_p("(r * sqrt((n - 2) / (1 - r * r)))", "(n - 2)")
    return f"""SELECT "left", "right", round(r, 4) AS pearson_r,
        CASE WHEN abs(r) >= 1 THEN 0.0 ELSE {p} END AS p_value, n
      FROM ({_pairs_src(tbl, cols)}) WHERE n >= 3 AND r IS NOT NULL
      ORDER BY abs(round(r, 4)) DESC, "left", "right" LIMIT {limit}"""


@register("ranked_pairs_lineitem", sql_rounded(_ranked_sql("lineitem", LI, 12), ["pearson_r", "p_value"],
                                               ["left", "right", "n"], P))
def _ranked(spark, sf_dir):
    return rounded(A.ranked_pairs(table(spark, sf_dir, "lineitem"), LI, 12), P)


def _findings_sql(tbl, cols):
    p = S.t_two_sided_p("(r * sqrt((n - 2) / (1 - r * r)))", "(n - 2)")
    m = f"""(SELECT *, CASE WHEN abs(r) >= 1 THEN 0.0 ELSE {p} END AS p_value FROM ({_pairs_src(tbl, cols)})
             WHERE n >= 3 AND r IS NOT NULL)"""
    return f"""
    SELECT 'strongest_positive' AS finding, * FROM (SELECT "left", "right", r, p_value, n FROM {m} m
        ORDER BY r DESC, "left" DESC, "right" DESC LIMIT 1)
    UNION ALL SELECT 'strongest_negative', * FROM (SELECT "left", "right", r, p_value, n FROM {m} m
        ORDER BY r ASC, "left" ASC, "right" ASC LIMIT 1)
    UNION ALL SELECT 'strongest_absolute', * FROM (SELECT "left", "right", r, p_value, n FROM {m} m
        ORDER BY abs(r) DESC, "left" DESC, "right" DESC LIMIT 1)
    UNION ALL SELECT 'multicollinear', "left", "right", r, p_value, n FROM {m} m WHERE abs(r) >= 0.7
    UNION ALL SELECT 'significant', * FROM (SELECT "left", "right", r, p_value, n FROM {m} m WHERE p_value < 0.05
        ORDER BY abs(r) DESC, "left", "right" LIMIT 5)"""


@register("relationship_findings_lineitem", sql_rounded(_findings_sql("lineitem", LI), ["r", "p_value"],
                                                        ["finding", "left", "right", "n"], P))
def _findings(spark, sf_dir):
    return rounded(A.relationship_findings(table(spark, sf_dir, "lineitem"), LI), P)


def _grid_sql(tbl, a, b):
    return f"""(WITH c AS (SELECT {a}::VARCHAR AS a_value, {b}::VARCHAR AS b_value, count(*) AS o FROM {tbl}
                  WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
      r AS (SELECT a_value, sum(o) AS rt FROM c GROUP BY 1), k AS (SELECT b_value, sum(o) AS ct FROM c GROUP BY 1),
      t AS (SELECT sum(o) AS n, count(DISTINCT a_value) AS rl, count(DISTINCT b_value) AS kl FROM c)
    SELECT r.a_value, k.b_value, coalesce(c.o, 0) AS observed, r.rt, k.ct, t.n, t.rl, t.kl,
           r.rt * k.ct / t.n AS expected
    FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c ON c.a_value = r.a_value AND c.b_value = k.b_value)"""


@register("crosstab_lineitem_flag_status", sql_rounded(
    f"""SELECT a_value, b_value, observed, observed * 100.0 / rt AS row_percent, expected
        FROM {_grid_sql('lineitem', 'l_returnflag', 'l_linestatus')}""", ["row_percent", "expected"],
    ["a_value", "b_value", "observed"]))
def _ct(spark, sf_dir):
    return rounded(A.crosstab(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus"))


def _chi_sql(tbl, a, b):
    g = _grid_sql(tbl, a, b)
    yates = "CASE WHEN (rl - 1) * (kl - 1) = 1 THEN least(0.5, abs(observed - expected)) ELSE 0.0 END"
    p = S.chi2_sf("chi2", "dof")
    v = "sqrt(chi2 / (n * greatest(least(rl - 1, kl - 1), 1)))"
    return f"""SELECT '{a}' AS first_column, '{b}' AS second_column, valid, n, r_levels, k_levels,
        CASE WHEN valid THEN chi2 END AS chi2, dof, CASE WHEN valid THEN {p} END AS p_value,
        CASE WHEN valid THEN {v} END AS cramers_v,
        CASE WHEN NOT valid THEN 'undefined' WHEN {v} < 0.1 THEN 'negligible'
             WHEN {v} < 0.3 THEN 'weak' WHEN {v} < 0.5 THEN 'moderate' ELSE 'strong' END AS association_strength,
        min_expected, low_expected_cells, sparse_cells,
        CASE WHEN valid THEN {sig_text(p)}
             ELSE 'needs_2_levels' END AS interpretation
      FROM (SELECT n, rl AS r_levels, kl AS k_levels, (rl - 1) * (kl - 1) AS dof, rl >= 2 AND kl >= 2 AS valid,
                   sum(pow(abs(observed - expected) - {yates}, 2) / expected) AS chi2, min(expected) AS min_expected,
                   count(*) FILTER (WHERE expected < 5) AS low_expected_cells,
                   count(*) FILTER (WHERE observed <= 1) AS sparse_cells, rl, kl
            FROM {g} GROUP BY n, rl, kl)"""


CHI_D = ["chi2", "p_value", "cramers_v", "min_expected"]
CHI_O = ["first_column", "second_column", "valid", "n", "r_levels", "k_levels", "dof", "association_strength",
         "low_expected_cells", "sparse_cells", "interpretation"]

for _name, _tbl, _a, _b in [("chi_square_lineitem_flag_status", "lineitem", "l_returnflag", "l_linestatus"),
                            ("chi_square_yates_labels", "labels", "quality", "toxic"),
                            ("chi_square_orders_priority_status", "orders", "o_orderpriority", "o_orderstatus"),
                            ("chi_square_events_type_user", "events", "event_type", "user_id")]:
    def _mk(t, a, b):
        return lambda spark, sf_dir: rounded(A.chi_square(table(spark, sf_dir, t), a, b), P)
    register(_name, sql_rounded(_chi_sql(_tbl, _a, _b), CHI_D, CHI_O, P))(_mk(_tbl, _a, _b))


def _scan_sql(tbl, cats, alpha=None, limit=5):
    parts = []
    for a, b in combinations(cats, 2):
        parts.append(f"""SELECT '{a}' AS first_column, '{b}' AS second_column, cramers_v, p_value,
            min_expected AS min_expected_frequency FROM ({_chi_sql(tbl, a, b)}) WHERE valid""")
    filt = f"WHERE p_value < {alpha}" if alpha else ""
    return f"""SELECT first_column, second_column, cramers_v, p_value, min_expected_frequency,
        'Cramer''s V=' || printf('%.3f', cramers_v) || ' (' ||
        CASE WHEN cramers_v < 0.1 THEN 'negligible' WHEN cramers_v < 0.3 THEN 'weak'
             WHEN cramers_v < 0.5 THEN 'moderate' ELSE 'strong' END || '), p=' || printf('%.3g', p_value) || ')'
        AS recommendation_reason
      FROM ({' UNION ALL '.join(parts)}) {filt}
      ORDER BY cramers_v DESC, p_value ASC, first_column, second_column {f'LIMIT {limit}' if limit else ''}"""


SCAN_D = ["cramers_v", "p_value", "min_expected_frequency"]
SCAN_O = ["first_column", "second_column", "recommendation_reason"]
PART_CATS = ["p_brand", "p_mostly", "p_type"]


@register("pair_scan_part_const", sql_rounded(_scan_sql(FX.PART_CONST_SQL, PART_CATS), SCAN_D, SCAN_O, P))
def _scan(spark, sf_dir):
    df = FX.part_const(spark, sf_dir)
    return rounded(A.pair_scan(df, ["p_name", "p_brand", "p_type", "p_const", "p_mostly", "p_empty"], limit=5), P)


ORDER_CATS = ["o_orderpriority", "o_orderstatus"]


@register("significant_chi_square_scan_orders", sql_rounded(_scan_sql("orders", ORDER_CATS, alpha=0.05, limit=None),
                                                            SCAN_D, SCAN_O, P))
def _sig_scan(spark, sf_dir):
    return rounded(A.pair_scan(table(spark, sf_dir, "orders"), ORDER_CATS, alpha=0.05), P)


@register("vif_two_predictors_lineitem", sql_rounded(
    """SELECT feature, 1 / (1 - r * r) AS "VIF", CASE WHEN 1 / (1 - r * r) >= 10 THEN 'high'
         WHEN 1 / (1 - r * r) >= 5 THEN 'moderate' ELSE 'ok' END AS interpretation
       FROM (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem),
            (VALUES ('l_quantity'), ('l_extendedprice')) v(feature)""", ["VIF"], ["feature", "interpretation"]))
def _vif2(spark, sf_dir):
    return rounded(A.vif_table(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"]))


@register("vif_three_predictors_lineitem", sql_rounded(
    """WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS c FROM lineitem),
       d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM r),
       v AS (SELECT 'l_quantity' AS feature, (1 - c * c) / det AS v FROM d UNION ALL SELECT 'l_extendedprice', (1 - b * b) / det FROM d
             UNION ALL SELECT 'l_discount', (1 - a * a) / det FROM d)
       SELECT feature, v AS "VIF", CASE WHEN v >= 10 THEN 'high' WHEN v >= 5 THEN 'moderate' ELSE 'ok' END AS interpretation FROM v""",
    ["VIF"], ["feature", "interpretation"]))
def _vif3(spark, sf_dir):
    return rounded(A.vif_table(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@register("vif_lineitem")
def _vif(spark, sf_dir):
    return A.vif_table(table(spark, sf_dir, "lineitem"), LI)


# ---- grouped tests ---------------------------------------------------------------------------
TEST_D = ["statistic", "p_value"]
TEST_O = ["test", "n", "valid", "interpretation"]


def _welch_sql(tbl, x, g):
    m = f"""(SELECT row_number() OVER (ORDER BY g) AS i, * FROM (SELECT {g}::VARCHAR AS g, count(*) AS n,
              avg({x}) AS m, var_samp({x}) AS v FROM {tbl} WHERE {x} IS NOT NULL AND {g} IS NOT NULL GROUP BY 1))"""
    se2 = "(a.v / a.n + b.v / b.n)"
    t = f"((a.m - b.m) / sqrt({se2}))"
    dof = f"(pow({se2}, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)))"
    p = S.t_two_sided_p(t, dof)
    return f"""SELECT 't_test' AS test, CASE WHEN k = 2 THEN {t} END AS statistic, CASE WHEN k = 2 THEN {p} END AS p_value,
        n_all AS n, k = 2 AS valid, CASE WHEN k = 2 THEN {sig_text(p)}
        ELSE 'needs_2_groups' END AS interpretation,
        CASE WHEN k = 2 THEN {dof} END AS dof
      FROM (SELECT count(*) AS k, sum(n) AS n_all FROM {m}) c, (SELECT * FROM {m} WHERE i = 1) a,
           (SELECT * FROM {m} WHERE i = 2) b"""


@register("t_test_lineitem_quantity_by_status", sql_rounded(_welch_sql("lineitem", "l_quantity", "l_linestatus"),
                                                            [*TEST_D, "dof"], TEST_O, P))
def _t(spark, sf_dir):
    return rounded(H.welch_t_test(table(spark, sf_dir, "lineitem"), "l_quantity", "l_linestatus"), P)


@register("t_test_labels_toxic_by_quality", sql_rounded(_welch_sql("labels", "toxic", "quality"),
                                                        [*TEST_D, "dof"], TEST_O, P))
def _t2(spark, sf_dir):
    return rounded(H.welch_t_test(table(spark, sf_dir, "labels"), "toxic", "quality"), P)


def _anova_sql(src_rows, test="anova", msg="needs_2_or_more_groups"):
    """``src_rows`` yields (g, x)."""
    f = "((ssb / (k - 1)) / (ssw / (n_all - k)))"
    p = S.f_sf(f, "(k - 1)", "(n_all - k)")
    return f"""SELECT '{test}' AS test, CASE WHEN k >= 2 THEN {f} END AS statistic,
        CASE WHEN k >= 2 THEN {p} END AS p_value, n_all AS n, k >= 2 AS valid,
        CASE WHEN k >= 2 THEN {sig_text(p)} ELSE '{msg}' END AS interpretation
      FROM (SELECT count(*) AS k, sum(n) AS n_all, sum(n * pow(m - grand, 2)) AS ssb,
                   sum(coalesce(v * (n - 1), 0.0)) AS ssw
            FROM (SELECT g, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM ({src_rows}) GROUP BY g),
                 (SELECT avg(x) AS grand FROM ({src_rows})))"""


def _gx(tbl, x, g):
    return f"SELECT {g}::VARCHAR AS g, {x}::DOUBLE AS x FROM {tbl} WHERE {x} IS NOT NULL AND {g} IS NOT NULL"


for _name, _tbl, _x, _g in [("anova_orders_price_by_priority", "orders", "o_totalprice", "o_orderpriority"),
                            ("anova_events_value_by_type", "events", "value", "event_type")]:
    def _mk(t, x, g):
        return lambda spark, sf_dir: rounded(H.anova(table(spark, sf_dir, t), x, g), P)
    register(_name, sql_rounded(_anova_sql(_gx(_tbl, _x, _g)), TEST_D, TEST_O, P))(_mk(_tbl, _x, _g))


def _ranked_rows(tbl, x, g):
    return f"""SELECT g, x, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rk
               FROM ({_gx(tbl, x, g)})"""


def _mwu_sql(tbl, x, g):
    rr = _ranked_rows(tbl, x, g)
    u1 = "(a.rs - a.n * (a.n + 1) / 2.0)"
    u = f"greatest({u1}, a.n * b.n - {u1})"
    sd = "sqrt(a.n * b.n / 12.0 * ((t.nn + 1) - t.tie / (t.nn * (t.nn - 1.0))))"
    z = f"(({u} - a.n * b.n / 2.0 - 0.5) / {sd})"
    p = f"(CASE WHEN {z} <= 0 THEN 1.0 ELSE least(1.0, {S.norm_two_sided_p(z)}) END)"
    grp = f"""(SELECT row_number() OVER (ORDER BY g) AS i, g, count(*) AS n, sum(rk) AS rs FROM ({rr}) GROUP BY g)"""
    return f"""SELECT 'mann_whitney' AS test, CASE WHEN k = 2 THEN {u1} END AS statistic,
        CASE WHEN k = 2 THEN {p} END AS p_value, t.nn::BIGINT AS n, k = 2 AS valid,
        CASE WHEN k = 2 THEN {sig_text(p)} ELSE 'needs_2_groups' END
          AS interpretation
      FROM (SELECT count(*) AS k FROM {grp}) c,
           (SELECT sum(c * c * c - c) AS tie, sum(c) AS nn FROM (SELECT count(*)::DOUBLE AS c FROM ({_gx(tbl, x, g)})
              GROUP BY x)) t,
           (SELECT * FROM {grp} WHERE i = 1) a LEFT JOIN (SELECT * FROM {grp} WHERE i = 2) b ON TRUE"""


@register("mann_whitney_lineitem_quantity_by_status", sql_rounded(_mwu_sql("lineitem", "l_quantity", "l_linestatus"),
                                                                  TEST_D, TEST_O, P))
def _mwu(spark, sf_dir):
    return rounded(H.mann_whitney(table(spark, sf_dir, "lineitem"), "l_quantity", "l_linestatus"), P)


def _kw_sql(tbl, x, g):
    rr = _ranked_rows(tbl, x, g)
    h = "((12.0 / (t.nn * (t.nn + 1)) * s.ssr - 3 * (t.nn + 1)) / (1 - t.tie / (t.nn * t.nn * t.nn - t.nn)))"
    p = S.chi2_sf(h, "(s.k - 1)")
    return f"""SELECT 'kruskal' AS test, CASE WHEN s.k >= 2 THEN {h} END AS statistic,
        CASE WHEN s.k >= 2 THEN {p} END AS p_value, t.nn::BIGINT AS n, s.k >= 2 AS valid,
        CASE WHEN s.k >= 2 THEN {sig_text(p)} ELSE 'needs_2_or_more_groups' END
          AS interpretation
      FROM (SELECT count(*) AS k, sum(rs * rs / n) AS ssr FROM (SELECT g, count(*) AS n, sum(rk) AS rs FROM ({rr})
              GROUP BY g)) s,
           (SELECT sum(c * c * c - c) AS tie, sum(c) AS nn FROM (SELECT count(*)::DOUBLE AS c FROM ({_gx(tbl, x, g)})
              GROUP BY x)) t"""


for _name, _tbl, _x, _g in [("kruskal_events_value_by_type", "events", "value", "event_type"),
                            ("kruskal_lineitem_quantity_by_flag", "lineitem", "l_quantity", "l_returnflag")]:
    def _mk(t, x, g):
        return lambda spark, sf_dir: rounded(H.kruskal(table(spark, sf_dir, t), x, g), P)
    register(_name, sql_rounded(_kw_sql(_tbl, _x, _g), TEST_D, TEST_O, P))(_mk(_tbl, _x, _g))


def _levene_sql(tbl, x, g):
    src = _gx(tbl, x, g)
    dev = f"""SELECT s.g, abs(s.x - m.med) AS x FROM ({src}) s JOIN (SELECT g, median(x) AS med FROM ({src})
              GROUP BY g HAVING count(*) > 1) m ON s.g = m.g"""
    return _anova_sql(dev, "levene", "needs_2_groups_of_2")


@register("levene_orders_price_by_priority", sql_rounded(_levene_sql("orders", "o_totalprice", "o_orderpriority"),
                                                         TEST_D, TEST_O, P))
def _lev(spark, sf_dir):
    return rounded(H.levene(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority"), P)


@register("group_sizes_orders_priority", """SELECT o_orderpriority::VARCHAR AS "group", count(*) AS n,
    count(*) < 5 AS small FROM orders WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1""")
def _gs(spark, sf_dir):
    return H.group_sizes(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority")


def _normal_sql(tbl, x):
    n = "n::DOUBLE"
    b1 = "b1"
    y0 = f"({b1} * sqrt((({n} + 1) * ({n} + 3)) / (6.0 * ({n} - 2))))"
    beta2 = f"(3.0 * ({n} * {n} + 27 * {n} - 70) * ({n} + 1) * ({n} + 3) / (({n} - 2) * ({n} + 5) * ({n} + 7) * ({n} + 9)))"
    w2 = f"(-1 + sqrt(2 * ({beta2} - 1)))"
    delta = f"(1 / sqrt(0.5 * ln({w2})))"
    al = f"sqrt(2 / ({w2} - 1))"
    y = f"(CASE WHEN {y0} = 0 THEN 1.0 ELSE {y0} END)"
    zs = f"({delta} * ln({y} / {al} + sqrt(pow({y} / {al}, 2) + 1)))"
    e = f"(3.0 * ({n} - 1) / ({n} + 1))"
    varb2 = f"(24.0 * {n} * ({n} - 2) * ({n} - 3) / (({n} + 1) * ({n} + 1) * ({n} + 3) * ({n} + 5)))"
    xx = f"((kb - {e}) / sqrt({varb2}))"
    sb1 = (f"(6.0 * ({n} * {n} - 5 * {n} + 2) / (({n} + 7) * ({n} + 9)) * "
           f"sqrt(6.0 * ({n} + 3) * ({n} + 5) / ({n} * ({n} - 2) * ({n} - 3))))")
    a = f"(6.0 + 8.0 / {sb1} * (2.0 / {sb1} + sqrt(1 + 4.0 / ({sb1} * {sb1}))))"
    denom = f"(1 + {xx} * sqrt(2 / ({a} - 4)))"
    term2 = f"(sign({denom}) * pow((1 - 2 / {a}) / abs({denom}), 1.0 / 3))"
    zk = f"(((1 - 2 / (9 * {a})) - {term2}) / sqrt(2 / (9 * {a})))"
    k2 = f"({zs} * {zs} + {zk} * {zk})"
    p = f"exp(-{k2} / 2)"
    return f"""SELECT 'normality' AS test, CASE WHEN n >= 20 THEN {k2} END AS statistic,
        CASE WHEN n >= 20 THEN {p} END AS p_value, n, n >= 20 AS valid,
        CASE WHEN n >= 20 THEN CASE WHEN {p} >= 0.05 THEN 'no_departure' ELSE 'departure' END END AS interpretation,
        CASE WHEN n >= 20 THEN {zs} END AS z_skew, CASE WHEN n >= 20 THEN {zk} END AS z_kurtosis
      FROM (SELECT count({x}) AS n, avg(pow({x} - mu, 3)) / pow(avg(pow({x} - mu, 2)), 1.5) AS b1,
                   avg(pow({x} - mu, 4)) / pow(avg(pow({x} - mu, 2)), 2) AS kb
            FROM {tbl}, (SELECT avg({x}) AS mu FROM {tbl}) WHERE {x} IS NOT NULL)"""


for _name, _tbl, _x in [("normality_events_value", "events", "value"),
                        ("normality_lineitem_quantity", "lineitem", "l_quantity"),
                        ("normality_orders_price", "orders", "o_totalprice")]:
    def _mk(t, x):
        return lambda spark, sf_dir: rounded(H.normality(table(spark, sf_dir, t), x), P)
    register(_name, sql_rounded(_normal_sql(_tbl, _x), [*TEST_D, "z_skew", "z_kurtosis"], TEST_O, P))(_mk(_tbl, _x))


# twelve values: the mean price of the orders of each calendar month
_MONTHS = """(SELECT month(o_orderdate) AS m, avg(o_totalprice) AS x FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1)"""
_W12 = ", ".join(repr(w) for w in small.weights(12))
_LN12 = math.log(12)
_MU12 = sum(c * _LN12 ** i for i, c in enumerate(small.MEAN_MORE))
_SD12 = math.exp(sum(c * _LN12 ** i for i, c in enumerate(small.SPREAD_MORE)))


def _months(spark, sf_dir):
    return (table(spark, sf_dir, "orders").where("o_orderdate is not null").groupBy(F.month("o_orderdate").alias("m")).agg(F.avg("o_totalprice").alias("x")))


@register("normality_small_orders_by_month", sql_rounded(f"""
WITH v AS (SELECT x, row_number() OVER (ORDER BY x) AS i, avg(x) OVER () AS mu FROM {_MONTHS}),
w AS (SELECT pow(sum((x - mu) * ([{_W12}])[i]), 2) / sum((x - mu) * (x - mu)) AS w, count(*) AS n FROM v),
z AS (SELECT w, n, (ln(1 - w) - ({_MU12!r})) / {_SD12!r} AS z FROM w),
p AS (SELECT w, n, CASE WHEN z >= 0 THEN {S.norm_two_sided_p('abs(z)')} / 2 ELSE 1 - {S.norm_two_sided_p('abs(z)')} / 2 END AS p FROM z)
SELECT 'normality' AS test, w AS statistic, p AS p_value, n, true AS valid, CASE WHEN p >= 0.05 THEN 'no_departure' ELSE 'departure' END AS interpretation,
  NULL::DOUBLE AS z_skew, NULL::DOUBLE AS z_kurtosis FROM p WHERE n = 12""", [*TEST_D, "z_skew", "z_kurtosis"], TEST_O, P))
def _norm_small(spark, sf_dir):
    return rounded(H.normality(_months(spark, sf_dir), "x"), P)


@register("mann_whitney_exact_orders_half_years", sql_rounded(f"""
WITH v AS (SELECT m <= 6 AS a, rank() OVER (ORDER BY x) AS r FROM {_MONTHS}),
u AS (SELECT sum(r) FILTER (WHERE a) - 21 AS u, greatest(sum(r) FILTER (WHERE a) - 21, 57 - sum(r) FILTER (WHERE a)) AS hi FROM v),
every AS (SELECT list_sum(list_transform(range(12), lambda j: CASE WHEN (s >> CAST(j AS INTEGER)) & 1 = 1 THEN j + 1 ELSE 0 END)) - 21 AS e
          FROM range(4096) t(s) WHERE bit_count(s) = 6),
p AS (SELECT u.u, least(1.0, 2.0 * (SELECT count(*) FROM every WHERE e >= u.hi) / (SELECT count(*) FROM every)) AS p FROM u)
SELECT 'mann_whitney' AS test, u::DOUBLE AS statistic, p AS p_value, 12::BIGINT AS n, true AS valid, {sig_text('p')} AS interpretation FROM p""",
    TEST_D, TEST_O, P))
def _mwu_exact(spark, sf_dir):
    """The months of the first against those of the second half of the year, by all 924 arrangements."""
    return rounded(H.mann_whitney(_months(spark, sf_dir).withColumn("g", F.when(F.col("m") <= 6, "first").otherwise("second")), "x", "g"), P)


_REPEATED = "(SELECT * FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1 HAVING count(*) > 1))"


@register("kruskal_screened_orders_price_by_customer", sql_rounded(_kw_sql(_REPEATED, "o_totalprice", "o_custkey"), TEST_D, TEST_O, P))
def _kruskal_screened(spark, sf_dir):
    """Customers with a single order are left out."""
    return rounded(H.kruskal(table(spark, sf_dir, "orders"), "o_totalprice", "o_custkey", min_rows=2), P)
