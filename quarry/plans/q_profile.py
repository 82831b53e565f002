"""Registered profile queries (P1-P25) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import profile as P
from quarry.plans.catalog import register, rounded, sql_rounded, table
from quarry.plans.sqlgen import q

LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
EVENTS_NUM = ["event_id", "user_id", "value"]

PROFILE_DOUBLES = ["mean", "median", "mode", "std", "variance", "min", "max", "range", "q1", "q3", "iqr",
                   "skewness", "kurtosis", "missing_percent", "outlier_percent_iqr", "coefficient_of_variation",
                   "lower_fence", "upper_fence"]
PROFILE_OTHERS = ["column", "count", "missing_count", "outlier_count_iqr", "normality_hint", "distinct_count"]


def _numeric_profile_sql(tbl: str, cols: list[str], skew: str = "adjusted") -> str:
    parts = []
    for c in cols:
        if skew == "adjusted":
            sk = "CASE WHEN n > 2 THEN CASE WHEN variance = 0 THEN 0.0 ELSE skew END END"
            ku = "CASE WHEN n > 3 THEN CASE WHEN variance = 0 THEN 0.0 ELSE kurt END END"
        else:
            sk = "CASE WHEN n > 2 THEN CASE WHEN variance = 0 THEN 0.0 ELSE m3 / pow(s_samp, 3) END END"
            ku = "CASE WHEN n > 3 THEN CASE WHEN variance = 0 THEN 0.0 ELSE m4 / pow(s_samp, 4) - 3 END END"
        parts.append(f"""
SELECT '{c}' AS "column", n AS "count", mean, median, mode, std, variance, mn AS "min", mx AS "max",
       mx - mn AS "range", q1, q3, q3 - q1 AS iqr, {sk} AS skewness, {ku} AS kurtosis,
       miss AS missing_count, CASE WHEN nrows > 0 THEN miss * 100.0 / nrows END AS missing_percent,
       outl AS outlier_count_iqr, CASE WHEN n = 0 THEN 0.0 ELSE outl * 100.0 / n END AS outlier_percent_iqr,
       CASE WHEN mean <> 0 THEN std / abs(mean) END AS coefficient_of_variation,
       CASE WHEN n < 8 THEN '{P.HINT_FEW}'
            WHEN abs({sk}) < 0.5 AND abs({ku}) < 1 THEN '{P.HINT_SYMMETRIC}'
            WHEN abs({sk}) >= 1 THEN '{P.HINT_SKEW}' ELSE '{P.HINT_OTHER}' END AS normality_hint,
       lf AS lower_fence, uf AS upper_fence, d AS distinct_count
FROM (
  SELECT s.*, m.mode,
         CASE WHEN d > 2 AND q3 - q1 <> 0 THEN q1 - 1.5 * (q3 - q1) END AS lf,
         CASE WHEN d > 2 AND q3 - q1 <> 0 THEN q3 + 1.5 * (q3 - q1) END AS uf,
         (SELECT count(*) FROM {tbl} t WHERE d > 2 AND q3 - q1 <> 0 AND
            (t.{q(c)} < q1 - 1.5 * (q3 - q1) OR t.{q(c)} > q3 + 1.5 * (q3 - q1))) AS outl
  FROM (SELECT count(x) AS n, count(*) AS nrows, count(*) - count(x) AS miss, avg(x) AS mean,
               quantile_cont(x, 0.5) AS median, stddev_samp(x) AS std, var_samp(x) AS variance,
               min(x) AS mn, max(x) AS mx, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3,
               skewness(x) AS skew, kurtosis(x) AS kurt, count(DISTINCT x) AS d,
               stddev_samp(x) AS s_samp, avg(pow(x - (SELECT avg({q(c)}) FROM {tbl}), 3)) AS m3,
               avg(pow(x - (SELECT avg({q(c)}) FROM {tbl}), 4)) AS m4
        FROM (SELECT {q(c)}::DOUBLE AS x FROM {tbl})) s,
       (SELECT (SELECT x FROM (SELECT {q(c)}::DOUBLE AS x FROM {tbl}) WHERE x IS NOT NULL
                GROUP BY x ORDER BY count(*) DESC, x ASC LIMIT 1) AS mode) m
)""")
    return " UNION ALL ".join(parts)


def _prof_query(tbl, cols, skew="adjusted"):
    def run(spark, sf_dir):
        df = table(spark, sf_dir, tbl)
        out = P.numeric_profile(df, cols, skew_kind=skew)
        return rounded(out.select(*PROFILE_OTHERS, *PROFILE_DOUBLES))
    return run


register("numeric_profile_lineitem", sql_rounded(_numeric_profile_sql("lineitem", LINEITEM_NUM), PROFILE_DOUBLES,
                                                 PROFILE_OTHERS))(_prof_query("lineitem", LINEITEM_NUM))
register("numeric_profile_events", sql_rounded(_numeric_profile_sql("events", EVENTS_NUM), PROFILE_DOUBLES,
                                               PROFILE_OTHERS))(_prof_query("events", EVENTS_NUM))
register("numeric_profile_sample_moments_orders",
         sql_rounded(_numeric_profile_sql("orders", ["o_totalprice"], skew="sample"), PROFILE_DOUBLES, PROFILE_OTHERS))(
    _prof_query("orders", ["o_totalprice"], skew="sample"))


# ---- P1 on a table with nulls, P8 describe ------------------------------------------------
from quarry.plans import fixtures as FX  # noqa: E402


@register("numeric_profile_with_nulls", sql_rounded(_numeric_profile_sql(FX.LINEITEM_NULLS_SQL, ["l_quantity"]),
                                                    PROFILE_DOUBLES, PROFILE_OTHERS))
def _np_nulls(spark, sf_dir):
    out = P.numeric_profile(FX.lineitem_nulls(spark, sf_dir), ["l_quantity"])
    return rounded(out.select(*PROFILE_OTHERS, *PROFILE_DOUBLES))


def _describe_sql(tbl, cols):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({q(c)}) AS "count", avg({q(c)}) AS mean, stddev_samp({q(c)}) AS std,
        min({q(c)})::DOUBLE AS "min", quantile_cont({q(c)}, 0.25) AS p25, quantile_cont({q(c)}, 0.5) AS p50,
        quantile_cont({q(c)}, 0.75) AS p75, max({q(c)})::DOUBLE AS "max" FROM {tbl}""" for c in cols)


@register("describe_lineitem", sql_rounded(_describe_sql("lineitem", LINEITEM_NUM),
                                           ["mean", "std", "min", "p25", "p50", "p75", "max"], ["column", "count"]))
def _describe(spark, sf_dir):
    return rounded(P.describe(table(spark, sf_dir, "lineitem"), LINEITEM_NUM))


# ---- P9 frequency tables -------------------------------------------------------------------
def _freq_sql(tbl, cols, top=None, percent_of="all"):
    parts = []
    for c in cols:
        denom = "count(*) OVER ()" if percent_of == "all" else f"sum(CASE WHEN {q(c)} IS NOT NULL THEN 1 ELSE 0 END) OVER ()"
        inner = f"""SELECT '{c}' AS "column", v AS value, n AS "count",
            CASE WHEN tot = 0 THEN 0.0 ELSE n * 100.0 / tot END AS percent,
            row_number() OVER (ORDER BY n DESC, v ASC) AS "rank"
          FROM (SELECT coalesce({q(c)}::VARCHAR, '<Missing>') AS v, count(*) AS n,
                       sum(count(*)) OVER () AS tot_all,
                       sum(sum(CASE WHEN {q(c)} IS NOT NULL THEN 1 ELSE 0 END)) OVER () AS tot_present
                FROM {tbl} GROUP BY 1) x, LATERAL (SELECT {'tot_all' if percent_of == 'all' else 'tot_present'} AS tot) y"""
        parts.append(f"SELECT * FROM ({inner}) z" + (f' WHERE "rank" <= {top}' if top else ""))
    del denom
    return " UNION ALL ".join(parts)


@register("frequency_orders", sql_rounded(_freq_sql("orders", ["o_orderpriority", "o_orderstatus"]), ["percent"],
                                          ["column", "value", "count", "rank"]))
def _freq_orders(spark, sf_dir):
    return rounded(P.frequency_table(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"]))


@register("frequency_top8_present_part", sql_rounded(_freq_sql("part", ["p_brand", "p_type"], top=8,
                                                               percent_of="present"),
                                                     ["percent"], ["column", "value", "count", "rank"]))
def _freq_top(spark, sf_dir):
    return rounded(P.frequency_table(table(spark, sf_dir, "part"), ["p_brand", "p_type"], top=8,
                                     percent_of="present"))


@register("frequency_with_missing", sql_rounded(_freq_sql(FX.LINEITEM_NULLS_SQL, ["l_returnflag"]), ["percent"],
                                                ["column", "value", "count", "rank"]))
def _freq_missing(spark, sf_dir):
    return rounded(P.frequency_table(FX.lineitem_nulls(spark, sf_dir), ["l_returnflag"]))


# ---- P10-P14 categorical profile -------------------------------------------------------------
def _cat_sql(tbl, cols):
    parts = []
    for c in cols:
        parts.append(f"""
SELECT '{c}' AS "column", a.u AS unique_count, t.v AS top_value, coalesce(t.n, 0) AS top_count,
  CASE WHEN a.nrows = 0 THEN 0.0 ELSE coalesce(t.n, 0) * 100.0 / a.nrows END AS top_value_percent,
  a.miss AS missing_count, a.miss * 100.0 / a.nrows AS missing_percent, coalesce(e.h, 0.0) AS entropy,
  CASE WHEN a.u > 1 THEN 1 - coalesce(e.h, 0.0) / log2(a.u) ELSE 1.0 END AS concentration_score,
  CASE WHEN a.nrows > 0 AND coalesce(t.n, 0) * 100.0 / a.nrows >= 70 THEN 'High imbalance'
       WHEN a.nrows > 0 AND coalesce(t.n, 0) * 100.0 / a.nrows >= 50 THEN 'Moderate imbalance'
       ELSE 'No major imbalance by top-share rule' END AS imbalance_warning,
  CASE WHEN a.u > least(50.0, greatest(10.0, a.nrows * 0.2)) THEN 'High cardinality' ELSE 'OK' END
    AS cardinality_warning, a.nrows AS "rows"
FROM (SELECT count(DISTINCT {q(c)}) AS u, count(*) AS nrows, count(*) - count({q(c)}) AS miss FROM {tbl}) a
LEFT JOIN (SELECT {q(c)}::VARCHAR AS v, count(*) AS n FROM {tbl} WHERE {q(c)} IS NOT NULL
           GROUP BY 1 ORDER BY n DESC, v ASC LIMIT 1) t ON TRUE
LEFT JOIN (SELECT -sum(p * log2(p + 1e-12)) AS h FROM (SELECT count(*) / sum(count(*)) OVER () AS p
           FROM {tbl} WHERE {q(c)} IS NOT NULL GROUP BY {q(c)})) e ON TRUE""")
    return " UNION ALL ".join(parts)


CAT_DOUBLES = ["top_value_percent", "missing_percent", "entropy", "concentration_score"]
CAT_OTHERS = ["column", "unique_count", "top_value", "top_count", "missing_count", "imbalance_warning",
              "cardinality_warning", "rows"]


@register("categorical_profile_orders", sql_rounded(_cat_sql("orders", ["o_orderpriority", "o_orderstatus"]),
                                                    CAT_DOUBLES, CAT_OTHERS))
def _cat_orders(spark, sf_dir):
    return rounded(P.categorical_profile(table(spark, sf_dir, "orders")).select(*CAT_OTHERS, *CAT_DOUBLES))


@register("categorical_profile_labels_binary", sql_rounded(_cat_sql("labels", ["quality", "toxic"]), CAT_DOUBLES,
                                                           CAT_OTHERS))
def _cat_labels(spark, sf_dir):
    return rounded(P.categorical_profile(table(spark, sf_dir, "labels")).select(*CAT_OTHERS, *CAT_DOUBLES))


@register("categorical_profile_with_missing", sql_rounded(_cat_sql(FX.LINEITEM_NULLS_SQL, ["l_returnflag",
                                                                                         "l_linestatus"]),
                                                          CAT_DOUBLES, CAT_OTHERS))
def _cat_missing(spark, sf_dir):
    df = FX.lineitem_nulls(spark, sf_dir).select("l_returnflag", "l_linestatus", "l_quantity")
    return rounded(P.categorical_profile(df).select(*CAT_OTHERS, *CAT_DOUBLES))


# ---- P15 missing report, P16 overview, P17-P18 summary, P20 samples --------------------------
def _missing_sql(tbl, cols_types):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) - count({q(c)}) AS missing_count,
        CASE WHEN count(*) = 0 THEN 0.0 ELSE (count(*) - count({q(c)})) * 100.0 / count(*) END AS missing_percent
        FROM {tbl}""" for c, t in cols_types)


LI_TYPES = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
            ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
            ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]


@register("missing_report_lineitem_nulls", sql_rounded(_missing_sql(FX.LINEITEM_NULLS_SQL, LI_TYPES),
                                                       ["missing_percent"], ["column", "dtype", "missing_count"]))
def _missing(spark, sf_dir):
    return rounded(P.missing_report(FX.lineitem_nulls(spark, sf_dir)))


ORDERS_TYPES = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]


def _overview_sql(tbl, cols_types):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) - count({q(c)}) AS missing_count,
        count(DISTINCT {q(c)}) AS unique_count,
        CASE WHEN count(*) = 0 THEN 0.0 ELSE count(DISTINCT {q(c)}) * 100.0 / count(*) END AS unique_percent
        FROM {tbl}""" for c, t in cols_types)


@register("column_overview_orders", sql_rounded(_overview_sql("orders", ORDERS_TYPES), ["unique_percent"],
                                                ["column", "dtype", "missing_count", "unique_count"]))
def _overview(spark, sf_dir):
    return rounded(P.column_overview(table(spark, sf_dir, "orders")))


def _summary_sql(tbl, cols, n_numeric):
    miss = " + ".join(f"(count(*) - count({q(c)}))" for c in cols)
    return f"""SELECT a.nrows AS "rows", {len(cols)}::BIGINT AS "columns", a.miss AS missing_cells,
      d.dup AS duplicate_rows, {n_numeric}::BIGINT AS numeric_columns,
      CASE WHEN a.nrows > 0 THEN 100 - a.miss * 100.0 / (a.nrows * {len(cols)}) ELSE 100.0 END AS completeness_percent
    FROM (SELECT count(*) AS nrows, {miss} AS miss FROM {tbl}) a,
         (SELECT coalesce(sum(n - 1), 0)::BIGINT AS dup FROM (SELECT count(*) AS n FROM {tbl} GROUP BY ALL_COLS)) d"""


@register("dataset_summary_orders_dup",
          sql_rounded(_summary_sql(FX.ORDERS_DUP_SQL, [c for c, _ in ORDERS_TYPES], 3).replace(
              "GROUP BY ALL_COLS", "GROUP BY " + ", ".join(c for c, _ in ORDERS_TYPES)),
              ["completeness_percent"], ["rows", "columns", "missing_cells", "duplicate_rows", "numeric_columns"]))
def _summary(spark, sf_dir):
    return rounded(P.dataset_summary(FX.orders_dup(spark, sf_dir)))


@register("dataset_summary_lineitem_nulls",
          sql_rounded(_summary_sql(FX.LINEITEM_NULLS_SQL, [c for c, _ in LI_TYPES], 8).replace(
              "GROUP BY ALL_COLS", "GROUP BY " + ", ".join(c for c, _ in LI_TYPES)),
              ["completeness_percent"], ["rows", "columns", "missing_cells", "duplicate_rows", "numeric_columns"]))
def _summary2(spark, sf_dir):
    return rounded(P.dataset_summary(FX.lineitem_nulls(spark, sf_dir)))


PART_TEXT = ["p_name", "p_brand", "p_type", "p_size", "p_partkey"]


@register("sample_values_part", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", "rank", value FROM (SELECT value, row_number() OVER (ORDER BY value) AS "rank"
        FROM (SELECT DISTINCT {q(c)}::VARCHAR AS value FROM part WHERE {q(c)} IS NOT NULL)) WHERE "rank" <= 5"""
    for c in PART_TEXT))
def _samples(spark, sf_dir):
    return P.sample_values(table(spark, sf_dir, "part").select(*PART_TEXT))


# ---- P22 histogram, P23 group describe, P24 compact ------------------------------------------
def _hist_sql(tbl, c, bins=10):
    return f"""
WITH r AS (SELECT min({q(c)})::DOUBLE AS lo, max({q(c)})::DOUBLE AS hi, count({q(c)}) AS total FROM {tbl}),
g AS (SELECT b.range::INTEGER AS bin, r.* FROM range(0, {bins}) b, r
      WHERE b.range < CASE WHEN r.hi = r.lo THEN 1 ELSE {bins} END),
c AS (SELECT CASE WHEN r.hi = r.lo THEN 0 ELSE least(floor(({q(c)} - r.lo) / ((r.hi - r.lo) / {bins})), {bins - 1})
             END::INTEGER AS bin, count(*) AS n FROM {tbl}, r WHERE {q(c)} IS NOT NULL GROUP BY 1)
SELECT '{c}' AS "column", g.bin, g.lo + g.bin * ((g.hi - g.lo) / CASE WHEN g.hi = g.lo THEN 1 ELSE {bins} END) AS bin_start,
  CASE WHEN g.bin = (CASE WHEN g.hi = g.lo THEN 1 ELSE {bins} END) - 1 THEN g.hi
       ELSE g.lo + (g.bin + 1) * ((g.hi - g.lo) / {bins}) END AS bin_end,
  coalesce(c.n, 0) AS "count", CASE WHEN g.total = 0 THEN 0.0 ELSE coalesce(c.n, 0) * 100.0 / g.total END AS percent
FROM g LEFT JOIN c ON g.bin = c.bin"""


@register("histogram_lineitem_quantity", sql_rounded(_hist_sql("lineitem", "l_quantity"),
                                                     ["bin_start", "bin_end", "percent"], ["column", "bin", "count"]))
def _hist_q(spark, sf_dir):
    return rounded(P.equal_width_histogram(table(spark, sf_dir, "lineitem"), "l_quantity"))


@register("histogram_events_value", sql_rounded(_hist_sql("events", "value"),
                                                ["bin_start", "bin_end", "percent"], ["column", "bin", "count"]))
def _hist_v(spark, sf_dir):
    return rounded(P.equal_width_histogram(table(spark, sf_dir, "events"), "value"))


@register("group_describe_orders", sql_rounded(
    """SELECT o_orderpriority AS "group", count(*) AS "count", avg(o_totalprice) AS mean,
       stddev_samp(o_totalprice) AS std, min(o_totalprice) AS "min", quantile_cont(o_totalprice, 0.25) AS p25,
       quantile_cont(o_totalprice, 0.5) AS p50, quantile_cont(o_totalprice, 0.75) AS p75,
       max(o_totalprice) AS "max" FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1""",
    ["mean", "std", "min", "p25", "p50", "p75", "max"], ["group", "count"]))
def _gdesc(spark, sf_dir):
    return rounded(P.group_describe(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority"))


@register("json_size_estimate_customer")
def _json_size(spark, sf_dir):
    return P.json_size(table(spark, sf_dir, "customer"))
