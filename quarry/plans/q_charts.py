"""Registered chart-data queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quarry.operators import charts as K
from quarry.plans import fixtures as FX
from quarry.plans.catalog import register, rounded, sql_rounded, table


@register("chart_histogram_by_color_lineitem", sql_rounded("""
WITH r AS (SELECT min(l_quantity)::DOUBLE AS lo, max(l_quantity)::DOUBLE AS hi, count(l_quantity) AS total FROM lineitem),
g AS (SELECT DISTINCT l_linestatus FROM lineitem WHERE l_quantity IS NOT NULL),
bins AS (SELECT b.range::INTEGER AS bin FROM range(0, 10) b, r WHERE b.range < CASE WHEN r.hi = r.lo THEN 1 ELSE 10 END),
c AS (SELECT l_linestatus, CASE WHEN r.hi = r.lo THEN 0 ELSE least(floor((l_quantity - r.lo) / ((r.hi - r.lo) / 10)), 9)
      END::INTEGER AS bin, count(*) AS n FROM lineitem, r WHERE l_quantity IS NOT NULL GROUP BY 1, 2)
SELECT 'l_quantity' AS "column", g.l_linestatus, bins.bin, r.lo + bins.bin * ((r.hi - r.lo) / 10) AS bin_start,
  CASE WHEN bins.bin = 9 THEN r.hi ELSE r.lo + (bins.bin + 1) * ((r.hi - r.lo) / 10) END AS bin_end,
  coalesce(c.n, 0) AS "count", coalesce(c.n, 0) * 100.0 / r.total AS percent
FROM bins CROSS JOIN g CROSS JOIN r LEFT JOIN c ON c.bin = bins.bin AND c.l_linestatus = g.l_linestatus""",
    ["bin_start", "bin_end", "percent"], ["column", "l_linestatus", "bin", "count"]))
def _hist_color(spark, sf_dir):
    return rounded(K.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 10, "l_linestatus"))


@register("chart_kde_events_by_type", sql_rounded(f"""
WITH base AS (SELECT event_type::VARCHAR AS event_type, value::DOUBLE AS x FROM events
              WHERE value IS NOT NULL AND event_type IS NOT NULL),
st AS (SELECT event_type, count(*) AS n, stddev_samp(x) AS sd, min(x) AS lo, max(x) AS hi,
              stddev_samp(x) * pow(count(*)::DOUBLE, -0.2) AS bw FROM base GROUP BY 1 HAVING bw > 0),
fine AS (SELECT b.event_type, least(floor((x - lo) / ((hi - lo) / {K.KDE_BINS})), {K.KDE_BINS - 1}) AS bb,
                count(*) AS c FROM base b JOIN st USING (event_type) GROUP BY 1, 2),
pts AS (SELECT f.event_type, gi.range::INTEGER AS gi, st.lo + gi.range * (st.hi - st.lo) / {K.KDE_GRID - 1} AS gx,
               st.n, st.bw, f.c, st.lo + (f.bb + 0.5) * ((st.hi - st.lo) / {K.KDE_BINS}) AS xc
        FROM fine f JOIN st USING (event_type) CROSS JOIN range(0, {K.KDE_GRID}) gi)
SELECT event_type, gi, gx AS x, sum(c * exp(-pow((gx - xc) / bw, 2) / 2)) / (n * bw * sqrt({2 * math.pi!r}))
  AS density FROM pts GROUP BY event_type, gi, gx, n, bw""", ["x", "density"], ["event_type", "gi"]))
def _kde(spark, sf_dir):
    return rounded(K.kde(table(spark, sf_dir, "events"), "value", "event_type"))


@register("chart_box_orders_price_by_priority", sql_rounded("""
WITH b AS (SELECT o_orderpriority::VARCHAR AS g, o_totalprice::DOUBLE AS v FROM orders WHERE o_totalprice IS NOT NULL),
q AS (SELECT g, quantile_cont(v, 0.25) AS q1, median(v) AS med, quantile_cont(v, 0.75) AS q3, count(*) AS n,
             min(v) AS mn, max(v) AS mx FROM b GROUP BY g),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS uf FROM q)
SELECT 'o_totalprice' AS "column", f.g AS o_orderpriority, f.n AS "count", mn AS "min", q1, med AS median, q3,
  mx AS "max", min(v) FILTER (WHERE v BETWEEN lf AND uf) AS whisker_low,
  max(v) FILTER (WHERE v BETWEEN lf AND uf) AS whisker_high, lf AS lower_fence, uf AS upper_fence,
  count(*) FILTER (WHERE NOT (v BETWEEN lf AND uf)) AS outliers
FROM f JOIN b ON b.g = f.g GROUP BY f.g, f.n, mn, q1, med, q3, mx, lf, uf""",
    ["min", "q1", "median", "q3", "max", "whisker_low", "whisker_high", "lower_fence", "upper_fence"],
    ["column", "o_orderpriority", "count", "outliers"]))
def _box(spark, sf_dir):
    return rounded(K.box_stats(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority"))


@register("chart_regression_lines_lineitem", sql_rounded("""
SELECT l_linestatus::VARCHAR AS l_linestatus, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS slope,
  regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_r2(l_extendedprice, l_quantity) AS r2,
  min(l_quantity)::DOUBLE AS x_start, max(l_quantity)::DOUBLE AS x_end,
  regr_intercept(l_extendedprice, l_quantity) + regr_slope(l_extendedprice, l_quantity) * min(l_quantity) AS y_start,
  regr_intercept(l_extendedprice, l_quantity) + regr_slope(l_extendedprice, l_quantity) * max(l_quantity) AS y_end
FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY 1""",
    ["slope", "intercept", "r2", "x_start", "x_end", "y_start", "y_end"], ["l_linestatus", "n"]))
def _reg(spark, sf_dir):
    return rounded(K.regression_lines(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice",
                                      "l_linestatus"))


_BAR_SQL = {
    "mean": "avg(o_totalprice)", "sum": "sum(o_totalprice)", "count": "count(o_totalprice)::DOUBLE",
    "median": "median(o_totalprice)",
}
for _agg, _fn in _BAR_SQL.items():
    def _mk(a):
        return lambda spark, sf_dir: rounded(K.bar(table(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice", a,
                                                   "o_orderpriority"))
    register(f"chart_bar_{_agg}_orders", sql_rounded(
        f"""SELECT o_orderstatus::VARCHAR AS o_orderstatus, o_orderpriority::VARCHAR AS o_orderpriority,
            {_fn} AS value FROM orders {'WHERE o_totalprice IS NOT NULL' if _agg == 'median' else ''} GROUP BY 1, 2""",
        ["value"], ["o_orderstatus", "o_orderpriority"]))(_mk(_agg))


@register("chart_bar_mean_null_groups", sql_rounded(
    f"""SELECT l_returnflag::VARCHAR AS l_returnflag, avg(l_quantity) AS value FROM {FX.LINEITEM_NULLS_SQL} GROUP BY 1""",
    ["value"], ["l_returnflag"]))
def _bar_nulls(spark, sf_dir):
    return rounded(K.bar(FX.lineitem_nulls(spark, sf_dir), "l_returnflag", "l_quantity", "mean"))


@register("chart_count_stacked_lineitem", """SELECT l_returnflag::VARCHAR AS l_returnflag,
    l_linestatus::VARCHAR AS l_linestatus, count(*) AS "count" FROM lineitem GROUP BY 1, 2""")
def _count(spark, sf_dir):
    return K.count_plot(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@register("chart_pie_part_type", sql_rounded("""SELECT coalesce(p_type::VARCHAR, '<Missing>') AS value, count(*) AS "count",
    count(*) * 100.0 / sum(count(*)) OVER () AS percent,
    row_number() OVER (ORDER BY count(*) DESC, coalesce(p_type::VARCHAR, '<Missing>')) AS "rank"
    FROM part GROUP BY 1""", ["percent"], ["value", "count", "rank"]))
def _pie(spark, sf_dir):
    return rounded(K.pie(table(spark, sf_dir, "part"), "p_type"))


@register("chart_category_mix_top15_part_brand", sql_rounded("""SELECT * FROM (
    SELECT coalesce(p_brand::VARCHAR, '<Missing>') AS value, count(*) AS "count",
    count(*) * 100.0 / sum(count(*)) OVER () AS percent,
    row_number() OVER (ORDER BY count(*) DESC, coalesce(p_brand::VARCHAR, '<Missing>')) AS "rank"
    FROM part GROUP BY 1) WHERE "rank" <= 15""", ["percent"], ["value", "count", "rank"]))
def _mix(spark, sf_dir):
    return rounded(K.pie(table(spark, sf_dir, "part"), "p_brand", top=15))


@register("chart_over_time_events_month", sql_rounded("""SELECT strftime(date_trunc('month', ts), '%Y-%m-%d %H:%M:%S')
    AS period, count(*) AS "count", avg(value) AS mean FROM events WHERE ts IS NOT NULL GROUP BY 1""",
    ["mean"], ["period", "count"]))
def _time(spark, sf_dir):
    out = K.over_time(table(spark, sf_dir, "events"), "ts", "month", "value")
    return rounded(out.withColumn("period", F.date_format("period", "yyyy-MM-dd HH:mm:ss")))


@register("chart_over_time_orders_year", """SELECT strftime(date_trunc('year', o_orderdate), '%Y-%m-%d %H:%M:%S')
    AS period, count(*) AS "count" FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1""")
def _time_y(spark, sf_dir):
    out = K.over_time(table(spark, sf_dir, "orders"), "o_orderdate", "year")
    return out.withColumn("period", F.date_format("period", "yyyy-MM-dd HH:mm:ss"))


@register("chart_missing_bar_lineitem_nulls", sql_rounded(f"""SELECT * FROM ({" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) - count({c}) AS missing_count, "
    f"(count(*) - count({c})) * 100.0 / count(*) AS missing_percent FROM {FX.LINEITEM_NULLS_SQL}"
    for c, t in [("l_quantity", "double"), ("l_returnflag", "string"), ("l_orderkey", "bigint")])})
    WHERE missing_count > 0""", ["missing_percent"], ["column", "dtype", "missing_count"]))
def _mbar(spark, sf_dir):
    return rounded(K.missing_bar(FX.lineitem_nulls(spark, sf_dir).select("l_quantity", "l_returnflag", "l_orderkey")))


_LI = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
       "l_returnflag", "l_linestatus", "l_shipdate"]


def _sample_sql(tbl: str, named: list[str], cols: list[str], n: int, where: str = "true") -> str:
    """The n least hashes of (row name, occurrence number, seed)."""
    name = "md5(concat_ws('|', " + ", ".join(f"coalesce({c}::VARCHAR, '\\N')" for c in named) + "))"
    listed = ", ".join(cols)
    return f"""SELECT {listed}, md5(concat_ws(':', m, i::VARCHAR, '{K.SEED}')) AS h FROM (
        SELECT {listed}, m, row_number() OVER (PARTITION BY m, {listed}) - 1 AS i
        FROM (SELECT {listed}, {name} AS m FROM {tbl} WHERE {where})) ORDER BY h, {listed} LIMIT {n}"""


_LI_KEY = ["l_orderkey", "l_linenumber"]
_XYC = ["l_quantity", "l_extendedprice", "l_linestatus"]


@register("chart_scatter_sample_lineitem", f"SELECT {', '.join(_XYC)} FROM ({_sample_sql('lineitem', _LI, _XYC, K.CHART_ROWS)})")
def _scatter(spark, sf_dir):
    """Rows named by all their columns."""
    return K.scatter(table(spark, sf_dir, "lineitem"), *_XYC)


@register("chart_scatter_copies_orders_dup", f"""SELECT o_totalprice, o_orderstatus, count(*) AS copies FROM (
    {_sample_sql(FX.ORDERS_DUP_SQL, ["o_orderkey"], ["o_totalprice", "o_orderstatus"], K.CHART_ROWS)}) GROUP BY ALL""")
def _scatter_dup(spark, sf_dir):
    """Repeated rows are drawn one by one."""
    pts = K.hash_sample(FX.orders_dup(spark, sf_dir), key=["o_orderkey"], columns=["o_totalprice", "o_orderstatus"])
    return pts.groupBy("o_totalprice", "o_orderstatus").agg(F.count("*").alias("copies"))


@register("chart_line_sample_events", f"""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, value FROM (
    {_sample_sql('events', ['event_id'], ['ts', 'value'], K.CHART_ROWS, 'ts IS NOT NULL AND value IS NOT NULL')})""")
def _line(spark, sf_dir):
    out = K.line(table(spark, sf_dir, "events"), "ts", "value", key=["event_id"])
    return out.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@register("chart_scatter_matrix_lineitem", f"SELECT {', '.join(_LI[:8])} FROM ({_sample_sql('lineitem', _LI_KEY, _LI[:8], K.CHART_ROWS)})")
def _smatrix(spark, sf_dir):
    return K.scatter_matrix(table(spark, sf_dir, "lineitem"), key=_LI_KEY)


_XYZ = ["l_quantity", "l_extendedprice", "l_discount"]


@register("chart_scatter_3d_lineitem", f"SELECT {', '.join(_XYZ)} FROM ({_sample_sql('lineitem', _LI, _XYZ, K.CHART_ROWS)})")
def _s3d(spark, sf_dir):
    return K.scatter_3d(table(spark, sf_dir, "lineitem"), *_XYZ)


_FLAGS = ", ".join(f"({c} IS NULL)::INTEGER AS {c}" for c in _LI)
_KEY_NAME = "md5(concat_ws('|', l_orderkey::VARCHAR, l_linenumber::VARCHAR))"


@register("chart_missing_heatmap_lineitem_nulls", " UNION ALL ".join(
    f"SELECT h AS row, '{c}' AS \"column\", {c} AS missing FROM s" for c in _LI).join(
    [f"WITH f AS (SELECT {_KEY_NAME} AS name, {_FLAGS} FROM {FX.LINEITEM_NULLS_SQL}), s AS ({_sample_sql('f', ['name'], _LI, K.HEATMAP_ROWS)}) ", ""]))
def _mheat(spark, sf_dir):
    return K.missing_heatmap(FX.lineitem_nulls(spark, sf_dir), key=_LI_KEY)


_BOX_EVENTS = """
WITH b AS (SELECT event_type::VARCHAR AS g, value::DOUBLE AS v FROM events WHERE value IS NOT NULL),
f AS (SELECT g, quantile_cont(v, 0.25) - 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) AS lf,
             quantile_cont(v, 0.75) + 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) AS uf,
             min(v) AS mn, quantile_cont(v, 0.25) AS q1, median(v) AS med, quantile_cont(v, 0.75) AS q3, max(v) AS mx
      FROM b GROUP BY g)"""


@register("chart_violin_events_by_type", sql_rounded(f"""{_BOX_EVENTS},
base AS (SELECT event_type::VARCHAR AS event_type, value::DOUBLE AS x FROM events WHERE value IS NOT NULL),
st AS (SELECT event_type, count(*) AS n, min(x) AS lo, max(x) AS hi,
              stddev_samp(x) * pow(count(*)::DOUBLE, -0.2) AS bw FROM base GROUP BY 1 HAVING bw > 0),
fine AS (SELECT b.event_type, least(floor((x - lo) / ((hi - lo) / {K.KDE_BINS})), {K.KDE_BINS - 1}) AS bb,
                count(*) AS c FROM base b JOIN st USING (event_type) GROUP BY 1, 2),
pts AS (SELECT f.event_type, gi.range AS gi, st.lo + gi.range * (st.hi - st.lo) / {K.KDE_GRID - 1} AS gx,
               st.n, st.bw, f.c, st.lo + (f.bb + 0.5) * ((st.hi - st.lo) / {K.KDE_BINS}) AS xc
        FROM fine f JOIN st USING (event_type) CROSS JOIN range(0, {K.KDE_GRID}) gi)
SELECT event_type, 'density' AS part, gx AS x, sum(c * exp(-pow((gx - xc) / bw, 2) / 2)) / (n * bw * sqrt({2 * math.pi!r}))
  AS y FROM pts GROUP BY event_type, gi, gx, n, bw
UNION ALL SELECT g, 'min', mn, NULL FROM f UNION ALL SELECT g, 'q1', q1, NULL FROM f
UNION ALL SELECT g, 'median', med, NULL FROM f UNION ALL SELECT g, 'q3', q3, NULL FROM f
UNION ALL SELECT g, 'max', mx, NULL FROM f""", ["x", "y"], ["event_type", "part"]))
def _violin(spark, sf_dir):
    return rounded(K.violin(table(spark, sf_dir, "events"), "value", "event_type"))


@register("chart_box_outlier_points_events", sql_rounded(f"""{_BOX_EVENTS}
SELECT b.g AS event_type, b.v AS value FROM b JOIN f ON b.g = f.g WHERE b.v < f.lf OR b.v > f.uf""",
    ["value"], ["event_type"]))
def _boxpts(spark, sf_dir):
    return rounded(K.box_outlier_points(table(spark, sf_dir, "events"), "value", "event_type"))
