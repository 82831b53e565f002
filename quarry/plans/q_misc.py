"""Registered window / set / scalar-function queries (W, F, C6, Q3, Q17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as TX
from quarry.operators import model as MD
from quarry.operators import profile as P
from quarry.operators import quality as Q
from quarry.operators import route as R
from quarry.plans import fixtures as FX
from quarry.plans.catalog import register, rounded, sql_rounded, table


@register("top_bottom_orders_price", """SELECT * FROM (SELECT o_orderkey, o_totalprice, 'top' AS side FROM orders
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 10) UNION ALL SELECT * FROM (SELECT o_orderkey, o_totalprice,
    'bottom' AS side FROM orders ORDER BY o_totalprice ASC, o_orderkey LIMIT 10)""")
def _topbottom(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return P.top_bottom(o, "o_totalprice", 10, ["o_orderkey"])


@register("distinct_first_order_lineitem_flag", """SELECT l_returnflag, row_number() OVER (ORDER BY fk, fl)
    AS first_position FROM (SELECT l_returnflag, arg_min(l_orderkey, (l_orderkey, l_linenumber)) AS fk,
    arg_min(l_linenumber, (l_orderkey, l_linenumber)) AS fl FROM lineitem GROUP BY 1)""")
def _first(spark, sf_dir):
    return P.distinct_in_first_order(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_orderkey", "l_linenumber"])


@register("melt_lineitem_measures", sql_rounded("""SELECT variable, count(*) AS n, sum(value) AS total FROM
    (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem)
     ON l_quantity, l_discount, l_tax INTO NAME variable VALUE value) GROUP BY 1""", ["total"], ["variable", "n"]))
def _melt(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    m = P.melt(li, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])
    return rounded(m.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))


@register("drop_duplicates_orders_dup", f"""SELECT count(*) AS "rows" FROM (SELECT DISTINCT * FROM {FX.ORDERS_DUP_SQL})""")
def _dedup(spark, sf_dir):
    return FX.orders_dup(spark, sf_dir).dropDuplicates().agg(F.count(F.lit(1)).alias("rows"))


@register("text_slug_label_part", """SELECT p_partkey,
    CASE WHEN coalesce(regexp_replace(lower(regexp_replace(p_name, '[^0-9A-Za-z]+', '_', 'g')), '^_+|_+$', '', 'g'), '')
         = '' THEN 'chart' ELSE regexp_replace(lower(regexp_replace(p_name, '[^0-9A-Za-z]+', '_', 'g')), '^_+|_+$', '', 'g')
    END AS slug,
    CASE WHEN coalesce(p_name, '') = '' THEN chr(8212) WHEN length(p_name) > 42
         THEN rtrim(substr(p_name, 1, 41)) || chr(8230) ELSE p_name END AS label FROM part""")
def _slug(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", TX.slug(F.col("p_name")).alias("slug"), TX.compact_label(F.col("p_name")).alias("label"))


@register("outlier_summary_top8_events", sql_rounded("""SELECT * FROM (
    SELECT "column", outlier_count, outlier_count * 100.0 / n_all AS outlier_percent FROM (""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", (SELECT count(*) FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1,
        quantile_cont({c}, 0.75) AS q3, count(DISTINCT {c}) AS d FROM lineitem) f WHERE d > 2 AND q3 - q1 <> 0 AND
        ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))) AS outlier_count,
        (SELECT count(*) FROM lineitem) AS n_all""".replace("lineitem", "events") for c in ["value", "user_id", "event_id"])
    + """) WHERE outlier_count > 0 ORDER BY outlier_count DESC, "column" LIMIT 8)""",
    ["outlier_percent"], ["column", "outlier_count"]))
def _out8(spark, sf_dir):
    prof = P.numeric_profile(table(spark, sf_dir, "events"), ["value", "user_id", "event_id"])
    return rounded(Q.outlier_report(prof, top=8, percent_of="all").select("column", "outlier_count",
                                                                          "outlier_percent"))


@register("quality_bundle_part_const")
def _bundle(spark, sf_dir):
    return Q.quality_bundle(FX.part_const(spark, sf_dir))


@register("text_number_formats_orders", """SELECT o_orderkey, format('{:,}', o_custkey * 1000 + o_orderkey) AS grouped,
    printf('%.1f%%', o_totalprice / 7777.7) AS share, strftime(o_orderdate, '%Y-%m-%d %H:%M UTC') AS placed FROM orders""")
def _formats(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", TX.thousands(F.col("o_custkey") * 1000 + F.col("o_orderkey")).alias("grouped"),
                                                 TX.percent(F.col("o_totalprice") / 7777.7).alias("share"), TX.utc_text(F.col("o_orderdate")).alias("placed"))


@register("json_records_events", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
    '{"event_id":' || event_id || ',"user_id":' || user_id || '}' AS record FROM events""")
def _records(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", TX.from_record(F.col("props"), "k long")["k"].alias("k"), TX.to_record("event_id", "user_id").alias("record"))


@register("risky_predictors_orders", """
    SELECT 'o_orderkey' AS feature, 'identifier' AS risk FROM orders HAVING count(DISTINCT o_orderkey) >= 0.5 * count(*)
    UNION ALL SELECT 'o_totalprice', 'identifier' FROM orders HAVING count(DISTINCT o_totalprice) >= 0.9 * count(*)
    UNION ALL SELECT 'o_orderstatus', 'leakage' FROM orders HAVING count(*) > 0 AND contains('o_orderstatus', 'status')""")
def _risky(spark, sf_dir):
    return MD.risky_predictors(table(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice", "o_orderstatus", "o_absent"])


@register("sanitized_code_conversations", """SELECT conv_id, turn, trim(regexp_replace(regexp_replace(
    'import os' || chr(10) || 'x = ' || length(text) || chr(10) || 'plt.show()', '(?m)^\\s*(import\\s+.+|from\\s+.+\\s+import\\s+.+)\\s*$', '', 'g'),
    '(?m)^\\s*plt\\.show\\(\\)\\s*$', '', 'g') || chr(10) || chr(10) || 'plt.tight_layout()', ' ') AS code FROM conversations""")
def _sanitized(spark, sf_dir):
    """Every turn's length put into a code block, taken out again and cleaned."""
    c = table(spark, sf_dir, "conversations")
    block = F.concat(F.lit("```python\nimport os\nx = "), F.length("text").cast("string"), F.lit("\nplt.show()\n```"))
    return c.select("conv_id", "turn", R.sanitize_code(R.extract_code(F.concat_ws("\n", F.lit("see"), block))).alias("code"))
