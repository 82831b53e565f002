"""Registered source / sink queries (S1-S13): formats written from the
supplied tables into the shared scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import clean as C
from quarry.operators import profile as P
from quarry.plans import fixtures as FX
from quarry.plans.catalog import register, rounded, sql_rounded, table
from quarry.sources import io as S


@register("source_parquet_pushdown_lineitem", sql_rounded("""SELECT l_returnflag, count(*) AS n,
    sum(l_extendedprice) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_discount > 0.05
    GROUP BY 1""", ["revenue"], ["l_returnflag", "n"]))
def _parquet(spark, sf_dir):
    li = S.read_table(spark, f"{sf_dir}/lineitem.parquet")
    out = (li.filter((F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp")) & (F.col("l_discount") > 0.05))
           .groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("revenue")))
    return rounded(out)


@register("source_csv_roundtrip_orders", sql_rounded("""SELECT o_orderpriority, count(*) AS n,
    sum(o_totalprice) AS total, max(o_orderkey) AS max_key FROM orders GROUP BY 1""", ["total"],
    ["o_orderpriority", "n", "max_key"]))
def _csv(spark, sf_dir):
    path = S.write_csv(table(spark, sf_dir, "orders"), S.scratch_path(spark, "orders-csv"))
    back = S.read_table(spark, path, fmt="csv")
    return rounded(back.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"),
                                                       F.sum("o_totalprice").alias("total"),
                                                       F.max("o_orderkey").cast("long").alias("max_key")))


@register("source_tsv_roundtrip_part", """SELECT p_type, count(*) AS n, sum(p_size)::BIGINT AS sizes
    FROM part GROUP BY 1""")
def _tsv(spark, sf_dir):
    path = S.scratch_path(spark, "part-tsv")
    table(spark, sf_dir, "part").write.option("header", True).option("sep", "\t").csv(path)
    back = S.read_table(spark, path, fmt="tsv")
    return back.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").cast("long").alias("sizes"))


@register("source_json_roundtrip_customer", sql_rounded("""SELECT c_mktsegment, count(*) AS n,
    sum(c_acctbal) AS balance FROM customer GROUP BY 1""", ["balance"], ["c_mktsegment", "n"]))
def _json(spark, sf_dir):
    path = S.write_json(table(spark, sf_dir, "customer"), S.scratch_path(spark, "customer-json"))
    back = S.read_table(spark, path, fmt="json")
    return rounded(back.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"),
                                                    F.sum("c_acctbal").alias("balance")))


@register("source_json_unwrap_nation", """SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1""")
def _json_unwrap(spark, sf_dir):
    path = S.scratch_path(spark, "nation-wrapped")
    nat = table(spark, sf_dir, "nation")
    nat.agg(F.collect_list(F.struct(*nat.columns)).alias("data"), F.lit("v1").alias("version")) \
        .write.json(path)  # one object holding the array of records (a 25-row table)
    back = S.read_table(spark, path, fmt="json")
    return back.groupBy(F.col("n_regionkey").cast("int").alias("n_regionkey")).agg(F.count(F.lit(1)).alias("n"))


@register("source_union_by_name_lineitem_split", """SELECT count(*) AS "rows", count(l_quantity) AS with_quantity,
    count(l_tax) AS with_tax FROM (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
    UNION ALL BY NAME SELECT l_orderkey, l_linenumber, l_tax FROM lineitem)""")
def _union(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    u = S.union_files([li.select("l_orderkey", "l_linenumber", "l_quantity"),
                       li.select("l_orderkey", "l_linenumber", "l_tax")])
    return u.agg(F.count(F.lit(1)).alias("rows"), F.count("l_quantity").alias("with_quantity"),
                  F.count("l_tax").alias("with_tax"))


@register("source_preview_orders", """SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders
    ORDER BY o_orderkey LIMIT 25""")
def _preview(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return S.preview(o, 25, ["o_orderkey"])


@register("sink_cleaned_csv_orders_text", """SELECT count(*) AS "rows", count(o_totalprice) AS priced
    FROM (SELECT CASE WHEN o_totalprice IN ('', 'NA', 'N/A', 'null', 'None') THEN NULL ELSE o_totalprice END
          AS o_totalprice FROM """ + FX.ORDERS_TEXT_SQL + ")")
def _sink_clean(spark, sf_dir):
    res = C.clean(FX.orders_text(spark, sf_dir), drop_duplicates=False, numeric_fill="none", categorical_fill="none")
    path = S.write_csv(res.data, S.scratch_path(spark, "cleaned"))
    back = S.read_table(spark, path, fmt="csv")
    return back.agg(F.count(F.lit(1)).alias("rows"), F.count("o_totalprice").alias("priced"))


@register("sink_combined_summary_lineitem", sql_rounded("""
    SELECT 'numeric' AS "table", 'l_quantity' AS "column", count(l_quantity) AS "count", avg(l_quantity) AS mean,
           NULL::BIGINT AS unique_count, NULL::VARCHAR AS top_value FROM lineitem
    UNION ALL SELECT 'numeric', 'l_discount', count(l_discount), avg(l_discount), NULL, NULL FROM lineitem
    UNION ALL SELECT 'categorical', 'l_returnflag', NULL, NULL, count(DISTINCT l_returnflag),
           (SELECT l_returnflag FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) FROM lineitem
    UNION ALL SELECT 'categorical', 'l_linestatus', NULL, NULL, count(DISTINCT l_linestatus),
           (SELECT l_linestatus FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) FROM lineitem""",
    ["mean"], ["table", "column", "count", "unique_count", "top_value"]))
def _sink_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    comb = S.combined_summary(P.numeric_profile(li, ["l_quantity", "l_discount"]),
                              P.categorical_profile(li.select("l_returnflag", "l_linestatus")))
    path = S.write_csv(comb.select("table", "column", "count", "mean", "unique_count", "top_value"),
                       S.scratch_path(spark, "summary"))
    back = S.read_table(spark, path, fmt="csv")
    return rounded(back.select("table", "column", F.col("count").cast("long").alias("count"), "mean",
                               F.col("unique_count").cast("long").alias("unique_count"), "top_value"))


@register("sink_profile_json_orders", sql_rounded(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) - count({c}) AS missing_count,
        count(DISTINCT {c}) AS unique_count, count(DISTINCT {c}) * 100.0 / count(*) AS unique_percent FROM orders"""
    for c, t in [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                 ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]),
    ["unique_percent"], ["column", "dtype", "missing_count", "unique_count"]))
def _sink_json(spark, sf_dir):
    path = S.write_json(P.column_overview(table(spark, sf_dir, "orders")), S.scratch_path(spark, "profile-json"))
    back = S.read_table(spark, path, fmt="json")
    return rounded(back.select("column", "dtype", "missing_count", "unique_count", "unique_percent"))


@register("source_registry_orders", """SELECT count(*) AS "rows" FROM orders""")
def _registry(spark, sf_dir):
    S.register(table(spark, sf_dir, "orders"), "quarry_orders_registered", persist=False)
    return S.get(spark, "quarry_orders_registered").agg(F.count(F.lit(1)).alias("rows"))
