"""Derived dirty tables (the supplied tables have no nulls or duplicates).

Each is a deterministic projection of a whole supplied table, written once
for Spark and once as SQL text for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.catalog import table


def lineitem_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return (li.withColumn("l_quantity", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")))
              .withColumn("l_returnflag", F.when(F.col("l_orderkey") % 11 != 0, F.col("l_returnflag"))))


LINEITEM_NULLS_SQL = """(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS l_quantity, l_extendedprice, l_discount, l_tax,
  CASE WHEN l_orderkey % 11 <> 0 THEN l_returnflag END AS l_returnflag, l_linestatus, l_shipdate FROM lineitem)"""


def orders_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untyped copy of orders: currency text with missing tokens, ISO date text."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 50
    price = (F.when(k == 1, "NA").when(k == 2, "N/A").when(k == 3, "null").when(k == 4, "None").when(k == 5, "")
             .otherwise(F.concat(F.lit("$"), F.format_string("%.2f", F.col("o_totalprice")))))
    return o.select(F.col("o_orderkey").cast("string").alias("o_orderkey"), price.alias("o_totalprice"),
                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
                    F.col("o_orderpriority"), F.col("o_orderstatus"))


ORDERS_TEXT_SQL = """(SELECT o_orderkey::VARCHAR AS o_orderkey,
  CASE o_orderkey % 50 WHEN 1 THEN 'NA' WHEN 2 THEN 'N/A' WHEN 3 THEN 'null' WHEN 4 THEN 'None' WHEN 5 THEN ''
       ELSE '$' || printf('%.2f', o_totalprice) END AS o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority, o_orderstatus FROM orders)"""


def orders_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.unionByName(o.filter(F.col("o_orderkey") % 10 == 0))


ORDERS_DUP_SQL = "(SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 10 = 0)"


def part_const(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return (p.withColumn("p_const", F.lit("same"))
              .withColumn("p_mostly", F.when(F.col("p_partkey") % 40 == 0, "rare").otherwise("common"))
              .withColumn("p_empty", F.lit(None).cast("string")))


PART_CONST_SQL = """(SELECT *, 'same' AS p_const,
  CASE WHEN p_partkey % 40 = 0 THEN 'rare' ELSE 'common' END AS p_mostly, NULL::VARCHAR AS p_empty FROM part)"""


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary label and score derived from labels: score ties on purpose."""
    lab = table(spark, sf_dir, "labels")
    return lab.select("doc_id", F.col("quality").cast("int").alias("actual"),
                      ((F.col("doc_id") * 37 + F.col("toxic") * 11) % 20 / 20.0).alias("score"),
                      F.when(((F.col("doc_id") * 37 + F.col("toxic") * 11) % 20) >= 10, 1).otherwise(0)
                      .cast("int").alias("predicted"))


PREDS_SQL = """(SELECT doc_id, quality::INTEGER AS actual, ((doc_id * 37 + toxic * 11) % 20) / 20.0 AS score,
  CASE WHEN (doc_id * 37 + toxic * 11) % 20 >= 10 THEN 1 ELSE 0 END::INTEGER AS predicted FROM labels)"""
