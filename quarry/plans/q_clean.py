"""Registered cleaning queries (C1-C19) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import clean as C
from quarry.operators import profile as P
from quarry.plans import fixtures as FX
from quarry.plans.catalog import register, rounded, sql_rounded, table

OT = FX.ORDERS_TEXT_SQL
DT_LIST = "[" + ", ".join(f"'{s}'" for _, s in C.DATETIME_FORMATS) + "]"
TOKENS = ", ".join(f"'{t}'" for t in C.MISSING_TOKENS)
BTOKENS = ", ".join(f"'{t}'" for t in C.BROWSER_MISSING_TOKENS)
OT_COLS = ["o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus"]


def _norm(c):
    return f"CASE WHEN {c} IN ({TOKENS}) THEN NULL ELSE {c} END"


def _num(c):
    return (f"CASE WHEN isnan(TRY_CAST(regexp_replace({c}, '[$,% ]', '', 'g') AS DOUBLE)) THEN NULL "
            f"ELSE TRY_CAST(regexp_replace({c}, '[$,% ]', '', 'g') AS DOUBLE) END")


NORM_OT = "(SELECT " + ", ".join(f"{_norm(c)} AS {c}" for c in OT_COLS) + f" FROM {OT})"


@register("clean_datetime_votes_orders_text", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS "rows", count({c}) AS present,
      count(*) FILTER (WHERE regexp_matches({c}, '\\d')) AS with_digit,
      count(*) FILTER (WHERE try_strptime({c}, {DT_LIST}) IS NOT NULL) AS parsed,
      coalesce(count({c}) >= 3 AND count(*) FILTER (WHERE regexp_matches({c}, '\\d')) / count({c}) >= 0.5
        AND count(*) FILTER (WHERE try_strptime({c}, {DT_LIST}) IS NOT NULL) / count({c}) >= 0.75, false)
        AS is_datetime FROM {NORM_OT}""" for c in OT_COLS))
def _dt_votes(spark, sf_dir):
    return C.datetime_votes(C.normalise_missing(FX.orders_text(spark, sf_dir)))


@register("clean_numeric_votes_orders_text", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS "rows", count({_num(c)}) AS parsed,
      coalesce(count({_num(c)}) / count(*) >= 0.9 AND count({_num(c)}) > 0, false) AS is_numeric
      FROM {NORM_OT}""" for c in OT_COLS))
def _num_votes(spark, sf_dir):
    return C.numeric_votes(C.normalise_missing(FX.orders_text(spark, sf_dir)))


@register("clean_typed_orders_text", sql_rounded(
    f"""SELECT {_num('o_orderkey')} AS o_orderkey, {_num('o_totalprice')} AS o_totalprice,
      strftime(try_strptime(o_orderdate, {DT_LIST}), '%Y-%m-%d %H:%M:%S') AS o_orderdate,
      o_orderpriority, o_orderstatus FROM {NORM_OT}""", ["o_orderkey", "o_totalprice"],
    ["o_orderdate", "o_orderpriority", "o_orderstatus"], digits=12))
def _typed(spark, sf_dir):
    res = C.clean(FX.orders_text(spark, sf_dir), drop_duplicates=False, numeric_fill="none",
                  categorical_fill="none")
    d = res.data.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return rounded(d, digits=12)


@register("clean_browser_tokens_orders_text", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE lower(trim({c})) IN ({BTOKENS})) AS nulled FROM {OT}"""
    for c in OT_COLS))
def _browser(spark, sf_dir):
    d = C.normalise_missing(FX.orders_text(spark, sf_dir), mode="browser")
    return d.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in OT_COLS]).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("long").alias("nulled")) for c in OT_COLS])).alias("r")) \
        .select("r.*")


LN = FX.LINEITEM_NULLS_SQL
LN_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
          "l_tax"]


def _fill_sql(numeric_fill):
    agg = {"median": "quantile_cont({c}, 0.5)", "mean": "avg({c})", "zero": "0.0"}[numeric_fill]
    parts = [f"""SELECT '{c}' AS "column", 'numeric' AS role, ({agg.format(c=c)})::DOUBLE AS fill_value,
                  count(*) - count({c}) AS n_filled FROM {LN}""" for c in LN_NUM]
    for c in ["l_returnflag", "l_linestatus"]:
        parts.append(f"""SELECT '{c}' AS "column", 'categorical' AS role,
          coalesce((SELECT {c} FROM {LN} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1),
                   'Missing') AS fill_value, (SELECT count(*) - count({c}) FROM {LN}) AS n_filled""")
    return " UNION ALL ".join(parts)


def _split(f):
    out = f.select("column", "role", F.when(F.col("role") == "numeric", F.col("fill_value").cast("double"))
                   .alias("fill_number"), F.when(F.col("role") == "categorical", F.col("fill_value"))
                   .alias("fill_text"), "n_filled")
    return rounded(out)


def _fill_sql_split(numeric_fill):
    inner = _fill_sql(numeric_fill).replace("::DOUBLE AS fill_value", "::VARCHAR AS fill_value")
    return sql_rounded(f"""SELECT "column", role, CASE WHEN role = 'numeric' THEN fill_value::DOUBLE END AS fill_number,
        CASE WHEN role = 'categorical' THEN fill_value END AS fill_text, n_filled FROM ({inner})""",
                       ["fill_number"], ["column", "role", "fill_text", "n_filled"])


for _mode in ("median", "mean"):
    def _mk(m):
        return lambda spark, sf_dir: _split(C.fill_values(FX.lineitem_nulls(spark, sf_dir), m, "mode"))
    register(f"clean_fill_values_{_mode}_lineitem_nulls", _fill_sql_split(_mode))(_mk(_mode))


IQR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _iqr_keep_sql():
    conds = []
    for c in IQR_COLS:
        f = f"""(SELECT CASE WHEN count(DISTINCT {c}) > 2 AND quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) <> 0
              THEN 1 ELSE 0 END AS ok, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem)"""
        conds.append(f"""(SELECT ok = 0 OR l.{c} IS NULL OR l.{c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)
                          FROM {f})""")
    return f"SELECT l_orderkey, l_linenumber FROM lineitem l WHERE {' AND '.join(conds)}"


@register("clean_iqr_filter_lineitem", _iqr_keep_sql())
def _iqr(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    kept, _ = C.iqr_filter(df.select("l_orderkey", "l_linenumber", *IQR_COLS), IQR_COLS)
    return kept.select("l_orderkey", "l_linenumber")


def _audit_sql():
    nums = ["o_orderkey", "o_custkey", "o_totalprice"]
    dd = f"(SELECT DISTINCT * FROM {FX.ORDERS_DUP_SQL})"
    fences = " UNION ALL ".join(
        f"""SELECT {i} AS pos, '{c}' AS c, quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lf,
            quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS uf
            FROM {dd} d HAVING count(DISTINCT {c}) > 2 AND quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) <> 0"""
        for i, c in enumerate(nums))
    keep = " AND ".join(
        f"(NOT EXISTS (SELECT 1 FROM f WHERE f.c = '{c}') OR d.{c} IS NULL OR d.{c} BETWEEN "
        f"(SELECT lf FROM f WHERE f.c = '{c}') AND (SELECT uf FROM f WHERE f.c = '{c}'))" for c in nums)
    return f"""WITH f AS ({fences}),
      dups AS (SELECT (SELECT count(*) FROM {FX.ORDERS_DUP_SQL}) - (SELECT count(*) FROM {dd}) AS n),
      kept AS (SELECT count(*) AS n FROM {dd} d WHERE {keep})
    SELECT 1 AS step_no, 'convert_datetime' AS step, NULL::VARCHAR AS "column", 0::BIGINT AS n_affected,
           'Converted 0 probable datetime column(s)' AS note
    UNION ALL SELECT 2, 'coerce_numeric', NULL, 0, 'Coerced 0 numeric-looking text column(s)'
    UNION ALL SELECT 3, CASE WHEN n > 0 THEN 'drop_duplicates' ELSE 'detect_duplicates' END, NULL, n,
           CASE WHEN n > 0 THEN 'Dropped ' ELSE 'Detected ' END || n || ' duplicate row(s)' FROM dups
    UNION ALL SELECT 4, 'fill_numeric', NULL, 0, 'numeric fill: median'
    UNION ALL SELECT 5, 'fill_categorical', NULL, 0, 'categorical fill: mode'
    UNION ALL SELECT 6, 'remove_outliers', (SELECT string_agg(c, ',' ORDER BY pos) FROM f),
           (SELECT count(*) FROM {dd}) - kept.n, 'Removed ' || ((SELECT count(*) FROM {dd}) - kept.n) ||
           ' row(s) with IQR outliers' FROM kept"""


@register("clean_audit_orders_dup", _audit_sql())
def _audit(spark, sf_dir):
    return C.clean(FX.orders_dup(spark, sf_dir), remove_outliers=True).audit


@register("filter_effect_lineitem_nulls", sql_rounded(
    f"""SELECT kept, groups, total, CASE WHEN total > 0 THEN kept * 100.0 / total ELSE 0.0 END AS kept_percent,
      kept = 0 AS empty, groups > 20 AS too_many_groups
    FROM (SELECT count(*) AS kept, count(DISTINCT l_linestatus) AS groups FROM {LN}
          WHERE l_quantity BETWEEN 10 AND 20 AND coalesce(l_returnflag, '<Missing>') IN ('A', '<Missing>')) a,
         (SELECT count(*) AS total FROM {LN}) b""", ["kept_percent"],
    ["kept", "groups", "total", "empty", "too_many_groups"]))
def _effect(spark, sf_dir):
    src = FX.lineitem_nulls(spark, sf_dir)
    f = C.level_filter(C.range_filter(src, "l_quantity", 10, 20), "l_returnflag", ["A", P.MISSING_LABEL])
    return rounded(C.filter_effect(f, src, "l_linestatus"))


@register("filter_choices_part_type", """SELECT value, "count", "rank", "rank" <= 10 AS preselected FROM (
    SELECT coalesce(p_type::VARCHAR, '<Missing>') AS value, count(*) AS "count",
           row_number() OVER (ORDER BY count(*) DESC, coalesce(p_type::VARCHAR, '<Missing>')) AS "rank"
    FROM part GROUP BY 1) WHERE "rank" <= 30""")
def _choices(spark, sf_dir):
    return C.filter_choices(table(spark, sf_dir, "part"), "p_type")


@register("listwise_deletion_lineitem_nulls", f"""SELECT count(*) AS "rows" FROM {LN}
    WHERE l_quantity IS NOT NULL AND l_returnflag IS NOT NULL AND l_extendedprice IS NOT NULL""")
def _listwise(spark, sf_dir):
    d = C.listwise(FX.lineitem_nulls(spark, sf_dir), ["l_quantity", "l_returnflag", "l_extendedprice"])
    return d.agg(F.count(F.lit(1)).alias("rows"))


@register("drop_missing_target_lineitem_nulls", f"""SELECT count(*) AS "rows", count(DISTINCT l_orderkey) AS orders
    FROM {LN} WHERE l_quantity IS NOT NULL""")
def _drop_target(spark, sf_dir):
    d = C.drop_missing_target(FX.lineitem_nulls(spark, sf_dir), "l_quantity")
    return d.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("l_orderkey").alias("orders"))


@register("column_search_lineitem", """SELECT "column", dtype FROM (VALUES ('l_extendedprice', 'double'))
    AS t("column", dtype)""")
def _search(spark, sf_dir):
    ov = P.column_overview(table(spark, sf_dir, "lineitem"))
    return C.search_columns(ov, "PRICE").select("column", "dtype")


# typing variants: the browser's votes on untyped text, the API's groups and the chat's picks on typed tables
_BN = "(SELECT " + ", ".join(f"CASE WHEN lower(trim({c})) IN ({BTOKENS}) THEN NULL ELSE {c} END AS {c}" for c in OT_COLS) + f" FROM {OT})"


@register("column_groups_browser_orders_text", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CASE WHEN count({c}) = 0 THEN 'text'
      WHEN count(*) FILTER (WHERE lower({c}) IN ('true', 'false', 'yes', 'no')) >= 0.9 * count({c}) OR count(DISTINCT {c}) = 2 THEN 'binary'
      WHEN count({_num(c)}) >= 0.86 * count({c}) THEN 'numeric'
      WHEN count(*) FILTER (WHERE try_strptime({c}, {DT_LIST}) IS NOT NULL) >= 0.75 * count({c}) THEN 'datetime'
      WHEN count(DISTINCT {c}) <= 0.55 * count({c}) OR count({c}) <= 30 THEN 'categorical' ELSE 'text' END AS role FROM {_BN}""" for c in OT_COLS))
def _groups_browser(spark, sf_dir):
    return C.column_groups(C.normalise_missing(FX.orders_text(spark, sf_dir), "browser"), "browser")


_TYPES = {"lineitem": {**dict.fromkeys(("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), "whole"),
                       **dict.fromkeys(("l_quantity", "l_extendedprice", "l_discount", "l_tax"), "number"),
                       "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "date"}}


@register("column_groups_api_lineitem", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", """ + ("'datetime'" if k == "date" else f"CASE WHEN count(DISTINCT {c}) = 2 THEN 'boolean' ELSE '{'categorical' if k == 'text' else 'numeric'}' END")
    + " AS role FROM lineitem HAVING count(*) > 0" for c, k in _TYPES["lineitem"].items()))
def _groups_api(spark, sf_dir):
    return C.column_groups(table(spark, sf_dir, "lineitem"), "api")


@register("column_groups_chat_lineitem", " UNION ALL ".join(
    [f"""SELECT '{c}' AS "column", '{'datetime' if k == 'date' else 'categorical' if k == 'text' else 'numeric'}' AS role FROM lineitem HAVING count(*) > 0"""
     for c, k in _TYPES["lineitem"].items()]
    + [f"""SELECT '{c}', 'categorical' FROM lineitem HAVING count(DISTINCT {c}) <= 20""" for c, k in _TYPES["lineitem"].items() if k == "whole"]))
def _groups_chat(spark, sf_dir):
    return C.column_groups(table(spark, sf_dir, "lineitem"), "chat")
