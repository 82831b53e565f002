"""Cleaning (C1-C19) with an audit trail.

The pipeline order C1 -> C3 -> C4 -> C6 -> C7 -> C8 -> C9 is part of the
semantics.  Decisions that change the schema (which text column becomes a
timestamp or a number) come from one aggregate over all candidate columns;
their result has one row per column and is read on the driver.  The data
itself is only ever transformed by column expressions, ``dropDuplicates``
and a filter, so the plan stays a single scan plus the shuffles those need.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import profile as P
from quarry.operators.roles import distinct_counts, floating_columns, kind_of, missing_expr, numeric_columns

# Missing-value tokens (exact, case-sensitive) and the browser's
# trimmed, case-insensitive set.
MISSING_TOKENS = ["", "NA", "N/A", "null", "None"]
BROWSER_MISSING_TOKENS = ["", "na", "n/a", "null", "none", "undefined", "nan"]
# Supported datetime text formats, tried in order (Spark pattern, SQL strptime pattern).
DATETIME_FORMATS = [
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
    ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"),
    ("yyyy-MM-dd", "%Y-%m-%d"),
    ("yyyy/MM/dd", "%Y/%m/%d"),
    ("MM/dd/yyyy", "%m/%d/%Y"),
    ("dd.MM.yyyy", "%d.%m.%Y"),
]
NUMERIC_STRIP = "[$,% ]"
NUMBER_SHAPE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INF_TOKENS = ["inf", "+inf", "-inf", "infinity", "+infinity", "-infinity"]


def trim_column_names(df: DataFrame) -> DataFrame:
    """C5 (S5): strip surrounding spaces from column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def normalise_missing(df: DataFrame, mode: str = "app") -> DataFrame:
    """Missing tokens -> null on text columns (``mode='browser'``: trimmed,
    case-insensitive, wider token set)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            hit = c.isin(MISSING_TOKENS) if mode != "browser" else F.lower(F.trim(c)).isin(BROWSER_MISSING_TOKENS)
            out.append(F.when(hit, F.lit(None).cast("string")).otherwise(c).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


DATE_SHAPE = r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}"


def parse_datetime(c: Column) -> Column:
    """First format that parses, else null.  Only date-shaped text is
    handed to the parser (failed parses are expensive)."""
    return F.when(c.rlike(DATE_SHAPE), F.coalesce(*[F.try_to_timestamp(c, F.lit(fmt)) for fmt, _ in DATETIME_FORMATS]))


def parse_number(c: Column) -> Column:
    """C4/C14: strip ``$ , %`` and spaces, then a tolerant cast; NaN text -> null."""
    t = F.regexp_replace(c, NUMERIC_STRIP, "")
    # only number-shaped text reaches the cast (failed casts are expensive)
    shaped = t.rlike(NUMBER_SHAPE) | F.lower(t).isin(*INF_TOKENS)
    v = F.when(shaped, t.try_cast("double"))
    return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)


def datetime_votes(df: DataFrame, columns: list[str] | None = None, mode: str = "app") -> DataFrame:
    """One aggregate over all text columns -> per column present count,
    digit share, parse share and the verdict (``app``: >= 3 present, >= 50 %
    contain a digit, >= 75 % of present parse; ``api``: > 75 % of all rows)."""
    cols = columns if columns is not None else string_columns(df)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        x = F.col(c)
        aggs += [F.count(x).alias(f"n{i}"), F.count_if(x.rlike(r"\d")).alias(f"d{i}"),
                 F.count_if(parse_datetime(x).isNotNull()).alias(f"p{i}")]
    one = df.agg(*aggs)
    rows = one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col("_rows").alias("rows"), F.col(f"n{i}").alias("present"),
                 F.col(f"d{i}").alias("with_digit"), F.col(f"p{i}").alias("parsed"))
        for i, c in enumerate(cols)])).alias("r")).select("r.*")
    share = F.try_divide("parsed", "present")
    if mode == "app":
        verdict = (F.col("present") >= 3) & (F.col("with_digit") / F.col("present") >= 0.5) & (share >= 0.75)
    elif mode == "browser":
        verdict = share >= 0.75
    elif mode == "chat":
        verdict = (F.col("present") >= 10) & (share >= 0.7)
    else:
        verdict = F.col("parsed") / F.greatest(F.col("rows"), F.lit(1)) > 0.75
    return rows.withColumn("is_datetime", F.coalesce(verdict, F.lit(False)))


def numeric_votes(df: DataFrame, columns: list[str] | None = None, mode: str = "app") -> DataFrame:
    """C4 vote: share of all rows (``app`` >= 90 %, ``api`` > 85 %; ``browser``: >= 86 % of the present ones) that parse
    as numbers after stripping currency/percent/thousands characters."""
    cols = columns if columns is not None else string_columns(df)
    one = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count(parse_number(F.col(c))).alias(f"p{i}") for i, c in enumerate(cols)],
                 *[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(cols)])
    rows = one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col("_rows").alias("rows"), F.col(f"p{i}").alias("parsed"), F.col(f"n{i}").alias("_present"))
        for i, c in enumerate(cols)])).alias("r")).select("r.*")
    share = F.try_divide(F.col("parsed"), F.col("_present" if mode == "browser" else "rows"))
    verdict = {"app": share >= 0.9, "api": share > 0.85, "browser": share >= 0.86}[mode]
    return rows.withColumn("is_numeric", F.coalesce(verdict & (F.col("parsed") > 0), F.lit(False))).drop("_present")


YES_NO = ["true", "false", "yes", "no"]


def column_groups(df: DataFrame, mode: str) -> DataFrame:
    """C11 variants: (column, role).

    * ``api``: datetime; boolean (booleans and other columns of two values); numeric; the rest categorical.
    * ``browser``: votes over the present values, in this order: binary (90 % yes/no words, or two values), numeric (86 %),
      datetime (75 %), categorical (distinct share up to 55 %, or at most 30 present), text.
    * ``chat``: numeric; datetime by type or, if no column has it, by a vote of text columns; categorical (text, booleans and
      integers of at most 20 values).  A column can have two roles here.
    """
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields if kind_of(f.dataType) != "skipped"}
    distinct = {c: n for c, n in distinct_counts(df, list(kinds)).first().asDict().items() if c in kinds}
    spark, kind = df.sparkSession, "column string, role string"
    text = [c for c in string_columns(df) if c in kinds]
    if mode == "api":
        def role(c: str) -> str:
            if kinds[c] == "datetime":
                return "datetime"
            return "boolean" if kinds[c] == "boolean" or distinct[c] == 2 else "numeric" if kinds[c] == "numeric" else "categorical"
        return spark.createDataFrame([(c, role(c)) for c in kinds], kind)
    dates = {r["column"] for r in datetime_votes(df, text, mode).where("is_datetime").collect()} if text else set()  # a row for each column
    if mode == "chat":
        whole = {f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)}
        typed = [c for c, k in kinds.items() if k == "datetime"]
        dates = set(typed) or dates
        rows = [(c, "numeric") for c, k in kinds.items() if k == "numeric"] + [(c, "datetime") for c in kinds if c in dates]
        rows += [(c, "categorical") for c, k in kinds.items() if c not in dates and (k in ("categorical", "boolean") or (c in whole and distinct[c] <= 20))]
        return spark.createDataFrame(rows, kind)
    numbers = {r["column"] for r in numeric_votes(df, text, "browser").where("is_numeric").collect()} if text else set()
    one = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(kinds)], *[
        (F.count_if(F.lower(F.col(c)).isin(YES_NO)) if c in text else F.lit(0)).alias(f"y{i}") for i, c in enumerate(kinds)]).first()

    def voted(i: int, c: str) -> str:
        present = one[f"n{i}"]
        if not present:
            return "text"
        if kinds[c] == "boolean" or one[f"y{i}"] >= 0.9 * present or distinct[c] == 2:
            return "binary"
        if kinds[c] == "numeric" or c in numbers:
            return "numeric"
        if kinds[c] == "datetime" or c in dates:
            return "datetime"
        return "categorical" if distinct[c] <= 0.55 * present or present <= 30 else "text"
    return spark.createDataFrame([(c, voted(i, c)) for i, c in enumerate(kinds)], kind)


@dataclass
class CleanResult:
    data: DataFrame
    audit: DataFrame


def fill_values(df: DataFrame, numeric_fill: str = "median", categorical_fill: str = "mode") -> DataFrame:
    """The fill value per column as text, with the number of cells it fills.
    Numeric: mean / median / zero; categorical: mode (ties -> smallest,
    all-missing -> ``Missing``) or the literal ``Missing``."""
    spark = df.sparkSession
    nums = numeric_columns(df)
    cats = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    parts = []
    if nums and numeric_fill != "none":
        if numeric_fill == "mean":
            vals = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in nums])
        elif numeric_fill == "median":
            vals = P.quantile_table(df, nums, [0.5], ["v"]).groupBy().pivot("column", nums).agg(F.first("v"))
        else:
            vals = spark.range(1).select(*[F.lit(0.0).alias(c) for c in nums])
        miss = df.agg(*[F.count_if(missing_expr(df, c)).alias(c) for c in nums])
        parts.append(vals.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit("numeric").alias("role"),
                                                              F.col(c).cast("double").cast("string").alias("fill_value"))
                                                     for c in nums])).alias("r")).select("r.*")
                     .join(miss.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"),
                                                                    F.col(c).cast("long").alias("n_filled"))
                                                           for c in nums])).alias("m")).select("m.*"), "column"))
    if cats and categorical_fill != "none":
        miss = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cats]).select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("long").alias("n_filled")) for c in cats])).alias("m")) \
            .select("m.*")
        if categorical_fill == "mode":
            hist = P.value_hist(df, cats).filter(F.col("value").isNotNull())
            modes = hist.groupBy("column").agg(
                F.min(F.struct((-F.col("n")).alias("negn"), F.col("value").alias("v")))["v"].alias("fill_value"))
            cat_part = miss.join(modes, "column", "left").withColumn("fill_value",
                                                                    F.coalesce("fill_value", F.lit("Missing")))
        else:
            cat_part = miss.withColumn("fill_value", F.lit("Missing"))
        parts.append(cat_part.select("column", F.lit("categorical").alias("role"), "fill_value", "n_filled"))
    if not parts:
        return spark.createDataFrame([], "column string, role string, fill_value string, n_filled long")
    return reduce(DataFrame.unionByName, parts)


def iqr_fences(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Q1: fences per numeric column; null when <= 2 distinct values or IQR 0/null."""
    prof = P.numeric_profile(df, columns)
    return prof.select("column", "lower_fence", "upper_fence", F.when(F.col("lower_fence").isNotNull(),
                                                                     F.col("iqr")).alias("iqr"))


def iqr_filter(df: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, list]:
    """Drop a row when any numeric value lies outside its column's fences
    (fences from the same pre-filter table; nulls and NaN pass).  Fences are one row
    per column, applied as literals."""
    pos = {c: i for i, c in enumerate(df.columns)}
    fences = sorted((r for r in iqr_fences(df, columns).collect() if r["lower_fence"] is not None),
                    key=lambda r: pos[r["column"]])  # schema order, for a deterministic audit
    if not fences:
        return df, []
    keep = reduce(lambda a, b: a & b, [F.col(r["column"]).cast("double").between(r["lower_fence"], r["upper_fence"]) |
                                       missing_expr(df, r["column"]) for r in fences])
    return df.filter(keep), fences


def clean(df: DataFrame, drop_duplicates: bool = True, numeric_fill: str = "median",
          categorical_fill: str = "mode", convert_datetimes: bool = True, remove_outliers: bool = False,
          mode: str = "app") -> CleanResult:
    """The whole pipeline; returns the cleaned table and an audit table
    ``(step_no, step, column, n_affected, note)``.  Intermediate typed tables
    are persisted (MEMORY_AND_DISK); call ``result.data.unpersist()`` /
    ``spark.catalog.clearCache()`` when done."""
    spark = df.sparkSession
    audit: list[tuple] = []
    cur = normalise_missing(trim_column_names(df), mode=mode)
    # C2/C3
    if convert_datetimes and string_columns(cur):
        votes = datetime_votes(cur, mode=mode).filter("is_datetime").select("column", "parsed").collect()
        for r in votes:
            cur = cur.withColumn(r["column"], parse_datetime(F.col(r["column"])))
        audit.append((1, "convert_datetime", ",".join(r["column"] for r in votes) or None, len(votes),
                      f"Converted {len(votes)} probable datetime column(s)"))
    # C4
    if string_columns(cur):
        votes = numeric_votes(cur, mode=mode).filter("is_numeric").select("column", "parsed").collect()
        for r in votes:
            cur = cur.withColumn(r["column"], parse_number(F.col(r["column"])))
        audit.append((2, "coerce_numeric", ",".join(r["column"] for r in votes) or None, len(votes),
                      f"Coerced {len(votes)} numeric-looking text column(s)"))
    # The typed table feeds several passes (duplicates, fills, fences, counts):
    # materialise it once instead of re-parsing the text for each of them.
    typed = cur.persist(StorageLevel.MEMORY_AND_DISK)
    cur = typed
    # C5/C6
    dups = P.duplicate_rows(cur).first()[0]
    if drop_duplicates and dups:
        cur = cur.dropDuplicates().persist(StorageLevel.MEMORY_AND_DISK)
    audit.append((3, "drop_duplicates" if drop_duplicates and dups else "detect_duplicates", None, int(dups),
                  f"{'Dropped' if drop_duplicates and dups else 'Detected'} {dups} duplicate row(s)"))
    # C7/C8 (statistics after de-duplication)
    fills = fill_values(cur, numeric_fill, categorical_fill).collect()
    num_fill, cat_fill = {}, {}
    for r in fills:
        if r["role"] == "numeric" and r["n_filled"] and r["fill_value"] is not None:
            num_fill[r["column"]] = float(r["fill_value"])
        elif r["role"] == "categorical" and r["n_filled"]:
            cat_fill[r["column"]] = r["fill_value"]
    for c, v in num_fill.items():
        x = F.col(c).cast("double")
        if c in floating_columns(cur):
            x = F.when(F.isnan(x), None).otherwise(x)
        cur = cur.withColumn(c, F.coalesce(x, F.lit(v)))
    if cat_fill:
        cur = cur.na.fill(cat_fill)
    audit.append((4, "fill_numeric", None, int(sum(r["n_filled"] or 0 for r in fills if r["role"] == "numeric"
                                                   and numeric_fill != "none")), f"numeric fill: {numeric_fill}"))
    audit.append((5, "fill_categorical", None, int(sum(r["n_filled"] or 0 for r in fills
                                                       if r["role"] == "categorical")),
                  f"categorical fill: {categorical_fill}"))
    # C9
    if remove_outliers and numeric_columns(cur):
        before = cur.count()
        cur, fences = iqr_filter(cur)
        after = cur.count()
        audit.append((6, "remove_outliers", ",".join(r["column"] for r in fences) or None, before - after,
                      f"Removed {before - after} row(s) with IQR outliers"))
    audit_df = spark.createDataFrame(audit, "step_no int, step string, column string, n_affected long, note string")
    return CleanResult(cur, audit_df)


def listwise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Projection then drop rows with any missing value."""
    return df.select(*columns).na.drop()


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    """C13."""
    return df.na.drop(subset=[target])


def range_filter(df: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    """Inclusive numeric range."""
    return df.filter(F.col(column).between(lo, hi))


def level_filter(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """Category IN-list where null is the level ``<Missing>``."""
    return df.filter(F.coalesce(F.col(column).cast("string"), F.lit(P.MISSING_LABEL)).isin(levels))


def filter_choices(df: DataFrame, column: str, k: int = 30, preselect: int = 10) -> DataFrame:
    """C17: the ``k`` most frequent levels (``<Missing>`` included), first
    ``preselect`` marked."""
    f = P.frequency_table(df, [column], top=k)
    return f.select("value", "count", "rank", (F.col("rank") <= preselect).alias("preselected"))


def filter_effect(filtered: DataFrame, original: DataFrame, group: str | None = None) -> DataFrame:
    """Rows kept of total, empty / too-many-groups warnings."""
    kept = filtered.agg(F.count(F.lit(1)).alias("kept"),
                        *([F.count_distinct(F.col(group)).alias("groups")] if group else []))
    tot = original.agg(F.count(F.lit(1)).alias("total"))
    out = kept.crossJoin(tot).withColumn("kept_percent", F.when(F.col("total") > 0,
                                                                F.col("kept") / F.col("total") * 100).otherwise(0.0))
    out = out.withColumn("empty", F.col("kept") == 0)
    if group:
        out = out.withColumn("too_many_groups", F.col("groups") > 20)
    return out


def search_columns(profile: DataFrame, text: str) -> DataFrame:
    """Case-insensitive column-name search in a profile table."""
    return profile.filter(F.lower(F.col("column")).contains(text.lower()))


def coerce_number(df: DataFrame, column: str) -> DataFrame:
    """C14: column to number, bad values -> null."""
    return df.withColumn(column, F.col(column).cast("string").try_cast("double"))


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "kind_of")]
