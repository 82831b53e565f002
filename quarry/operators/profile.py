"""Profiles (P1-P25): numeric moments and quantiles, value histograms,
categorical summaries, missing report, overview and dataset summary.

Plan shape for a table of any size:
* one wide ``agg`` for all moments of all numeric columns (partial/final
  aggregation, a single-row result);
* one ties-collapsed ``(column, value, n)`` table for quantiles, mode,
  distinct counts and outlier counts (map-side combined shuffle);
* everything else is a join of per-column tables (one row per column).
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.numeric import (adjusted_kurtosis, adjusted_skewness, safe_pct,
                                      sample_moment_kurtosis, sample_moment_skewness)
from quarry.operators import ranks
from quarry.operators.roles import (floating_columns, kind_of, missing_expr, numeric_columns,
                                    profiled_columns)
from quarry.operators.topk import top_k

MISSING_LABEL = "<Missing>"
#: Columns of one aggregate of moments (more make code that the JVM does not compile); scans over which moments or counts are spread at most.
TOGETHER, SCANS = 4, 8

# Normality hint texts of the numeric profile.
HINT_FEW = "Too few observations for a reliable normality hint"
HINT_SYMMETRIC = "Approximately symmetric; formal normality still requires a test"
HINT_SKEW = "Strong skew; consider transformation or robust/nonparametric methods"
HINT_OTHER = "Some asymmetry/heavy tails possible; inspect histogram/Q-Q plot"


def _num(df: DataFrame, c: str):
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v) if c in floating_columns(df) else v


def _groups(columns: list[str], least: int) -> list[list[str]]:
    """The columns in groups of ``least`` or more, SCANS groups at most."""
    size = max(least, -(-len(columns) // SCANS))
    return [columns[i:i + size] for i in range(0, len(columns), size)]


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long table of moments: a wide aggregate for each few columns, unpivoted."""
    return reduce(DataFrame.unionByName, [_moments(df, own) for own in _groups(columns, TOGETHER)])


def _moments(df: DataFrame, columns: list[str]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(columns):
        v = _num(df, c)
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"),
                 F.var_samp(v).alias(f"v{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"),
                 F.skewness(v).alias(f"g{i}"), F.kurtosis(v).alias(f"k{i}"),
                 F.stddev_pop(v).alias(f"sp{i}"), F.count_if(missing_expr(df, c)).alias(f"x{i}")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col("_rows").alias("rows"), F.col(f"n{i}").alias("count"),
                     F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"), F.col(f"v{i}").alias("variance"),
                     F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"), F.col(f"g{i}").alias("g1"),
                     F.col(f"k{i}").alias("g2"), F.col(f"sp{i}").alias("std_pop"),
                     F.col(f"x{i}").cast("long").alias("missing_count"))
            for i, c in enumerate(columns)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def quantile_table(df: DataFrame, columns: list[str], probs: list[float], names: list[str],
                   method: str = "exact", accuracy: int = 100_000, counts: DataFrame | None = None,
                   cum: DataFrame | None = None) -> DataFrame:
    """Per-column quantiles; ``exact`` by cumulative counts of distinct values (``cum``, if they are there already),
    ``approx`` by ``percentile_approx`` (bounded-memory sketch)."""
    if method == "approx":
        vals = ranks.long_values(df, columns)
        return vals.groupBy("column").agg(
            F.percentile_approx("value", probs, accuracy).alias("_q")).select(
            "column", *[F.col("_q")[i].alias(nm) for i, nm in enumerate(names)])
    if cum is None:
        cum = ranks.cumulative_counts(counts if counts is not None else ranks.value_counts(df, columns), ["column"])
    return ranks.exact_quantiles(cum, ["column"], probs, names=names)


def numeric_profile(df: DataFrame, columns: list[str] | None = None, skew_kind: str = "adjusted",
                    quantiles: str = "exact", cum: DataFrame | None = None) -> DataFrame:
    """One row per numeric column (P1): count, mean, median, mode, std, variance,
    min, max, range, IQR, skewness, kurtosis, missing, IQR outliers, CV, hint.

    ``skew_kind='sample'`` gives the browser's moment variant (P5).  ``cum``: the cumulative counts of these
    columns, where the caller has them (and keeps them)."""
    cols = columns if columns is not None else numeric_columns(df)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column string")
    mom = moments(df, cols)
    counts = cum if cum is not None else ranks.value_counts(df, cols).persist(StorageLevel.MEMORY_AND_DISK)
    # distinct count and mode per column (one row per column, read once)
    per_rows = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct_count"),
        F.min(F.struct((-F.col("n")).alias("negn"), F.col("value").alias("v")))["v"].alias("mode")).collect()
    per = spark.createDataFrame(per_rows, "column string, distinct_count long, mode double")
    qs = quantile_table(df, cols, [0.25, 0.5, 0.75], ["q1", "median", "q3"], quantiles, counts=counts, cum=cum)
    # One row per column: collected (bounded by the column count) so the
    # fences enter the outlier count as literals instead of re-running the
    # quantile plan in a second branch.
    fence_rows = (qs.join(per, "column")
                  .withColumn("iqr", F.col("q3") - F.col("q1"))
                  .withColumn("_ok", (F.col("distinct_count") > 2) & (F.col("iqr") != 0))
                  .withColumn("lower_fence", F.when(F.col("_ok"), F.col("q1") - 1.5 * F.col("iqr")))
                  .withColumn("upper_fence", F.when(F.col("_ok"), F.col("q3") + 1.5 * F.col("iqr")))
                  .select("column", "q1", "median", "q3", "iqr", "distinct_count", "mode", "lower_fence",
                          "upper_fence")).collect()
    fences = spark.createDataFrame(fence_rows, "column string, q1 double, median double, q3 double, iqr double, "
                                               "distinct_count long, mode double, lower_fence double, "
                                               "upper_fence double")
    out_n = None
    if any(r["lower_fence"] is not None for r in fence_rows):
        # outliers counted on the ties-collapsed table (no second raw scan)
        hit = F.lit(False)
        for r in fence_rows:
            if r["lower_fence"] is not None:
                hit = hit | ((F.col("column") == r["column"]) &
                             ((F.col("value") < r["lower_fence"]) | (F.col("value") > r["upper_fence"])))
        out_rows = counts.filter(hit).groupBy("column").agg(F.sum("n").cast("long").alias("outlier_count_iqr"))
        out_n = spark.createDataFrame(out_rows.collect(), "column string, outlier_count_iqr long")
    if cum is None:
        counts.unpersist()
    n = F.col("count")
    flat = F.col("variance") == 0
    if skew_kind == "sample":
        skew = F.when(n > 2, F.when(flat, 0.0).otherwise(sample_moment_skewness(F.col("g1"), n)))
        kurt = F.when(n > 3, F.when(flat, 0.0).otherwise(sample_moment_kurtosis(F.col("g2"), n)))
    else:
        skew = F.when(n > 2, F.when(flat, 0.0).otherwise(adjusted_skewness(F.col("g1"), n)))
        kurt = F.when(n > 3, F.when(flat, 0.0).otherwise(adjusted_kurtosis(F.col("g2"), n)))
    prof = mom.join(fences, "column", "left")
    if out_n is not None:
        prof = prof.join(out_n, "column", "left")
    else:
        prof = prof.withColumn("outlier_count_iqr", F.lit(None).cast("long"))
    prof = (prof
            .withColumn("skewness", skew).withColumn("kurtosis", kurt)
            .withColumn("range", F.col("max") - F.col("min"))
            .withColumn("missing_percent", F.when(F.col("rows") > 0, F.col("missing_count") / F.col("rows") * 100.0))
            .withColumn("outlier_count_iqr", F.coalesce("outlier_count_iqr", F.lit(0)).cast("long"))
            .withColumn("outlier_percent_iqr", safe_pct("outlier_count_iqr", "count"))
            .withColumn("coefficient_of_variation",
                        F.when(F.col("mean") != 0, F.col("std") / F.abs(F.col("mean"))))
            .withColumn("normality_hint",
                        F.when(n < 8, HINT_FEW)
                        .when((F.abs("skewness") < 0.5) & (F.abs("kurtosis") < 1), HINT_SYMMETRIC)
                        .when(F.abs("skewness") >= 1, HINT_SKEW).otherwise(HINT_OTHER)))
    return prof.select("column", F.col("count").cast("long").alias("count"), "mean", "median", "mode", "std",
                       "variance", "min", "max", "range", "q1", "q3", "iqr", "skewness", "kurtosis",
                       "missing_count", "missing_percent", "outlier_count_iqr", "outlier_percent_iqr",
                       "coefficient_of_variation", "normality_hint", "lower_fence", "upper_fence",
                       F.coalesce(F.col("distinct_count"), F.lit(0)).cast("long").alias("distinct_count"),
                       "std_pop", "rows")


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """pandas ``describe()`` per numeric column."""
    p = numeric_profile(df, columns)
    return p.select("column", "count", "mean", "std", "min", F.col("q1").alias("p25"),
                    F.col("median").alias("p50"), F.col("q3").alias("p75"), "max")


def _as_text(df: DataFrame, c: str):
    kind = kind_of(df.schema[c].dataType)
    v = F.col(c)
    if c in floating_columns(df):
        v = F.when(~F.isnan(v), v)
    if kind == "datetime":
        return F.date_format(v, "yyyy-MM-dd HH:mm:ss")
    return v.cast("string")


def typed_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, text, value, n)``: the rows of ``value_hist`` (``text`` for its value) with numeric columns' values as doubles too.

    Numbers are counted as they are, a column in a set of its own, and written as text once counted: rows are neither
    multiplied by the columns nor formatted one by one."""
    cols = columns if columns is not None else profiled_columns(df)
    floats, parts = floating_columns(df), []
    for own in _groups(cols, 1):
        keys: dict[str, list[str]] = {}
        exprs = []
        for i, c in enumerate(own):
            number = kind_of(df.schema[c].dataType) == "numeric"
            v = F.when(~F.isnan(F.col(c)), F.col(c)) if c in floats else F.col(c) if number else _as_text(df, c)
            exprs.append(v.alias(f"k{i}"))
            keys[c] = [f"k{i}"]
            if c in floats:  # both zeros are one number, but two texts
                exprs.append(F.when(F.col(c) == 0, F.col(c).cast("string")).alias(f"z{i}"))
                keys[c].append(f"z{i}")
        names = [k for ks in keys.values() for k in ks]
        # which column a row counts: the bits of the keys that are not in its set
        bits = {c: sum(1 << (len(names) - 1 - j) for j, k in enumerate(names) if k not in ks) for c, ks in keys.items()}
        rows = df.select(*exprs).groupingSets([[F.col(k) for k in ks] for ks in keys.values()], *names).agg(
            F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
        pick = lambda of: F.coalesce(*[F.when(F.col("_g") == bits[c], of(c)) for c in own])
        text = lambda c: F.coalesce(*[F.col(k).cast("string") for k in reversed(keys[c])])
        value = lambda c: F.col(keys[c][0]).cast("double") if kind_of(df.schema[c].dataType) == "numeric" else F.lit(None).cast("double")
        parts.append(rows.select(pick(F.lit).alias("column"), pick(text).alias("text"), pick(value).alias("value"), "n"))
    return reduce(DataFrame.unionByName, parts) if parts else df.sparkSession.createDataFrame([], "column string, text string, value double, n long")


def value_hist(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The shared value histogram ``(column, value, n)`` over all profiled columns;
    ``value`` is text, null for missing (P9).  Persist it when reused."""
    cols = columns if columns is not None else profiled_columns(df)
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), _as_text(df, c).alias("value")) for c in cols])).alias("kv"))
    return pairs.groupBy(F.col("kv.column").alias("column"), F.col("kv.value").alias("value")).agg(
        F.count(F.lit(1)).alias("n"))


def frequency_table(df: DataFrame, columns: list[str], top: int | None = None, percent_of: str = "all",
                    keep_missing: bool = True, hist: DataFrame | None = None) -> DataFrame:
    """Frequency table per column with a ``<Missing>`` level (P9): count, percent
    (of all rows, or of present rows), count-descending rank; optional top-k."""
    h = hist if hist is not None else value_hist(df, columns)
    h = h.filter(F.col("column").isin(columns))
    tot = h.groupBy("column").agg(F.sum("n").alias("_all"),
                                  F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).alias("_present"))
    if not keep_missing:
        h = h.filter(F.col("value").isNotNull())
    h = h.withColumn("value", F.coalesce("value", F.lit(MISSING_LABEL)))
    denom = "_all" if percent_of == "all" else "_present"
    order = [F.col("n").desc(), F.col("value").asc()]
    if top is not None:
        ranked = top_k(h, ["column"], order, top)
    else:
        # count-descending rank of every level from the rank engine (levels
        # of a near-unique column never meet in one task)
        keyed = h.withColumn("_o", F.struct((-F.col("n")).alias("negn"), F.col("value").alias("v"))) \
            .withColumnRenamed("n", "_cnt").withColumn("n", F.lit(1))
        ranked = (ranks.cumulative_counts(keyed, ["column"], value="_o")
                  .withColumn("rank", F.col("cum_before") + 1).drop("n", "cum_before", "total", "_o")
                  .withColumnRenamed("_cnt", "n"))
    return (ranked.join(F.broadcast(tot), "column")
            .withColumn("percent", safe_pct(F.col("n"), F.col(denom)))
            .select("column", "value", F.col("n").cast("long").alias("count"), "percent",
                    F.col("rank").cast("long").alias("rank")))


def categorical_profile(df: DataFrame, columns: list[str] | None = None, hist: DataFrame | None = None) -> DataFrame:
    """One row per categorical or binary column (P10-P14).  Without a shared
    histogram, only text/boolean columns and two-valued numeric columns are
    counted (numeric columns are screened without a distinct aggregate)."""
    if hist is None and columns is None:
        from quarry.operators.roles import two_valued
        kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
        nums = [c for c, k in kinds.items() if k == "numeric"]
        binary_nums = [c for c, d in two_valued(df, nums).items() if d == 2]
        cols = [c for c, k in kinds.items() if k in ("categorical", "boolean")] + binary_nums
        if not cols:
            return df.sparkSession.createDataFrame([], "column string")
        hist = value_hist(df, cols)
    h = hist if hist is not None else value_hist(df)
    present = h.filter(F.col("value").isNotNull())
    per = h.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing_count"),
        F.count("value").alias("unique_count"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("present"))
    top = present.groupBy("column").agg(
        F.min(F.struct((-F.col("n")).alias("negn"), F.col("value").alias("v"))).alias("_t"))
    ent = (present.join(F.broadcast(per.select("column", "present")), "column")
           .withColumn("_p", F.col("n") / F.col("present"))
           .groupBy("column").agg((-F.sum(F.col("_p") * F.log2(F.col("_p") + 1e-12))).alias("entropy")))
    if columns is None:
        kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
        cat = [c for c, k in kinds.items() if k in ("categorical", "boolean")]
        allowed = F.col("column").isin(cat) | ((F.col("unique_count") == 2) &
                                               F.col("column").isin([c for c, k in kinds.items() if k == "numeric"]))
    else:
        allowed = F.col("column").isin(columns)
    u = F.col("unique_count")
    return (per.filter(allowed).join(top, "column", "left").join(ent, "column", "left")
            .withColumn("top_value", F.col("_t")["v"])
            .withColumn("top_count", F.coalesce(-F.col("_t")["negn"], F.lit(0)).cast("long"))
            .withColumn("top_value_percent", safe_pct("top_count", "rows"))
            .withColumn("missing_percent", F.col("missing_count") / F.col("rows") * 100.0)
            .withColumn("entropy", F.coalesce("entropy", F.lit(0.0)))
            .withColumn("concentration_score",
                        F.when(u > 1, 1 - F.col("entropy") / F.log2(u.cast("double"))).otherwise(1.0))
            .withColumn("imbalance_warning",
                        F.when(F.col("top_value_percent") >= 70, "High imbalance")
                        .when(F.col("top_value_percent") >= 50, "Moderate imbalance")
                        .otherwise("No major imbalance by top-share rule"))
            .withColumn("cardinality_warning",
                        F.when(u > F.least(F.lit(50.0), F.greatest(F.lit(10.0), F.col("rows") * 0.2)),
                               "High cardinality").otherwise("OK"))
            .select("column", F.col("unique_count").cast("long").alias("unique_count"), "top_value", "top_count",
                    "top_value_percent", F.col("missing_count").cast("long").alias("missing_count"),
                    "missing_percent", "entropy", "concentration_score", "imbalance_warning",
                    "cardinality_warning", F.col("rows").cast("long").alias("rows")))


def missing_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing count and percent per column with dtype, most missing first."""
    cols = columns if columns is not None else profiled_columns(df)
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(missing_expr(df, c)).alias(f"m{i}")
                                                     for i, c in enumerate(cols)])
    return (one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                 F.col(f"m{i}").cast("long").alias("missing_count"), F.col("_rows").alias("_rows"))
        for i, c in enumerate(cols)])).alias("r")).select("r.*")
            .withColumn("missing_percent", safe_pct("missing_count", "_rows")).drop("_rows"))


def column_overview(df: DataFrame, hist: DataFrame | None = None) -> DataFrame:
    """dtype, missing, distinct and distinct percent per column."""
    h = hist if hist is not None else value_hist(df)
    per = h.groupBy("column").agg(F.sum("n").alias("rows"), F.count("value").alias("unique_count"),
                                  F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"))
    meta = df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields
                                            if kind_of(f.dataType) != "skipped"], "column string, dtype string")
    return (meta.join(per, "column")
            .select("column", "dtype", F.col("missing").cast("long").alias("missing_count"),
                    F.col("unique_count").cast("long").alias("unique_count"),
                    safe_pct("unique_count", "rows").alias("unique_percent")))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Full-row duplicates: rows minus distinct rows, null-safe."""
    return (df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
            .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows")))


def dataset_summary(df: DataFrame, json_size: bool = False) -> DataFrame:
    """rows, columns, missing cells, duplicates, numeric columns and
    completeness (P17/P18), one row; ``json_size`` adds the P19 estimate
    (serialises every row, so it is opt-in)."""
    cols = profiled_columns(df)
    aggs = [F.count(F.lit(1)).alias("rows"),
            sum((F.count_if(missing_expr(df, c)) for c in cols), F.lit(0)).cast("long").alias("missing_cells")]
    if json_size:
        aggs.append(F.sum(F.length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))).cast("long")
                    .alias("json_chars"))
    one = df.agg(*aggs)
    cells = F.col("rows") * F.lit(len(df.columns))
    return (one.crossJoin(duplicate_rows(df))
            .select("rows", F.lit(len(df.columns)).cast("long").alias("columns"), "missing_cells",
                    "duplicate_rows", F.lit(len(numeric_columns(df))).cast("long").alias("numeric_columns"),
                    F.when(cells > 0, 100 - F.col("missing_cells") / cells * 100).otherwise(100.0)
                    .alias("completeness_percent"), *(["json_chars"] if json_size else [])))


def json_size(df: DataFrame) -> DataFrame:
    """Size estimate as the total length of the rows' JSON records."""
    return df.agg(F.sum(F.length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))).cast("long")
                  .alias("json_chars"), F.count(F.lit(1)).alias("rows"))


def sample_values(df: DataFrame, k: int = 5, hist: DataFrame | None = None) -> DataFrame:
    """First ``k`` distinct non-missing values per column in value order (P20),
    by a two-stage top-k (never one collected group per column)."""
    h = hist if hist is not None else value_hist(df)
    firsts = top_k(h.filter(F.col("value").isNotNull()), ["column"], [F.col("value").asc()], k)
    return firsts.select("column", F.col("rank").cast("long").alias("rank"), "value")


def equal_width_histogram(df: DataFrame, column: str, bins: int = 10, by: str | None = None) -> DataFrame:
    """Equal-width bins, last bin closed, one bin when min = max, empty bins kept
    (P22, K1).  Optional colour/group column ``by``."""
    v = _num(df, column)
    keys = [by] if by else []
    base = df.select(*[F.col(k) for k in keys], v.alias("x")).filter(F.col("x").isNotNull())
    rng = base.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("total"))
    nb = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(F.lit(bins))
    w = (F.col("hi") - F.col("lo")) / nb
    binned = (base.crossJoin(F.broadcast(rng))  # one-row table
              .withColumn("bin", F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
                  F.least(F.floor((F.col("x") - F.col("lo")) / w), F.lit(bins - 1))).cast("int"))
              .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count")))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(rng)) \
        .filter(F.col("bin") < nb)
    if by:
        grid = grid.crossJoin(base.select(by).distinct())  # levels x bins
    hits = binned.select(*[F.col(k).alias(f"_{k}") for k in [*keys, "bin"]], "count")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, "bin"]])
    out = (grid.join(hits, same, "left")
           .withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))
           .withColumn("bin_start", F.col("lo") + F.col("bin") * w)
           .withColumn("bin_end", F.when(F.col("bin") == nb - 1, F.col("hi")).otherwise(
               F.col("lo") + (F.col("bin") + 1) * w))
           .withColumn("percent", safe_pct("count", "total")))
    return out.select(F.lit(column).alias("column"), *keys, "bin", "bin_start", "bin_end", "count", "percent")


def group_describe(df: DataFrame, value: str, group: str) -> DataFrame:
    """count, mean, std, min, quartiles, max of ``value`` per ``group`` (P23),
    quartiles exact by cumulative counts per group."""
    v = _num(df, value)
    base = df.select(F.col(group).alias("group"), v.alias("value")).filter(F.col("value").isNotNull())
    mom = base.groupBy("group").agg(F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"),
                                    F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
                                    F.max("value").alias("max"))
    counts = base.groupBy("group", "value").agg(F.count(F.lit(1)).alias("n"))
    qs = ranks.exact_quantiles(ranks.cumulative_counts(counts, ["group"]), ["group"], [0.25, 0.5, 0.75],
                               names=["p25", "p50", "p75"])
    return mom.join(qs, "group").select("group", F.col("count").cast("long").alias("count"), "mean", "std",
                                        "min", "p25", "p50", "p75", "max")


def compact_numeric_summary(prof: DataFrame) -> DataFrame:
    """Rounded (3) headline numeric summary."""
    return prof.select("column", "count", *[F.round(c, 3).alias(c) for c in
                                            ("mean", "median", "std", "min", "max", "skewness")],
                       "missing_count", "outlier_count_iqr")


def compact_categorical_summary(cat: DataFrame) -> DataFrame:
    """Rounded (3) headline categorical summary."""
    return cat.select("column", "unique_count", "top_value", "top_count",
                      F.round("top_value_percent", 3).alias("top_value_percent"), "missing_count",
                      F.round("entropy", 3).alias("entropy"))


def top_bottom(df, column: str, n: int = 10, key: list[str] | None = None) -> DataFrame:
    """The ``n`` largest and ``n`` smallest rows by ``column`` (ties broken
    by ``key``), tagged ``top`` / ``bottom``; each side is a distributed top-k."""
    key = key or [c for c in df.columns if c != column]
    hi = df.orderBy(F.col(column).desc_nulls_last(), *key).limit(n).withColumn("side", F.lit("top"))
    lo = df.orderBy(F.col(column).asc_nulls_last(), *key).limit(n).withColumn("side", F.lit("bottom"))
    return hi.unionByName(lo)


def distinct_in_first_order(df, column: str, order: list[str]) -> DataFrame:
    """Distinct values ordered by their first appearance under ``order``."""
    first = (df.groupBy(column).agg(F.min(F.struct(*[F.col(c) for c in order])).alias("_first"))
             .withColumn("n", F.lit(1)).withColumn("_k", F.lit(0)))
    # positions from the rank engine (no single-task global window)
    cum = ranks.cumulative_counts(first, ["_k"], value="_first")
    return cum.select(column, (F.col("cum_before") + 1).cast("int").alias("first_position"))


def melt(df, id_cols: list[str], value_cols: list[str], var: str = "variable", val: str = "value") -> DataFrame:
    """Wide -> long."""
    return df.unpivot(id_cols, value_cols, var, val)
