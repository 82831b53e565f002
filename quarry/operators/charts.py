"""Chart data (K1-K22): the aggregated or sampled table behind each chart.

Rendering is not built.  Aggregated charts are group-bys; point charts use
a deterministic hash sample (the n least hashes of row name and occurrence
number, a distributed top-k), which is the sampling feature of the point charts only; statistics
are always computed on all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.numeric import safe_pct
from quarry.operators import profile as P
from quarry.operators import ranks
from quarry.operators.assoc import corr_matrix
from quarry.operators.roles import missing_expr, numeric_columns

SEED = 42
CHART_ROWS = 5000
HEATMAP_ROWS = 1500
KDE_BINS = 1024
KDE_GRID = 100
BLOCK_OF_COPIES = 1 << 16


def _num(df: DataFrame, c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def row_mark(df: DataFrame, columns: list[str]) -> Column:
    """A row's name: MD5 over the texts of its values."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]))


def hash_sample(df: DataFrame, n: int = CHART_ROWS, seed: int = SEED, key: list[str] | None = None,
                columns: list[str] | None = None, where: Column | None = None, mark: str | None = None) -> DataFrame:
    """A sample of ``n`` rows, of which ``columns`` are returned; the same after any repartitioning.

    A row is named by its ``key`` or, without one, by all its columns.  Rows of one
    name are counted, and the sample is the n least hashes of (name, occurrence number, seed), so
    equal rows are drawn one by one.  Counting combines on the map side and moves the
    name and the chart's columns only; ``mark`` names a column for the hash, which is
    unique to the drawn row."""
    cols = list(dict.fromkeys(columns or df.columns))
    base = df.filter(where) if where is not None else df
    counts = base.select(row_mark(df, key or df.columns).alias("_m"), *cols).groupBy("_m", *cols).agg(F.count(F.lit(1)).alias("_c"))

    def drawn(rows: DataFrame) -> DataFrame:
        last = F.least(F.col("_c") - 1, (F.col("_b") + 1) * BLOCK_OF_COPIES - 1)
        return rows.select("_m", *cols, F.explode(F.sequence(F.col("_b") * BLOCK_OF_COPIES, last)).alias("_i"))

    few = drawn(counts.where(F.col("_c") <= BLOCK_OF_COPIES).withColumn("_b", F.lit(0).cast("long")))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_c - 1) div {BLOCK_OF_COPIES}"))).alias("_b")
    many = drawn(counts.where(F.col("_c") > BLOCK_OF_COPIES).select("*", blocks).repartition("_m", "_b"))  # a row with very many copies is numbered in many tasks
    hashed = few.unionByName(many).withColumn("_h", F.md5(F.concat_ws(":", "_m", F.col("_i").cast("string"), F.lit(str(seed)))))
    # rows that share a name but differ in the chart's columns (a key that repeats) follow each other in their order
    out = hashed.orderBy("_h", *cols).limit(n)
    return out.select(*(columns or df.columns), *([F.col("_h").alias(mark)] if mark else []))


def _present(df: DataFrame, columns: list[str]) -> Column:
    """All of them have a value."""
    return reduce(lambda a, b: a & b, [~missing_expr(df, c) for c in columns])


def histogram(df: DataFrame, column: str, bins: int = 10, color: str | None = None) -> DataFrame:
    """K1: equal-width histogram, optionally per colour (40 bins in the API)."""
    return P.equal_width_histogram(df, column, bins, color)


def kde(df: DataFrame, column: str, group: str | None = None, grid: int = KDE_GRID,
        bins: int = KDE_BINS) -> DataFrame:
    """K2: Gaussian kernel density on an even grid over [min, max], Scott
    bandwidth (std * n^-1/5), per group.  Values are first binned into
    ``bins`` fine bins (sum of counts at bin centres), so the work is
    groups x bins x grid whatever the row count."""
    keys = [group] if group else []
    base = df.select(*[F.col(k).cast("string").alias(k) for k in keys], _num(df, column).alias("x")) \
        .filter(F.col("x").isNotNull())
    if group:
        base = base.filter(F.col(group).isNotNull())
    st = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("sd"),
                                 F.min("x").alias("lo"), F.max("x").alias("hi"))
    st = st.withColumn("bw", F.col("sd") * F.pow(F.col("n").cast("double"), -0.2)) \
        .filter(F.col("bw") > 0)
    w = (F.col("hi") - F.col("lo")) / bins
    fine = (base.join(st, keys) if keys else base.crossJoin(F.broadcast(st)))
    fine = (fine.withColumn("b", F.least(F.floor((F.col("x") - F.col("lo")) / w), F.lit(bins - 1)))
            .groupBy(*keys, "b").agg(F.count(F.lit(1)).alias("c")))
    centres = fine.join(st, keys) if keys else fine.crossJoin(F.broadcast(st))
    centres = centres.withColumn("xc", F.col("lo") + (F.col("b") + 0.5) * w)
    g = df.sparkSession.range(grid).select(F.col("id").cast("int").alias("gi"))
    pts = centres.crossJoin(F.broadcast(g)).withColumn(
        "gx", F.col("lo") + F.col("gi") * (F.col("hi") - F.col("lo")) / (grid - 1))
    dens = pts.groupBy(*keys, "gi", "gx", "n", "bw").agg(
        F.sum(F.col("c") * F.exp(-F.pow((F.col("gx") - F.col("xc")) / F.col("bw"), 2) / 2)).alias("s"))
    return dens.select(*keys, "gi", F.col("gx").alias("x"),
                       (F.col("s") / (F.col("n") * F.col("bw") * F.sqrt(F.lit(2 * 3.141592653589793))))
                       .alias("density"))


def box_stats(df: DataFrame, column: str, group: str | None = None) -> DataFrame:
    """Min, Q1, median, Q3, max, whiskers (furthest values inside
    the 1.5 IQR fences), outlier count, per group; quartiles exact."""
    keys = [group] if group else ["_all"]
    base = df.select((F.col(group).cast("string") if group else F.lit("all")).alias(keys[0]),
                     _num(df, column).alias("value")).filter(F.col("value").isNotNull())
    counts = base.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    q = ranks.exact_quantiles(ranks.cumulative_counts(counts, keys), keys, [0.25, 0.5, 0.75],
                              names=["q1", "median", "q3"])
    q = q.withColumn("lower_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
        .withColumn("upper_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    j = counts.join(q, keys)
    inside = (F.col("value") >= F.col("lower_fence")) & (F.col("value") <= F.col("upper_fence"))
    agg = j.groupBy(*keys, "q1", "median", "q3", "lower_fence", "upper_fence").agg(
        F.sum("n").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.sum(F.when(~inside, F.col("n")).otherwise(0)).alias("outliers"))
    out = agg.select(F.lit(column).alias("column"), *(F.col(k) for k in keys if group), F.col("count").cast("long"),
                     "min", "q1", "median", "q3", "max", "whisker_low", "whisker_high", "lower_fence",
                     "upper_fence", F.col("outliers").cast("long").alias("outliers"))
    return out


def box_outlier_points(df: DataFrame, column: str, group: str | None = None) -> DataFrame:
    """K3 outlier points: rows outside their group's fences."""
    b = box_stats(df, column, group).select(*( [group] if group else []), "lower_fence", "upper_fence")
    base = df.select(*([F.col(group).cast("string").alias(group)] if group else []), _num(df, column).alias("value"))
    j = base.join(b, [group]) if group else base.crossJoin(F.broadcast(b))
    return j.filter((F.col("value") < F.col("lower_fence")) | (F.col("value") > F.col("upper_fence"))) \
        .drop("lower_fence", "upper_fence")


def violin(df: DataFrame, column: str, group: str | None = None) -> DataFrame:
    """K4: density curve and box summary in one long table."""
    d = kde(df, column, group).select(*([group] if group else []), F.lit("density").alias("part"),
                                       F.col("x"), F.col("density").alias("y"))
    b = box_stats(df, column, group)
    parts = []
    for stat in ("min", "q1", "median", "q3", "max"):
        parts.append(b.select(*([group] if group else []), F.lit(stat).alias("part"), F.col(stat).alias("x"),
                              F.lit(None).cast("double").alias("y")))
    return reduce(DataFrame.unionByName, [d, *parts])


def scatter(df: DataFrame, x: str, y: str, color: str | None = None, n: int = CHART_ROWS, key: list[str] | None = None) -> DataFrame:
    """K5: sampled points."""
    cols = [x, y] + ([color] if color else [])
    return hash_sample(df, n, key=key, columns=cols, where=_present(df, [x, y]))


def regression_lines(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """K6: OLS line per colour (slope, intercept, r2, end points)."""
    keys = [color] if color else []
    base = df.select(*[F.col(k).cast("string").alias(k) for k in keys], _num(df, x).alias("x"),
                     _num(df, y).alias("y")).na.drop()
    return base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"),
        F.min("x").alias("x_start"), F.max("x").alias("x_end")) \
        .withColumn("y_start", F.col("intercept") + F.col("slope") * F.col("x_start")) \
        .withColumn("y_end", F.col("intercept") + F.col("slope") * F.col("x_end"))


def heatmap(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """K7: correlation heatmap cells."""
    return corr_matrix(df, columns or numeric_columns(df))


def bar(df: DataFrame, x: str, y: str, agg: str = "mean", color: str | None = None) -> DataFrame:
    """K8: mean / median / sum / count of ``y`` by ``x`` (and colour); null
    groups kept as their own bar."""
    keys = [x] + ([color] if color else [])
    base = df.select(*[F.col(k).cast("string").alias(k) for k in keys], _num(df, y).alias("y"))
    if agg == "median":
        counts = base.filter(F.col("y").isNotNull()).groupBy(*keys, "y").agg(F.count(F.lit(1)).alias("n"))
        filled = counts.na.fill("\u0000null", subset=keys)
        q = ranks.exact_quantiles(ranks.cumulative_counts(filled, keys, value="y"), keys, [0.5], value="y",
                                  names=["value"])
        return q.select(*[F.when(F.col(k) == "\u0000null", None).otherwise(F.col(k)).alias(k) for k in keys],
                        "value")
    fn = {"mean": F.avg("y"), "sum": F.sum("y"), "count": F.count("y")}[agg]
    return base.groupBy(*keys).agg(fn.cast("double").alias("value"))


def count_plot(df: DataFrame, x: str, color: str | None = None) -> DataFrame:
    """Record counts by x (and colour), null kept."""
    keys = [x] + ([color] if color else [])
    return df.groupBy(*[F.col(k).cast("string").alias(k) for k in keys]).agg(F.count(F.lit(1)).alias("count"))


def pie(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Shares with a ``<Missing>`` level (top-k optional)."""
    return P.frequency_table(df, [column], top=top).select("value", "count", "percent", "rank")


def line(df: DataFrame, x: str, y: str, n: int = CHART_ROWS, key: list[str] | None = None) -> DataFrame:
    """Sampled rows ordered by x."""
    return hash_sample(df, n, key=key, columns=[x, y], where=_present(df, [x, y])).orderBy(x, y)


def over_time(df: DataFrame, ts: str, unit: str = "month", value: str | None = None) -> DataFrame:
    """Counts (and mean of ``value``) per ``date_trunc(unit)`` period."""
    aggs = [F.count(F.lit(1)).alias("count")]
    if value:
        aggs.append(F.avg(_num(df, value)).alias("mean"))
    return (df.filter(F.col(ts).isNotNull()).groupBy(F.date_trunc(unit, F.col(ts)).alias("period")).agg(*aggs))


def scatter_matrix(df: DataFrame, n: int = CHART_ROWS, k: int | None = None, key: list[str] | None = None) -> DataFrame:
    """The numeric columns (the first ``k``, if given) of a sample."""
    return hash_sample(df, n, key=key, columns=numeric_columns(df)[:k])


def scatter_3d(df: DataFrame, x: str, y: str, z: str, n: int = CHART_ROWS, key: list[str] | None = None) -> DataFrame:
    """K15."""
    return hash_sample(df, n, key=key, columns=[x, y, z], where=_present(df, [x, y, z]))


def missing_heatmap(df: DataFrame, n: int = HEATMAP_ROWS, key: list[str] | None = None) -> DataFrame:
    """0/1 missing indicator per sampled row x column (long)."""
    cols = df.columns
    flags = df.select(row_mark(df, key or cols).alias("_name"), *[missing_expr(df, c).cast("int").alias(c) for c in cols])
    s = hash_sample(flags, n, key=["_name"], columns=cols, mark="_row")
    return s.select("_row", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in cols]))
                    .alias("m")).select(F.col("_row").alias("row"), "m.column", "m.missing")


def geo_points(df: DataFrame, lat: str, lon: str, color: str | None = None, label: str | None = None,
               n: int = CHART_ROWS, key: list[str] | None = None) -> DataFrame:
    """Valid coordinates only, sampled."""
    cols = [lat, lon] + [c for c in (color, label) if c]
    return hash_sample(df, n, key=key, columns=cols, where=F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180))


def missing_bar(df: DataFrame, top: int | None = None) -> DataFrame:
    """Columns with missing values, most first (the first ``top``, if given)."""
    out = P.missing_report(df).filter(F.col("missing_count") > 0).orderBy(F.col("missing_count").desc(), "column")
    return out.limit(top) if top else out


def percent_bar(df: DataFrame, x: str) -> DataFrame:
    c = count_plot(df, x)
    tot = c.agg(F.sum("count").alias("_t"))
    return c.crossJoin(tot).select(x, "count", safe_pct("count", "_t").alias("percent"))
