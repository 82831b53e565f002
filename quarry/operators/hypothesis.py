"""Hypothesis tests (T3-T10) from group moments and ties-collapsed ranks.

Each test reduces the data to one row per group (count, mean, variance,
rank sum) or per distinct value (tie counts) before any statistic is
formed, so the work is one or two aggregations whatever the row count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import dist, small
from quarry.operators import ranks
from quarry.operators.assoc import ALPHA, _num, significance_text
from quarry.operators.roles import floating_columns

TWO_GROUP = {"t_test": "Independent samples t-test", "mann_whitney": "Mann-Whitney U"}
#: Mann-Whitney: rows of the smaller group up to which p is exact, and values of U that are counted for it.
EXACT_ROWS, EXACT_TERMS = 8, 1 << 24
K_GROUP = {"anova": "One-way ANOVA", "kruskal": "Kruskal-Wallis"}


def grouped_values(df: DataFrame, value: str, group: str, min_rows: int = 1) -> DataFrame:
    """Listwise deletion over (value, group); group as text.  ``min_rows`` 2 leaves out groups of one row (the API's screening)."""
    gv = df.select(F.col(group).cast("string").alias("g"), _num(df, value).alias("x")).na.drop()
    if min_rows <= 1:
        return gv
    return gv.join(gv.groupBy("g").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows).select("g"), "g", "left_semi")


def group_moments(gv: DataFrame) -> DataFrame:
    """Per group n, mean, variance, ordered by group label."""
    return gv.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"),
                               F.var_samp("x").alias("var"))


def group_sizes(df: DataFrame, value: str, group: str) -> DataFrame:
    """Group sizes with the small-group (< 5) warning flag."""
    m = group_moments(grouped_values(df, value, group))
    return m.select(F.col("g").alias("group"), F.col("n").cast("long").alias("n"), (F.col("n") < 5).alias("small"))


def _result(one: DataFrame, test: str, stat, p, n, valid, message: str, extra: list | None = None) -> DataFrame:
    # statistic and p in their own projection so the text reuses the column
    base = one.select(F.when(valid, stat).alias("statistic"), F.when(valid, p).alias("p_value"),
                      n.cast("long").alias("n"), valid.alias("valid"), *(extra or []))
    return base.select(F.lit(test).alias("test"), "statistic", "p_value", "n", "valid",
                       F.when(F.col("valid"), significance_text("p_value")).otherwise(F.lit(message))
                       .alias("interpretation"), *[c for c in base.columns
                                                   if c not in ("statistic", "p_value", "n", "valid")])


def _first_two(m: DataFrame) -> DataFrame:
    """Moments of the first two groups in label order, as one row."""
    w = Window.orderBy("g")
    r = m.orderBy("g").limit(2).withColumn("_i", F.row_number().over(w))  # distributed top-2, then 2 rows
    k = m.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n_all"))
    a = r.filter("_i = 1").select(F.col("g").alias("g1"), F.col("n").alias("n1"), F.col("mean").alias("m1"),
                                  F.col("var").alias("v1"))
    b = r.filter("_i = 2").select(F.col("g").alias("g2"), F.col("n").alias("n2"), F.col("mean").alias("m2"),
                                  F.col("var").alias("v2"))
    if m.count() < 2:  # one row per group
        return k
    return k.crossJoin(a).crossJoin(b)


def welch_t_test(df: DataFrame, value: str, group: str) -> DataFrame:
    """Welch t of the first two groups (exactly two non-empty groups)."""
    m = group_moments(grouped_values(df, value, group))
    one = _first_two(m)
    if "m1" not in one.columns:
        return _result(one, "t_test", F.lit(None), F.lit(None), F.col("n_all"), F.lit(False),
                       "needs_2_groups")
    se2 = F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2")
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(se2))
    dof = F.try_divide(F.pow(se2, 2), F.try_divide(F.pow(F.col("v1") / F.col("n1"), 2), F.col("n1") - 1) +
                       F.try_divide(F.pow(F.col("v2") / F.col("n2"), 2), F.col("n2") - 1))
    one = one.withColumn("_t", t).withColumn("dof", dof)
    p = dist.t_two_sided_p("_t", "dof")
    return _result(one, "t_test", F.col("_t"), p, F.col("n_all"), F.col("k") == 2,
                   "needs_2_groups",
                   [F.when(F.col("k") == 2, F.col("dof")).alias("dof")])


def _anova_from_moments(m: DataFrame) -> DataFrame:
    one = m.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n_all"),
                (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    j = m.crossJoin(one)  # one row per group
    parts = j.groupBy("k", "n_all").agg(
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("ssb"),
        F.sum(F.coalesce(F.col("var") * (F.col("n") - 1), F.lit(0.0))).alias("ssw"))
    f = F.try_divide(F.try_divide(F.col("ssb"), F.col("k") - 1), F.try_divide(F.col("ssw"), F.col("n_all") - F.col("k")))
    return (parts.withColumn("F", f).withColumn("_d1", F.col("k") - 1).withColumn("_d2", F.col("n_all") - F.col("k"))
            .withColumn("p", dist.f_sf("F", "_d1", "_d2")))


def anova(df: DataFrame, value: str, group: str, min_rows: int = 1) -> DataFrame:
    """T4: one-way ANOVA F and p over all groups of at least ``min_rows``."""
    m = group_moments(grouped_values(df, value, group)).where(F.col("n") >= min_rows)
    one = _anova_from_moments(m)
    return _result(one, "anova", F.col("F"), F.col("p"), F.col("n_all"), F.col("k") >= 2,
                   "needs_2_or_more_groups")


def _rank_sums(gv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rank sum per group and the tie term sum(t^3 - t), from value counts."""
    vc = gv.groupBy("x", "g").agg(F.count(F.lit(1)).alias("n_vg"))
    per_value = vc.groupBy("x").agg(F.sum("n_vg").alias("n")).withColumn("_k", F.lit(0))
    cum = ranks.cumulative_counts(per_value, ["_k"], value="x")
    rk = cum.select("x", ranks.average_rank(cum).alias("avg_rank"), "n")
    ties = rk.agg(F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("tie_term"),
                  F.sum("n").alias("n_total"))
    sums = (vc.join(rk.select("x", "avg_rank"), "x").groupBy("g")
            .agg(F.sum(F.col("n_vg") * F.col("avg_rank")).alias("rank_sum"), F.sum("n_vg").alias("n")))
    return sums, ties


def mann_whitney(df: DataFrame, value: str, group: str) -> DataFrame:
    """T5: U of the first group (label order), two-sided.  Without ties and with at most EXACT_ROWS rows in
    a group the p-value is exact (unless the other group makes more than EXACT_TERMS values of U); else it is
    the tie- and continuity-corrected normal approximation."""
    gv = grouped_values(df, value, group)
    sums, ties = _rank_sums(gv)
    w = Window.orderBy("g")
    s = sums.orderBy("g").limit(2).withColumn("_i", F.row_number().over(w))  # distributed top-2, then 2 rows
    k = sums.agg(F.count(F.lit(1)).alias("k"))
    a = s.filter("_i = 1").select(F.col("rank_sum").alias("r1"), F.col("n").alias("n1"))
    b = s.filter("_i = 2").select(F.col("n").alias("n2"))
    one = k.crossJoin(ties).crossJoin(a).join(b, how="left")
    n1, n2, N = F.col("n1").cast("double"), F.col("n2").cast("double"), F.col("n_total").cast("double")
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    u2 = n1 * n2 - u1
    mu = n1 * n2 / 2
    sd = F.sqrt(n1 * n2 / 12 * ((N + 1) - F.try_divide(F.col("tie_term"), N * (N - 1))))
    one = one.withColumn("_u1", u1).withColumn("_z", F.try_divide(F.greatest(u1, u2) - mu - 0.5, sd))
    # two-sided: 2 * P(Z > z) for z >= 0
    p = F.when(F.col("_z") <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), dist.norm_two_sided_p("_z")))
    few = one.where((F.col("k") == 2) & (F.col("tie_term") == 0) & (F.least("n1", "n2") <= EXACT_ROWS) & (n1 * n2 <= EXACT_TERMS)).select("_u1", "n1", "n2").first()
    if few is not None:
        p = F.lit(small.u_two_sided_p(few["_u1"], few["n1"], few["n2"]))
    return _result(one, "mann_whitney", F.col("_u1"), p, F.col("n_total"), F.col("k") == 2,
                   "needs_2_groups")


def kruskal(df: DataFrame, value: str, group: str, min_rows: int = 1) -> DataFrame:
    """Kruskal-Wallis H with tie correction, chi-square p (k - 1 dof), over all groups of at least ``min_rows``."""
    gv = grouped_values(df, value, group, min_rows)
    sums, ties = _rank_sums(gv)
    agg = sums.agg(F.count(F.lit(1)).alias("k"), F.sum(F.pow("rank_sum", 2) / F.col("n")).alias("ssr"))
    one = agg.crossJoin(ties)
    N = F.col("n_total").cast("double")
    h0 = F.try_divide(F.lit(12.0), N * (N + 1)) * F.col("ssr") - 3 * (N + 1)
    h = F.try_divide(h0, 1 - F.try_divide(F.col("tie_term"), F.pow(N, 3) - N))
    one = one.withColumn("_h", h).withColumn("_df", F.col("k") - 1)
    p = dist.chi2_sf("_h", "_df")
    return _result(one, "kruskal", F.col("_h"), p, F.col("n_total"), F.col("k") >= 2,
                   "needs_2_or_more_groups")


def grouped_test(df: DataFrame, value: str, group: str, test: str) -> DataFrame:
    """Dispatch by name (``t_test``, ``anova``, ``mann_whitney``, ``kruskal``)."""
    return {"t_test": welch_t_test, "anova": anova, "mann_whitney": mann_whitney, "kruskal": kruskal}[test](
        df, value, group)


def normality(df: DataFrame, value: str) -> DataFrame:
    """D'Agostino-Pearson K^2 from population skewness and kurtosis of all
    rows (closed form; no sample), p = exp(-K^2 / 2); with 8 to 19 rows Shapiro-Wilk's W (without the two z), with fewer none."""
    v = F.col(value).cast("double")
    if value in floating_columns(df):
        v = F.when(~F.isnan(v), v)
    one = df.agg(F.count(v).alias("n"), F.skewness(v).alias("b1"), F.kurtosis(v).alias("g2"))
    n = F.col("n").cast("double")
    # D'Agostino's transformation of sqrt(b1): its standard deviation, then an inverse hyperbolic sine
    b1 = F.col("b1") / F.sqrt(6 * (n - 2) / ((n + 1) * (n + 3)))
    kurt = 3 * (n - 1) / (n + 1) * ((n * n + 27 * n - 70) * (n + 3)) * ((n + 1) * (n + 1)) / ((n - 1) * (n - 2) * (n + 5) * (n + 7) * (n + 9))
    spread = F.sqrt(2 * kurt - 2) - 1
    b1 = F.when(b1 == 0, F.lit(1.0)).otherwise(b1)
    zs = F.asinh(b1 * F.sqrt((spread - 1) / 2)) / F.sqrt(F.log(spread) / 2)
    # Anscombe and Glynn's transformation of b2: standardised, then the cube root of a scaled chi-square
    var_b2 = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    b2 = (F.col("g2") + 3 - 3 * (n - 1) / (n + 1)) / F.sqrt(var_b2)
    third = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    freedom = 6 + 8 / third * (2 / third + F.sqrt(1 + 4 / (third * third)))
    scaled = (1 - 2 / freedom) / (1 + b2 * F.sqrt(2 / (freedom - 4)))
    zk = (1 - 2 / (9 * freedom) - F.signum(scaled) * F.pow(F.abs(scaled), 1.0 / 3)) * F.sqrt(9 * freedom / 2)
    k2 = zs * zs + zk * zk
    p = F.exp(-k2 / 2)
    many = F.col("n") >= 20
    # all values, if they are few
    few = df.select(v.alias("v")).where("v is not null").limit(20).agg(F.sort_array(F.collect_list("v")).alias("_few"))
    one = one.crossJoin(few).withColumn("_w", small.shapiro_w("_few"))  # one row each
    one = one.withColumn("_zw", small.shapiro_z(F.col("_w"), F.col("n"))).withColumn("_za", F.abs("_zw"))
    upper = F.when(F.col("_zw") >= 0, dist.norm_two_sided_p("_za") / 2).otherwise(1 - dist.norm_two_sided_p("_za") / 2)
    one = one.withColumn("_k2", F.when(many, k2)).withColumn("_pk", F.when(many, p)).withColumn("_pw", upper).withColumn("_zs", F.when(many, zs)).withColumn("_zk", F.when(many, zk))
    valid = many | F.col("_w").isNotNull()
    res = _result(one, "normality", F.when(many, F.col("_k2")).otherwise(F.col("_w")), F.when(many, F.col("_pk")).otherwise(F.col("_pw")), F.col("n"), valid,
                  "needs_8_rows", [F.when(many, F.col("_zs")).alias("z_skew"), F.when(many, F.col("_zk")).alias("z_kurtosis")])
    res = res.withColumn("interpretation", F.when(~F.col("valid") & (F.col("n") >= small.SMALLEST), F.lit("needs_two_values")).otherwise(F.col("interpretation")))
    return res.withColumn("interpretation", F.when(F.col("valid"), F.when(F.col("p_value") >= ALPHA, "no_departure").otherwise("departure"))
                          .otherwise(F.col("interpretation")))


def levene(df: DataFrame, value: str, group: str) -> DataFrame:
    """Brown-Forsythe / median-centred Levene over groups with > 1 row."""
    gv = grouped_values(df, value, group)
    cum = ranks.cumulative_counts(gv.groupBy("g", "x").agg(F.count(F.lit(1)).alias("n")), ["g"], value="x").filter("total > 1")
    counts = cum.select("g", "x", "n")
    med = ranks.exact_quantiles(cum, ["g"], [0.5], value="x", names=["med"])
    # deviations from the ties-collapsed table: groups may be of any size
    dev = counts.join(med, "g").select("g", "n", F.abs(F.col("x") - F.col("med")).alias("d"))
    w = F.col("n").cast("double")
    m = dev.groupBy("g").agg(F.sum("n").alias("n"), (F.sum(w * F.col("d")) / F.sum("n")).alias("mean"), F.sum(w * F.col("d") * F.col("d")).alias("_sq"))
    m = m.select("g", "n", "mean", F.try_divide(F.greatest(F.lit(0.0), F.col("_sq") - F.col("n") * F.col("mean") * F.col("mean")), F.col("n") - 1).alias("var"))
    one = _anova_from_moments(m)
    return _result(one, "levene", F.col("F"), F.col("p"), F.col("n_all"), F.col("k") >= 2,
                   "needs_2_groups_of_2")


def assumption_checks(df: DataFrame, value: str, group: str | None = None) -> DataFrame:
    """T7-T9 bundle: normality, Levene and group sizes as one long table."""
    parts = [normality(df, value).select("test", "statistic", "p_value", "n", "interpretation")]
    if group:
        parts.append(levene(df, value, group).select("test", "statistic", "p_value", "n", "interpretation"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

