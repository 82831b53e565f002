"""Unit tests: rank engine, quantiles, p-values, formatting, validity guards."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.functions import dist
from quarry.functions.text import fmt_g
from quarry.operators import assoc as A
from quarry.operators import hypothesis as H
from quarry.operators import profile as P
from quarry.operators import ranks


def test_cumulative_counts_match_a_single_window(spark, sf_dir):
    from pyspark.sql import Window
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    counts = ranks.value_counts(ev, ["value", "user_id"])
    nulls = spark.createDataFrame([(None, 1.0, 3), (None, 2.0, 1), ("x", 1.0, 2)], "column string, value double, n long")
    for table in (counts, nulls):
        w = Window.partitionBy("column").orderBy("value")
        want = table.select("column", "value", (F.sum("n").over(w) - F.col("n")).alias("c"), F.sum("n").over(Window.partitionBy("column")).alias("t"))
        got = ranks.cumulative_counts(table, ["column"]).select("column", "value", "cum_before", "total")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_row_positions_number_every_row(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.lit(7).alias("v"))
    at = ranks.row_positions(df, ["k"], ["v"], "at").collect()
    for k in range(3):
        assert sorted(r["at"] for r in at if r["k"] == k) == list(range(sum(r["k"] == k for r in at)))


def test_exact_quantiles_equal_percentile(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cols = ["l_quantity", "l_extendedprice"]
    q = P.quantile_table(li, cols, [0.1, 0.25, 0.5, 0.9], ["a", "b", "c", "d"]).collect()
    ref = li.agg(*[F.percentile(c, [0.1, 0.25, 0.5, 0.9]).alias(c) for c in cols]).first()
    for r in q:
        for got, want in zip([r.a, r.b, r.c, r.d], ref[r.column]):
            assert got == pytest.approx(want, rel=1e-12)


def test_tail_probabilities_known_values(spark):
    row = spark.range(1).select(
        dist.t_two_sided_p(2.1, 7.0).alias("t"),
        dist.chi2_sf(6.0, 2.0).alias("c"),
        dist.norm_two_sided_p(1.959963984540054).alias("z"),
        dist.f_sf(1.0, 1.0, 1e9).alias("f")).first()
    assert row.c == pytest.approx(math.exp(-3), rel=1e-12)
    assert row.z == pytest.approx(0.05, rel=1e-9)
    assert row.t == pytest.approx(0.0738711962129229, rel=1e-9)
    assert row.f == pytest.approx(0.3173105078629141, rel=1e-6)


def test_fmt_g_matches_python(spark):
    vals = [0.0123, 1.23456e-7, 0.999999, 123456.0, 9999.5, 1e-300, 3.0, 0.00099996, 2.2e-16]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.s for r in df.select(fmt_g(F.col("x")).alias("s")).collect()]
    assert got == ["%.4g" % v for v in vals]


def test_profile_guards_micro_table(spark):
    df = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (None, None)], "x double, c string")
    p = P.numeric_profile(df, ["x"]).first()
    assert p["count"] == 2 and p["missing_count"] == 1
    assert p["skewness"] is None and p["kurtosis"] is None  # n <= 2 / n <= 3
    assert p["lower_fence"] is None and p["outlier_count_iqr"] == 0  # <= 2 distinct
    assert p["normality_hint"] == P.HINT_FEW
    c = P.categorical_profile(df).first()
    assert c["unique_count"] == 1 and c["concentration_score"] == 1.0


def test_grouped_test_guards(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (3.0, "a")], "x double, g string")
    assert H.welch_t_test(df, "x", "g").first()["valid"] is False
    assert H.kruskal(df, "x", "g").first()["valid"] is False
    assert A.pearson_test(df.limit(2), "x", "x").first()["valid"] is False


def test_mann_whitney_matches_pandas_formula(spark):
    pdf = pd.DataFrame({"x": [1, 2, 2, 3, 4, 4, 4, 5, 6, 7, 8, 8], "g": list("aabababbabab")})
    df = spark.createDataFrame(pdf)
    r = H.mann_whitney(df, "x", "g").first()
    ranks_ = pdf["x"].rank()
    r1 = ranks_[pdf.g == "a"].sum()
    n1 = (pdf.g == "a").sum()
    assert r["statistic"] == pytest.approx(r1 - n1 * (n1 + 1) / 2)


def test_chi_square_invariants(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ct = A.crosstab(li, "l_returnflag", "l_linestatus")
    tot = ct.agg(F.sum("observed"), F.sum("expected")).first()
    assert tot[0] == pytest.approx(tot[1])


def test_top_k_with_a_hot_key_matches_a_plain_window(spark):
    from pyspark.sql import Window
    from quarry.operators.topk import top_k
    rows = [("hot", i % 997, i) for i in range(20000)] + [(f"k{j}", j, j) for j in range(50)]
    df = spark.createDataFrame(rows, "key string, v long, id long")
    order = [F.col("v").desc(), F.col("id").asc()]
    got = top_k(df, ["key"], order, 5).select("key", "id", "rank")
    w = Window.partitionBy("key").orderBy(*order)
    want = df.withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("key", "id", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_two_valued_screen(spark):
    from quarry.operators.roles import two_valued
    df = spark.createDataFrame([(1, 5.0, 7, None), (2, 5.0, 9, None), (1, 5.0, 7, None)],
                               "a int, b double, c int, d double")
    assert two_valued(df, ["a", "b", "c", "d"]) == {"a": 2, "b": 1, "c": 2, "d": 0}


def test_exact_split_size(spark, sf_dir):
    from quarry.operators import model as M
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    n = o.count()
    sp = M.split(o, ["o_orderkey"], test_size=0.25)
    assert sp.filter("is_test").count() == math.ceil(n * 0.25)


def test_too_many_classes_is_refused(spark, sf_dir):
    from quarry.operators import model as M
    with pytest.raises(ValueError):
        M.MAX_CLASSES = 3
        try:
            M.fit_model(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_brand", ["p_size"], "decision_tree",
                        key=["p_partkey"])
        finally:
            M.MAX_CLASSES = 1000


def test_chi_square_matches_the_full_grid(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    for shape, yates in (((5, 40), True), ((2, 2), True), ((2, 2), False)):
        o = rng.integers(0, 9, shape)
        o[0, 0] = 0
        o[:, 0] += np.arange(shape[0])
        rows = [(f"a{i}", f"b{j}") for i in range(shape[0]) for j in range(shape[1]) for _ in range(o[i, j])]
        r = A.chi_square(spark.createDataFrame(rows, "a string, b string"), "a", "b", yates=yates).first()
        o = o[o.sum(1) > 0][:, o.sum(0) > 0]
        e = o.sum(1)[:, None] * o.sum(0)[None] / o.sum()
        d = np.abs(o - e)
        chi2 = ((np.maximum(d - 0.5, 0) if yates and o.shape == (2, 2) else d) ** 2 / e).sum()
        assert r.chi2 == pytest.approx(chi2, rel=1e-9) and r.min_expected == pytest.approx(e.min())
        assert r.low_expected_cells == (e < 5).sum() and r.sparse_cells == (o <= 1).sum()


def test_frequency_ranks_are_dense_and_count_descending(spark, sf_dir):
    f = P.frequency_table(spark.read.parquet(f"{sf_dir}/part.parquet"), ["p_brand"]).orderBy("rank").collect()
    assert [r["rank"] for r in f] == list(range(1, len(f) + 1))
    for x, y in zip(f, f[1:]):
        assert x["count"] > y["count"] or (x["count"] == y["count"] and x["value"] < y["value"])


def test_streaming_moments_match_batch(spark, sf_dir):
    from quarry.sources.io import scratch_path
    from quarry.streaming.moments import run_available_now
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = scratch_path(spark, "stream-test-src")
    ev.write.parquet(src)
    out = run_available_now(spark, src, ev.schema, scratch_path(spark, "stream-test-sink"),
                            name=src.rsplit("/", 1)[-1])
    got = {(r["event_type"], r["window_start"]): r for r in out.collect()}
    want = (ev.groupBy(F.date_trunc("day", "ts").alias("d"), "event_type")
            .agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("value").alias("n")).collect())
    assert len(got) == len(want)
    for w in want:
        g = got[(w["event_type"], w["d"])]
        assert g["n"] == w["n"] and g["mean"] == pytest.approx(w["m"], rel=1e-9)
        if w["v"] is not None:
            assert g["variance"] == pytest.approx(w["v"], rel=1e-6, abs=1e-9)


def test_tail_probabilities_of_very_large_tables(spark):
    """Half of the mass lies above the mean, less 1 / (3 sqrt(pi k))."""
    for k in (1e4, 1e6, 1e7, 1e8, 1e9, 1e10):
        p = spark.range(1).select(dist.chi2_sf(k, k).alias("p"), dist.f_sf(1.0, k, k).alias("f")).first()
        assert p.p == pytest.approx(0.5 - 1 / (3 * math.sqrt(math.pi * k)), abs=1e-5 / math.sqrt(k))
        assert p.f == pytest.approx(0.5, abs=1e-9)


def test_split_is_exact_with_repeated_rows(spark, sf_dir):
    from quarry.operators import model as M
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_quantity", "l_returnflag")
    n = li.count()
    got = M.split(li, li.columns, 0.25)
    assert got.count() == n and got.filter("is_test").count() == math.ceil(n * 0.25)
    by = {r["l_returnflag"]: (r["n"], r["t"]) for r in M.split(li, li.columns, 0.25, stratify="l_returnflag")
          .groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert all(t == math.floor(n * 0.25 + 0.5) for n, t in by.values())
    folds = [r["count"] for r in M.fold_ids(li, li.columns, 7).groupBy("fold").count().collect()]
    assert len(folds) == 7 and max(folds) - min(folds) <= 1


def test_point_samples_draw_rows_not_values(spark, sf_dir):
    from quarry.operators import charts as K
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pts = K.scatter(li, "l_quantity", "l_discount", n=2000)
    assert pts.count() == 2000 and pts.distinct().count() > 0.7 * li.select("l_quantity", "l_discount").distinct().count()


def test_missing_and_nan_values(spark):
    from quarry.functions.text import compact_label
    from quarry.operators import clean as C
    from quarry.operators import quality as Q
    rows = [(float(i), float(i * i % 7), "a" if i % 2 else None) for i in range(20)] + [(float("nan"), 1.0, "a"), (None, 2.0, None)]
    df = spark.createDataFrame(rows, "x double, y double, c string")
    assert [r["zscore_outliers"] for r in Q.zscore_outliers(df, ["x"]).collect()] == [0]
    assert C.iqr_filter(df, ["x"])[0].count() == 22
    h = P.equal_width_histogram(df, "y", 5, by="c").collect()
    assert sum(r["count"] for r in h if r["c"] is None) == 11 and sum(r["count"] for r in h) == 22
    toks = spark.createDataFrame([("NA",), ("nan",), (" na ",), ("undefined",)], "t string")
    assert C.normalise_missing(toks, "api").filter("t is null").count() == C.normalise_missing(toks, "app").filter("t is null").count()
    labels = spark.createDataFrame([("x" * 42,), ("x" * 40 + "  yy",), ("",), (None,)], "t string").select(compact_label(F.col("t")).alias("l"))
    assert [r.l for r in labels.collect()] == ["x" * 42, "x" * 40 + "\u2026", "\u2014", "\u2014"]


def test_spearman_matrix_deletes_by_pair(spark):
    rows = [(1.0, 2.0, 1.0), (2.0, 1.0, None), (3.0, 4.0, 2.0), (4.0, 3.0, None), (5.0, 6.0, 3.0), (6.0, 5.0, 4.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    m = {(r["left"], r["right"]): (r["r"], r["n"]) for r in A.spearman_matrix(df, ["a", "b", "c"]).collect()}
    assert m[("a", "b")] == (pytest.approx(0.82857142857), 6) and m[("b", "a")][1] == 6
    assert m[("a", "c")] == (pytest.approx(1.0), 4) and m[("c", "c")] == (1.0, 4)


def test_spearman_matrix_ranks_columns_and_not_pairs(spark, monkeypatch):
    seen, count = [], ranks.cumulative_counts
    monkeypatch.setattr(ranks, "cumulative_counts", lambda c, *a, **k: seen.append(c.count()) or count(c, *a, **k))
    names = list("abcde")
    whole = spark.range(900).select(*[((F.col("id") * (7 + i)) % (30 + i)).cast("double").alias(c) for i, c in enumerate(names)])
    odd = whole.select("a", "b", "e", F.when(F.col("c") > 5, F.col("c")).alias("c"), F.when(F.col("d") % 3 != 0, F.col("d")).alias("d"), F.lit(None).cast("double").alias("none"))
    for limit in (A.BROADCAST_VALUES, 3):
        monkeypatch.setattr(A, "BROADCAST_VALUES", limit)
        for df in (whole, odd):
            want = df.toPandas().corr(method="spearman")
            for r in A.spearman_matrix(df, df.columns).collect():
                w = want.loc[r["left"], r["right"]]
                assert r["r"] == pytest.approx(1.0 if r["left"] == r["right"] else 0.0 if w != w else w, abs=1e-12)
    assert seen[0] == sum(30 + i for i in range(5))  # every column's values once


def test_readers(spark, tmp_path):
    from quarry.sources.io import read_table
    (tmp_path / "d.csv").mkdir()
    (tmp_path / "d.csv" / "1.csv").write_bytes("name,v\nJosé,1\n".encode("latin-1"))
    (tmp_path / "d.csv" / "2.csv").write_bytes("name,v\nZoë,2\n".encode())
    assert {r["name"] for r in read_table(spark, str(tmp_path / "d.csv")).collect()} == {"José", "Zoë"}
    (tmp_path / "q.csv").write_text('a,b\n"x\ny",1\n')
    assert [tuple(r) for r in read_table(spark, str(tmp_path / "q.csv"), multiline=True).collect()] == [("x\ny", 1)]
    (tmp_path / "n.json").write_text('{"id": 1, "items": [{"q": 1}]}\n{"id": 2, "items": [{"q": 2}, {"q": 3}]}\n')
    assert sorted(read_table(spark, str(tmp_path / "n.json")).columns) == ["id", "items"]
    (tmp_path / "o.json").write_text('{"rows": [{"q": 2}, {"q": 3}]}')
    assert [r["q"] for r in read_table(spark, str(tmp_path / "o.json")).collect()] == [2, 3]


def test_models_are_fitted_on_all_cores(spark):
    from quarry.operators import model as M
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(40000).coalesce(1)
    assert M._spread(rows, 40000).rdd.getNumPartitions() == min(40, cores)
    assert M._spread(rows, 150).rdd.getNumPartitions() == 1
    assert M._spread(rows, 10_000_000).rdd.getNumPartitions() == max(100, cores)
