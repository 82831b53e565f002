"""Bounded summaries give what exact counting gives; sketches merge within their error."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import profile as P
from quarry.operators import quality as Q
from quarry.operators import screen as S
from quarry.operators import sketches as K
from quarry.plans import fixtures as FX


def exact_top(df, columns, k):
    rows = P.value_hist(df, columns).where("value is not null").collect()
    out = []
    for c in columns:
        own = sorted(((-r.n, r.value) for r in rows if r.column == c))[:k]
        out += [(c, v, -n, i) for i, (n, v) in enumerate(own, 1)]
    return sorted(out)


def mixed(spark):
    rnd = random.Random(1)
    rows = [(f"u{i}", rnd.choice(["hot"] * 30 + [f"r{rnd.randint(0, 5000)}"] * 20), "one", None, rnd.choice("ab") if i % 9 else None, float(i % 21), "x" if i % 25 else f"y{i}") for i in range(6000)]
    return spark.createDataFrame(rows, "id string, skewed string, same string, none string, two string, v double, nearly string").repartition(5)


def test_top_values_are_exact_for_any_capacity(spark):
    df = mixed(spark)
    for capacity, ks in ((4, (1,)), (64, (3,)), (1024, (1, 3))):
        for k in ks:
            got = sorted(map(tuple, S.top_values(df, df.columns, k, capacity).collect()))
            assert got == exact_top(df, df.columns, k)
    assert S.top_values(df.limit(0), ["id"], 2).collect() == []


def test_bounds_hold(spark):
    df = mixed(spark)
    true = {(r.column, r.value): r.n for r in P.value_hist(df).collect()}
    seen = S.heavy_hitters(df, capacity=8).collect()
    assert all(r.low <= true[r.column, r.value] <= r.low + r.lost for r in seen if r.value is not None)
    listed, lost = {(r.column, r.value) for r in seen}, {r.column: r.lost for r in seen if r.value is None}
    assert all(n <= lost[c] for (c, v), n in true.items() if v is not None and (c, v) not in listed)


@pytest.mark.parametrize("name", ["orders", "customer", "part", "lineitem", "events", "documents", "part_const", "orders_dup", "orders_text", "lineitem_nulls", "mixed"])
def test_flags_equal_the_exact_ones(spark, sf_dir, name):
    df = mixed(spark) if name == "mixed" else getattr(FX, name)(spark, sf_dir) if hasattr(FX, name) else spark.read.parquet(f"{sf_dir}/{name}.parquet")
    got = sorted(map(tuple, S.column_flags(df).collect()))
    assert got == sorted(map(tuple, Q.column_flags(Q.column_stats(df)).collect()))


def test_sketches_merge_within_their_error(spark, tmp_path):
    df = spark.range(60000).select((F.pmod(F.xxhash64("id"), F.lit(100000)) / 7.0).alias("x"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 100).alias("y"),
                                   F.lit(None).cast("double").alias("z"), (F.col("id") % 4).alias("part"))
    for p in range(4):
        K.add(K.sketch(df.where(F.col("part") == p).drop("part")), str(tmp_path / "s"))
    whole, one = K.stored(spark, str(tmp_path / "s")), K.sketch(df.drop("part"))
    assert {r.column: r.n for r in whole.collect()} == {"x": 60000, "y": 40000, "z": 0}
    data = df.select("x", "y").toPandas()
    for s in (whole, one):
        for r in K.quantiles(s, [0, 0.01, 0.25, 0.5, 0.9, 1]).collect():
            v = data[r.column].dropna().to_numpy()
            below, upto = (v < r.value).mean(), (v <= r.value).mean()
            assert below - 2 * K.rank_error() <= r.prob <= upto + 2 * K.rank_error()
            assert r.prob not in (0, 1) or r.value == (v.min() if r.prob == 0 else v.max())
    share = K.ranks(whole, "y", [49.0]).first().share
    assert abs(share - (data.y.dropna() <= 49).mean()) <= 2 * K.rank_error()
    by = K.sketch(df, ["x"], ["part"])
    assert by.count() == 4 and K.merge(by).first().n == 60000
    assert K.sketch(df.limit(0), ["x"]).first().n == 0


def test_flat_columns_are_counted_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(S, "ROWS", 64)
    df = spark.range(4000).selectExpr("id", "cast(if(id % 4 = 0, -1, id) as string) as mixed")
    counts = S._full_counts(df, ["id", "mixed"])
    at = counts.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count"), F.count("*")).first()
    assert at[0] < 200 and at[1] > 60
    assert S.top_values(df, ["id", "mixed"], 2, 8).where("column = 'mixed'").orderBy("rank").first()["count"] == 1000
