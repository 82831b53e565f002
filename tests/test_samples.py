"""W11 samples and blocked correlations (A3)."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quarry.operators import assoc as A
from quarry.operators import charts as K


def test_sample_is_the_same_after_repartitioning_and_draws_copies_one_by_one(spark):
    rows = [("hot", 1.0, 2.0)] * 900 + [(f"k{i}", float(i), float(i % 7)) for i in range(1800)]
    df = spark.createDataFrame(rows, "name string, x double, y double")
    draw = lambda d: sorted(map(tuple, K.hash_sample(d, 600).collect()))
    first = draw(df)
    assert first == draw(df.repartition(7)) == draw(df.orderBy("y").coalesce(1))
    hot = sum(r[0] == "hot" for r in first)
    assert len(first) == 600 and 150 < hot < 250  # about a third, as in the data
    for fn in (lambda d: K.scatter(d, "x", "y", n=200), lambda d: K.line(d, "x", "y", n=200), lambda d: K.scatter_matrix(d, 200),
               lambda d: K.scatter_3d(d, "x", "y", "x", 200).toDF("a", "b", "c"), lambda d: K.missing_heatmap(d, 50)):
        assert sorted(map(tuple, fn(df).collect())) == sorted(map(tuple, fn(df.repartition(5)).collect()))
    assert K.hash_sample(df.limit(0), 5).collect() == []
    assert K.missing_heatmap(df, 50).count() == 150


def test_very_many_copies_are_numbered_in_blocks(spark):
    df = spark.range(300000).select(F.lit(1).alias("a"))
    assert K.hash_sample(df, 1000).count() == 1000
    assert K.hash_sample(df, 1000, mark="m").select("m").distinct().count() == 1000


def test_correlations_of_200_columns_with_missing_values(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 200)) + rng.normal(size=(400, 1)) * rng.uniform(0, 2, 200) + 1e6 * (np.arange(200) % 3)
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7] = 5.0
    x[:, 8] = np.nan
    names = [f"c{i}" for i in range(200)]
    pdf = pd.DataFrame(x, columns=names)
    got = A.corr_matrix(spark.createDataFrame(pdf).repartition(3), names).toPandas()
    assert len(got) == 200 * 200
    r = got.pivot(index="left", columns="right", values="r").loc[names, names].to_numpy(float)
    n = got.pivot(index="left", columns="right", values="n").loc[names, names].to_numpy(float)
    mark = ~np.isnan(x)
    assert (n == mark.astype(int).T @ mark.astype(int)).all()
    want = pdf.corr().to_numpy()
    off = ~np.eye(200, dtype=bool) & ~np.isnan(want)
    assert np.allclose(r[off], want[off], atol=1e-7)
    assert np.isnan(r[7][np.arange(200) != 7]).all() and np.isnan(r[8][np.arange(200) != 8]).all() and (np.diag(r) == 1).all()


def test_correlations_with_infinity_and_pairwise_constants(spark):
    df = spark.createDataFrame([(1.0, 2.0, float("inf")), (2.0, 4.5, 1.0), (3.0, 6.0, 2.0), (4.0, None, 3.0), (None, 1.0, 9.0)], "a double, b double, c double")
    got = {(r.left, r.right): (r.r, r.n) for r in A.corr_matrix(df, ["a", "b", "c"], full=False).collect()}
    assert got["a", "c"] == (None, 4) and got["a", "b"][1] == 3 and abs(got["a", "b"][0] - np.corrcoef([1, 2, 3], [2, 4.5, 6])[0, 1]) < 1e-12
    same = spark.createDataFrame([(0.1, 1.0), (0.1, 2.0), (0.1, 5.0), (7.3, None)], "a double, b double")
    assert A.corr_matrix(same, ["a", "b"], full=False).first()["r"] is None
    assert A.corr_matrix(df, ["a"], full=False).collect() == [] and A.corr_matrix(df, ["a"]).collect()[0]["n"] == 4


def test_typing_variants(spark):
    from quarry.operators import clean as C
    rows = [(str(i), "yes" if i % 2 else "no", f"2024-01-{i % 28 + 1:02d}", f"free text {i}", "a" if i % 3 else "b", i % 4, bool(i % 2), None) for i in range(60)]
    df = spark.createDataFrame(rows, "n string, flag string, day string, note string, two string, level int, b boolean, none string")
    got = lambda mode: sorted(map(tuple, C.column_groups(df, mode).collect()))
    assert dict(got("browser")) == {"n": "numeric", "flag": "binary", "day": "datetime", "note": "text", "two": "binary", "level": "numeric", "b": "binary", "none": "text"}
    assert dict(got("api")) == {"n": "categorical", "flag": "boolean", "day": "categorical", "note": "categorical", "two": "boolean", "level": "numeric", "b": "boolean", "none": "categorical"}
    chat = got("chat")
    assert ("day", "datetime") in chat and ("level", "numeric") in chat and ("level", "categorical") in chat and ("n", "categorical") in chat and ("day", "categorical") not in chat
    few = C.column_groups(df.limit(5), "browser")
    assert dict(map(tuple, few.collect()))["note"] == "categorical"
