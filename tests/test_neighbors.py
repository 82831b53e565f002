"""Exact nearest neighbours (M15) against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import model as M
from quarry.operators import neighbors as N


def brute(train, q, k):
    d = np.zeros(len(train))
    for i in range(train.shape[1]):
        e = q[i] - train[:, i]
        d += e * e
    order = np.lexsort((np.arange(len(train)), d))[:k]
    return [(int(i), float(np.sqrt(d[i]))) for i in order]


def found(spark, train, query, k, **options):
    t = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(train)], "id long, vec array<double>")
    q = spark.createDataFrame([([float(x) for x in v],) for v in query], "vec array<double>")
    return {tuple(r.vec): [(x.id, x.distance) for x in r.neighbours or []] for r in N.nearest(t, q, k, **options).collect()}


def clouds():
    rng = np.random.default_rng(0)
    grid = rng.integers(0, 6, (1500, 2)).astype(float)
    grid[:500] = 3  # a third of all rows are copies, and most distances tie
    far = np.concatenate([rng.normal(size=(300, 3)), rng.normal(size=(300, 3)) + 60, np.full((2, 3), 1e7)])
    return {"spread": (rng.normal(size=(1500, 4)), rng.normal(size=(100, 4))), "grid": (grid, grid[::5]), "far": (far, far[::4]), "few": (grid[:3], grid[:50])}


@pytest.mark.parametrize("name", ["spread", "grid", "far", "few"])
def test_equals_brute_force(spark, name):
    train, query = clouds()[name]
    got = found(spark, train, query, 5)
    for q in query:
        want, have = brute(train, q, 5), got[tuple(q)]
        assert [i for i, _ in have] == [i for i, _ in want]
        assert np.allclose([d for _, d in have], [d for _, d in want])


def test_blocks_that_no_query_reaches_are_not_compared(spark):
    rng = np.random.default_rng(1)
    train = np.concatenate([rng.normal(size=(400, 2)) + c for c in ((0, 0), (500, 0), (0, 500))])
    t = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(train)], "id long, vec array<double>")
    out = N.nearest(t, t.limit(100).select("vec"), 3)
    assert "CartesianProduct" not in out._jdf.queryExecution().toString() and "NestedLoopJoin" not in out._jdf.queryExecution().toString()


def test_nulls_empty_and_self(spark):
    kind = "id long, vec array<double>, label double"
    t = spark.createDataFrame([(1, [0.0], 1.0), (2, [1.0], 2.0), (3, [5.0], 9.0), (4, [None], 7.0), (5, None, 7.0), (6, [float("nan")], 7.0)], kind)
    got = {r.id: r.predicted for r in N.predict(t, t.select("id", "vec"), k=1, skip_self=True).collect()}
    assert got == {1: 2.0, 2: 1.0, 3: 2.0, 4: None, 5: None, 6: None}
    assert [r.neighbours for r in N.nearest(t.limit(0), t.where("id = 1"), 2).collect()] == [[]]


def test_fit_model_knn_equals_brute_force(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    orders = orders.withColumn("month", F.month("o_orderdate"))
    fit = M.fit_model(orders, "o_totalprice", ["o_custkey", "month"], "knn", key=["o_orderkey"])
    rows = M.split(orders, ["o_orderkey"]).select("o_custkey", "month", "o_totalprice", "is_test").toPandas()
    train, test = rows[~rows.is_test], rows[rows.is_test]
    x, z = (d[["o_custkey", "month"]].to_numpy(float) for d in (train, test))
    mean, std = x.mean(axis=0), x.std(axis=0)
    x, z = (x - mean) / std, (z - mean) / std
    want = []
    for q in z:  # rows tied at the fifth place make the mean ambiguous: skip those
        d = np.sort(((x - q) ** 2).sum(axis=1))
        if d[5] - d[4] > 1e-9:
            want.append(train.o_totalprice.to_numpy()[np.argsort(((x - q) ** 2).sum(axis=1))[:5]].mean())
    have = {round(r.predicted, 4) for r in fit.predictions.collect()}
    assert len(want) > 50 and all(round(w, 4) in have for w in want)
    assert set(fit.metrics.columns) == {"n", "mae", "rmse", "r2", "model"}


def test_fit_model_knn_classifier(spark):
    df = spark.range(600).select("id", (F.col("id") % 50 + F.when(F.col("id") % 2 == 0, 0).otherwise(200)).cast("double").alias("x"),
                                 F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("y"))
    fit = M.fit_model(df, "y", ["x"], "knn", key=["id"])
    assert fit.metrics.first()["accuracy"] == 1.0 and set(fit.predictions.columns) == {"actual", "predicted", "score"}


def test_cells_grow_with_the_table(spark, monkeypatch):
    points = np.random.default_rng(2).normal(size=(20000, 2))
    points[:3000] = 0.5  # copies cannot be cut
    tree = N._Tree(points)
    sizes = np.bincount(tree.cell(points), minlength=tree.cells)
    assert tree.cells > 2000 and sizes.min() > 0 and np.sort(sizes)[-2] <= N.PER_LEAF
    train, query = clouds()["grid"]
    assert N._Tree(np.zeros((0, 2))).cells == 1
    got = found(spark, train, np.concatenate([query, [[90.0, 90.0]]]), 5, cell=12)
    for q in [*query, (90.0, 90.0)]:
        assert [i for i, _ in got[tuple(q)]] == [i for i, _ in brute(train, np.array(q), 5)]
