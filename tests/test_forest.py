"""Regression forests grown from sums, against Spark ML's on the same rows."""
import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from quarry.operators import forest
from quarry.operators import model as M


@pytest.fixture(scope="module")
def rows(spark):
    """Numbers with many values, with few and with one, a text column with nulls, repeated rows, and a signal in all but the constant."""
    rng = np.random.default_rng(3)
    out = []
    for i in range(3000):
        x, few, word = float(rng.normal()), int(rng.integers(5)), ["a", "b", "c", "d", None][int(rng.integers(5))]
        out.append((i, x, few, 7, word, 3 * x + (few == 2) * 4 + {"a": 5, "b": -2}.get(word, 0) + float(rng.normal())))
    out += out[:50]
    return spark.createDataFrame(out, "id long, x double, few int, same int, word string, y double").repartition(3).cache()


def _coded(rows):
    prep = M.prepare(rows.withColumn("is_test", F.lit(False)), rows.withColumn("is_test", F.lit(False)), ["x", "few", "same", "word"])
    text = [f"{c}__idx" for c in prep.categorical]
    return prep, text, prep.data.select(*prep.numeric, *text, "features", F.col("y").alias("label"), "id")


def test_tree_equals_spark_ml(spark, rows):
    """With every row counted once, a tree is the one that Spark ML grows."""
    prep, text, data = _coded(rows)
    data = data.cache()
    cells = forest.Cells([*prep.numeric, *text], forest.bounds(data, prep.numeric), prep.levels)
    assert [len(e) for e in cells.edges] == [31, 4, 0]
    table = data.select(*cells.columns, "label").toArrow()
    code, y = cells.of(table.combine_chunks().to_batches()[0]), table.column("label").to_numpy()
    names, of = np.unique(code, return_inverse=True)
    sums = np.stack([np.bincount(of, v) for v in (np.ones_like(y), y, y * y)])
    for depth in (3, 30):
        tree = forest.grow(cells, names, sums, depth)
        got = forest._walk(cells, [tree[:4]], code)
        ml = DecisionTreeRegressor(maxDepth=depth, minInstancesPerNode=1).setFeaturesCol("features").setLabelCol("label").fit(data)
        want = np.array([r.prediction for r in ml.transform(data).select("prediction").collect()])
        assert np.allclose(got, want, rtol=1e-9)
        own = np.bincount(tree[0][tree[0] >= 0], tree[4][tree[0] >= 0], ml.numFeatures)
        # of two levels left in a node, either may be named: the same split
        assert np.allclose(own / own.sum(), ml.featureImportances.toArray(), atol=1e-9 if depth == 3 else 5e-3), (own / own.sum(), ml.featureImportances)


def test_draws(spark, rows):
    """Every row takes part in every tree, with counts of mean and variance 1; large tasks give their sums up in between."""
    prep, text, data = _coded(rows)
    cells = forest.Cells([*prep.numeric, *text], forest.bounds(data, prep.numeric), prep.levels)
    kind = "tree int, cell long, w double, wy double, wyy double"
    total = data.select(*cells.columns, "label").mapInArrow(forest._sums(cells, 40, 1, 0.0), kind).groupBy("tree").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy")).collect()
    assert len(total) == 40 and abs(np.mean([r.w for r in total]) / 3050 - 1) < 0.02 and np.std([r.w for r in total]) / 3050**0.5 == pytest.approx(1, abs=0.4)
    w = forest._draw(np.random.default_rng(5), (2000, 100))
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02) and (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)


def test_large_forests_are_grown_from_sums(spark, rows, monkeypatch):
    fits = {}
    for least in (M.FOREST_ROWS, 1):
        monkeypatch.setattr(M, "FOREST_ROWS", least)
        fits[least] = M.fit_model(rows, "y", ["x", "few", "same", "word"], "random_forest", key=["id"], trees=30)
    small, large = fits.values()
    assert isinstance(large.model, forest.Forest) and len(large.model.trees) == 30 and not isinstance(small.model, forest.Forest)
    a, b = small.metrics.first(), large.metrics.first()
    assert a[0] == b[0] and large.metrics.columns == small.metrics.columns and large.predictions.dtypes == small.predictions.dtypes
    assert b.r2 > 0.7 and b.r2 == pytest.approx(a.r2, abs=0.02)
    one, two = ({r.feature: r.importance for r in f.importance.collect()} for f in (small, large))
    assert set(one) == set(two) and all(abs(one[k] - two[k]) < 0.03 for k in one)
    monkeypatch.setattr(forest, "CELLS", 10)  # too many cells to be collapsed
    assert not isinstance(M.fit_model(rows, "y", ["x", "few", "word"], "random_forest", key=["id"], trees=2).model, forest.Forest)
