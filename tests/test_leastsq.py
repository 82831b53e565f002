"""Least squares by a tall-skinny QR against numpy's on the same rows."""

import numpy as np
import pandas as pd
import pytest

from quarry.operators import assoc as A
from quarry.operators import leastsq
from quarry.operators import model as M


def data(n=5000):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 4)) * [1, 100, 1e-3, 5] + [0, 1e6, 3, -7]
    y = 4 + x @ [2.0, -0.03, 50.0, 0.0] + rng.normal(size=n)
    return pd.DataFrame(np.column_stack((x, y)), columns=["a", "b", "c", "d", "y"])


def test_coefficients_and_errors(spark):
    pdf = data()
    df = spark.createDataFrame(pdf).repartition(37)  # several levels of the tree
    coef, fit = M.ols(df, "y", ["a", "b", "c", "d"])
    got = {r.term: r for r in coef.collect()}
    x = np.column_stack((np.ones(len(pdf)), pdf[["a", "b", "c", "d"]]))
    beta, *_ = np.linalg.lstsq(x, pdf.y.to_numpy(), rcond=None)
    res = pdf.y.to_numpy() - x @ beta
    s2 = res @ res / (len(pdf) - 5)
    _, r = np.linalg.qr(x)
    se = np.sqrt(s2 * (np.linalg.inv(r) ** 2).sum(axis=1))
    for i, t in enumerate(["const", "a", "b", "c", "d"]):
        assert got[t].coefficient == pytest.approx(beta[i], rel=1e-6, abs=1e-8) and got[t].std_error == pytest.approx(se[i], rel=1e-6)
    one = fit.first()
    assert one.n == len(pdf) and one.r2 == pytest.approx(1 - res @ res / ((pdf.y - pdf.y.mean()) ** 2).sum()) and one.residual_std == pytest.approx(np.sqrt(s2))


def test_collinear_predictors_are_named(spark):
    pdf = data(500)
    pdf["e"], pdf["k"] = pdf.a * 2 - pdf.d, 0.1
    df = spark.createDataFrame(pdf)
    with pytest.raises(leastsq.Collinear) as e:
        M.ols(df, "y", ["a", "b", "d", "e", "k"])
    assert "k" in e.value.columns and len(set(e.value.columns) & {"a", "d", "e"}) == 1 and "b" not in e.value.columns
    assert all(c in str(e.value) for c in e.value.columns)
    vif = {r.feature: r.VIF for r in A.vif_table(df, ["a", "b", "d", "e", "k"]).collect()}
    assert all(np.isinf(vif[c]) for c in "adek") and vif["b"] == pytest.approx(1, abs=0.05)


def test_nearly_collinear_is_not_refused(spark):
    pdf = data(2000)
    pdf["e"] = pdf.a + pdf.d + np.random.default_rng(3).normal(size=2000) * 1e-4
    vif = {r.feature: r.VIF for r in A.vif_table(spark.createDataFrame(pdf), ["a", "d", "e"]).collect()}
    for c in "ade":
        others = np.column_stack([np.ones(2000)] + [pdf[o] for o in "ade" if o != c])
        res = pdf[c] - others @ np.linalg.lstsq(others, pdf[c].to_numpy(), rcond=None)[0]
        assert vif[c] == pytest.approx(((pdf[c] - pdf[c].mean()) ** 2).sum() / (res ** 2).sum(), rel=1e-4)


def test_guards(spark):
    df = spark.createDataFrame(data(11))
    with pytest.raises(ValueError, match="at least 10"):
        M.ols(df.limit(5), "y", ["a"])
    with pytest.raises(ValueError, match="constant"):
        M.ols(df.withColumn("y", df.a * 0), "y", ["a"])
    assert A.vif_table(df, ["a"]).collect() == [] and A.vif_table(df.limit(0), ["a", "b"]).collect() == []


def test_cross_validation_in_one_pass_equals_separate_fits(spark):
    pdf = data(600)
    pdf["g"] = [("u", "v", "w")[i % 3] for i in range(600)]
    pdf["fold"] = [(i * 7) % 5 for i in range(600)]
    pdf["y"] += (pdf.g == "v") * 3
    got = {r.fold: r.score for r in M.cross_validate(spark.createDataFrame(pdf).repartition(6), "y", ["a", "b", "d", "g"], fold="fold").collect()}
    x = np.column_stack((np.ones(600), pdf[["a", "b", "d"]], *((pdf.g == v).astype(float) for v in "vw")))
    y = pdf.y.to_numpy()
    for f in range(5):
        test = (pdf.fold == f).to_numpy()
        beta, *_ = np.linalg.lstsq(x[~test], y[~test], rcond=None)
        e = y[test] - x[test] @ beta
        assert got[f] == pytest.approx(1 - e @ e / ((y[test] - y[test].mean()) ** 2).sum(), rel=1e-6)
