"""Shapiro-Wilk and the exact Mann-Whitney distribution against published values and enumeration."""

from itertools import combinations

import pytest

from quarry.functions import small
from quarry.operators import hypothesis as H
from quarry.operators import model as M

# weights of eleven men in pounds, as in Shapiro and Wilk (1965)
MEN = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]


def one(spark, values):
    return H.normality(spark.createDataFrame([(float(v),) for v in values], "x double"), "x").first()


def test_published_example(spark):
    r = one(spark, MEN)
    assert r.statistic == pytest.approx(0.78881, abs=5e-6) and r.p_value == pytest.approx(0.006704, abs=2e-6)
    assert r.valid and r.interpretation == "departure" and r.z_skew is None


def test_weights():
    for n in range(8, 20):
        w = small.weights(n)
        assert sum(x * x for x in w) == pytest.approx(1) and sum(w) == pytest.approx(0, abs=1e-12) and w == sorted(w)


def test_shift_scale_and_size_limits(spark):
    base = [0.1, 0.5, 0.9, 1.4, 2.2, 2.3, 3.1, 4.8, 5.0, 5.5, 7.1, 8.8, 9.4]
    a, b = one(spark, base), one(spark, [1e6 - 3 * x for x in base])
    assert a.statistic == pytest.approx(b.statistic, rel=1e-9) and a.p_value == pytest.approx(b.p_value, rel=1e-6)
    assert one(spark, base[:7]).interpretation == "needs_8_rows" and not one(spark, base[:7]).valid
    assert one(spark, base[:8]).valid and one(spark, base + base[:6]).z_skew is None and one(spark, base + base[:7]).z_skew is not None
    assert one(spark, [3.0] * 9).interpretation == "needs_two_values" and one(spark, []).valid is False


def test_exact_u_by_enumeration():
    for n1, n2 in ((1, 1), (1, 7), (2, 3), (4, 4), (3, 9), (6, 5)):
        us = [sum(c) - n1 * (n1 - 1) // 2 for c in combinations(range(n1 + n2), n1)]
        for u in set(us):
            want = min(1.0, 2 * sum(x >= max(u, n1 * n2 - u) for x in us) / len(us))
            assert small.u_two_sided_p(u, n1, n2) == pytest.approx(want, abs=1e-12)
            assert small.u_two_sided_p(n1 * n2 - u, n2, n1) == pytest.approx(want, abs=1e-12)
    assert small.u_two_sided_p(0, 8, 2000) == pytest.approx(2 / 4.0644e21, rel=0.02)  # 2 / C(2008, 8)


def test_mann_whitney_is_exact_only_without_ties(spark):
    rows = [("a", 1.0), ("a", 2.5), ("a", 4.0), ("b", 3.0), ("b", 5.0), ("b", 6.0), ("b", 7.0)]
    r = H.mann_whitney(spark.createDataFrame(rows, "g string, x double"), "x", "g").first()
    assert r.statistic == 1 and r.p_value == pytest.approx(4 / 35)
    tied = H.mann_whitney(spark.createDataFrame([*rows, ("a", 3.0)], "g string, x double"), "x", "g").first()
    assert tied.p_value != pytest.approx(small.u_two_sided_p(tied.statistic, 4, 4))


def test_rows_without_a_score_are_left_out(spark):
    rows = [("1", 0.9), ("0", 0.2), ("1", 0.6), ("0", 0.7), ("1", None), (None, 0.5), ("0", float("nan"))]
    df = spark.createDataFrame(rows, "actual string, score double")
    a = M.auc(df).first()
    assert (a.positives, a.negatives, a.roc_auc) == (2, 2, 0.75)
    assert M.roc(df).count() == 5 and M.roc(df.where("score is not null and actual is not null")).count() == 5
