"""Counts shared by a dataset's tables, and moments by groups of columns."""
import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F

from quarry.operators import findings as R
from quarry.operators import profile as P
from quarry.operators import quality as Q
from quarry.operators import ranks
from quarry.operators.roles import numeric_columns

KIND = "big long, d double, f float, dec decimal(10,2), i int, flag boolean, day date, at timestamp, word string, none string, nothing double"


@pytest.fixture(scope="module")
def odd(spark):
    rows = []
    for i in range(400):
        big = 2**53 + i % 3 if i % 5 else -i
        d = [0.0, -0.0, float("nan"), None, float("inf"), 1e300, 0.1 * (i % 7)][i % 7]
        rows.append((big, d, [None, float("nan"), -0.0, 0.1, 0.0][i % 5], decimal.Decimal(i % 4) / 4, None if i % 6 == 0 else i % 2, [True, False, None][i % 3], dt.date(2020, 1, 1 + i % 9),
                     dt.datetime(2021, 3, 28, 1, 59, 59, (i % 4) * 1000) if i % 8 else None, [None, "", "a", "null", "-0.0"][i % 5], None, float("nan") if i % 2 else None))
    return spark.createDataFrame(rows + rows[:30], KIND).repartition(3).cache()


@pytest.mark.parametrize("scans", [1, 3, 20])
def test_typed_counts(odd, monkeypatch, scans):
    """The same rows as the text histogram and the numbers' own counts, however many columns share a scan."""
    monkeypatch.setattr(P, "SCANS", scans)
    got = P.typed_counts(odd)
    assert sorted(map(repr, got.select("column", F.col("text").alias("value"), "n").collect())) == sorted(map(repr, P.value_hist(odd).collect()))
    numbers = got.where("value is not null").groupBy("column", "value").agg(F.sum("n").alias("n"))
    assert sorted(map(repr, numbers.collect())) == sorted(map(repr, ranks.value_counts(odd, numeric_columns(odd)).collect()))
    assert P.typed_counts(odd.limit(0)).collect() == []


def test_moments_by_groups(odd, monkeypatch):
    names = numeric_columns(odd)
    want = None
    for together, scans in ((1, 20), (4, 8), (2, 1)):
        monkeypatch.setattr(P, "TOGETHER", together)
        monkeypatch.setattr(P, "SCANS", scans)
        got = sorted(repr([f"{x:.9g}" if isinstance(x, float) else x for x in r]) for r in P.moments(odd, names).collect())
        want = want or got
        assert got == want and len(got) == len(names)
    assert [r["rows"] for r in P.moments(odd.limit(0), names).collect()] == [0] * len(names)


def test_values_of_a_dataset_are_counted_once(odd, monkeypatch):
    """No table of a dataset counts the numbers again, and all get what their own counts would give."""
    df = odd.drop("d", "nothing")
    names = [c for c in numeric_columns(df) if c != "i"]  # i has two values
    own = {"outliers": sorted(map(tuple, R.unguarded_outliers(df, names).collect())), "profile": sorted(map(repr, P.numeric_profile(df).collect())),
           "stats": sorted(map(tuple, Q.column_stats(df).collect()))}
    calls = []
    count = ranks.value_counts
    monkeypatch.setattr(ranks, "value_counts", lambda df, columns, cast="double", *a, **k: (calls.append(columns) if cast == "double" else None, count(df, columns, cast, *a, **k))[1])
    monkeypatch.setattr(P, "value_hist", lambda df, *a: calls.append(df))
    rows = R.insights(df).collect()
    sh = R.Shared(df)
    assert sorted(map(tuple, R.unguarded_outliers(df, names, sh.cum).collect())) == own["outliers"]
    assert sorted(map(repr, sh.prof.collect())) == own["profile"] and sorted(map(tuple, sh.stats.collect())) == own["stats"]
    sh.release()
    assert calls == [] and {r.code for r in rows} >= {"rows", "columns", "completeness", "missing_hotspot", "outlier_hotspot"}
