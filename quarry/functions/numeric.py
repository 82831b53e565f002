"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sig(c: Column | str, digits: int = 7) -> Column:
    """Round to ``digits`` significant digits, half-even, NaN -> null, -0 -> 0.

    Written as integer rounding of ``x * 10**s`` so that a SQL engine doing the
    same IEEE steps lands on the same double (used for result comparison).
    """
    x = as_col(c).cast("double")
    s = F.lit(digits - 1) - F.floor(F.log10(F.abs(x)))
    up = F.rint(x * F.pow(F.lit(10.0), s)) / F.pow(F.lit(10.0), s)
    down = F.rint(x / F.pow(F.lit(10.0), -s)) * F.pow(F.lit(10.0), -s)
    out = F.when(s >= 0, up).otherwise(down) + F.lit(0.0)
    return (F.when(x.isNull() | F.isnan(x), F.lit(None).cast("double"))
            .when(x == 0, F.lit(0.0)).otherwise(out))


def dec(c: Column | str, places: int = 8) -> Column:
    """Round to fixed decimal places, half-even, NaN -> null (p-values)."""
    x = as_col(c).cast("double")
    scale = float(10 ** places)
    out = F.rint(x * F.lit(scale)) / F.lit(scale) + F.lit(0.0)
    return F.when(x.isNull() | F.isnan(x), F.lit(None).cast("double")).otherwise(out)


def nan_to_null(c: Column | str) -> Column:
    x = as_col(c)
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def safe_pct(a: Column | str, b: Column | str) -> Column:
    """a / b * 100, 0 when b is 0 (reference percent helper)."""
    a, b = as_col(a), as_col(b)
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b * 100.0)


def adjusted_skewness(g1: Column, n: Column) -> Column:
    """Bias-adjusted G1 from Spark's population skewness; needs n > 2."""
    n = n.cast("double")
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(g2: Column, n: Column) -> Column:
    """Bias-adjusted excess kurtosis G2 from Spark's population kurtosis; n > 3."""
    n = n.cast("double")
    return F.when(n > 3, ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)))


def sample_moment_skewness(g1: Column, n: Column) -> Column:
    """Browser variant: mean of z^3 with the sample std."""
    n = n.cast("double")
    return g1 * F.pow((n - 1) / n, 1.5)


def sample_moment_kurtosis(g2: Column, n: Column) -> Column:
    """Browser variant: mean of z^4 with the sample std, minus 3."""
    n = n.cast("double")
    return (g2 + 3) * F.pow((n - 1) / n, 2) - 3


def is_missing(c: Column | str, floating: bool) -> Column:
    """Null, or NaN for floating columns (pandas counts NaN as missing)."""
    x = as_col(c)
    return (x.isNull() | F.isnan(x)) if floating else x.isNull()
