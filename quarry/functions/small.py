"""Tests on few rows: Shapiro-Wilk for 8 to 19 values (T7) and the exact distribution of Mann-Whitney's U (T5).

Shapiro-Wilk follows Royston (1995): weights from the expected normal order statistics, corrected at
both ends by polynomials in n ** -1/2, and a normal transformation of W.  They are column expressions over a
sorted array of at most 19 values.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SMALLEST, LARGEST = 8, 19
# Royston's polynomials, constant term first.
END = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
NEXT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
MEAN_FEW, SPREAD_FEW = (0.5440, -0.39978, 0.025054, -6.714e-4), (1.3822, -0.77857, 0.062767, -0.0020322)
MEAN_MORE, SPREAD_MORE = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)
GAMMA = (-2.273, 0.459)


def weights(n: int) -> list[float]:
    """The weights of the n sorted values (n at least 6), antisymmetric, squares summing to 1."""
    m = [NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    square, u = sum(x * x for x in m), 1 / math.sqrt(n)
    value = lambda c: sum(a * u ** k for k, a in enumerate(c))
    last, second = m[-1] / math.sqrt(square) + value(END), m[-2] / math.sqrt(square) + value(NEXT)
    inner = math.sqrt((square - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last ** 2 - 2 * second ** 2))
    return [-last, -second, *(x / inner for x in m[2:-2]), second, last]


def _poly(x: Column, c: tuple[float, ...]) -> Column:
    out = F.lit(c[-1])
    for a in reversed(c[:-1]):
        out = out * x + F.lit(a)
    return out


def shapiro_w(values: str) -> Column:
    """W of a sorted array column of SMALLEST to LARGEST values (null otherwise, and for equal values)."""
    table = F.create_map(*[x for n in range(SMALLEST, LARGEST + 1) for x in (F.lit(n), F.array(*[F.lit(w) for w in weights(n)]))])
    add = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)
    mean = F.try_divide(add(F.col(values)), F.size(values))
    # centred first: the weights sum to 0, so the numerator stays the same
    top = add(F.zip_with(values, table[F.size(values)], lambda x, w: (x - mean) * w))
    below = add(F.transform(values, lambda x: (x - mean) * (x - mean)))
    return F.when(F.size(values).between(SMALLEST, LARGEST) & (below > 0), F.least(F.lit(1.0), F.try_divide(top * top, below)))


def shapiro_z(w: Column, n: Column) -> Column:
    """Royston's normal deviate of W; large ones speak against normality."""
    n = n.cast("double")
    rest, log_n = F.log(1 - w), F.log(n)
    few = (-F.log(_poly(n, GAMMA) - rest) - _poly(n, MEAN_FEW)) / F.exp(_poly(n, SPREAD_FEW))
    more = (rest - _poly(log_n, MEAN_MORE)) / F.exp(_poly(log_n, SPREAD_MORE))
    return F.when(w >= 1, F.lit(-40.0)).when(n <= 11, F.when(rest >= _poly(n, GAMMA), F.lit(40.0)).otherwise(few)).otherwise(more)


def u_two_sided_p(u: float, n1: int, n2: int) -> float:
    """The exact two-sided p of U without ties: twice the share of all arrangements whose U is at least max(u, n1 n2 - u).

    The arrangements with a given U are the coefficients of prod (1 - x^(n + i)) / (1 - x^i), i = 1..m, for the smaller
    group m: one division (a running sum with stride i) and one multiplication (a shifted difference) for each of its rows."""
    m, n = sorted((n1, n2))
    tail = int(min(u, n1 * n2 - u))  # by symmetry: arrangements with U of at most this
    ways = np.zeros(tail + 1)
    ways[0] = 1.0
    for i in range(1, m + 1):
        if n + i <= tail:
            ways[n + i:] -= ways[:tail + 1 - n - i].copy()
        for start in range(min(i, tail + 1)):
            ways[start::i] = np.cumsum(ways[start::i])
        ways /= (n + i) / i  # shares of all arrangements, so that nothing overflows
    return float(min(1.0, 2 * ways.sum()))
