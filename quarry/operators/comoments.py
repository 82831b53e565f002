"""Correlation matrices of many columns (A3/K7): masked co-moments in blocks of columns.

Each task turns its rows into one matrix of values (missing ones 0) and one of
marks, and a product of two column blocks gives the pairwise counts, sums, squares and products of
all their pairs at once.  Blocks are added up by Spark, pair by pair, so nothing larger than
a block of pairs is ever in one place, and 200 columns cost 16 block products a batch instead of 20,000 aggregates.

Values are shifted by one of the column's own values near its mean, which keeps the sums of squares
small and makes a constant column's moments exactly zero.  An infinite value makes the
correlations of the pairs it takes part in undefined (null), as an undefined variance does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a block; rows multiplied at once; share of the squares below which a variance is rounding noise.
WIDTH, ROWS, NOISE = 64, 4096, 1e-13
_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy", "bad")


def _blocks(shift: np.ndarray, width: int):
    """Batches to one row per pair of columns (i <= j) and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(shift)
        spans = [(a, min(k, a + width)) for a in range(0, k, width)]
        total = {(p, q): np.zeros((len(_SUMS), spans[p][1] - spans[p][0], spans[q][1] - spans[q][0])) for p in range(len(spans)) for q in range(p, len(spans))}
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns], axis=1) - shift
                mark = ~np.isnan(x)
                wild = np.isinf(x)
                some = bool(wild.any())
                x = np.where(mark & ~wild, x, 0.0)
                m, w, xx = mark.astype(float), wild.astype(float), x * x
                for (p, q), t in total.items():
                    i, j = slice(*spans[p]), slice(*spans[q])
                    t[0] += m[:, i].T @ m[:, j]
                    t[1] += x[:, i].T @ m[:, j]
                    t[2] += m[:, i].T @ x[:, j]
                    t[3] += xx[:, i].T @ m[:, j]
                    t[4] += m[:, i].T @ xx[:, j]
                    t[5] += x[:, i].T @ x[:, j]
                    if some:
                        t[6] += w[:, i].T @ m[:, j] + m[:, i].T @ w[:, j]
        for (p, q), t in total.items():
            i, j = np.meshgrid(np.arange(*spans[p]), np.arange(*spans[q]), indexing="ij")
            keep = i <= j
            yield pa.RecordBatch.from_arrays([pa.array(i[keep].astype(np.int32)), pa.array(j[keep].astype(np.int32)), *(pa.array(v[keep]) for v in t)], names=["i", "j", *_SUMS])
    return run


def pair_moments(df: DataFrame, columns: list[Column], width: int = WIDTH, centred: bool = False) -> DataFrame:
    """(i, j, n, r) for every pair i <= j of ``columns`` (doubles), over the rows that have both values.
    ``centred`` columns have a mean near 0 and need no shifts (one look at the rows less)."""
    names = [f"c{i}" for i in range(len(columns))]
    x = df.select(*[c.cast("double").alias(n) for c, n in zip(columns, names, strict=True)])
    head = None if centred else x.limit(1000).toArrow()  # only to choose the shifts
    shift = [0.0] * len(names) if centred else []
    for n in names[len(shift):]:
        v = head.column(n).to_numpy().astype(float)
        v = v[np.isfinite(v)]
        shift.append(float(v[np.abs(v - v.mean()).argmin()]) if len(v) else 0.0)
    kind = "i int, j int, " + ", ".join(f"{s} double" for s in _SUMS)
    s = x.mapInArrow(_blocks(np.array(shift), width), kind).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in _SUMS])

    def spread(square: str, total: str) -> Column:
        v = F.col(square) - F.try_divide(F.col(total) * F.col(total), F.col("n"))
        return F.when(v > NOISE * F.col(square), v)

    cov = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n"))
    r = F.when(F.col("bad") == 0, cov / F.sqrt(spread("sxx", "sx") * spread("syy", "sy")))
    return s.select("i", "j", F.col("n").cast("long").alias("n"), F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))
