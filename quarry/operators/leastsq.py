"""Least squares by a tall-skinny QR.

Every task reduces its rows to the triangular factor of [1, X, y] (a square
matrix as wide as the columns, whatever the number of rows), and factors are stacked and factored again
up a tree.  One factor answers everything: the block behind its first column is the factor of the centred
predictors, its last column holds the right-hand side and its last entry the residual.  Normal equations
would square the condition number; this does not.

Dependent columns are found by a second, pivoted factorisation of the centred block with its columns
scaled to length one: a column whose remainder is below TOLERANCE is a combination of the ones before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows factored at once; relative length below which a column adds nothing.
ROWS, TOLERANCE = 4096, 1e-9


class Collinear(ValueError):
    """Predictors that are constant or combinations of others; ``columns`` names them."""

    def __init__(self, columns: list[str], among: list[str]):
        super().__init__(f"Predictors are collinear: {', '.join(columns)} {'is' if len(columns) == 1 else 'are'} constant or given by the others "
                         f"({', '.join(c for c in among if c not in columns)}). Remove duplicate or dependent predictors.")
        self.columns = columns


def _factor(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _shrink_groups(width: int):
    """Batches of (g int, x array<double>) to one factor for each group and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r: dict[int, np.ndarray] = {}
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                x = np.asarray(part.column("x").flatten().to_numpy(zero_copy_only=False), float).reshape(part.num_rows, width - 1)
                x, g = np.concatenate((np.ones((len(x), 1)), x), axis=1), part.column("g").to_numpy()
                for k in np.unique(g).tolist():
                    r[k] = _factor(np.concatenate((r.get(k, np.zeros((0, width))), x[g == k])))
        yield pa.RecordBatch.from_arrays([pa.array(list(r), pa.int32()), pa.array([x.tobytes() for x in r.values()], pa.binary())], names=["g", "r"])
    return run


def _stack_groups(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column("g").to_pylist(), b.column("r").to_pylist(), strict=True):
                r[k] = _factor(np.concatenate((r.get(k, np.zeros((0, width))), np.frombuffer(raw).reshape(-1, width))))
        yield pa.RecordBatch.from_arrays([pa.array(list(r), pa.int32()), pa.array([x.tobytes() for x in r.values()], pa.binary())], names=["g", "r"])
    return run


def group_factors(rows: DataFrame, width: int) -> dict[int, np.ndarray]:
    """The triangular factor of [1, x] for each of a few groups (g int, x array<double>), in one pass."""
    level = rows.mapInArrow(_shrink_groups(width), "g int, r binary").repartition("g").mapInArrow(_stack_groups(width), "g int, r binary")
    out: dict[int, np.ndarray] = {}
    for row in level.collect():  # one factor for each group
        out[row["g"]] = np.frombuffer(bytes(row["r"])).reshape(-1, width)
    return out


def fold_scores(factors: dict[int, np.ndarray]) -> dict[int, tuple[int, float]]:
    """(rows, R^2) of every fold under the least-squares fit of the others, from the folds' factors alone: the
    others' factors stacked give the fit, and the fold's own factor its squared errors and spread."""
    out = {}
    for f, own in factors.items():
        others = np.concatenate([r for g, r in factors.items() if g != f] or [np.zeros((1, own.shape[1]))])
        beta = np.linalg.lstsq(others[:, :-1], others[:, -1], rcond=None)[0]
        error = own @ np.append(-beta, 1.0)
        ends = _factor(own[:, [0, -1]])  # of [1, y]
        spread = float(ends[1, 1] ** 2) if len(ends) > 1 else 0.0
        out[f] = (int(round(float((own[:, 0] ** 2).sum()))), 1 - float(error @ error) / spread if spread > 0 else float("nan"))
    return out


def _shrink(width: int):
    """Batches of (x array<double>) to one factor for each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.column(0).slice(lo, ROWS)
                x = np.asarray(part.flatten().to_numpy(zero_copy_only=False), float).reshape(len(part), width - 1)
                r = _factor(np.concatenate((r, np.concatenate((np.ones((len(x), 1)), x), axis=1))))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.tobytes()], pa.binary())], names=["pid", "r"])
    return run


def _stack(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for b in batches:
            for raw in b.column("r").to_pylist():
                r = _factor(np.concatenate((r, np.frombuffer(raw).reshape(-1, width))))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.tobytes()], pa.binary())], names=["pid", "r"])
    return run


@dataclass
class Factor:
    """The triangular factor of [1, X, y] with a positive diagonal."""
    names: list[str]
    r: np.ndarray

    @property
    def n(self) -> int:
        return int(round(self.r[0, 0] ** 2))

    @property
    def centred(self) -> np.ndarray:
        k = len(self.names)
        return self.r[1:k + 1, 1:k + 1]

    @property
    def constant(self) -> np.ndarray:
        """Columns whose centred length is rounding noise of their values."""
        k = len(self.names)
        return np.sqrt((self.centred ** 2).sum(axis=0)) <= 1e-12 * np.maximum(np.sqrt((self.r[:k + 1, 1:k + 1] ** 2).sum(axis=0)), 1e-300)

    def dependent(self) -> list[str]:
        """Columns that are constant, or given by columns that keep a larger remainder."""
        k = len(self.names)
        c = self.centred.copy()
        length, constant = np.sqrt((c * c).sum(axis=0)), self.constant
        c = np.where(constant, 0.0, c / np.where(length > 0, length, 1.0))
        gone = [self.names[j] for j in np.flatnonzero(constant)]
        open_ = [j for j in range(k) if not constant[j]]
        while open_:
            rest = (c[:, open_] ** 2).sum(axis=0)
            best = int(np.flatnonzero(rest >= rest.max() * (1 - 1e-9))[0])  # of equal remainders the first column leads
            if rest[best] <= TOLERANCE ** 2:
                gone += [self.names[j] for j in open_]
                break
            j = open_.pop(best)
            q = c[:, j] / np.sqrt(rest[best])
            c -= np.outer(q, q @ c)
        return [x for x in self.names if x in gone]

    def inverse(self) -> np.ndarray:
        """(centred X' X) inverted, from the factor."""
        inv = np.linalg.solve(self.centred, np.eye(len(self.names)))
        return inv @ inv.T

    def vif(self) -> np.ndarray:
        """Variance inflation of every column: its squared length times its diagonal entry of the inverse.  Infinite for a
        constant column and for every column that takes part in a dependency, the others as if the dependent ones were left out."""
        dependent = self.dependent()
        free = [j for j, c in enumerate(self.names) if c not in dependent]
        out = np.full(len(self.names), np.inf)
        if not free:
            return out
        part = _factor(self.centred[:, free])
        inv = np.linalg.solve(part, np.eye(len(free)))
        out[free] = (part ** 2).sum(axis=0) * (inv ** 2).sum(axis=1)
        length = np.sqrt((self.centred ** 2).sum(axis=0))
        for j in (j for j, c in enumerate(self.names) if c in dependent and not self.constant[j]):
            # the combination of free columns that gives this one
            weight = np.linalg.lstsq(self.centred[:, free] / length[free], self.centred[:, j] / length[j], rcond=None)[0]
            out[[i for i, w in zip(free, weight, strict=True) if abs(w) > 1e-6]] = np.inf
        return out


def factor(rows: DataFrame, names: list[str]) -> Factor:
    """The factor of ``rows`` (one column: array<double> of the predictors and, last, the target)."""
    width = len(names) + 2
    level = rows.mapInArrow(_shrink(width), "pid int, r binary")
    level = level.repartition("pid").mapInArrow(_stack(width), "pid int, r binary")  # streamed: a task holds one factor at a time
    parts = [np.frombuffer(bytes(x["r"])).reshape(-1, width) for x in level.collect()]  # a factor for each shuffle partition at most
    r = _factor(np.concatenate([np.zeros((width, width)), *parts]))
    return Factor(names, r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None])
