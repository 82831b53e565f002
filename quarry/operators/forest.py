"""Regression forests of large tables (M14), grown from sums instead of rows.

A tree sees a row only through the bins of its numeric columns (BINS at most, as in Spark ML) and the levels of its
text columns, so all rows in the same cell go the same way in every tree.  Each task draws every row's Poisson(1)
count in every tree (the draws of Spark ML's bagging, by another generator) and adds up count, label and
squared label by tree and cell; Spark adds the tasks up, and each tree is grown from its cells' sums in one task.  What is
shuffled and held grows with cells and trees, not with rows; every row is drawn and counted in every tree.

Growth follows Spark ML: all features at every node, the split of largest variance gain (the first of equal ones), both sides not
empty, leaves where no split gains or at the depth limit; importances are gains weighted by rows, each tree's adding up to 1.
Bin bounds come from all training rows (Spark ML takes them from some 10,000 of them).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import ranks

#: Bins of a numeric column; cells and their possible combinations that a forest is grown from at most; (cells x trees) that a task holds; rows drawn at once; rows of a task.
BINS, CELLS, COMBINATIONS, HELD, ROWS, TASK_ROWS = 32, 1 << 15, 1 << 62, 1 << 21, 1 << 13, 1_000_000
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.array([1.0, *range(1, 21)])))


def bounds(train: DataFrame, numeric: list[str]) -> list[np.ndarray]:
    """Each column's bin bounds (a value up to the first goes to bin 0): halfway between neighbours, between all values where
    there are at most BINS, else where the rows are nearest to equal shares."""
    if not numeric:
        return []
    cum = ranks.cumulative_counts(ranks.value_counts(train, numeric), ["column"])
    at = F.col("cum_before") + F.col("n") / 2.0
    ends = [F.col("total") * (k / BINS) for k in range(1, BINS)]
    shares = cum.groupBy("column").agg(F.count(F.lit(1)).alias("d"), F.array(*[F.struct(
        F.max(F.when(at <= e, F.col("value"))).alias("lo"), F.min(F.when(at > e, F.col("value"))).alias("hi")) for e in ends]).alias("b"))
    shares = {r["column"]: r for r in shares.collect()}  # a row for each column
    few = [c for c in numeric if c in shares and shares[c]["d"] <= BINS]
    values: dict[str, list[float]] = {}
    for r in cum.where(F.col("column").isin(*few)).select("column", "value").collect() if few else []:  # at most BINS rows a column
        values.setdefault(r["column"], []).append(r["value"])
    out = []
    for c in numeric:
        v = sorted(values.get(c, []))
        pairs = zip(v, v[1:], strict=False) if c in values else [(x["lo"], x["hi"]) for x in shares[c]["b"]] if c in shares else []
        out.append(np.unique([(lo + hi) / 2.0 for lo, hi in pairs if lo is not None and hi is not None]).astype(float))
    return out


@dataclass
class Cells:
    """How a row's cell is named: one number of the bins of its numeric columns and the level numbers of the others."""
    columns: list[str]
    edges: list[np.ndarray]
    levels: list[int]

    @property
    def sizes(self) -> list[int]:
        return [len(e) + 1 for e in self.edges] + [n + 1 for n in self.levels]  # a level more for unknown ones

    @property
    def combinations(self) -> int:
        return int(np.prod([float(s) for s in self.sizes])) if self.sizes else 1

    def of(self, batch: pa.RecordBatch) -> np.ndarray:
        code = np.zeros(batch.num_rows, np.int64)
        for i, (c, size) in enumerate(zip(self.columns, self.sizes, strict=True)):
            v = batch.column(c).to_numpy(zero_copy_only=False).astype(float)
            code = code * size + (np.searchsorted(self.edges[i], v) if i < len(self.edges) else v.astype(np.int64))
        return code

    def parts(self, code: np.ndarray) -> np.ndarray:
        """(columns, cells): bins and level numbers."""
        out = []
        for size in reversed(self.sizes):
            out.append(code % size)
            code = code // size
        return np.array(out[::-1], np.int64).reshape(len(self.sizes), -1)


def _draw(rng: np.random.Generator, shape: tuple[int, int]) -> np.ndarray:
    return np.searchsorted(_POISSON, rng.random(shape), side="right").astype(float)


def _sums(cells: Cells, trees: int, seed: int, centre: float):
    """Batches with label to (tree, cell, w, wy, wyy)."""
    def rows(codes: np.ndarray, acc: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 20) // trees)
        for lo in range(0, len(codes), step):
            part = acc[lo:lo + step]
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(trees, dtype=np.int32), len(part))), pa.array(np.repeat(codes[lo:lo + step], trees)),
                                              *(pa.array(np.ascontiguousarray(part[:, i]).ravel()) for i in range(3))], names=["tree", "cell", "w", "wy", "wyy"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.Generator(np.random.SFC64([seed, TaskContext.get().partitionId()]))
        codes, acc = np.zeros(0, np.int64), np.zeros((0, 3, trees))
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                b = batch.slice(lo, ROWS)
                code, y = cells.of(b), b.column("label").to_numpy(zero_copy_only=False).astype(float) - centre
                order = np.argsort(code, kind="stable")
                code, y = code[order], y[order]
                at = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
                every = np.union1d(codes, code[at])
                if len(every) > len(codes):
                    more = np.zeros((len(every), 3, trees))
                    more[np.searchsorted(every, codes)] = acc
                    codes, acc = every, more
                w = _draw(rng, (len(y), trees))
                place = np.searchsorted(codes, code[at])
                acc[place, 0] += np.add.reduceat(w, at, axis=0)
                w *= y[:, None]
                acc[place, 1] += np.add.reduceat(w, at, axis=0)
                w *= y[:, None]
                acc[place, 2] += np.add.reduceat(w, at, axis=0)
                if acc.size > 3 * HELD:
                    yield from rows(codes, acc)
                    codes, acc = np.zeros(0, np.int64), np.zeros((0, 3, trees))
        yield from rows(codes, acc)
    return run


def _variance(w, s, q):
    mean = s / np.maximum(w, 1)
    return np.maximum(q / np.maximum(w, 1) - mean * mean, 0.0)


def grow(cells: Cells, code: np.ndarray, sums: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """One tree of (3, cells) sums: feature (-1: leaf), bin (numeric: up to it goes left; text: the level that goes right), left child (the
    right one follows), prediction and gain x rows of each node."""
    part, numeric = cells.parts(code), len(cells.edges)
    spots = [(j, j, size - 1) for j, size in enumerate(cells.sizes[:numeric])]  # column, its first feature, splits
    at = numeric
    for j, n in enumerate(cells.levels, numeric):
        spots.append((j, at, n))
        at += n + 1  # the feature of unknown levels is 0 in all training rows
    feature, split, left, value, gains = [], [], [], [], []

    def node(own: np.ndarray) -> int:
        w, s, _ = sums[:, own].sum(axis=1)
        for store, x in ((feature, -1), (split, 0), (left, -1), (value, s / w if w > 0 else 0.0), (gains, 0.0)):
            store.append(x)
        return len(feature) - 1

    level = [(node(np.arange(len(code))), np.arange(len(code)))]
    for _ in range(depth):
        below = []
        for i, own in level:
            total = sums[:, own].sum(axis=1)
            impurity = _variance(*total)
            best = (0.0, 0, 0, 0)
            for j, first, n in spots if impurity > 0 else ():
                if n < 1:
                    continue
                x = part[j, own]
                per = np.stack([np.bincount(x, v, cells.sizes[j]) for v in sums[:, own]])
                there = np.cumsum(per, axis=1)[:, :n] if j < numeric else total[:, None] - per[:, :n]  # what goes left
                here = total[:, None] - there
                gain = impurity - (there[0] * _variance(*there) + here[0] * _variance(*here)) / total[0]
                gain = np.where((there[0] >= 1) & (here[0] >= 1), gain, -1.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, first if j < numeric else first + k, k)
            if best[0] > 0:
                gain, j, f, k = best
                goes = part[j, own] <= k if j < numeric else part[j, own] != k
                feature[i], split[i], gains[i] = f, k, gain * total[0]
                left[i] = node(own[goes])
                below += [(left[i], own[goes]), (node(own[~goes]), own[~goes])]
        level = below
    return np.array(feature, np.int32), np.array(split, np.int32), np.array(left, np.int32), np.array(value), np.array(gains)


def _grown(cells: Cells, depth: int):
    names = ["feature", "split", "left", "value", "gain"]

    def run(key, table):
        table = table.sort_by("cell")
        out = grow(cells, table.column("cell").to_numpy(), np.stack([table.column(c).to_numpy() for c in ("w", "wy", "wyy")]), depth)
        return pa.table([pa.array([key[0].as_py()] * len(out[0]), pa.int32()), pa.array(np.arange(len(out[0]), dtype=np.int32)), *map(pa.array, out)], names=["tree", "node", *names])
    return run


def _walk(cells: Cells, trees: list[tuple[np.ndarray, ...]], code: np.ndarray) -> np.ndarray:
    """Mean prediction of each cell."""
    part, numeric = cells.parts(code), len(cells.edges)
    owner = np.concatenate([np.arange(numeric), np.repeat(np.arange(numeric, len(cells.sizes)), cells.sizes[numeric:])]).astype(np.int64)
    total = np.zeros(len(code))
    for feature, split, left, value in trees:
        at = np.zeros(len(code), np.int64)
        while (go := np.flatnonzero(feature[at] >= 0)).size:
            i = at[go]
            column = owner[feature[i]]
            x = part[column, go]
            right = np.where(column < numeric, x > split[i], x == split[i])
            at[go] = left[i] + right
        total += value[at]
    return total / max(1, len(trees))


@dataclass
class Forest:
    """A fitted forest; ``transform`` adds ``prediction``."""
    cells: Cells
    trees: list[tuple[np.ndarray, ...]]
    centre: float
    featureImportances: DenseVector

    def transform(self, rows: DataFrame) -> DataFrame:
        shared, cells, centre = rows.sparkSession.sparkContext.broadcast(self.trees), self.cells, self.centre
        kept = [c for c in rows.columns if c not in cells.columns]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, answers = np.zeros(0, np.int64), np.zeros(0)
            for b in batches:
                code = cells.of(b)
                new = np.setdiff1d(code, known)
                if len(new):
                    known, answers = np.concatenate([known, new]), np.concatenate([answers, _walk(cells, shared.value, new)])
                    order = np.argsort(known)
                    known, answers = known[order], answers[order]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(answers[np.searchsorted(known, code)] + centre)], names=[*kept, "prediction"])

        schema = rows.select(*kept).schema.add("prediction", "double")
        return rows.mapInArrow(run, schema)


def fit(train: DataFrame, numeric: list[str], text: list[str], levels: list[int], trees: int, depth: int, seed: int) -> Forest | None:
    """A forest of ``train`` (numeric columns, level numbers of ``text`` columns, of which ``levels`` are known, and ``label``), or None where
    its rows lie in too many cells to be collapsed."""
    cells = Cells([*numeric, *text], bounds(train, numeric), levels)
    if cells.combinations >= COMBINATIONS:
        return None
    spark = train.sparkSession

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0, np.int64)
        for b in batches:
            known = np.union1d(known, cells.of(b))
            if len(known) > CELLS:  # too many already
                break
        yield pa.RecordBatch.from_arrays([pa.array(known)], names=["cell"])

    found = CELLS + 1 if cells.combinations > CELLS else cells.combinations
    if found > CELLS:
        found = train.select(*cells.columns).mapInArrow(seen, "cell long").distinct().count()
    centre = train.agg(F.avg("label")).first()[0]
    if found > CELLS or centre is None:
        return None
    sums = (train.select(*cells.columns, "label").mapInArrow(_sums(cells, trees, seed, centre), "tree int, cell long, w double, wy double, wyy double")
            .groupBy("tree", "cell").agg(*[F.sum(c).alias(c) for c in ("w", "wy", "wyy")]))
    nodes = (sums.repartition(min(trees, spark.sparkContext.defaultParallelism), "tree").groupBy("tree")
             .applyInArrow(_grown(cells, depth), "tree int, node int, feature int, split int, left int, value double, gain double").toArrow().sort_by([("tree", "ascending"), ("node", "ascending")]))
    tree = nodes.column("tree").to_numpy()
    at = np.searchsorted(tree, np.arange(trees + 1))
    columns = [nodes.column(c).to_numpy() for c in ("feature", "split", "left", "value", "gain")]
    grown, total = [], np.zeros(len(numeric) + sum(cells.sizes[len(numeric):]))
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        feature, split, left, value, gain = (c[lo:hi] for c in columns)
        grown.append((feature, split, left, value))
        own = np.bincount(feature[feature >= 0], gain[feature >= 0], len(total))
        total += own / own.sum() if own.sum() > 0 else 0.0
    return Forest(cells, grown, centre, Vectors.dense(total / total.sum() if total.sum() > 0 else total))
