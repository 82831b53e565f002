"""Exact k nearest neighbours by a tree of cells and their bounding boxes.

A k-d tree over a bounded sample of the training vectors (``SAMPLE`` values at most, ``PER_LEAF`` sample rows a leaf)
cuts the space into cells of about ``CELL`` rows, so their number grows with the table and the work of a query does not.
Training rows and queries go to their cells and are packed into small blocks.  A query meets the
blocks of its own cell; its k-th distance there then bounds which other cells it has to look at: those whose box (of
all its training rows, not of the sample) comes as near.  Blocks of queries are compared with the boxes first and single queries
only with what is left.

Equal training vectors are kept k times at most (further copies lose every tie) and equal
queries are answered once, so copies never multiply.  Each block of queries meets each block of training rows as
one row: no key is gathered into one task.  The driver holds the sample, and a box for each block.

Distances are Euclidean, squares summed in the order of the components; ties go to the smaller id.
Vectors that are null or hold a null or a non-finite component take no part (such queries
have no neighbours); with fewer than k training rows all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import ensure_checkpoint_dir

#: Training rows aimed at in a cell; sample rows that a leaf may have; values of the sample; values of a block; distances compared at once.
CELL, PER_LEAF, SAMPLE, BLOCK, AT_ONCE = 576, 8, 1 << 22, 1 << 13, 1 << 20


def _matrix(col: pa.Array) -> np.ndarray:
    n = len(col)
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), float).reshape(n, -1) if n else np.zeros((0, 0))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, components added one after another."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        d = a[:, i, None] - b[None, :, i]
        out += d * d
    return out


def _gaps(a_low: np.ndarray, a_high: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least squared distances of boxes to boxes, summed as in ``_squares`` (rounding keeps them at or below any pair's)."""
    out = np.zeros((len(a_low), len(low)))
    for i in range(low.shape[1]):
        d = np.maximum(0.0, np.maximum(low[None, :, i] - a_high[:, i, None], a_low[:, i, None] - high[None, :, i]))
        out += d * d
    return out


class _Tree:
    """Cuts at the median of the widest component; the leaves are the cells."""

    def __init__(self, points: np.ndarray, per_leaf: int = PER_LEAF):
        component, value, left, right = [], [], [], []
        cells, todo = 0, [(points, None, 0)]
        while todo:
            part, parent, side = todo.pop()
            wide = np.ptp(part, axis=0) if len(part) > per_leaf and part.shape[1] else np.zeros(1)
            at = int(wide.argmax())
            if wide[at] > 0:
                x = part[:, at]
                cut = np.partition(x, (len(x) - 1) // 2)[(len(x) - 1) // 2]
                if cut == x.max():
                    cut = x[x < cut].max()
                node = len(component)
                component.append(at)
                value.append(cut)
                left.append(0)
                right.append(0)
                todo += [(part[x <= cut], node, 0), (part[x > cut], node, 1)]
            else:
                node, cells = -1 - cells, cells + 1
            if parent is not None:
                (right if side else left)[parent] = node
        self.component, self.value = np.array(component, np.int64), np.array(value, float)
        self.left, self.right, self.cells = np.array(left, np.int64), np.array(right, np.int64), cells

    def cell(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), 0 if len(self.value) else -1, np.int64)
        while True:
            n = np.flatnonzero(out >= 0)
            if not len(n):
                return -1 - out
            at = out[n]
            out[n] = np.where(x[n, self.component[at]] <= self.value[at], self.left[at], self.right[at])


def _dealt(shared):
    """(id, vec) to (id, vec, cell)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for b in batches:
            cell = tree.cell(_matrix(b.column("vec"))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), pa.array(cell)], names=["id", "vec", "cell"])
    return run


_PACKED = "cell int, first boolean, n int, ids binary, vecs binary, low binary, high binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell to blocks of one cell with their boxes; ``first`` marks one block of each cell."""
    last = None
    for b in batches:
        vec, cell, ids = _matrix(b.column("vec")), b.column("cell").to_numpy(), b.column("id").to_numpy()
        if not len(cell):
            continue
        size = max(8, BLOCK // max(1, vec.shape[1]))
        cuts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))).tolist() + [len(cell)]
        out: list[tuple] = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            for i in range(lo, hi, size):
                j = min(hi, i + size)
                out.append((int(cell[i]), int(cell[i]) != last, j - i, ids[i:j].tobytes(), vec[i:j].tobytes(), vec[i:j].min(axis=0).tobytes(), vec[i:j].max(axis=0).tobytes()))
                last = int(cell[i])
        kinds = [pa.int32(), pa.bool_(), pa.int32(), *[pa.binary()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate(kinds)], names=["cell", "first", "n", "ids", "vecs", "low", "high"])


def _blocks(rows: DataFrame, tree) -> DataFrame:
    return (rows.select("id", "vec").mapInArrow(_dealt(tree), "id long, vec array<double>, cell int")
            .repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(_pack, _PACKED))


class _Boxes:
    """The box and the number of training rows of every cell that has some."""

    def __init__(self, cell: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray):
        order = np.argsort(cell, kind="stable")
        self.cells, start = np.unique(cell[order], return_index=True)
        self.n = np.add.reduceat(n[order], start)
        self.low, self.high = np.minimum.reduceat(low[order], start), np.maximum.reduceat(high[order], start)

    def within(self, q: np.ndarray, k: int) -> np.ndarray:
        """An upper bound of the squared k-th distance of queries that found fewer than k in their own cells: the
        farthest corners of the cells, nearest first, until these hold k rows."""
        out = np.full(len(q), np.inf)
        if self.n.sum() < k:
            return out
        for lo in range(0, len(q), max(1, AT_ONCE // len(self.cells))):
            part = q[lo:lo + max(1, AT_ONCE // len(self.cells))]
            d = np.zeros((len(part), len(self.cells)))
            for i in range(q.shape[1]):
                e = np.maximum(np.abs(part[:, i, None] - self.low[None, :, i]), np.abs(part[:, i, None] - self.high[None, :, i]))
                d += e * e
            order = np.argsort(d, axis=1)
            at = (np.cumsum(self.n[order], axis=1) >= k).argmax(axis=1)
            out[lo:lo + len(part)] = d[np.arange(len(part)), order[np.arange(len(part)), at]]
        return out

    def asks(self, own: int, ids: np.ndarray, q: np.ndarray, bound: np.ndarray) -> Iterator[tuple]:
        """(cell, n, ids, vecs, bounds): the queries that have to look at each other cell."""
        near = np.flatnonzero((_gaps(q.min(axis=0)[None], q.max(axis=0)[None], self.low, self.high)[0] <= bound.max()) & (self.cells != own))
        step = max(1, AT_ONCE // len(q))
        for lo in range(0, len(near), step):
            at = near[lo:lo + step]
            reach = _gaps(q, q, self.low[at], self.high[at]) <= bound[:, None]
            for c in np.flatnonzero(reach.any(axis=0)).tolist():
                r = np.flatnonzero(reach[:, c])
                yield int(self.cells[at[c]]), len(r), ids[r].tobytes(), q[r].tobytes(), bound[r].tobytes()


_MET = "query long, near array<struct<d2: double, id: long>>, cell int, n int, ids binary, vecs binary, bounds binary"
_NEAR = pa.list_(pa.struct([("d2", pa.float64()), ("id", pa.int64())]))


def _best(q: np.ndarray, t: np.ndarray, ids: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, d2) of each query's k best of the block within its bound, best first."""
    parts = []
    step = max(1, AT_ONCE // max(1, len(t)))
    for lo in range(0, len(q), step):
        d = _squares(q[lo:lo + step], t)
        limit = bound[lo:lo + step]
        if len(t) > k:
            limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
        row, at = np.nonzero(d <= limit[:, None])
        d = d[row, at]
        order = np.lexsort((ids[at], d, row))
        row, at, d = row[order], at[order], d[order]
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
        keep = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row)))) < k
        parts.append((row[keep] + lo, ids[at[keep]], d[keep]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _meet(k: int, boxes=None):
    """Block pairs to each query's k best of the block; with ``boxes`` (the pairs of a cell with itself) also rows without a query:
    the other cells to look at, asked by the pair that has the cell's first block (or none)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(c) for c in ("q_cell", "q_n", "q_ids", "q_vecs", "q_bounds", "first", "n", "ids", "vecs")]
            for i in range(b.num_rows):
                cell, qn, qi, qv, qb, first, tn, ti, tv = (c[i].as_py() for c in columns)
                q, q_ids = np.frombuffer(qv).reshape(qn, -1), np.frombuffer(qi, np.int64)
                bound = np.full(qn, np.inf) if qb is None else np.frombuffer(qb)
                row, found, d2 = _best(q, np.frombuffer(tv).reshape(tn, -1), np.frombuffer(ti, np.int64), bound, k) if tn else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
                count = np.bincount(row, minlength=qn)
                has = np.flatnonzero(count)
                ends = np.concatenate(([0], np.cumsum(count[has]))).astype(np.int32)
                near = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(d2), pa.array(found)], names=["d2", "id"]))
                none = [pa.nulls(len(has), t) for t in (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[has]), near.cast(_NEAR), *none], names=["query", "near", "cell", "n", "ids", "vecs", "bounds"])
                if boxes is None or first is False:
                    continue
                bound = np.full(qn, np.inf)
                full = np.flatnonzero(count >= k)
                if len(full):
                    bound[full] = d2[np.cumsum(count)[full] - 1]
                if len(full) < qn:
                    short = np.flatnonzero(count < k)
                    bound[short] = boxes.value.within(q[short], k)
                for ask in boxes.value.asks(cell, q_ids, q, bound):
                    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, _NEAR), *(pa.array([v], t) for v, t in zip(ask, kinds, strict=True))],
                                                     names=["query", "near", "cell", "n", "ids", "vecs", "bounds"])
    return run


def _met(asks: DataFrame, blocks: DataFrame, k: int, boxes=None) -> DataFrame:
    q = asks.select(*(F.col(c).alias(f"q_{c}") for c in ("cell", "n", "ids", "vecs", "bounds")))
    # in the first round also queries of cells without training rows, which ask the others
    pairs = q.join(blocks, F.col("q_cell") == F.col("cell"), "inner" if boxes is None else "left").select("q_cell", "q_n", "q_ids", "q_vecs", "q_bounds", "first", "n", "ids", "vecs")
    return pairs.mapInArrow(_meet(k, boxes), _MET)


def _whole(df: DataFrame, vec: str) -> DataFrame:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col(vec).isNotNull() & finite)


def nearest(train: DataFrame, query: DataFrame, k: int = 5, cell: int = CELL) -> DataFrame:
    """(vec, neighbours): for every distinct vector of ``query`` (vec array<double>) the k nearest rows of ``train``
    (id long, vec), as an array of (rank, id, distance)."""
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    copies = Window.partitionBy("vec").orderBy("id")
    t = (_whole(train.select(F.col("id").cast("long"), F.col("vec").cast("array<double>")), "vec")
         .withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k).drop("_copy").checkpoint())
    q = _whole(query.select(F.col("vec").cast("array<double>")).distinct(), "vec").withColumn("id", F.monotonically_increasing_id()).checkpoint()
    n, width = t.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if not n:
        return q.select("vec", F.expr("cast(array() as array<struct<rank: int, id: long, distance: double>>)").alias("neighbours"))
    wanted = max(1, min(SAMPLE // max(1, width), n * 3 // 4 * PER_LEAF // cell))
    drawn = t.where(F.pmod(F.xxhash64("vec", "id", F.lit(7)), F.lit(max(1, n // wanted))) == 0).select("vec").toArrow()
    tree = spark.sparkContext.broadcast(_Tree(_matrix(drawn.column("vec").combine_chunks()) if drawn.num_rows else np.zeros((0, width))))

    blocks = _blocks(t, tree).checkpoint()
    box = blocks.select("cell", "n", "low", "high").toArrow()  # a row for each block
    low, high = (np.frombuffer(b"".join(box.column(c).to_pylist())).reshape(box.num_rows, -1) for c in ("low", "high"))
    boxes = spark.sparkContext.broadcast(_Boxes(box.column("cell").to_numpy(), box.column("n").to_numpy().astype(np.int64), low, high))
    near = _met(_blocks(q, tree).withColumn("bounds", F.lit(None).cast("binary")), blocks, k, boxes).checkpoint()
    far = _met(near.where("query is null"), blocks, k)
    both = near.where("query is not null").select("query", "near").unionByName(far.select("query", "near"))
    best = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)
    found = both.groupBy("query").agg(F.transform(best, lambda x, i: F.struct((i + 1).alias("rank"), x["id"].alias("id"), F.sqrt(x["d2"]).alias("distance"))).alias("neighbours"))
    return q.join(found, F.col("id") == F.col("query"), "left").select("vec", "neighbours")


def predict(train: DataFrame, query: DataFrame, k: int = 5, task: str = "regression", skip_self: bool = False, positive=None) -> DataFrame:
    """``query`` (vec, its other columns kept) with ``predicted``: the mean (regression) or the most frequent ``label``
    (classification, ties to the first in order) of its k nearest rows of ``train`` (id, vec, label).  With ``skip_self``
    the row of ``query``'s own ``id`` is not its neighbour.  With ``positive``, ``score`` is that label's share of the votes."""
    found = nearest(train, query, k + 1 if skip_self else k)
    q = query.withColumn("_q", F.monotonically_increasing_id()).checkpoint()
    own = F.filter("neighbours", lambda x: x["id"] != F.col("id")) if skip_self else F.col("neighbours")
    asked = q.withColumn("_v", F.col("vec").cast("array<double>")).join(found.withColumnRenamed("vec", "_v"), "_v", "left")
    votes = (asked.select("_q", F.explode(F.slice(own, 1, k)).alias("_n")).select("_q", F.col("_n.id").alias("_id"))
             .join(train.select(F.col("id").cast("long").alias("_id"), "label").dropDuplicates(["_id"]), "_id"))
    if task == "regression":
        answer = votes.groupBy("_q").agg(F.avg(F.col("label").cast("double")).alias("predicted"))
    else:
        counted = votes.groupBy("_q", "label").agg(F.count("*").alias("_c"))
        share = [] if positive is None else [(F.sum(F.when(F.col("label") == positive, F.col("_c")).otherwise(0)) / F.sum("_c")).alias("score")]
        answer = counted.groupBy("_q").agg(F.min_by("label", F.struct(-F.col("_c"), F.col("label"))).alias("predicted"), *share)
    return q.join(answer, "_q", "left").drop("_q")
