"""Column screening by bounded summaries: top values (P9, P10, Q8) and distinct ratios
without moving every value of a near-unique column.

* **Heavy hitters.**  Every task keeps at most CAPACITY counters a column (Misra-Gries; what is
  subtracted is remembered), Spark adds the tasks' counters up by value, and the
  subtractions give a bound that holds for every value: low <= count <= low + lost.  A value can only be among the
  k most frequent if low + lost reaches the k-th largest low; those few are counted exactly in a
  second scan.  Where the k-th largest low does not exceed ``lost`` (flat columns) the column
  is counted in full, the only way to rank ties of rare values.
* **Distinct counts.**  A HyperLogLog sketch a column (error 0.8 %) settles a threshold if the estimate is
  farther from it than BAND; columns within the band are counted exactly.

So results equal the exact ones (up to a sketch off by more than five standard errors), and what is shuffled grows
with columns, tasks and CAPACITY, not with distinct values.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import profile as P
from quarry.operators import quality as Q
from quarry.operators.roles import kind_of, profiled_columns
from quarry.session import ensure_checkpoint_dir

#: Counters of a column in a task; binary logarithm of a sketch's registers; relative band around thresholds (5 standard errors); values of flat columns in a task.
CAPACITY, LG_K, BAND, ROWS = 1024, 14, 0.04, 1 << 18


def _texts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[P._as_text(df, c).alias(f"c{i}") for i, c in enumerate(columns)])


def _counters(columns: list[str], capacity: int):
    """Batches of text columns to (column, value, low, lost): a task's counters; its subtractions are on a row without a value."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict[str, int]] = [{} for _ in columns]
        lost = [0] * len(columns)
        for b in batches:
            for i, col in enumerate(b.columns):
                found = pc.value_counts(col.drop_null())
                own = kept[i]
                for v, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True):
                    own[v] = own.get(v, 0) + n
                if len(own) > capacity:
                    cut = sorted(own.values(), reverse=True)[capacity]
                    kept[i] = {v: n - cut for v, n in own.items() if n > cut}
                    lost[i] += cut
        rows = [(c, v, n, 0) for c, own in zip(columns, kept, strict=True) for v, n in own.items()]
        rows += [(c, None, 0, x) for c, x in zip(columns, lost, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                                          pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())], names=["column", "value", "low", "lost"])
    return run


def heavy_hitters(df: DataFrame, columns: list[str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(column, value, low, lost): ``low`` <= count <= ``low`` + ``lost`` for every value listed; the row without a value stands for every other."""
    columns = columns if columns is not None else profiled_columns(df)
    rows = _texts(df, columns).mapInArrow(_counters(columns, capacity), "column string, value string, low long, lost long")
    rows = rows.groupBy("column", "value").agg(F.sum("low").alias("low"), F.sum("lost").alias("lost"))
    over = rows.where("value is null").select(F.col("column").alias("_c"), F.col("lost").alias("_lost"))
    return rows.join(over, F.col("column") == F.col("_c")).select("column", "value", "low", F.col("_lost").alias("lost"))


def _candidates(df: DataFrame, columns: list[str], k: int, capacity: int) -> tuple[DataFrame, list[str]]:
    """The values that can be among a column's k most frequent, and the columns where the counters can't tell."""
    ensure_checkpoint_dir(df.sparkSession)
    seen = heavy_hitters(df, columns, capacity).where("value is not null").checkpoint()
    at = Window.partitionBy("column").orderBy(F.desc("low"), "value")
    kth = seen.withColumn("_r", F.row_number().over(at)).where(F.col("_r") <= k).groupBy("column").agg(
        F.min("low").alias("kth"), F.count("*").alias("listed"), F.max("lost").alias("lost")).collect()  # a row for each column
    # with fewer values than k and nothing lost, the list is the whole column
    settled = {r["column"] for r in kth if r["lost"] == 0 or (r["listed"] == k and r["kth"] > r["lost"])}
    least = {r["column"]: (r["kth"] - r["lost"] if r["listed"] == k else 0) for r in kth}
    flat = [c for c in columns if c not in settled]  # also those of which no counter is left
    if not settled:
        return seen.where("false").select("column", "value"), flat
    need = F.create_map(*[x for c in sorted(settled) for x in (F.lit(c), F.lit(least[c]))])
    return seen.where(F.col("column").isin(*settled) & (F.col("low") >= need[F.col("column")])).select("column", "value"), flat


def _batch_counts(columns: list[str]):
    """Batches of text columns to (column, value, n): the values of one batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, col in zip(columns, b.columns, strict=True):
                found = pc.value_counts(col.drop_null())
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(found), pa.string()), found.field("values").cast(pa.string()), found.field("counts")], names=["column", "value", "n"])
    return run


def _full_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, count) of flat columns.  Nearly every row has a value of its own, so counting ahead of the shuffle would
    only hold a task's whole share in memory: batches are counted, and dealt to as many tasks as keep ROWS values each."""
    parts = max(1, -(-df.count() * len(columns) // ROWS))
    rows = _texts(df, columns).mapInArrow(_batch_counts(columns), "column string, value string, n long")
    return rows.repartition(parts, "column", "value").groupBy("column", "value").agg(F.sum("n").alias("count"))


def top_values(df: DataFrame, columns: list[str], k: int, capacity: int = CAPACITY) -> DataFrame:
    """(column, value, count, rank): the ``k`` most frequent values (missing ones left out) of every column, ties by value, exact."""
    some, flat = _candidates(df, columns, k, capacity)
    rows = _texts(df, columns)
    pairs = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("value")) for i, c in enumerate(columns) if c not in flat])).alias("p")) \
        if len(flat) < len(columns) else None
    parts = []
    if pairs is not None:
        parts.append(pairs.select("p.*").join(some, ["column", "value"], "left_semi").groupBy("column", "value").agg(F.count("*").alias("count")))
    if flat:
        parts.append(_full_counts(df, flat))
    counts = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    at = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    return counts.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= k).select("column", "value", "count", F.col("rank").cast("long").alias("rank"))


def summaries(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, rows, missing, distinct): one scan; ``distinct`` is estimated, but 0 and 1 are certain."""
    columns = columns if columns is not None else profiled_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, rows long, missing long, distinct long")
    t = _texts(df, columns)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i in range(len(columns)):
        c = f"c{i}"
        aggs += [F.count(c).alias(f"n{i}"), F.hll_sketch_estimate(F.hll_sketch_agg(c, LG_K)).alias(f"d{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
    distinct = [F.when(F.col(f"n{i}") == 0, 0).when(F.col(f"lo{i}") == F.col(f"hi{i}"), 1).otherwise(F.greatest(F.lit(2), F.col(f"d{i}"))) for i in range(len(columns))]
    one = t.agg(*aggs)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col("rows").cast("long").alias("rows"), (F.col("rows") - F.col(f"n{i}")).cast("long").alias("missing"),
                                                   distinct[i].cast("long").alias("distinct")) for i, c in enumerate(columns)])).alias("s")).select("s.*")


def _settled(distinct: int, rows: int) -> bool:
    """The estimate is far enough from every threshold of the flags (20 values; half and nine tenths of the rows)."""
    if distinct <= 1:
        return True
    return all(abs(distinct - t) > BAND * max(distinct, t) + 0.5 for t in (20.5, 0.5 * rows, 0.9 * rows))


def column_flags(df: DataFrame, prof: DataFrame | None = None, capacity: int = CAPACITY, near_constant: bool = True) -> DataFrame:
    """Q7-Q10 (and Q13 with ``prof``): the flags of ``quality.column_flags``, decided from the summaries; columns
    too near a threshold are counted exactly.  Without ``near_constant`` that flag is not looked at (one scan less)."""
    columns = profiled_columns(df)
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    stats = {r["column"]: r.asDict() for r in summaries(df, columns).collect()}  # a row for each column
    first = {} if not near_constant else {r["column"]: r for r in heavy_hitters(df, columns, capacity).groupBy("column").agg(F.max("low").alias("low"), F.max("lost").alias("lost")).collect()}
    exact, rows = [], []
    for i, c in enumerate(df.columns):
        if c not in stats:
            continue
        s = stats[c]
        present = s["rows"] - s["missing"]
        low, lost = (first[c]["low"], first[c]["lost"]) if c in first else (0, 0)
        nearly = present > 0 and low / present < 0.95 <= (low + lost) / present
        if nearly or not _settled(s["distinct"], s["rows"]):
            exact.append(c)
        else:
            rows.append((i, c, kinds[c], s["rows"], s["missing"], s["distinct"], low, present, s["distinct"] / max(1, s["rows"])))
    kind = "position int, column string, kind string, rows long, missing long, distinct long, top_count long, present long, unique_ratio double"
    table = df.sparkSession.createDataFrame(rows, kind)
    if exact:
        table = table.unionByName(Q.column_stats(df.select(*exact)).select(*table.columns))
    flags = Q.column_flags(table, prof)
    return flags if near_constant else flags.drop("near_constant")
