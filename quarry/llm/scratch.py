"""Shared helpers: scratch tables that cut lineage, running totals over a
globally ordered table, and connected components.

Scratch tables are Parquet below the folder named by ``spark.checkpoint.dir``,
so every executor can read them again after another one is lost.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; only a local
    session (tests) may lack that setting and then gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quarry-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/quarry-llm-{spark.sparkContext.applicationId}"


#: Rows of a file of a scratch table whose size is known beforehand.
FILE_ROWS = 1 << 16


def save(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` as a scratch table and read it back: later steps start from files.  Where about ``rows`` narrow
    rows are known to come, they are written by a task for each FILE_ROWS, or each core if that is more: every
    file costs an executor memory, and small tables would be written in as many as there are shuffle partitions."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete the application's scratch tables, once no result needs them any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _shift(spark: SparkSession, offsets: list[tuple[int, int]]) -> DataFrame:
    """(__pid, __off), made without Python workers, which would stay beside those of the session."""
    pid, off = ([x[i] for x in offsets] for i in (0, 1))
    return spark.createDataFrame(pa.table({"__pid": pa.array(pid, pa.int32()), "__off": pa.array(off, pa.int64())}))


def running_total(df: DataFrame, order: list, value: str, before: str) -> DataFrame:
    """Adds ``before``: the total of ``value`` (long, not null) over all rows that
    sort ahead of this one by ``order``.

    The rows are dealt out by range, each partition sums its own run in sorted
    order, and the partitions' totals (one row per partition) give the offsets:
    no task sees more than its range.  Rows that tie in ``order`` get an
    arbitrary but fixed sequence.
    """
    spark = df.sparkSession
    schema = T.StructType([*df.schema.fields, T.StructField("__in", T.LongType()), T.StructField("__pid", T.IntegerType())])
    arrow_names = [f.name for f in schema.fields]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, total = TaskContext.get().partitionId(), 0
        for b in batches:
            v = b.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(v) + total
            cols = [*b.columns, pa.array(ends - v), pa.array(np.full(len(v), pid, np.int32))]
            total = int(ends[-1]) if len(v) else total
            yield pa.RecordBatch.from_arrays(cols, names=arrow_names)

    placed = save(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(runs, schema))
    sums = placed.groupBy("__pid").agg(F.max(F.col("__in") + F.col(value)).alias("__sum")).collect()  # a row per partition
    offsets, total = [], 0
    for pid, s in sorted((r["__pid"], r["__sum"]) for r in sums):
        offsets.append((pid, total))
        total += s
    shift = _shift(spark, offsets)
    return (placed.join(F.broadcast(shift), "__pid")  # one row per partition
            .withColumn(before, F.col("__in") + F.col("__off")).drop("__in", "__off", "__pid"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long); root is the
    component's smallest node.

    Alternating large-star and small-star steps: each is a grouped minimum and
    an equi-join, so a node with very many links is combined on the map side and
    its join partition can be split.  Ends when a round changes nothing.
    """
    edges = save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    most = 2 * edges.count()  # nodes, and edges of a round
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = save(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                     .unionByName(low.select("u", F.col("m").alias("v"))).distinct(), most)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return save(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), most)


def numbered(df: DataFrame, key: str, order: list, name: str) -> DataFrame:
    """Adds ``name``: the row's place (from 0) among the rows of the same ``key``, in ``order``.

    Rows are dealt out by range over the key and the order together, so a key
    that holds a third of all rows is spread over many partitions; each partition
    numbers its own runs, and one row per partition (its first and last run) tells
    where a run goes on.  Rows that tie in ``order`` get an arbitrary sequence.
    """
    spark = df.sparkSession
    schema = T.StructType([*df.schema.fields, T.StructField("__in", T.LongType()), T.StructField("__at", T.LongType()),
                           T.StructField("__lead", T.BooleanType()), T.StructField("__pid", T.IntegerType())])
    names = [f.name for f in schema.fields]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, at, run, lead, before = TaskContext.get().partitionId(), 0, 0, True, None
        for b in batches:
            n, col = b.num_rows, b.column(key)
            if not n:
                continue
            new = np.zeros(n, bool)
            codes = col.dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] = codes[1:] != codes[:-1]
            first = col[0].as_py()
            new[0] = at > 0 and first != before[0]
            start = np.where(new, np.arange(n), -1)
            start = np.maximum.accumulate(start)
            place = np.where(start < 0, np.arange(n) + run, np.arange(n) - start)
            leads = (start < 0) & lead
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place), pa.array(np.arange(n) + at), pa.array(leads), pa.array(np.full(n, pid, np.int32))], names=names)
            at, run, lead, before = at + n, int(place[-1]) + 1, bool(leads[-1]), (col[n - 1].as_py(),)

    placed = save(df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).mapInArrow(runs, schema))
    ends = placed.groupBy("__pid").agg(  # a row per partition
        F.min_by(F.struct(key), "__at").alias("first"), F.max_by(F.struct(key, "__in", "__lead"), "__at").alias("last")).collect()
    offsets, before, carry = [], None, 0
    for r in sorted(ends, key=lambda r: r["__pid"]):
        start = carry if before is not None and before[0] == r["first"][key] else 0
        offsets.append((r["__pid"], start))
        before = (r["last"][key],)
        carry = r["last"]["__in"] + 1 + (start if r["last"]["__lead"] else 0)
    shift = _shift(spark, offsets)
    return (placed.join(F.broadcast(shift), "__pid")  # one row per partition
            .withColumn(name, F.col("__in") + F.when(F.col("__lead"), F.col("__off")).otherwise(0)).drop("__in", "__at", "__lead", "__off", "__pid"))
