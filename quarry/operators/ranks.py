"""Ties-collapsed value counts, cumulative counts, exact quantiles, ranks.

Nothing here sorts raw rows.  Rows are first collapsed to one row per
distinct ``(key, value)`` with a count (map-side combined, so a value that
holds a third of all rows is one row).  Cumulative counts come from one plan
at every size: ``repartitionByRange`` places contiguous value ranges in
partitions, a checkpoint fixes the partition ids (so later passes agree, also
when executors are lost), per-partition totals give offsets, and a window
per ``(key, partition)`` finishes the job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import ensure_checkpoint_dir


def long_values(df: DataFrame, columns: list[str], cast: str = "double",
                key: str = "column", value: str = "value") -> DataFrame:
    """Unpivot ``columns`` to ``(key, value)``, dropping null (and NaN) values."""
    exprs = [F.struct(F.lit(c).alias(key), F.col(c).cast(cast).alias(value)) for c in columns]
    out = df.select(F.explode(F.array(*exprs)).alias("kv")).select(f"kv.{key}", f"kv.{value}")
    keep = F.col(value).isNotNull()
    if cast in ("double", "float"):
        keep = keep & ~F.isnan(F.col(value))
    return out.filter(keep)


def value_counts(df: DataFrame, columns: list[str], cast: str = "double",
                 key: str = "column", value: str = "value", n: str = "n") -> DataFrame:
    """``(key, value, n)``: one row per distinct non-missing value of each column."""
    return long_values(df, columns, cast, key, value).groupBy(key, value).agg(F.count(F.lit(1)).alias(n))


def _same(keys: list[str], prefix: str) -> Column:
    """Null-safe equality of the key columns with their prefixed copies."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys], F.lit(True))


def _ranged(df: DataFrame, keys: list[str], order: list[str], weight: str) -> tuple[DataFrame, DataFrame]:
    """``df`` dealt out by range with its partition id ``_pid``, and the offsets: per
    key and partition, the weight ahead of it and the key's total."""
    ensure_checkpoint_dir(df.sparkSession)
    ranged = (df.repartitionByRange(*[F.col(c) for c in [*keys, *order]])
              .withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True))
    sums = ranged.groupBy(*keys, "_pid").agg(F.sum(weight).alias("_w"))
    wk = Window.partitionBy(*keys)
    ahead = F.sum("_w").over(wk.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col("_pid").alias("_o_pid"),
                          F.coalesce(ahead, F.lit(0)).alias("_off"), F.sum("_w").over(wk).alias("total"))
    return ranged, offsets


def cumulative_counts(counts: DataFrame, keys: list[str], value: str = "value", n: str = "n") -> DataFrame:
    """Add ``cum_before`` (rows with a smaller value under the same keys) and
    ``total`` (rows under the same keys) to a ties-collapsed count table."""
    ranged, offsets = _ranged(counts, keys, [value], n)
    w = Window.partitionBy(*keys, "_pid").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inner = ranged.withColumn("_in", F.coalesce(F.sum(n).over(w), F.lit(0)))
    return (inner.join(offsets, _same(keys, "_o_") & (F.col("_pid") == F.col("_o_pid")))
            .select(*counts.columns, (F.col("_off") + F.col("_in")).cast("long").alias("cum_before"),
                    F.col("total").cast("long").alias("total")))


def row_positions(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Adds ``out``: the 0-based position of every row under its keys.  Rows that
    tie in ``order`` follow a mark that is fixed once (so ties of any size are dealt out too)."""
    ensure_checkpoint_dir(df.sparkSession)
    marked = df.withColumn("_mark", F.monotonically_increasing_id()).withColumn("_one", F.lit(1)).checkpoint(eager=True)
    ranged, offsets = _ranged(marked, keys, [*order, "_mark"], "_one")
    w = Window.partitionBy(*keys, "_pid").orderBy(*order, "_mark")
    inner = ranged.withColumn("_in", F.row_number().over(w) - 1)
    return (inner.join(offsets, _same(keys, "_o_") & (F.col("_pid") == F.col("_o_pid")))
            .select(*df.columns, (F.col("_off") + F.col("_in")).cast("long").alias(out)))


def average_rank(cum: DataFrame, n: str = "n") -> Column:
    """Average (mid) rank of a tied block, 1-based."""
    return F.col("cum_before") + (F.col(n) + 1) / 2.0


def min_rank(cum: DataFrame) -> Column:
    """Lowest rank of a tied block, 1-based (browser Spearman variant)."""
    return F.col("cum_before") + 1


def exact_quantiles(cum: DataFrame, keys: list[str], probs: list[float], value: str = "value",
                    n: str = "n", names: list[str] | None = None) -> DataFrame:
    """Linear-interpolation quantiles (pandas / ``percentile`` semantics) from a
    cumulative count table: one row per key with one column per prob."""
    names = names or [f"q{int(round(p * 100)):02d}" for p in probs]
    total = F.col("total")

    def at(index: Column) -> Column:
        """The value at a 0-based position: its block's row knows that it holds it."""
        return F.max(F.when((F.col("cum_before") <= index) & (index < F.col("cum_before") + F.col(n)), F.col(value)))

    aggs = [F.max(total).alias("_t")]
    for i, p in enumerate(probs):
        low = F.floor((total - 1) * F.lit(float(p))).cast("long")
        aggs += [at(low).alias(f"_a{i}"), at(F.least(low + 1, total - 1)).alias(f"_b{i}")]
    per = cum.groupBy(*keys).agg(*aggs)
    part = lambda p: (F.col("_t") - 1) * F.lit(float(p)) - F.floor((F.col("_t") - 1) * F.lit(float(p)))
    return per.select(*keys, *[(F.col(f"_a{i}") + part(p) * (F.col(f"_b{i}") - F.col(f"_a{i}"))).alias(nm)
                               for i, (p, nm) in enumerate(zip(probs, names, strict=True))])
