"""Structured Streaming variant of the mergeable profiles (optional, §2.13).

Counts, sums and sums of squares are mergeable, so windowed moments of an
unbounded ``events``-like stream are a watermarked ``groupBy(window, key)``;
mean and variance are derived from the sums when read.  Each micro-batch
writes the windows it changed to a folder of its own (named by batch, so a
repeated batch overwrites itself); a reader takes each window's last version.
The watermark lets finished windows leave the state, and the query's
checkpoint lives in the shared checkpoint folder, so a restarted job
resumes exactly once.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import ensure_checkpoint_dir


def windowed_moments(stream: DataFrame, ts: str, value: str, key: str, window: str = "1 day",
                     watermark: str = "1 day", decimal_scale: int | None = None) -> DataFrame:
    """Per (window, key): n, sum, sum of squares, min, max of ``value``.
    ``decimal_scale`` sums fixed-point values exactly (order-independent)."""
    v = F.col(value).cast(f"decimal(20,{decimal_scale})" if decimal_scale is not None else "double")
    return (stream.withWatermark(ts, watermark)
            .groupBy(F.window(ts, window).alias("w"), F.col(key))
            .agg(F.count(v).alias("n"), F.sum(v).alias("s1"), F.sum(v * v).alias("s2"),
                 F.min(v).alias("min"), F.max(v).alias("max")))


def finish_moments(df: DataFrame) -> DataFrame:
    """Mean and sample variance from the mergeable sums."""
    n = F.col("n").cast("double")
    s1, s2 = F.col("s1").cast("double"), F.col("s2").cast("double")
    return df.select(F.col("w.start").alias("window_start"), *[c for c in df.columns if c not in ("w",)],
                     (s1 / n).alias("mean"),
                     F.when(n > 1, (s2 - s1 * s1 / n) / (n - 1)).alias("variance"))


def run_available_now(spark: SparkSession, source_dir: str, schema, sink_dir: str, name: str,
                      ts: str = "ts", value: str = "value", key: str = "event_type",
                      window: str = "1 day", decimal_scale: int | None = None) -> DataFrame:
    """Process everything in ``source_dir`` (parquet files) and return the
    sink as a batch DataFrame."""
    base = ensure_checkpoint_dir(spark)
    stream = spark.readStream.schema(schema).parquet(source_dir)
    agg = windowed_moments(stream, ts, value, key, window, decimal_scale=decimal_scale)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink_dir}/batch={batch_id}")

    q = (agg.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", os.path.join(base, "quarry-streams", name))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return finish_moments(last_versions(spark.read.parquet(sink_dir), key))


def last_versions(written: DataFrame, key: str) -> DataFrame:
    """The newest batch's row for each window and key."""
    rest = [c for c in written.columns if c not in ("w", key, "batch")]
    last = written.groupBy("w", key).agg(F.max_by(F.struct(*rest), "batch").alias("_v"))
    return last.select("w", key, *[F.col(f"_v.{c}").alias(c) for c in rest])
