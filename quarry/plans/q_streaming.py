"""Registered streaming query: windowed moments of ``events`` via Structured Streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.plans.catalog import register, table
from quarry.sources.io import scratch_path
from quarry.streaming.moments import run_available_now


@register("stream_daily_moments_events", """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S')
    AS window_start, event_type, count(value) AS n, sum(value::DECIMAL(20,2)) AS s1,
    sum(value::DECIMAL(20,2) * value::DECIMAL(20,2)) AS s2, min(value)::DECIMAL(20,2) AS "min",
    max(value)::DECIMAL(20,2) AS "max" FROM events GROUP BY 1, 2""")
def _stream(spark, sf_dir):
    # event time must be TIMESTAMP (the files hold TIMESTAMP_NTZ, read as UTC)
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    src = scratch_path(spark, "events-stream-src")
    ev.repartition(4).write.parquet(src)  # the stream's input files, derived from the table
    out = run_available_now(spark, src, ev.schema, scratch_path(spark, "events-stream-sink"),
                            name=src.rsplit("/", 1)[-1], decimal_scale=2)
    # the exact mergeable state is compared; mean / variance are derived from it
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type",
                      F.col("n").cast("long").alias("n"), "s1", "s2", "min", "max")
