"""Scans, sinks and the dataset registry.

Readers are Spark's own sources; the format comes from the file suffix.
Scratch output goes below the shared folder named by ``spark.checkpoint.dir``
(never a machine-local temporary folder).
"""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import ensure_checkpoint_dir

FORMATS = {"csv": "csv", "tsv": "tsv", "txt": "tsv", "json": "json", "parquet": "parquet"}
MAX_MEMORY_ROWS = 250_000  # the reference API's cap; off by default here


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "quarry-scratch", f"{name}-{uuid.uuid4().hex[:12]}")


def trim_names(df: DataFrame) -> DataFrame:
    """Strip column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def _unwrap_json(df: DataFrame) -> DataFrame:
    """S3: a file that is one object: its first array-of-records member holds the rows."""
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            return df.select(F.explode(F.col(f.name)).alias("_r")).select("_r.*")
    return df


def _read_text(spark: SparkSession, path: str, sep: str, infer: bool, multiline: bool, options: dict) -> DataFrame:
    """Delimited files, each in UTF-8 or (where that fails) Latin-1.  Lines are
    read in splits unless ``multiline`` says that quoted fields hold line breaks."""
    def reader(encoding: str):
        return (spark.read.option("header", True).option("inferSchema", infer).option("multiLine", multiline)
                .option("sep", sep).option("encoding", encoding).options(**options))

    # one pass over the raw lines; a row per file comes back
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), (~F.is_valid_utf8("value")).alias("bad"))
    files = {r["file"]: r["bad"] for r in lines.groupBy("file").agg(F.max("bad").alias("bad")).collect()}
    bad = sorted(f for f, b in files.items() if b)
    good = sorted(f for f, b in files.items() if not b)
    if not bad:
        return reader("UTF-8").csv(path)
    parts = [reader("ISO-8859-1").csv(bad)] + ([reader("UTF-8").csv(good)] if good else [])
    return union_files(parts)


def read_table(spark: SparkSession, path: str, fmt: str | None = None, infer: bool = True, multiline: bool = False,
               **options) -> DataFrame:
    """Read CSV (header, inferred types, UTF-8 or Latin-1 by file),
    TSV/TXT, JSON (lines, an array, or the first array of records in one object) or
    Parquet; unknown suffixes raise ``ValueError``."""
    suffix = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    kind = FORMATS.get(suffix)
    if kind is None:
        raise ValueError("Supported file formats are CSV, TSV/TXT, JSON and Parquet.")
    if kind in ("csv", "tsv"):
        df = _read_text(spark, path, "\t" if kind == "tsv" else ",", infer, multiline, options)
    elif kind == "json":
        # JSON lines first; a whole-file array / object otherwise
        df = spark.read.options(**options).json(path)
        if df.columns == ["_corrupt_record"]:
            df = _unwrap_json(spark.read.option("multiLine", True).options(**options).json(path))
        elif not multiline and len(df.head(2)) == 1:  # one line: it may be the whole object
            df = _unwrap_json(df)
    else:
        df = spark.read.options(**options).parquet(path)
    return trim_names(df)


def union_files(frames: list[DataFrame]) -> DataFrame:
    """Union by name, missing columns -> null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def cap_rows(df: DataFrame, n: int | None = None) -> DataFrame:
    """Optional row cap (the reference's single-machine limit); off by default."""
    return df.limit(n) if n else df


def preview(df: DataFrame, n: int = 25, order_by: list[str] | None = None, as_json: bool = False) -> DataFrame:
    """First ``n`` rows in an explicit order; optional null-safe JSON records."""
    out = df.orderBy(*(order_by or df.columns)).limit(n)
    return out.select(F.to_json(F.struct(*out.columns)).alias("record")) if as_json else out


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV sink with a header row."""
    df.write.mode(mode).option("header", True).csv(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """JSON-lines sink of an analysis table."""
    df.write.mode(mode).json(path)
    return path


def combined_summary(numeric: DataFrame, categorical: DataFrame) -> DataFrame:
    """Numeric and categorical summaries unioned with a ``table`` tag."""
    return (numeric.withColumn("table", F.lit("numeric"))
            .unionByName(categorical.withColumn("table", F.lit("categorical")), allowMissingColumns=True))


def register(df: DataFrame, name: str, persist: bool = True) -> str:
    """Named dataset registry (temp view, optionally persisted)."""
    if persist:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    df.createOrReplaceTempView(name)
    return name


def get(spark: SparkSession, name: str) -> DataFrame:
    """Look a registered dataset up; unknown names raise ``KeyError``."""
    if not spark.catalog.tableExists(name):
        raise KeyError(f"Dataset not found: {name}")
    return spark.table(name)
