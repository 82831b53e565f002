"""Registered queries over the supplied tables, each with its DuckDB oracle.

``QUERIES[name] = (fn(spark, sf_dir) -> DataFrame, oracle_sql or None)``.
Every query reads whole tables (or tables Spark derives from them); double
results are rounded to 7 significant digits, p-values to 8 decimals, on
both sides, so engines that sum in different orders still compare equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.numeric import dec, sig
from quarry.plans import sqlgen

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, p_cols: tuple[str, ...] = (), digits: int = 7) -> DataFrame:
    """Round every double column: p-value columns to 8 decimals, others to
    ``digits`` significant digits."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append((dec(f.name) if f.name in p_cols else sig(f.name, digits)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def sql_rounded(inner: str, doubles: list[str], others: list[str], p_cols: tuple[str, ...] = (),
                digits: int = 7) -> str:
    """Outer SELECT applying the same rounding as :func:`rounded`."""
    parts = [sqlgen.q(c) for c in others]
    for c in doubles:
        parts.append((sqlgen.dec(sqlgen.q(c)) if c in p_cols else sqlgen.sig(sqlgen.q(c), digits))
                     + f" AS {sqlgen.q(c)}")
    return f"SELECT {', '.join(parts)} FROM ({inner}) AS _r"
