"""Column roles (C11) and the first-numeric / first-categorical picks (C20).

Roles come from the schema plus one aggregate of exact distinct counts;
the result is a small driver-side dataclass (one entry per column, never
per row) and, for SQL use, a role DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FLOATING = (T.FloatType, T.DoubleType)
DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)
COMPLEX = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, NUMERIC):
        return "numeric"
    if isinstance(dtype, DATETIME):
        return "datetime"
    if isinstance(dtype, COMPLEX):
        return "skipped"
    return "categorical"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) == "numeric"]


def floating_columns(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema.fields if isinstance(f.dataType, FLOATING)}


def categorical_columns(df: DataFrame) -> list[str]:
    """Text and boolean columns (the reference counts bool as categorical)."""
    return [f.name for f in df.schema.fields if kind_of(f.dataType) in ("categorical", "boolean")]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) == "datetime"]


def profiled_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) != "skipped"]


def missing_expr(df: DataFrame, c: str):
    col = F.col(c)
    if c in floating_columns(df):
        return col.isNull() | F.isnan(col)
    return col.isNull()


@dataclass
class ColumnRoles:
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    datetime: list[str] = field(default_factory=list)
    binary: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    distinct: dict[str, int] = field(default_factory=dict)
    rows: int = 0

    def first_numeric(self) -> str | None:
        return self.numeric[0] if self.numeric else None

    def first_categorical(self) -> str | None:
        return self.categorical[0] if self.categorical else None


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: ``rows`` and exact non-missing distinct count per column.

    Distinct values of all columns are collapsed in one map-side combined
    aggregate keyed by column (several distinct counts in one aggregate would
    multiply every row by the number of columns before combining)."""
    from quarry.operators import ranks
    cols = columns if columns is not None else profiled_columns(df)
    flo = set(floating_columns(df))
    rows = df.count()
    got: dict[str, int] = {}
    if cols:
        # + 0.0: both zeros are one value; NaN is missing
        same = df.select(*[(F.nanvl(F.col(c), F.lit(None).cast("double")) + F.lit(0.0) if c in flo else F.col(c)).cast("string").alias(c) for c in cols])
        per = ranks.value_counts(same, cols, "string").groupBy("column").agg(F.count(F.lit(1)).alias("d"))
        got = {r["column"]: r["d"] for r in per.collect()}  # one row per column
    values = [rows, *[got.get(c, 0) for c in cols]]
    return df.sparkSession.range(1).select(*[F.lit(v).cast("long").alias(c) for v, c in zip(values, ["rows", *cols], strict=True)])


def two_valued(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Distinct counts capped at 3 for numeric columns without a distinct
    aggregate: min / max in one pass, then a count of values that are
    neither (literals) in a second; near-unique columns never shuffle."""
    if not columns:
        return {}
    flo = floating_columns(df)

    def v(c):
        x = F.col(c).cast("double")
        return F.when(~F.isnan(x), x) if c in flo else x

    mm = df.agg(*[F.min(v(c)).alias(f"lo{i}") for i, c in enumerate(columns)],
                *[F.max(v(c)).alias(f"hi{i}") for i, c in enumerate(columns)]).first()
    probe = [(i, c) for i, c in enumerate(columns) if mm[f"lo{i}"] is not None and mm[f"lo{i}"] != mm[f"hi{i}"]]
    out = {c: (0 if mm[f"lo{i}"] is None else 1) for i, c in enumerate(columns)}
    if probe:
        other = df.agg(*[F.count_if((v(c) != mm[f"lo{i}"]) & (v(c) != mm[f"hi{i}"])).alias(f"o{i}")
                         for i, c in probe]).first()
        for i, c in probe:
            out[c] = 2 if other[f"o{i}"] == 0 else 3
    return out


def column_roles(df: DataFrame, exact_numeric_distinct: bool = False) -> ColumnRoles:
    """Roles sorted by name, binary = exactly two distinct non-missing values
    (may overlap numeric/categorical), datetime excluded from binary.

    Exact distinct counts are computed for text/boolean/datetime columns; for
    numeric columns only "0, 1, 2 or more" is needed for the binary rule, so
    they use :func:`two_valued` (``distinct`` holds 3 for "more than two")
    unless ``exact_numeric_distinct``."""
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    nums = [c for c, k in kinds.items() if k == "numeric"]
    exact = [c for c, k in kinds.items() if k != "skipped" and (k != "numeric" or exact_numeric_distinct)]
    row = distinct_counts(df, exact).first().asDict()
    distinct = {k: int(v) for k, v in row.items() if k != "rows"}
    if not exact_numeric_distinct:
        distinct.update(two_valued(df, nums))
    roles = ColumnRoles(rows=int(row["rows"]), distinct=distinct)
    for f in df.schema.fields:
        kind = kind_of(f.dataType)
        if kind == "skipped":
            roles.skipped.append(f.name)
            continue
        if kind == "numeric":
            roles.numeric.append(f.name)
        elif kind == "datetime":
            roles.datetime.append(f.name)
        else:
            roles.categorical.append(f.name)
        if kind != "datetime" and roles.distinct.get(f.name) == 2:
            roles.binary.append(f.name)
    for name in ("numeric", "categorical", "datetime", "binary", "skipped"):
        getattr(roles, name).sort()
    return roles


def roles_table(df: DataFrame) -> DataFrame:
    """``(column, dtype, role, is_binary, distinct_count)``, one row per column."""
    spark = df.sparkSession
    counts = distinct_counts(df)
    cols = profiled_columns(df)
    if cols:
        stacked = counts.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("long").alias("distinct_count")) for c in cols
        ])).alias("r")).select("r.*")
    else:
        stacked = spark.createDataFrame([], "column string, distinct_count long")
    meta = spark.createDataFrame(
        [(f.name, f.dataType.simpleString(), {"boolean": "categorical"}.get(kind_of(f.dataType), kind_of(f.dataType)))
         for f in df.schema.fields], "column string, dtype string, role string")
    return (meta.join(stacked, "column", "left")
            .withColumn("is_binary", (F.col("distinct_count") == 2) & (F.col("role") != "datetime")))
