"""Top-k per key.

Spark keeps at most k rows per key in each task before the shuffle (a window
limit on ``row_number() <= k``), so a key that holds most of the rows sends k
rows per task, not all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k per key by ``order`` (which must be a total order)."""
    if not keys:
        df = df.orderBy(*order).limit(k)  # k rows per task, then k in all
    w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)
