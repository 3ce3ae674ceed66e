"""Ranking per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, partition_by, order_by, k: int | None = None, rank_col: str = "rank") -> DataFrame:
    """``row_number`` per group; keep rank <= k when k is truthy (Spark then plans a
    WindowGroupLimit, a partial top-k before the shuffle). ``k`` of 0 or None keeps
    every row, ranked. A per-row k is a filter on the rank after its largest value."""
    parts = [partition_by] if isinstance(partition_by, (str, Column)) else list(partition_by)
    orders = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    w = Window.partitionBy(*parts).orderBy(*orders)
    out = df.withColumn(rank_col, F.row_number().over(w))
    return out.where(F.col(rank_col) <= F.lit(int(k))) if k else out
