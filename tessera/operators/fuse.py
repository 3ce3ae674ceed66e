"""Combining candidate lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def context_lists(ranked: DataFrame, group_col: str, rank_col: str, text_col: str,
                  out: str = "docs") -> DataFrame:
    """Per group, the texts in rank order as an array.

    Only for already-limited candidate lists (top-k): the list per group is
    bounded by k, so the collect never holds an unbounded group."""
    return (ranked.groupBy(group_col)
            .agg(F.sort_array(F.collect_list(F.struct(F.col(rank_col).alias("r"),
                                                      F.col(text_col).alias("t")))).alias("_l"))
            .select(group_col, F.transform("_l", lambda x: x["t"]).alias(out)))


def dedupe_best_rank(cands: DataFrame, key_cols, id_col: str, rank_cols: list[str]) -> DataFrame:
    """One row per (key, id) with the lowest rank (ties by the further columns)."""
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    best = cands.groupBy(*keys, id_col).agg(F.min(F.struct(*rank_cols)).alias("_b"))
    return best.select(*keys, id_col, "_b.*")
