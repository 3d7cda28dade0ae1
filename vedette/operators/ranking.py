"""Top-n and paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int = 1,
                  rank_as: str | None = None) -> DataFrame:
    """First ``limit`` rows of every key.

    The ``row_number() <= n`` filter becomes a window group limit in the plan: each
    task keeps at most n rows per key before the shuffle, so a hot key costs nothing.
    """
    rank = rank_as or "_rank"
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= limit)
    return out if rank_as else out.drop(rank)


def page(df: DataFrame, order: Sequence[Column], skip: int = 0, limit: int = 100) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(limit)
