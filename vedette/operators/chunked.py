"""Previous row, running count and last value for keys of any size.

A window keyed by tenant, asset or chain alone runs a hot key in one task. Here the key
is cut into chunks along its order. A small table with one row per (key, chunk), summed
up before it is shuffled, tells each chunk what came before it. That row is put in front
of the chunk's own rows, so the wide rows are shuffled once and never joined.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import div_us

CHUNK = "_chunk"
FRONT = "_front"  # 0 for the carried row, 1 for the key's own rows


def _own(df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[str], **values: Column) -> DataFrame:
    return df.select(
        *keys, chunk.alias(CHUNK), F.lit(1).alias(FRONT), F.struct(*order).alias("_order"),
        *[c.alias(n) for n, c in values.items()], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


def _before(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def _within(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys, CHUNK).orderBy(FRONT, "_order")


def _with_front(own: DataFrame, front: DataFrame) -> DataFrame:
    return own.unionByName(front.withColumn(FRONT, F.lit(0)), allowMissingColumns=True)


def previous_within(df: DataFrame, keys: Sequence[str], ts: str, tie: str, lookback_us: int,
                    out: str = "prev_us") -> DataFrame:
    """Adds the time of the key's previous row, NULL if it is more than ``lookback_us`` back.

    Chunks are as long as the look-back, so the last row of the chunk before is all a
    chunk must know.
    """
    chunk = div_us(ts, lookback_us)
    own = _own(df, keys, chunk, [ts, tie], _ts=F.col(ts))
    front = df.groupBy(*keys, chunk.alias(CHUNK)).agg(F.max(ts).alias("_ts")).withColumn(CHUNK, F.col(CHUNK) + 1)
    rows = _with_front(own, front).withColumn(out, F.lag("_ts").over(_within(keys))).where("_row is not null")
    return rows.withColumn(out, F.when(F.col("_ts") - F.col(out) <= lookback_us, F.col(out))).select("_row.*", out)


def earlier_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
                 out: str | Mapping[str, Column] = "earlier") -> DataFrame:
    """Adds how many rows of the key come before this one, or sums over them.

    ``out`` names the count, or maps names to BIGINT columns to sum. ``chunk`` must not
    decrease along ``order``.
    """
    one = F.lit(1).cast("bigint")
    sums = {out: one} if isinstance(out, str) else {n: F.coalesce(c.cast("bigint"), F.lit(0)) for n, c in out.items()}
    parts = {n: f"_w{i}" for i, n in enumerate(sums)}
    own = _own(df, keys, chunk, order, **{parts[n]: c for n, c in sums.items()})
    totals = df.groupBy(*keys, chunk.alias(CHUNK)).agg(*[F.sum(c).alias(parts[n]) for n, c in sums.items()])
    front = totals.withColumns({w: F.sum(w).over(_before(keys)) for w in parts.values()})
    earlier = _within(keys).rowsBetween(Window.unboundedPreceding, -1)
    rows = _with_front(own, front).withColumns({n: F.coalesce(F.sum(w).over(earlier), F.lit(0)) for n, w in parts.items()})
    return rows.where("_row is not null").select("_row.*", *sums)


def previous_value(df: DataFrame, keys: Sequence[str], order: str, chunk: Column, value: str,
                   out: str = "previous") -> DataFrame:
    """Adds ``value`` of the key's previous row in ``order`` (unique within the key)."""
    own = _own(df, keys, chunk, [order], _v=F.col(value))
    lasts = df.groupBy(*keys, chunk.alias(CHUNK)).agg(F.max_by(value, order).alias("_v"))
    front = lasts.withColumn("_v", F.lag("_v").over(Window.partitionBy(*keys).orderBy(CHUNK)))
    return _with_front(own, front).withColumn(out, F.lag("_v").over(_within(keys))).where("_row is not null").select("_row.*", out)


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, value: str,
               out: str) -> DataFrame:
    """Adds the latest non-null ``value`` among the key's rows up to this one."""
    own = _own(df, keys, chunk, order, _v=F.col(value))
    known = F.when(F.col(value).isNotNull(), F.struct(*order))
    lasts = df.groupBy(*keys, chunk.alias(CHUNK)).agg(F.max_by(value, known).alias("_v"))
    front = lasts.withColumn("_v", F.last("_v", ignorenulls=True).over(_before(keys)))
    upto = _within(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = _with_front(own, front).withColumn(out, F.last("_v", ignorenulls=True).over(upto))
    return rows.where("_row is not null").select("_row.*", out)
