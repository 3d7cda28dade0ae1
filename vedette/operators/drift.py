"""Population stability index between the last week and the three weeks before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions.numeric import DAY_US, round_to


def psi(events: DataFrame, as_of: int | Column | None = None, columns=rules.DRIFT_FEATURES,
        bins: int = rules.DRIFT_BINS, overall: bool = True) -> DataFrame:
    """PSI per tenant (and for all tenants as client_id ``*``) and feature.

    Ten equal bins on [0, 1], the last one closed; values outside count in n only. A
    window with fewer than 100 rows gives 0. One aggregation to (tenant, feature) with a
    filtered count per bin and window: nothing larger than that is shuffled.
    """
    now = events.agg(F.max("ts_us")).scalar() if as_of is None else (F.lit(as_of) if isinstance(as_of, int) else as_of)
    rows = events.where(F.col("ts_us") > now - F.lit(28 * DAY_US)).select(
        "client_id", (F.col("ts_us") > now - F.lit(7 * DAY_US)).alias("_recent"),
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in columns])
    tenants = F.array("client_id", F.lit("*")) if overall else F.array("client_id")
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns])
    # the bin is the number of inner edges i*step at or below the value
    above = sum(((F.col("value") >= F.lit(i * (1.0 / bins))).cast("int") for i in range(1, bins)), F.lit(0))
    counted = (
        rows.select(F.explode(tenants).alias("client_id"), "_recent", pairs.alias("_p"))
        .select("client_id", "_recent", F.inline("_p"))
        .withColumn("bin", F.when(F.col("value").between(0.0, 1.0), above))
        .groupBy("client_id", "feature", "_recent", "bin").agg(F.count("*").alias("n"))
    )
    recent, before = F.col("_recent"), ~F.col("_recent")
    wide = counted.groupBy("client_id", "feature").agg(
        F.coalesce(F.sum(F.when(recent, F.col("n"))), F.lit(0)).alias("n_recent"),
        F.coalesce(F.sum(F.when(before, F.col("n"))), F.lit(0)).alias("n_baseline"),
        *[F.coalesce(F.sum(F.when(recent & (F.col("bin") == b), F.col("n"))), F.lit(0)).alias(f"_r{b}") for b in range(bins)],
        *[F.coalesce(F.sum(F.when(before & (F.col("bin") == b), F.col("n"))), F.lit(0)).alias(f"_b{b}") for b in range(bins)],
    )
    total = F.lit(0.0)
    for b in range(bins):
        r = (F.col(f"_r{b}") + 1) / (F.col("n_recent") + bins + 1)
        base = (F.col(f"_b{b}") + 1) / (F.col("n_baseline") + bins + 1)
        total = total + (r - base) * F.log(r / base)
    enough = (F.col("n_recent") >= rules.DRIFT_MIN_ROWS) & (F.col("n_baseline") >= rules.DRIFT_MIN_ROWS)
    return wide.select("client_id", "feature", "n_recent", "n_baseline",
                       F.when(enough, round_to(total, 6)).otherwise(0.0).alias("psi"))


def drift_gate(psis: DataFrame, limit: float = rules.DRIFT_LIMIT) -> DataFrame:
    return psis.groupBy("client_id").agg(F.max("psi").alias("max_psi"), (F.max("psi") > limit).alias("drifted"))
