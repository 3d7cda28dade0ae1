"""Model features per event and per tenant."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import rules
from ..functions import text as t
from ..functions.numeric import US
from ..session import small_side
from .joins import train_asset_join
from .sweep import activity

KEYS = ["client_id", "asset_id"]


def temporal_features(events: DataFrame, recent: DataFrame | None = None) -> DataFrame:
    """Adds timestamp_delta, events_per_minute, hour_of_day and day_of_week per (client, asset).

    The delta feature is 1.0 from one hour on, so a one-hour look-back is exact. ``recent``
    holds earlier events that count but are not returned.
    """
    if recent is not None:
        events = events.withColumn("_old", F.lit(False)).unionByName(
            recent.select(*KEYS, "ts_us", "event_id").withColumn("_old", F.lit(True)), allowMissingColumns=True)
    e = activity(events, KEYS, "ts_us", "event_id", count_as="_n")
    if recent is not None:
        e = e.where(~F.col("_old")).drop("_old")
    return e.withColumns({
        "timestamp_delta": t.delta_feature((F.col("ts_us") - F.col("prev_us")) / F.lit(float(US))),
        "events_per_minute": t.rate_feature("_n"),
        "hour_of_day": t.hour_of_day("ts_us"),
        "day_of_week": t.day_of_week("ts_us"),
    }).drop("prev_us", "_n")


MIN_TRAINING_ROWS = 50


def training_features(events: DataFrame, assets: DataFrame, min_rows: int = 0, recent: DataFrame | None = None) -> DataFrame:
    """The nine model features of every event.

    ``min_rows`` leaves out tenants with fewer events: for training (``MIN_TRAINING_ROWS``),
    never for scoring.

    ``recent``: earlier events that count in gaps and rates. An unregistered asset takes its activity level as its value.
    """
    if min_rows:
        sizes = events.groupBy("client_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_rows)
        events = events.join(small_side(sizes.drop("_n")), "client_id", "left_semi")
    e = train_asset_join(temporal_features(events, recent), assets)
    value = F.least(F.col("valor_activo") / F.lit(rules.ASSET_VALUE_CEILING), F.lit(1.0))
    numeric = F.col("numeric_anomaly") if "numeric_anomaly" in events.columns else t.numeric_feature("numeric_value")
    return e.withColumns({
        "asset_value": F.coalesce(F.when(F.col("valor_activo").isNotNull(), value), F.col("events_per_minute")),
        "event_type_id": t.event_type_id("event_type"),
        "numeric_anomaly": numeric,
    }).select("client_id", "asset_id", "event_id", "ts_us",
              *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in rules.FEATURES])


def history_at_event(events: DataFrame, assets: DataFrame) -> DataFrame:
    """Events of the last minute, gap to the previous event within 24 h and asset value, per event."""
    e = activity(events, KEYS, "ts_us", "event_id", lookback_us=86_400 * US, count_as="epm_count", prev_as="last_us")
    return train_asset_join(e, assets)


def contamination(events: DataFrame) -> DataFrame:
    """Share of dangerous events per tenant, kept within [0.005, 0.1]."""
    danger = (F.coalesce("severity_score", F.lit(0.0)) > 0.5) | ~F.lower(
        F.coalesce("pattern_hint", F.lit("none"))).isin("none", "reconnaissance")
    share = F.count_if(danger) / F.count("*")
    return events.groupBy("client_id").agg(
        F.count("*").alias("n_total"), F.count_if(danger).alias("n_danger"),
        F.greatest(F.lit(0.005), F.least(F.lit(0.1), share)).alias("contamination"))


def scaler(features: DataFrame, columns=rules.FEATURES) -> DataFrame:
    """Mean and population deviation per tenant and feature, wide; a zero deviation becomes 1."""
    aggs = []
    for c in columns:
        sd = F.stddev_pop(c)
        aggs += [F.avg(c).alias(f"{c}_mean"), F.when(sd > 1e-12, sd).otherwise(1.0).alias(f"{c}_scale")]
    return features.groupBy("client_id").agg(F.count("*").alias("n_rows"), *aggs)


def standard_scaler(features: DataFrame, columns=rules.FEATURES) -> DataFrame:
    """z-scores per tenant. The statistics are one row per tenant."""
    return scale(features, small_side(scaler(features, columns)), columns)


def scale(features: DataFrame, stats: DataFrame, columns=rules.FEATURES) -> DataFrame:
    joined = features.join(stats, "client_id")
    z = [((F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_scale")).alias(c) for c in columns]
    return joined.select(*[c for c in features.columns if c not in columns], *z)
