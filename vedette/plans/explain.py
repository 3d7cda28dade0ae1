"""Explanations of incidents: newest feature vector, attribution, sentence."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import rules
from ..operators import features as feat, iforest, joins
from ..session import cut_lineage
from .train import KEYS, Trained


def incident_vectors(incidents: DataFrame, features: DataFrame) -> DataFrame:
    """(client_id, id, nine features) of each incident: the asset's newest vector at its
    creation, or severity = score, asset value .5 and a delta of 300 where there is none."""
    packed = features.withColumn("features_vector", F.struct(*rules.FEATURES)).select(
        "client_id", "asset_id", "event_id", "ts_us", "features_vector")
    rows = joins.last_feature_vector(incidents.select("client_id", "asset_id", "id", "created_us", "anomaly_score"), packed)
    v = F.col("features_vector")
    default = {"severity_score": F.coalesce("anomaly_score", F.lit(0.5)), "asset_value": F.lit(0.5), "timestamp_delta": F.lit(300.0)}
    return rows.select("client_id", "id", *[
        F.when(v.isNotNull(), F.coalesce(v[f], F.lit(0.0))).otherwise(default.get(f, F.lit(0.0))).alias(f) for f in rules.FEATURES])


def explain_incidents(incidents: DataFrame, features: DataFrame, trained: Trained | None = None) -> DataFrame:
    """(client_id, id, contributions, explanation). Without a model the simple attribution is used."""
    vectors = incident_vectors(incidents, features)
    if trained is None:
        parts = iforest.attribution_fallback("severity_score", "timestamp_delta")
        rows = vectors
    else:
        scaled = cut_lineage(feat.scale(vectors, trained.stats))
        rows = iforest.shap_attribution(scaled, trained.model, KEYS, "id")
        parts = {f: F.col(f) for f in rules.FEATURES}
    contributions = F.create_map(*[x for f, c in parts.items() for x in (F.lit(f), c)])
    return rows.select("client_id", "id", contributions.alias("contributions"),
                       iforest.explain_incident(parts).alias("explanation"))
