"""Training, scoring and explaining with the isolation forest, for all tenants at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import features as feat, iforest
from ..session import cut_lineage, small_side

KEYS = ["client_id"]


@dataclass
class Trained:
    scaled: DataFrame
    stats: DataFrame
    model: DataFrame
    offset: DataFrame
    decided: DataFrame
    stability: DataFrame


def train(features: DataFrame, contamination: DataFrame, row_id: str = "event_id") -> Trained:
    """Scale, fit, score and place the decision offset.

    Features, trees and scores feed several later steps each, so each is checkpointed
    once instead of being computed again by every step.
    """
    features = cut_lineage(features)
    stats = small_side(feat.scaler(features))
    scaled = feat.scale(features, stats)
    model = cut_lineage(iforest.fit(scaled, KEYS, row_id))
    scores = cut_lineage(iforest.raw_scores(scaled, model, KEYS, row_id))
    offset = small_side(iforest.offsets(scores, contamination, KEYS))
    decided = iforest.decide(scores, offset, KEYS)
    return Trained(scaled, stats, model, offset, decided, iforest.stability(decided, contamination, KEYS))


def score(features: DataFrame, trained: Trained, row_id: str = "event_id") -> DataFrame:
    """decision, anomaly_score and confidence of new rows; tenants without a model drop out."""
    scaled = feat.scale(features, trained.stats)
    scores = iforest.raw_scores(scaled, trained.model, KEYS, row_id)
    return iforest.decide(scores, trained.offset, KEYS)


def explain(trained: Trained, row_id: str = "event_id") -> DataFrame:
    """Attribution of the rows decided as anomalies."""
    flagged = trained.decided.where("is_anomaly").select(*KEYS, row_id)
    rows = trained.scaled.join(flagged, [*KEYS, row_id], "left_semi")
    return iforest.shap_attribution(rows, trained.model, KEYS, row_id)
