"""The event path: gateway, ingest and escalation as lazy plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import rules
from ..functions import text as t
from ..operators import detector, features as feat, filters, hst, incidents, iforest, joins, risk, sweep
from ..session import cut_lineage
from . import normalize, train


def gateway_batch(raw: DataFrame, assets: DataFrame, intel: DataFrame, technical_id: str | None = None,
                  ip_address: str | None = "victim_ip", earlier: DataFrame | None = None, **columns) -> DataFrame:
    """Normalise, enrich, correlate, match the asset, filter noise and label.

    ``raw`` holds event_id, client_id, ts_us and raw. An asset matches by technical id (if a
    column is named), host name, asset name or address. ``earlier``: events before the batch
    that its correlation windows reach.
    """
    e = normalize.normalize_events(raw, **columns)
    e = joins.threat_intel_enrich(e, intel)
    if earlier is None:
        e = sweep.correlate(e)
    else:
        both = e.withColumn("_old", F.lit(False)).unionByName(earlier.withColumn("_old", F.lit(True)), allowMissingColumns=True)
        e = sweep.correlate(both).where(~F.col("_old")).drop("_old")
    e = joins.match_asset(e, assets, technical_id=technical_id, hostname="asset_id", ip_address=ip_address)
    a = F.col("asset")
    value = F.when(a.isNotNull(), t.asset_value_feature(
        F.coalesce(a["valor_confidencialidad"], F.lit(3)), F.coalesce(a["valor_integridad"], F.lit(3)),
        F.coalesce(a["valor_disponibilidad"], F.lit(3)), a["valor_activo"])).otherwise(0.5)
    e = e.withColumn("features_vector", F.col("features_vector").withField("timestamp_delta", F.col("correlation_delta"))
                     .withField("asset_value", value))
    return filters.result_label(filters.siem_noise_filter(e))


def event_features(events: DataFrame, recent: DataFrame | None = None) -> DataFrame:
    """The detector's nine features per event, from columns with defaults of 0; ``recent``: earlier events in its windows."""
    e = feat.temporal_features(events, recent)

    def have(name: str, default):
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in events.columns else default

    return e.withColumns({
        "asset_value": have("asset_value", F.lit(0.5)),
        "event_type_id": t.event_type_id("event_type"),
        "command_risk": have("command_risk", F.lit(0.0)),
        "numeric_anomaly": have("numeric_anomaly", t.numeric_feature("numeric_value") if "numeric_value" in events.columns else F.lit(0.0)),
        "danger_score": have("danger_score", F.lit(0.3)),
    })


def ingest_batch(events: DataFrame, window: int = rules.HST_WINDOW) -> DataFrame:
    """Density score, port-scan score, combined score, escalation and route per event.

    ``events`` are correlated events; ``dst_port`` is optional. Events without a tenant
    are not scored.
    """
    return ingest_after(events, None, window)[0]


def ingest_after(events: DataFrame, state: detector.State | None, window: int = rules.HST_WINDOW,
                 lateness_us: int = 0) -> tuple[DataFrame, detector.State]:
    """``ingest_batch`` of a batch that comes after ``state`` (None: the first), and the state after it.

    Batches in a row score as one joint batch, if no event is older than those before it
    (``lateness_us``: by how much it may be, for the windows). Score frames are joined with each
    other first, the events once.
    """
    state = detector.empty(events.sparkSession) if state is None else state
    known = cut_lineage(events.where(F.coalesce("client_id", F.lit("")) != ""))
    narrow = event_features(known, state.recent).select(
        *hst.KEYS, "event_id", "ts_us", "danger_score", "severity_score", *[c for c in rules.FEATURES if c != "severity_score"])
    narrow = narrow.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in rules.FEATURES if c != "severity_score"})
    dens, sequenced = hst.half_space_trees_after(narrow, state, window)
    scores = dens.select("event_id", "river_score", "river_warmup", "is_anomaly", "learned")
    if "dst_port" in known.columns:
        columns = ["event_id", "ts_us", "client_id", "src_ip", "dst_port"]
        tried = known.select(*columns, F.lit(False).alias("_old")).unionByName(state.recent.select(*columns, F.lit(True).alias("_old")))
        scans = sweep.port_scan_score(tried.where("src_ip is not null and dst_port is not null"), ["client_id", "src_ip"]).where("not _old")
        scores = scores.join(scans.select("event_id", "nmap_score", "is_scan", "unique_ports", "rate_per_min"), "event_id", "left")
        scores = scores.withColumns({"nmap_score": F.coalesce("nmap_score", F.lit(0.0)), "is_scan": F.coalesce("is_scan", F.lit(False))})
        e = known.join(scores, "event_id")
    else:
        e = known.join(scores, "event_id").withColumns(
            {"nmap_score": F.lit(0.0), "is_scan": F.lit(False), "dst_port": F.lit(None).cast("int")})
    e = e.withColumn("combined_score", t.combined_score("river_score", "nmap_score", "src_ip", "dst_port"))
    return filters.route(filters.escalation(e)), detector.grown(state, known, sequenced, window, lateness_us)


def escalate_batch(events: DataFrame, assets: DataFrame, history: DataFrame, model: train.Trained | None = None,
                   known: DataFrame | None = None, reviews: DataFrame | None = None, mode: str = "SHADOW",
                   recent: DataFrame | None = None) -> DataFrame:
    """Incidents from escalated events: dedupe, asset meta, model score, money, consolidation.

    Without a model (or for tenants without one) the severity is the score. ``history``
    is the feature store for the yearly rate, ``recent`` what came shortly before the batch,
    for the gaps and rates that the model looks at.
    """
    e = events.where("route = 'escalated'")
    e = joins.drop_known(e, known)
    e = e.withColumn("pattern", t.effective_pattern("correlation_pattern", "pattern_hint"))
    e = joins.fetch_asset_meta(e, assets)
    if model is None:
        e = e.withColumn("_model", F.lit(None).cast("double"))
    else:
        # gaps and rates need all events, the model only those that are scored
        rows = feat.training_features(events, assets, recent=recent).join(e.select("event_id"), "event_id", "left_semi")
        scored = train.score(rows, model)
        e = e.join(scored.select("event_id", F.col("anomaly_score").alias("_model")), "event_id", "left")
    fallback = iforest.fallback_score("severity_score", F.lit(mode), F.col("_model").isNotNull(), F.col("_model"))
    e = e.withColumns({"anomaly_score": fallback["anomaly_score"], "model_mode": fallback["model_used"],
                       "lateral": iforest.lateral_flag("correlation_pattern", "severity_score")}).drop("_model")
    e = risk.incident_risk(e.drop("aro", "ale"), risk.yearly_rate(risk.attack_days(history)))
    e = cut_lineage(e)
    found = incidents.consolidate(e, reviews)
    opener = e.select("event_id", "ef", "sle", "valor_activo_snapshot", "clasificacion_criticidad", "aro_confidence",
                      "model_mode", "lateral").withColumnRenamed("event_id", "opener_id")
    return found.join(opener, "opener_id", "left").withColumn("status", filters.incident_status(F.lit(mode)))
