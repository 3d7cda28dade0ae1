"""Store, composite-job and forensic queries."""

import os
import uuid

from pyspark.sql import functions as F

from .. import rules
from ..operators import features, incidents, sweep
from ..session import shared_folder
from ..sources.raw import read_inventory
from ..session import widen
from ..plans import explain, forensic, normalize, pipeline, train
from ..plans.event_path import EventPath
from ..sources import store
from .registry import query
from .risk import _sessions
from .scalars import _classify_sql, _detect_sql
from .joins import INTEL_SQL, shared_hashes
from .windows import CORR, r


@query("scan_features", "month_events", """
SELECT event_id, client_id, ts_us FROM month_events WHERE client_id = 'client-1' AND ts_us >= (SELECT max(ts_us) FROM month_events) - 7 * 86400000000""")
def _(v):
    e = v.month_events
    since = e.agg(F.max("ts_us")).scalar() - F.lit(7 * 86_400_000_000)
    return store.scan_features(e, "client-1", since).select("event_id", "client_id", "ts_us")


@query("sink_features", "sec_events", """
WITH h AS (SELECT * REPLACE (CASE WHEN event_id % 17 = 0 THEN NULL ELSE md5(concat('e', event_id // 8)) END AS raw_hash) FROM sec_events),
k AS (SELECT *, coalesce(raw_hash, concat('row:', event_id)) AS row_key FROM h)
SELECT client_id, row_key, event_id, strftime(make_timestamp(ts_us), '%Y-%m-%d') AS created_date
FROM (SELECT *, row_number() OVER (PARTITION BY client_id, row_key ORDER BY ts_us, event_id) AS rn FROM k) WHERE rn = 1""")
def _(v):
    base = os.path.join(shared_folder(v.spark), f"store-{uuid.uuid4().hex}")
    e = shared_hashes(v.sec_events)
    store.sink_features(e, base)
    store.sink_features(e.withColumn("ts_us", F.col("ts_us") + 90_000_000_000), base)  # again, a day later: adds nothing
    return v.spark.read.parquet(base).select("client_id", "row_key", "event_id", F.col("created_date").cast("string").alias("created_date"))


@query("sink_escalated_features", "sec_events", """
SELECT client_id, escalated, count(*) AS rows, max(river_score) AS top_score FROM (SELECT *, command_risk >= 0.4 AS escalated, severity_score AS river_score FROM (
  SELECT * REPLACE (concat(raw_hash, '-', event_id) AS raw_hash) FROM sec_events)) GROUP BY 1, 2""")
def _(v):
    base = os.path.join(shared_folder(v.spark), f"features-{uuid.uuid4().hex}")
    e = v.sec_events.withColumns({"raw_hash": F.concat("raw_hash", F.lit("-"), F.col("event_id").cast("string")),
                                  "river_score": F.col("severity_score"), "escalated": F.col("command_risk") >= 0.4})
    store.sink_features(e.where("not escalated"), base)
    store.sink_features(e.where("escalated"), base)
    store.sink_features(e.where("escalated"), base)  # a second delivery changes nothing
    return v.spark.read.parquet(base).groupBy("client_id", "escalated").agg(
        F.count("*").alias("rows"), F.max("river_score").alias("top_score"))


@query("upsert_incidents", "burst_events decisions", _sessions(True))
def _(v):
    early = F.col("ts_us") < F.lit(1704067200000000 + 64_800_000_000)
    stored = incidents.consolidate(v.burst_events.where(early), v.decisions)
    new = incidents.consolidate(v.burst_events.where(~early), v.decisions)
    return incidents.merge_incidents(stored, new, v.decisions).drop("opener_id")


@query("read_inventory", "messy_assets", """
SELECT count(*) AS assets, count(CASE WHEN trim("Nombre del Activo") <> '' THEN 1 END) AS named, count("Valor") AS valued FROM messy_assets""")
def _(v):
    base = os.path.join(shared_folder(v.spark), f"inventory-{uuid.uuid4().hex}")
    v.messy_assets.write.csv(base, header=True)
    df = read_inventory(v.spark, base)
    return df.agg(F.count("*").alias("assets"), F.count(F.when(F.trim("`Nombre del Activo`") != "", 1)).alias("named"),
                  F.count("Valor").alias("valued"))


@query("retention", "incidents", "SELECT id, created_us FROM incidents WHERE created_us >= (SELECT max(created_us) FROM incidents) - 90 * 86400000000")
def _(v):
    return store.retention(v.incidents, v.incidents.agg(F.max("created_us")).scalar(), 90, "created_us").select("id", "created_us")


@query("expire_reports", "incidents", "SELECT id FROM incidents WHERE created_us > (SELECT max(created_us) FROM incidents) - 86400000000")
def _(v):
    return store.expire_reports(v.incidents, v.incidents.agg(F.max("created_us")).scalar()).select("id")


_CLEAN = "CASE event_id % 5 WHEN 4 THEN replace(raw, '<script>alert(1)</script>', '[REDACTED]') ELSE raw END"
_NORM = f"""n0 AS (SELECT *, {_CLEAN} AS clean, json_keys(raw) AS k FROM raw_logs),
n1 AS (SELECT *, {_detect_sql()} AS source,
  CASE event_id % 5 WHEN 0 THEN json_extract_string(raw, '$.data.srcip') WHEN 1 THEN json_extract_string(raw, '$.sourceIPAddress') WHEN 4 THEN json_extract_string(raw, '$.src_ip') END AS src_ip,
  CASE event_id % 5 WHEN 0 THEN json_extract_string(raw, '$.agent.name') ELSE 'unknown' END AS asset_id,
  CASE WHEN event_id % 5 = 0 THEN json_extract_string(raw, '$.rule.description') WHEN event_id % 5 = 2 AND json_extract_string(raw, '$.event_type') = 'authentication_failed' THEN 'authentication_failed'
     WHEN event_id % 5 = 4 THEN '[REDACTED] failed' ELSE 'Security Event' END AS event_type,
  floor(severity_score * 1000::DOUBLE + 0.5::DOUBLE) / 1000::DOUBLE AS sev3 FROM n0),
n2 AS (SELECT *, lower(concat(event_type, ' ', replace(replace(clean, '":', '": '), ',"', ', "'))) AS x, severity_score AS sev FROM n1),
n3 AS (SELECT *, {_classify_sql('x')} AS best FROM n2)"""


@query("normalize_events", "raw_logs", f"""
WITH {_NORM} SELECT event_id, client_id, source, src_ip, asset_id, event_type, sev3 AS severity_score,
  CASE WHEN sev3 >= 0.85 THEN 'critical' WHEN sev3 >= 0.65 THEN 'high' WHEN sev3 >= 0.4 THEN 'medium' ELSE 'low' END AS severity,
  coalesce(best.p, CASE WHEN sev >= 0.8 THEN 'high_severity_event' ELSE 'none' END) AS pattern_hint, coalesce(CAST(best.c AS DOUBLE), CASE WHEN sev >= 0.8 THEN 0.5 ELSE 0.0 END::DOUBLE) AS pattern_confidence FROM n3""")
def _(v):
    return normalize.normalize_events(widen(v.raw_logs), severity=F.col("severity_score"), received_us=F.col("ts_us")).select(
        "event_id", "client_id", "source", "src_ip", "asset_id", "event_type", "severity_score", "severity", "pattern_hint", "pattern_confidence")


_GATE = f"""{_NORM}, norm AS (SELECT event_id, client_id, ts_us, source, src_ip, asset_id, event_type, sev3, coalesce(best.p, CASE WHEN sev >= 0.8 THEN 'high_severity_event' ELSE 'none' END) AS hint FROM n3),
{INTEL_SQL.replace('FROM sec_events e', 'FROM norm e')}, {CORR.replace('FROM sec_events', 'FROM norm')},
g AS (SELECT c.event_id, c.client_id, c.source, c.src_ip, c.asset_id, c.sev3, c.hint, c.event_type, coalesce(i.x IS NOT NULL AND i.ts_us < i.x.u AND i.src_ip NOT LIKE '10.%' AND (i.x.b OR i.x.c >= 25), false) AS threat_intel,
  c.correlation_pattern AS p0, c.correlation_count AS n0, c.is_outbound FROM correlated c JOIN intel_at i USING (event_id)),
h AS (SELECT *, CASE WHEN threat_intel THEN 'c2_beacon' WHEN src_ip IS NULL THEN CASE WHEN is_outbound THEN 'suspicious_outbound' ELSE 'none' END ELSE p0 END AS correlation_pattern,
  CASE WHEN threat_intel THEN 1 WHEN src_ip IS NULL THEN CASE WHEN is_outbound THEN 1 ELSE 0 END ELSE n0 END AS correlation_count FROM g),
l AS (SELECT *, CASE WHEN threat_intel THEN greatest(sev3, 0.8) ELSE sev3 END AS s, CASE WHEN correlation_pattern <> 'none' THEN correlation_pattern ELSE hint END AS q0 FROM h),
z AS (SELECT *, CASE WHEN correlation_count >= 5 AND q0 IN ('none', 'brute_force_attempt') THEN 'brute_force' ELSE q0 END AS label_pattern FROM l),
y AS (SELECT *, CASE WHEN s >= 0.75 OR label_pattern IN ('lateral_movement', 'brute_force_success', 'c2_beacon') THEN 'high' WHEN s >= 0.45 OR label_pattern IN ('brute_force', 'port_scan', 'suspicious_outbound') THEN 'medium' ELSE 'low' END AS risk_level FROM z)
SELECT event_id, client_id, source, src_ip, asset_id, threat_intel, correlation_pattern, correlation_count,
  coalesce((SELECT min(id) FROM assets a WHERE a.client_id = y.client_id AND a.hostname = y.asset_id), (SELECT min(id) FROM assets a WHERE a.client_id = y.client_id AND lower(a.nombre_activo) = lower(y.asset_id)),
    (SELECT min(id) FROM assets a WHERE a.client_id = y.client_id AND a.ip_address = CASE y.event_id % 5 WHEN 0 THEN '10.0.0.7' END)) AS asset_row,
  NOT (sev3 < 0.05 OR lower(event_type) IN ('health_check', 'ping', 'keepalive', 'heartbeat', 'metrics_collection', 'log_rotation')) AS passed, risk_level,
  CASE risk_level WHEN 'high' THEN 'escalate' WHEN 'medium' THEN 'review' ELSE 'ignore' END AS action, label_pattern FROM y"""


@query("gateway_batch", "raw_logs intel assets", f"WITH {_GATE}")
def _(v):
    e = pipeline.gateway_batch(widen(v.raw_logs), v.assets, v.intel, severity=F.col("severity_score"), received_us=F.col("ts_us"))
    return e.select("event_id", "client_id", "source", "src_ip", "asset_id", "threat_intel", "correlation_pattern",
                    "correlation_count", F.col("asset.id").alias("asset_row"), "passed", "risk_level", "action", "label_pattern")


@query("ingest_batch", "", None)
def _(v):
    e = sweep.correlate(v.sec_events).withColumn("dst_port", F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 1000).cast("int")))
    return pipeline.ingest_batch(e, window=100).select("event_id", "client_id", "river_score", "nmap_score", "combined_score", "via", "route")


_ESC = f"""c1 AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'brute_force_success' ELSE 'none' END AS cpat FROM sec_events WHERE command_risk >= 0.4),
d1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id, raw_hash ORDER BY ts_us, event_id) AS rn FROM c1) k WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM incidents i WHERE i.status = 'APPROVED' AND i.client_id = k.client_id AND md5(concat('e', i.id)) = k.raw_hash)),
e1 AS (SELECT *, CASE WHEN cpat <> 'none' THEN cpat ELSE pattern_hint END AS pattern, severity_score AS score FROM d1),
g1 AS (SELECT *, lag(ts_us) OVER (PARTITION BY client_id, asset_id, src_ip, pattern ORDER BY ts_us, event_id) AS p FROM e1),
b1 AS (SELECT *, CASE WHEN p IS NULL OR ts_us - p > (CASE pattern WHEN 'port_scan' THEN 120 WHEN 'brute_force_attempt' THEN 60 WHEN 'none' THEN 60 WHEN 'brute_force_success' THEN 15 WHEN 'lateral_movement' THEN 10 WHEN 'data_exfiltration' THEN 5 ELSE 120 END) * 60000000::BIGINT THEN 1 ELSE 0 END AS o FROM g1),
s1 AS (SELECT *, sum(o) OVER (PARTITION BY client_id, asset_id, src_ip, pattern ORDER BY ts_us, event_id) AS k FROM b1)
SELECT client_id, asset_id, src_ip, pattern, count(*) AS event_count, min(ts_us) AS first_seen_us, max(ts_us) AS last_seen_us, max(score) AS peak_anomaly_score, arg_max(score, (ts_us, event_id)) AS anomaly_score, arg_min(event_id, (ts_us, event_id)) AS opener_id, 'SHADOW' AS status
FROM s1 GROUP BY client_id, asset_id, src_ip, pattern, k"""


@query("escalate_batch", "sec_events incidents", "WITH " + _ESC)
def _(v):
    e = v.sec_events.withColumns({
        "route": F.when(F.col("command_risk") >= 0.4, "escalated").otherwise("normal"),
        "correlation_pattern": F.when(F.col("event_id") % 2 == 0, "brute_force_success").otherwise("none"),
    })
    known = v.incidents.where("status = 'APPROVED'").select("client_id", F.md5(F.concat(F.lit("e"), F.col("id").cast("string"))).alias("raw_hash"))
    out = pipeline.escalate_batch(e, v.assets, v.month_events, known=known)
    return out.select("client_id", "asset_id", "src_ip", "pattern", "event_count", "first_seen_us", "last_seen_us",
                      "peak_anomaly_score", "anomaly_score", "opener_id", "status")


@query("escalate_batch_model", "", None)
def _(v):
    trained = train.train(features.training_features(v.sec_events, v.assets, features.MIN_TRAINING_ROWS), features.contamination(v.sec_events))
    e = v.sec_events.withColumns({
        "route": F.when(F.col("command_risk") >= 0.4, "escalated").otherwise("normal"),
        "correlation_pattern": F.lit("none"),
    })
    out = pipeline.escalate_batch(e, v.assets, v.month_events, model=trained)
    return out.select("client_id", "asset_id", "src_ip", "pattern", "event_count", "peak_anomaly_score", "ef", "sle", "aro", "ale", "model_mode")


_FLAGGED = """f AS (SELECT event_id, concat(['db-', 'web-', 'iot-', 'pc-'][1 + event_id % 4], event_id % 20) AS target_asset, event_type AS event_name, command_risk > 0.8 AS is_anomaly FROM sec_events),
per AS (SELECT target_asset, count(*) AS events, count(*) FILTER (is_anomaly) AS anomalies FROM f GROUP BY 1 HAVING count(*) FILTER (is_anomaly) > 0),
av AS (SELECT *, CASE WHEN target_asset LIKE 'db%' THEN 0.95 WHEN target_asset LIKE 'web%' THEN 0.60 WHEN target_asset LIKE 'iot%' THEN 0.40 ELSE 0.30 END::DOUBLE AS av FROM per),
m1 AS (SELECT *, """ + r("av * 50000::DOUBLE", 2) + " AS av_usd, " + r("least(0.99::DOUBLE, av * 0.6::DOUBLE + anomalies / events * 0.8::DOUBLE)", 2) + """ AS ef, anomalies * 12.0::DOUBLE AS aro FROM av),
m2 AS (SELECT *, """ + r("av_usd * ef", 2) + """ AS sle_usd FROM m1),
money AS (SELECT target_asset, events, anomalies, av_usd, ef, aro, sle_usd, """ + r("sle_usd * aro", 2) + " AS ale_cost FROM m2)"


def _flagged(v):
    i = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("db-", "web-", "iot-", "pc-")]), (i % 4 + 1).cast("int"))
    return v.sec_events.select("event_id", F.concat(kind, (i % 20).cast("string")).alias("target_asset"),
                               F.col("event_type").alias("event_name"), (F.col("command_risk") > 0.8).alias("is_anomaly"))


@query("sandbox_asset_money", "sec_events", f"WITH {_FLAGGED} SELECT * FROM money")
def _(v):
    return forensic.asset_money(_flagged(v)).select("target_asset", "events", "anomalies", "av_usd", "ef", "aro", "sle_usd", "ale_cost")


@query("forensic_report", "sec_events", f"""
WITH {_FLAGGED} SELECT {r("greatest(5.0::DOUBLE, 100.0::DOUBLE * pow(1.0::DOUBLE - sum(anomalies) / (SELECT count(*) FROM sec_events), 2.5::DOUBLE))", 1)} AS global_health,
 CAST(sum(CAST(ale_cost AS DECIMAL(22,2))) AS DOUBLE) AS total_ale_risk, count(*) AS critical_assets_count FROM money""")
def _(v):
    f = _flagged(v)
    return forensic.health(f, forensic.asset_money(f))


@query("top_threats", "sec_events", f"WITH {_FLAGGED} SELECT target_asset, ale_cost FROM money ORDER BY ale_cost DESC, target_asset LIMIT 5")
def _(v):
    return forensic.top_threats(forensic.asset_money(_flagged(v))).select("target_asset", "ale_cost")


@query("event_top3", "sec_events", f"""
WITH {_FLAGGED}, c AS (SELECT target_asset, event_name, count(*) AS n FROM f WHERE is_anomaly GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY target_asset ORDER BY n DESC, event_name) AS p FROM c)
SELECT target_asset, string_agg(event_name, ', ' ORDER BY p) AS top_events FROM t WHERE p <= 3 GROUP BY 1""")
def _(v):
    return forensic.event_top3(_flagged(v))


@query("forensic_scan", "", None)
def _(v):
    return forensic.forensic_scan(widen(v.raw_logs))["assets"]


@query("explain_asset", "", None)
def _(v):
    prepared = forensic.prepare(widen(v.raw_logs))
    return forensic.explain_assets(prepared.withColumn("is_anomaly", F.col("danger_score") >= 0.5))


def _shifted(v):
    created = F.lit(1704067200000000) + F.col("created_us") % F.lit(2592000000000)
    return v.incidents.withColumn("created_us", created)


def _vectors(v):
    e = v.month_events.withColumns({"timestamp_delta": F.col("command_risk") * 4000.0})
    return e.select("client_id", "asset_id", "event_id", "ts_us", *[
        (F.col(f) if f in e.columns else F.lit(0.5)).cast("double").alias(f) for f in rules.FEATURES])


@query("explain_incidents", "month_events incidents", f"""
WITH s AS (SELECT id, client_id, asset_id, 1704067200000000 + (created_us % 2592000000000) AS t, anomaly_score FROM incidents),
j AS (SELECT s.id, s.client_id, coalesce(f.severity_score, s.anomaly_score) AS sev, coalesce(f.command_risk * 4000.0, 300.0) AS d FROM s ASOF LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id, asset_id, ts_us ORDER BY event_id DESC) AS rn FROM month_events) WHERE rn = 1) f
 ON s.client_id = f.client_id AND s.asset_id = f.asset_id AND s.t >= f.ts_us)
SELECT id, client_id, CASE WHEN abs(a) >= abs(b) THEN '{rules.EXPLANATIONS["severity_score"]}' ELSE '{rules.EXPLANATIONS["timestamp_delta"]}' END AS explanation
FROM (SELECT *, {r('(sev - 0.5) * 0.6', 4)} AS a, {r('-d / 10000.0', 4)} AS b FROM j)""")
def _(v):
    return explain.explain_incidents(_shifted(v), _vectors(v)).select("id", "client_id", "explanation")


@query("explain_incidents_model", "", None)
def _(v):
    trained = train.train(features.training_features(v.sec_events, v.assets, features.MIN_TRAINING_ROWS), features.contamination(v.sec_events))
    return explain.explain_incidents(_shifted(v), _vectors(v), trained).select("id", "client_id", "explanation")


@query("event_path", "", None)
def _(v):
    """Two batches of raw logs through the whole path; the incidents of both."""
    path = EventPath(os.path.join(shared_folder(v.spark), f"path-{uuid.uuid4().hex}"), v.assets, v.intel, window=100,
                     technical_id="external_event_id", columns=lambda: {"severity": F.col("severity_score"), "received_us": F.col("ts_us")})
    cut = v.raw_logs.agg(F.percentile_approx("ts_us", 0.5)).scalar()
    for batch, part in enumerate((v.raw_logs.where(F.col("ts_us") <= cut), v.raw_logs.where(F.col("ts_us") > cut))):
        path(widen(part), batch)
    return path.incidents(v.spark).select(*incidents.KEY, "event_count", "first_seen_us", "last_seen_us", "peak_anomaly_score", "opener_id", "status", "ef", "sle")
