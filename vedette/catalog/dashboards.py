"""Report queries over the incident table."""

from pyspark.sql import functions as F

from ..operators import dashboards as d
from .registry import query

NOW = "(SELECT max(created_us) FROM incidents)"
DAY = 86400000000
SUM2 = "coalesce(CAST(sum(CAST(ale AS DECIMAL(22,2))) AS DOUBLE), 0.0::DOUBLE)"


def avg6(c):
    return f"floor((CAST(sum(CAST({c} AS DECIMAL(26,6))) AS DOUBLE) / nullif(count({c}), 0)) * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE"


def rawavg(c):
    return f"(CAST(sum(CAST({c} AS DECIMAL(26,6))) AS DOUBLE) / nullif(count({c}), 0))"


def _summary(days):
    return f"""
SELECT client_id, count(*) AS total_alerts, count(*) FILTER (anomaly_score >= 0.8) AS critical_alerts,
  count(*) FILTER (anomaly_score >= 0.5 AND anomaly_score < 0.8) AS medium_alerts,
  {SUM2} AS ale_impact, coalesce({avg6('anomaly_score')}, 0) AS avg_confidence
FROM incidents WHERE created_us >= {NOW} - 24 * 3600000000 * {days} GROUP BY client_id"""


@query("stats_summary", "incidents", _summary(30))
def _(v):
    return d.stats_summary(v.incidents, hours=24 * 30)


def _trends(days):
    return f"""
SELECT client_id, created_us // 3600000000 * 3600000000 AS hour_us, count(*) AS incidents,
  CASE WHEN {rawavg('anomaly_score')} >= 0.8 THEN 'high' WHEN {rawavg('anomaly_score')} >= 0.5 THEN 'medium' ELSE 'low' END AS risk_level
FROM incidents WHERE created_us >= {NOW} - {days} * {DAY} GROUP BY 1, 2"""


@query("attack_trends", "incidents", _trends(365))
def _(v):
    return d.attack_trends(v.incidents, days=365)


def _top(field):
    return f"""
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY client_id ORDER BY incidents DESC, entity) AS INT) AS position FROM (
  SELECT client_id, {field} AS entity, count(*) AS incidents FROM incidents
  WHERE {field} IS NOT NULL AND {field} NOT IN ('127.0.0.1', '::1') GROUP BY 1, 2)) WHERE position <= 5"""


@query("top_attackers", "incidents", _top("src_ip"))
def _(v):
    return d.top_entities(v.incidents, "src_ip")


@query("top_assets", "incidents", _top("asset_id"))
def _(v):
    return d.top_entities(v.incidents, "asset_id")


def _profiles(days):
    return f"""
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY client_id ORDER BY machines_targeted DESC, total_financial_risk DESC NULLS LAST, attacker_ip) AS INT) AS position FROM (
  SELECT client_id, src_ip AS attacker_ip, count(DISTINCT asset_id) AS machines_targeted, count(*) AS total_incidents, {SUM2} AS total_financial_risk,
   min(first_seen_us) AS campaign_start_us, max(last_seen_us) AS campaign_last_seen_us,
   bool_or(last_seen_us >= {NOW} - 600000000) AS campaign_active, bool_or(lateral_movement_detected) AS lateral_movement_confirmed
  FROM incidents WHERE src_ip IS NOT NULL AND src_ip <> '0.0.0.0' AND created_us >= {NOW} - {days} * {DAY} GROUP BY 1, 2)) WHERE position <= 20"""


@query("attacker_correlation", "incidents", _profiles(30))
def _(v):
    return d.attacker_profiles(v.incidents, days=30)


def _timelines(days):
    return f"""
WITH top AS ({_profiles(days)})
SELECT i.client_id, i.src_ip AS attacker_ip, id, asset_id, victim_ip, pattern, event_type, event_count, ale, first_seen_us, last_seen_us,
  last_seen_us >= {NOW} - 600000000 AS still_active
FROM incidents i WHERE created_us >= {NOW} - {days} * {DAY} AND EXISTS (SELECT 1 FROM top t WHERE t.client_id = i.client_id AND t.attacker_ip = i.src_ip)"""


@query("attacker_timelines", "incidents", _timelines(30))
def _(v):
    return d.attacker_timelines(v.incidents, days=30)


_EXECUTIVE = f"""
SELECT client_id, count(*) FILTER (anomaly_score >= 0.85) AS critical_count,
  count(*) FILTER (anomaly_score >= 0.65 AND anomaly_score < 0.85) AS high_count,
  count(*) FILTER (anomaly_score >= 0.40 AND anomaly_score < 0.65) AS medium_count,
  count(*) FILTER (anomaly_score < 0.40) AS low_count,
  coalesce(CAST(sum(CAST(ale AS DECIMAL(22,2))) FILTER (status IN ('PENDING', 'SHADOW')) AS DOUBLE), 0.0::DOUBLE) AS total_active_financial_risk,
  count(*) FILTER (status = 'PENDING' AND anomaly_score >= 0.65 AND created_us < {NOW} - {DAY}) AS high_alerts_unattended_24h,
  floor({rawavg('((created_us - first_seen_us) / 60000000.0::DOUBLE)')} * 10 + 0.5::DOUBLE) / 10 AS avg_mttd_minutes,
  floor({rawavg('((reviewed_us - created_us) / 60000000.0::DOUBLE)')} * 10 + 0.5::DOUBLE) / 10 AS avg_mttr_minutes,
  count(DISTINCT src_ip) FILTER (created_us >= {NOW} - 7 * {DAY}) AS unique_attackers_7d,
  count(DISTINCT asset_id) FILTER (created_us >= {NOW} - 7 * {DAY}) AS assets_affected_7d
FROM incidents WHERE created_us >= {NOW} - 30 * {DAY} GROUP BY client_id"""


@query("executive_metrics", "incidents", _EXECUTIVE)
def _(v):
    return d.executive_metrics(v.incidents)


_BY_ASSET = f"""
SELECT client_id, asset_id, clasificacion_criticidad, count(*) AS total_incidents, {SUM2} AS total_ale,
  coalesce(max(valor_activo_snapshot), 0) AS asset_value, max(peak_anomaly_score) AS max_risk_score,
  CAST(sum(event_count) AS BIGINT) AS total_raw_events, max(last_seen_us) AS last_attack_us,
  bool_or(last_seen_us >= {NOW} - 600000000) AS under_attack_now,
  string_agg(DISTINCT pattern, ',' ORDER BY pattern) AS patterns, count(DISTINCT src_ip) AS unique_attackers,
  bool_or(lateral_movement_detected) AS lateral_movement
FROM incidents WHERE created_us >= {NOW} - 30 * {DAY} GROUP BY ALL"""


@query("risk_by_asset", "incidents", _BY_ASSET)
def _(v):
    return d.risk_by_asset(v.incidents).withColumn("patterns", F.array_join("patterns", ","))


@query("risk_summary", "incidents", f"""
WITH base AS (SELECT * FROM incidents WHERE ale IS NOT NULL),
m AS (SELECT client_id, asset_id, pattern, row_number() OVER (PARTITION BY client_id, asset_id ORDER BY count(*) DESC, pattern) AS rn FROM base GROUP BY 1, 2, 3)
SELECT b.client_id, b.asset_id, count(*) AS total_incidents, CAST(sum(CAST(ale AS DECIMAL(22,2))) AS DOUBLE) AS total_ale, {avg6('aro')} AS avg_aro,
  {avg6('anomaly_score')} AS avg_anomaly, max(created_us) AS last_incident_us, min(m.pattern) AS most_frequent_pattern
FROM base b JOIN m ON m.client_id = b.client_id AND m.asset_id = b.asset_id AND m.rn = 1 GROUP BY 1, 2""")
def _(v):
    return d.risk_summary(v.incidents)


_LATEST = """
SELECT client_id, id, created_us, explanation FROM (
  SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY created_us DESC, id DESC) AS rn FROM incidents WHERE explanation IS NOT NULL) WHERE rn = 1"""


@query("latest_explanation", "incidents", _LATEST)
def _(v):
    return d.latest_explanation(v.incidents)


#: Per frame of the dashboard: SQL, columns that name a row beside the tenant, texts, other measures.
_FRAMES = {
    "summary": (_summary(7), [], [], ["total_alerts", "critical_alerts", "medium_alerts", "ale_impact", "avg_confidence"]),
    "trends": (_trends(7), ["hour_us"], ["risk_level"], ["incidents"]),
    "top_attackers": (_top("src_ip"), ["position"], ["entity"], ["incidents"]),
    "top_assets": (_top("asset_id"), ["position"], ["entity"], ["incidents"]),
    "latest_explanation": (_LATEST, [], ["explanation"], ["id", "created_us"]),
    "attacker_profiles": (_profiles(7), ["position"], ["attacker_ip"], [
        "machines_targeted", "total_incidents", "total_financial_risk", "campaign_start_us", "campaign_last_seen_us",
        "campaign_active", "lateral_movement_confirmed"]),
    "attacker_timelines": (_timelines(7), ["id"], ["attacker_ip", "asset_id", "victim_ip", "pattern", "event_type"], [
        "event_count", "ale", "first_seen_us", "last_seen_us", "still_active"]),
    "executive_metrics": (_EXECUTIVE, [], [], [
        "critical_count", "high_count", "medium_count", "low_count", "total_active_financial_risk", "high_alerts_unattended_24h",
        "avg_mttd_minutes", "avg_mttr_minutes", "unique_attackers_7d", "assets_affected_7d"]),
    "risk_by_asset": (_BY_ASSET, ["asset_id", "clasificacion_criticidad"], ["patterns"], [
        "total_incidents", "total_ale", "asset_value", "max_risk_score", "total_raw_events", "last_attack_us", "under_attack_now",
        "unique_attackers", "lateral_movement"]),
}


def _dashboard_sql():
    """Every value of the nine frames: one row per frame, row and column."""
    parts = []
    for frame, (sql, names, texts, measures) in _FRAMES.items():
        name = " || '/' || ".join(["''", *[f"CAST({c} AS VARCHAR)" for c in names]])
        values = ", ".join([*[f"('{c}', {c}, NULL)" for c in texts], *[f"('{c}', NULL, CAST({c} AS DOUBLE))" for c in measures]])
        parts.append(f"SELECT '{frame}' AS frame, client_id, {name} AS name, m.measure, CAST(m.label AS VARCHAR) AS label, "
                     f"CAST(m.value AS DOUBLE) AS value FROM ({sql}) AS f, LATERAL (VALUES {values}) AS m(measure, label, value)")
    return "\nUNION ALL\n".join(parts)


@query("dashboard", "incidents", _dashboard_sql())
def _(v):
    frames, out = d.dashboard(v.incidents), None
    frames["risk_by_asset"] = frames["risk_by_asset"].withColumn("patterns", F.array_join("patterns", ","))
    for frame, (_, names, texts, measures) in _FRAMES.items():
        values = [F.struct(F.lit(c).alias("measure"), F.col(c).alias("label"), F.lit(None).cast("double").alias("value")) for c in texts]
        values += [F.struct(F.lit(c).alias("measure"), F.lit(None).cast("string").alias("label"), F.col(c).cast("double").alias("value"))
                   for c in measures]
        name = F.concat(*[x for c in names for x in (F.lit("/"), F.col(c).cast("string"))]) if names else F.lit("")
        rows = frames[frame].select(F.lit(frame).alias("frame"), "client_id", name.alias("name"), F.inline(F.array(*values)))
        out = rows if out is None else out.unionByName(rows)
    return out


_DERIVED = f"""coalesce(last_seen_us, {NOW}) AS x, last_seen_us >= {NOW} - 600000000 AS attack_still_active,
  floor((coalesce(last_seen_us, {NOW}) - first_seen_us) / 60000000.0::DOUBLE * 10 + 0.5::DOUBLE) / 10 AS attack_duration_minutes"""


@query("scan_incidents", "incidents", f"""
SELECT client_id, id, status, created_us, position, attack_still_active, attack_duration_minutes FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY client_id ORDER BY created_us DESC, id DESC) AS INT) AS position, {_DERIVED} FROM incidents WHERE status = 'PENDING')
WHERE position <= 50""")
def _(v):
    return d.incident_list(v.incidents).select("client_id", "id", "status", "created_us", "position",
                                               "attack_still_active", "attack_duration_minutes")


@query("incident_projection", "incidents", f"SELECT id, attack_still_active, attack_duration_minutes FROM (SELECT *, {_DERIVED} FROM incidents)")
def _(v):
    i = v.incidents
    return d.derived_columns(i, d.newest(i, "created_us")).select("id", "attack_still_active", "attack_duration_minutes")


@query("incident_by_id", "incidents", f"""
SELECT id, client_id, asset_id, src_ip, pattern, status, ale FROM incidents
WHERE id = (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 3 = 1) AND client_id = 'client-1'""")
def _(v):
    wanted = v.table("orders").where("o_orderstatus = 'O' and o_custkey % 3 = 1").agg(F.max("o_orderkey")).scalar()
    return d.incident_by_id(v.incidents, wanted, "client-1").select(
        "id", "client_id", "asset_id", "src_ip", "pattern", "status", "ale")


@query("pending_by_id", "incidents", f"""
SELECT id, client_id, status FROM incidents WHERE status = 'PENDING' AND client_id = 'client-1'
AND id = (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 3 = 1)""")
def _(v):
    wanted = v.table("orders").where("o_orderstatus = 'O' and o_custkey % 3 = 1").agg(F.max("o_orderkey")).scalar()
    return d.pending_by_id(v.incidents, wanted, "client-1").select("id", "client_id", "status")


@query("asset_behavior", "incidents", """
SELECT client_id, asset_id, id, position, src_ip, pattern, event_type, anomaly_score, aro, ale, status, created_us FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY client_id, asset_id ORDER BY created_us DESC, id DESC) AS INT) AS position FROM incidents) WHERE position <= 50""")
def _(v):
    return d.asset_behavior(v.incidents).select("client_id", "asset_id", "id", "position", "src_ip", "pattern",
                                                "event_type", "anomaly_score", "aro", "ale", "status", "created_us")


@query("top_by_cost", "incidents", """
SELECT id, client_id, ale FROM incidents ORDER BY ale DESC NULLS LAST, id LIMIT 25""")
def _(v):
    return v.incidents.select("id", "client_id", "ale").orderBy(F.desc_nulls_last("ale"), "id").limit(25)
