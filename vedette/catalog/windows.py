"""Sliding-window queries."""

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.numeric import US
from ..operators import chunked, filters, sweep
from .registry import query

F4 = "floor(({x}) * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE"


def r(x, digits):
    p = f"{10 ** digits}::DOUBLE"
    return f"floor(({x}) * {p} + 0.5::DOUBLE) / {p}"


FLAGS = """flagged AS (SELECT *,
  regexp_matches(lower(event_type), 'failed|failure|invalid|denied|authentication_failed|brute') AS is_failure,
  regexp_matches(lower(event_type), 'success|accepted|authenticated|logged_in|login') AS is_success,
  regexp_matches(lower(event_type), 'block|deny|firewall') AS is_blocked,
  regexp_matches(lower(event_type), 'outbound|egress') AS is_outbound FROM sec_events)"""

CORR = FLAGS + """, framed AS (SELECT *,
  list(DISTINCT asset_id) FILTER (is_failure) OVER w AS fa, list(DISTINCT asset_id) FILTER (is_success) OVER w AS sa,
  count(*) FILTER (is_blocked) OVER w AS blocked, count(*) OVER w AS n,
  count(*) FILTER (is_failure) OVER wa AS f, count(*) FILTER (is_success) OVER wa AS s,
  lag(ts_us) OVER (PARTITION BY client_id, src_ip ORDER BY ts_us, event_id) AS prev_us
  FROM flagged
  WINDOW w AS (PARTITION BY client_id, src_ip ORDER BY ts_us RANGE BETWEEN 360000000 PRECEDING AND CURRENT ROW),
         wa AS (PARTITION BY client_id, src_ip, asset_id ORDER BY ts_us RANGE BETWEEN 360000000 PRECEDING AND CURRENT ROW)),
correlated AS (SELECT *,
  CASE WHEN len(fa) > 0 AND len(sa) > 0 AND len(list_filter(fa, lambda x: NOT list_contains(sa, x))) > 0 THEN 'lateral_movement'
       WHEN f >= 3 AND s > 0 THEN 'brute_force_success' WHEN f >= 5 THEN 'brute_force' WHEN blocked >= 10 THEN 'port_scan'
       WHEN is_outbound THEN 'suspicious_outbound' ELSE 'none' END AS correlation_pattern,
  CASE WHEN len(fa) > 0 AND len(sa) > 0 AND len(list_filter(fa, lambda x: NOT list_contains(sa, x))) > 0 THEN len(fa) + len(sa)
       WHEN f >= 3 AND s > 0 THEN f WHEN f >= 5 THEN f WHEN blocked >= 10 THEN blocked
       WHEN is_outbound THEN 1 ELSE n END AS correlation_count,
  n AS correlation_events,
  CASE WHEN ts_us - prev_us <= 360000000 THEN floor(greatest(0.1::DOUBLE, (ts_us - prev_us) / 1000000::DOUBLE) * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE ELSE 300.0::DOUBLE END AS correlation_delta
  FROM framed)"""


@query("correlate_patterns", "sec_events", f"WITH {CORR} SELECT event_id, correlation_pattern, correlation_count, correlation_events, correlation_delta FROM correlated")
def _(v):
    return sweep.correlate(v.sec_events).select("event_id", "correlation_pattern", "correlation_count",
                                                "correlation_events", "correlation_delta")


@query("correlation_delta", "sec_events", f"WITH {CORR} SELECT client_id, src_ip, event_id, correlation_delta FROM correlated")
def _(v):
    e = chunked.previous_within(v.sec_events, ["client_id", "src_ip"], "ts_us", "event_id", 360 * US)
    gap = F.when(F.col("prev_us").isNotNull(), F.greatest(F.lit(0.1), (F.col("ts_us") - F.col("prev_us")) / F.lit(1e6)))
    return e.select("client_id", "src_ip", "event_id",
                    F.coalesce(F.floor(gap * 100.0 + 0.5).cast("double") / 100.0, F.lit(300.0)).alias("correlation_delta"))


@query("pattern_overview", "sec_events", f"""
WITH {CORR}, p AS (SELECT *, CASE WHEN correlation_pattern <> 'none' THEN correlation_pattern ELSE pattern_hint END AS p0 FROM correlated),
q AS (SELECT *, CASE WHEN correlation_count >= 5 AND p0 IN ('none', 'brute_force_attempt') THEN 'brute_force' ELSE p0 END AS pattern FROM p)
SELECT client_id, pattern, CASE WHEN severity_score >= 0.75 OR pattern IN ('lateral_movement', 'brute_force_success', 'c2_beacon') THEN 'high'
  WHEN severity_score >= 0.45 OR pattern IN ('brute_force', 'port_scan', 'suspicious_outbound') THEN 'medium' ELSE 'low' END AS risk_level, count(*) AS events
FROM q GROUP BY ALL""")
def _(v):
    labelled = filters.result_label(sweep.correlate(v.sec_events))
    return labelled.groupBy("client_id", F.col("label_pattern").alias("pattern"), "risk_level").agg(
        F.count("*").alias("events"))


@query("timestamp_delta", "sec_events", f"""
SELECT event_id, CASE WHEN p IS NULL THEN 1.0 ELSE {r("least(1.0::DOUBLE, log10((ts_us - p) / 1000000::DOUBLE + 1.0::DOUBLE) / log10(3601.0::DOUBLE))", 4)} END AS timestamp_delta
FROM (SELECT *, lag(ts_us) OVER (PARTITION BY client_id, asset_id ORDER BY ts_us, event_id) AS p FROM sec_events)""")
def _(v):
    e = chunked.previous_within(v.sec_events, ["client_id", "asset_id"], "ts_us", "event_id", 3600 * US)
    return e.select("event_id", t.delta_feature((F.col("ts_us") - F.col("prev_us")) / F.lit(1e6)).alias("timestamp_delta"))


@query("events_per_minute", "sec_events", f"""
SELECT event_id, {r("least(1.0::DOUBLE, (count(*) OVER (PARTITION BY client_id, asset_id ORDER BY ts_us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)) / 60.0::DOUBLE)", 4)} AS events_per_minute FROM sec_events""")
def _(v):
    e = v.sec_events.withColumn("_one", F.lit(1).cast("bigint"))
    counted = sweep.live_counts(e, ["client_id", "asset_id"], "ts_us", 60 * US, {"n": "_one"})
    return counted.select("event_id", t.rate_feature("n").alias("events_per_minute"))


@query("port_scan_score", "port_events", f"""
WITH pairs AS (SELECT a.event_id, b.dst_port, count(*) AS c FROM port_events a JOIN port_events b
   ON a.src_ip = b.src_ip AND b.ts_us > a.ts_us - 60000000 AND b.ts_us <= a.ts_us GROUP BY 1, 2),
agg AS (SELECT event_id, CAST(sum(c) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS u, sum(c) AS ni FROM pairs GROUP BY 1),
ent AS (SELECT p.event_id, -sum(p.c / a.n * log2(p.c / a.n)) AS h FROM pairs p JOIN agg a USING (event_id) GROUP BY 1),
m AS (SELECT event_id, n, u, u / n AS diversity, CASE WHEN u = 1 THEN 0 ELSE h END / log2(65535.0::DOUBLE) AS entropy FROM agg JOIN ent USING (event_id))
SELECT event_id,
  CASE WHEN n >= 5 THEN {r("diversity * 0.5 + entropy * 0.3 + least(n / 500.0, 1.0) * 0.2", 4)} ELSE 0 END AS nmap_score,
  n >= 5 AND u > 20 AND diversity > 0.7 AND n > 50 AS is_scan, CAST(CASE WHEN n >= 5 THEN u ELSE 0 END AS BIGINT) AS unique_ports,
  CASE WHEN n >= 5 THEN {r("n", 1)} ELSE 0 END AS rate_per_min, CASE WHEN n >= 5 THEN {r("diversity", 3)} ELSE 0 END AS diversity_ratio,
  CASE WHEN n >= 5 THEN {r("entropy", 3)} ELSE 0 END AS port_entropy
FROM m""")
def _(v):
    return sweep.port_scan_score(v.port_events).select("event_id", "nmap_score", "is_scan", "unique_ports",
                                                       "rate_per_min", "diversity_ratio", "port_entropy")


_REACH = """judged AS (SELECT *, NOT (severity_score < 0.05 OR lower(event_type) IN ('health_check', 'ping', 'keepalive', 'heartbeat', 'metrics_collection', 'log_rotation')
    OR (src_ip IN ('127.0.0.1', '::1', '192.168.14.137') AND severity_score < 0.5)) AS ok FROM sec_events)"""


@query("ip_rate_limit", "sec_events", f"""
WITH {_REACH}, c AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY src_ip ORDER BY ts_us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS n FROM judged)
SELECT event_id, n AS ip_per_minute, CASE WHEN ok AND severity_score < 0.4 AND n > 20 THEN substr(raw_hash, 1, 1) = '0' ELSE ok END AS passed,
  ok AND severity_score < 0.4 AND n > 20 AND substr(raw_hash, 1, 1) = '0' AS sampled FROM c""")
def _(v):
    keep = F.substring("raw_hash", 1, 1) == "0"
    return filters.ip_rate_limit(v.sec_events, per_minute=20, keep=keep).select(
        "event_id", "ip_per_minute", "passed", "sampled")


@query("lateral_movement_history", "sec_events", """
SELECT e.event_id, severity_score >= 0.6 AND EXISTS (SELECT 1 FROM sec_events h WHERE h.client_id = e.client_id AND h.src_ip = e.src_ip
   AND h.asset_id <> e.asset_id AND h.event_type ILIKE '%ssh%success%' AND h.ts_us > e.ts_us - 300000000 AND h.ts_us < e.ts_us) AS lateral_history
FROM sec_events e""")
def _(v):
    return sweep.lateral_movement_history(v.sec_events).select("event_id", "lateral_history")


@query("history_before_event", "incidents", """
SELECT id, count(*) OVER (PARTITION BY client_id, asset_id ORDER BY created_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS attack_count,
  count(*) OVER (PARTITION BY client_id, asset_id, pattern ORDER BY created_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0 AS first_occurrence
FROM incidents""")
def _(v):
    from ..operators.risk import history_before
    return history_before(v.incidents).select("id", "attack_count", "first_occurrence")
