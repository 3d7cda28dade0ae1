"""Column-function queries: sanitising, classification, scores and filters."""

from pyspark.sql import functions as F

from .. import rules
from ..functions import text as t
from ..operators import filters
from ..session import widen
from .registry import query
from .windows import r


def _q(s: str) -> str:
    return s.replace("'", "''")


def _duck_sanitize(col: str) -> str:
    out = f"regexp_replace({col}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')"
    for p in rules.INJECTION_PATTERNS:
        p = p.replace("(?iU)on\\w+", "(?i)on[\\pL\\pN_]+").replace("(?iU)", "(?i)").replace("(?d)", "")
        out = f"regexp_replace({out}, '{_q(p)}', '[REDACTED]', 'g')"
    return out


def _sanitize_sql(table: str, key: str, col: str) -> str:
    return f"""SELECT {key}, s AS clean,
  contains(s, '[REDACTED]') AS redacted FROM (SELECT {key}, {_duck_sanitize(col)} AS s FROM {table})"""


@query("sanitize_text", "", _sanitize_sql("pages", "page_id", "html"))
def _(v):
    clean = widen(v.table("pages")).select("page_id", t.sanitize_text("html").alias("clean"))
    return clean.withColumn("redacted", F.col("clean").contains("[REDACTED]"))


@query("sanitize_documents", "", _sanitize_sql("documents", "doc_id", "text"))
def _(v):
    clean = widen(v.table("documents")).select("doc_id", t.sanitize_text("text").alias("clean"))
    return clean.withColumn("redacted", F.col("clean").contains("[REDACTED]"))


@query("payload_checks", "", """
SELECT page_id, strlen(html) <= 10485760 AS size_ok, strlen(html) <= 5000 AS small,
  substr(ltrim(html, ' '), 1, 1) IN ('{', '[') AS json_like FROM pages""")
def _(v):
    return v.table("pages").select("page_id", t.payload_size_ok("html").alias("size_ok"),
                                   t.payload_size_ok("html", 5000).alias("small"),
                                   t.looks_like_json("html").alias("json_like"))


def _detect_sql():
    parts = []
    for alternatives, name in rules.SOURCE_SIGNATURES:
        test = " OR ".join("(" + " AND ".join(f"list_contains(k, '{x}')" for x in a) + ")" for a in alternatives)
        if name == "google_workspace":
            test = f"({test}) AND starts_with(raw ->> '$.kind', 'admin#reports')"
        parts.append(f"WHEN {test} THEN '{name}'")
    return "CASE " + " ".join(parts) + " ELSE 'unknown' END"


@query("detect_source", "raw_logs", f"SELECT event_id, {_detect_sql()} AS source FROM (SELECT *, json_keys(raw) AS k FROM raw_logs)")
def _(v):
    return v.raw_logs.select("event_id", t.detect_source("raw").alias("source"))


def _classify_sql(text: str) -> str:
    """Independent form: list of hits, then best confidence, first on ties."""
    hits = []
    for i, (name, conf, regexes, reason) in enumerate(rules.PATTERN_FAMILIES):
        test = " OR ".join(f"regexp_matches(x, '{_q(p)}')" for p in regexes)
        if name == "data_exfiltration":
            block = " OR ".join(f"regexp_matches(x, '{_q(p)}')" for p in rules.PATTERN_FAMILIES[1][2])
            test = f"({test}) AND NOT ({block})"
        hits.append(f"CASE WHEN {test} THEN {{'c': {conf}, 'o': {-i}, 'p': '{name}', 'r': '{_q(reason)}'}} END")
    return f"list_max(list_filter([{', '.join(hits)}], lambda h: h IS NOT NULL))"


def _classify_query(table, key, col, sev):
    return f"""WITH s AS (SELECT {key}, {sev} AS sev, lower({col}) AS x FROM {table}), b AS (SELECT *, {_classify_sql('x')} AS best FROM s)
SELECT {key}, coalesce(best.p, CASE WHEN sev >= 0.8 THEN 'high_severity_event' ELSE 'none' END) AS pattern,
  coalesce(CAST(best.c AS DOUBLE), CASE WHEN sev >= 0.8 THEN 0.5 ELSE 0.0 END::DOUBLE) AS confidence,
  coalesce(best.r, CASE WHEN sev >= 0.8 THEN '{rules.HIGH_SEVERITY_EVENT[2]}' ELSE '{rules.NO_PATTERN[2]}' END) AS reason FROM b"""


@query("classify_pattern", "raw_logs", _classify_query("raw_logs", "event_id", "raw", "severity_score"))
def _(v):
    return widen(v.raw_logs).select("event_id", t.classify_pattern("raw", "severity_score").alias("c")).select("event_id", "c.*")


@query("classify_documents", "", _classify_query("documents", "doc_id", "text", "CAST(doc_id % 10 AS DOUBLE) / 10"))
def _(v):
    sev = F.col("doc_id") % 10 / F.lit(10.0)
    return widen(v.table("documents")).select("doc_id", t.classify_pattern("text", sev).alias("c")).select("doc_id", "c.*")


@query("normalize_timestamp", "sec_events", """
SELECT event_id, shape, CASE shape WHEN 0 THEN ts_us // 1000000 * 1000000 WHEN 1 THEN ts_us // 1000000 * 1000000 WHEN 2 THEN ts_us // 1000000 * 1000000
  WHEN 3 THEN ts_us // 1000000 * 1000000 WHEN 4 THEN ts_us // 1000000 * 1000000 WHEN 5 THEN ts_us // 1000000 * 1000000 END AS parsed_us
FROM (SELECT *, event_id % 7 AS shape FROM sec_events)""")
def _(v):
    s, ts = F.col("event_id") % 7, F.timestamp_micros("ts_us")
    text = (
        F.when(s == 0, F.date_format(ts, "yyyyMMddHHmmss"))
        .when(s == 1, F.call_function("div", F.col("ts_us"), F.lit(1000000)).cast("string"))
        .when(s == 2, F.call_function("div", F.col("ts_us"), F.lit(1000)).cast("string"))
        .when(s == 3, F.col("ts_us").cast("string"))
        .when(s == 4, (F.col("ts_us") * 1000).cast("string"))
        .when(s == 5, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise(F.lit("not a time"))
    )
    return v.sec_events.select("event_id", s.alias("shape"), t.normalize_timestamp(text).alias("parsed_us"))


@query("severity_level", "sec_events", """
SELECT event_id, CASE WHEN severity_score >= 0.85 THEN 'critical' WHEN severity_score >= 0.65 THEN 'high' WHEN severity_score >= 0.40 THEN 'medium' ELSE 'low' END AS severity FROM sec_events""")
def _(v):
    return v.sec_events.select("event_id", t.severity_level("severity_score").alias("severity"))


@query("event_hash", "sec_events", """
SELECT event_id, sha256(concat('{"asset_id": "', asset_id, '", "event_type": "', event_type, '", "src_ip": "', src_ip, '", "timestamp": "', ts_us, '"}')) AS event_hash,
  CAST(('0x' || substr(md5(event_type), 1, 8)) AS BIGINT) % 1000 / 1000::DOUBLE AS event_type_id FROM sec_events""")
def _(v):
    return v.sec_events.select(
        "event_id", t.event_hash("asset_id", "src_ip", "event_type", F.col("ts_us").cast("string")).alias("event_hash"),
        t.event_type_id("event_type").alias("event_type_id"))


@query("numeric_feature", "", f"""
SELECT event_id, CASE WHEN value <= 0 THEN 0 ELSE {r("least(1.0::DOUBLE, log10(value + 1.0::DOUBLE) / 4.0::DOUBLE)", 4)} END AS numeric_anomaly FROM events""")
def _(v):
    return v.table("events").select("event_id", t.numeric_feature("value").alias("numeric_anomaly"))


def _tier_sql(x, tiers, default):
    return "CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains({x}, '{w}')" for w in words) + f" THEN {v}" for v, words in tiers) + f" ELSE {default} END::DOUBLE"


@query("command_feature", "", f"SELECT doc_id, CASE WHEN text = '' THEN 0.0 ELSE {_tier_sql('lower(text)', rules.COMMAND_TIERS, 0.1)} END::DOUBLE AS command_risk FROM documents")
def _(v):
    return widen(v.table("documents")).select("doc_id", t.command_feature("text").alias("command_risk"))


@query("calendar_features", "month_events", f"""
SELECT event_id, {r("sin(6.283185307179586::DOUBLE * ((ts_us // 3600000000) % 24) / 24.0::DOUBLE) / 2.0 + 0.5", 4)} AS hour_of_day,
  {r("(isodow(make_timestamp(ts_us)) - 1) / 6.0::DOUBLE", 4)} AS day_of_week FROM month_events""")
def _(v):
    return v.month_events.select("event_id", t.hour_of_day("ts_us").alias("hour_of_day"),
                                 t.day_of_week("ts_us").alias("day_of_week"))


@query("asset_value_feature", "assets", f"""
SELECT id, {r("((coalesce(valor_confidencialidad, 3) + valor_integridad + valor_disponibilidad) / 15.0::DOUBLE) * 0.6::DOUBLE + least(coalesce(valor_activo, 0) / 100000::DOUBLE, 1.0) * 0.4::DOUBLE", 4)} AS asset_value FROM assets""")
def _(v):
    return v.assets.select("id", t.asset_value_feature(F.coalesce("valor_confidencialidad", F.lit(3)), "valor_integridad",
                                                       "valor_disponibilidad", "valor_activo").alias("asset_value"))


@query("asset_value_norm", "", f"""
SELECT o_orderkey, CASE WHEN v <= 0 THEN 0 WHEN v <= 1 THEN {r('v', 4)} ELSE {r('least(v / 100000::DOUBLE, 1.0)', 4)} END AS value_norm
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE CAST(o_orderkey % 11 - 2 AS DOUBLE) / 7 END AS v FROM orders)""")
def _(v):
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).otherwise((F.col("o_orderkey") % 11 - 2) / F.lit(7.0))
    return v.table("orders").select("o_orderkey", t.asset_value_norm(raw).alias("value_norm"))


@query("danger_score", "raw_logs", f"SELECT event_id, {_tier_sql('lower(raw)', rules.DANGER_TIERS, 0.3)} AS danger, {_tier_sql('lower(raw)', rules.DANGER_TIERS, 0.3)} >= 0.9 AS forced FROM raw_logs")
def _(v):
    d = t.danger_score("raw")
    return v.raw_logs.select("event_id", d.alias("danger"), t.is_forced_anomaly(d).alias("forced"))


def _sensor_sql():
    out = "CASE "
    for w, (a, b) in rules.SENSOR_THRESHOLDS.items():
        out += f"WHEN contains(topic, '{w}') THEN CASE WHEN value <= {a} THEN 0.1::DOUBLE ELSE {r(f'least(1.0::DOUBLE, 0.3::DOUBLE + (value - {a}::DOUBLE) / {b - a + 1}::DOUBLE * 0.7::DOUBLE)', 3)} END "
    return out + f"WHEN value > 100 THEN {r('least(1.0::DOUBLE, log10(value / 100.0::DOUBLE + 1.0::DOUBLE) * 0.5::DOUBLE)', 3)} ELSE 0.1::DOUBLE END"


_TOPICS = "['plant/temp', 'plant/pressure', 'Humidity', 'voltage/a', 'current', 'flow', 'vibration', 'other']"


@query("iot_danger", "", f"""
SELECT event_id, {_sensor_sql()} AS iot_danger FROM (SELECT event_id, value, lower({_TOPICS}[1 + event_id % 8]) AS topic FROM events)""")
def _(v):
    topics = F.array(*[F.lit(x) for x in ("plant/temp", "plant/pressure", "Humidity", "voltage/a", "current", "flow",
                                         "vibration", "other")])
    topic = F.element_at(topics, (F.col("event_id") % 8 + 1).cast("int"))
    return v.table("events").select("event_id", t.sensor_danger(topic, "value").alias("iot_danger"))


@query("private_ip", "sec_events", """
WITH ips AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN src_ip WHEN 1 THEN concat('172.', event_id % 256, '.0.1') WHEN 2 THEN concat('192.', event_id % 256, '.1.1')
   WHEN 3 THEN concat(event_id % 300, '.1.2.3') WHEN 4 THEN 'no address' ELSE '127.0.0.1' END AS ip FROM sec_events),
o AS (SELECT *, list_transform(string_split(ip, '.'), lambda x: TRY_CAST(x AS INT)) AS p FROM ips)
SELECT event_id, ip, CASE WHEN len(p) <> 4 OR list_contains(list_transform(p, lambda x: coalesce(x BETWEEN 0 AND 255, false)), false) THEN true
  ELSE p[1] = 10 OR p[1] = 127 OR (p[1] = 172 AND p[2] BETWEEN 16 AND 31) OR (p[1] = 192 AND p[2] = 168) END AS is_private,
  NOT (ip LIKE '10.%' OR ip LIKE '192.168.%' OR regexp_matches(ip, '^172\\.1[6-9]\\.') OR ip LIKE '172.2%' OR ip LIKE '127.%') AS external
FROM o""")
def _(v):
    e, s = F.col("event_id"), F.col("event_id") % 6
    ip = (F.when(s == 0, F.col("src_ip")).when(s == 1, F.concat(F.lit("172."), (e % 256).cast("string"), F.lit(".0.1")))
          .when(s == 2, F.concat(F.lit("192."), (e % 256).cast("string"), F.lit(".1.1")))
          .when(s == 3, F.concat((e % 300).cast("string"), F.lit(".1.2.3"))).when(s == 4, "no address").otherwise("127.0.0.1"))
    return v.sec_events.select("event_id", ip.alias("ip")).select(
        "event_id", "ip", t.is_private_ip("ip").alias("is_private"), t.external_ip("ip").alias("external"))


@query("auth_window_flags", "sec_events", """
SELECT event_id, list_bool_or([contains(e, w) FOR w IN ['failed', 'failure', 'invalid', 'denied', 'authentication_failed', 'brute']]) AS is_failure,
  list_bool_or([contains(e, w) FOR w IN ['success', 'accepted', 'authenticated', 'logged_in', 'login']]) AS is_success,
  list_bool_or([contains(e, w) FOR w IN ['block', 'deny', 'firewall']]) AS is_blocked, list_bool_or([contains(e, w) FOR w IN ['outbound', 'egress']]) AS is_outbound
FROM (SELECT event_id, lower(event_type) AS e FROM sec_events)""")
def _(v):
    return v.sec_events.select("event_id", *[c.alias(n) for n, c in t.auth_flags("event_type").items()])


_NOISE = "lower(event_type) IN ('health_check', 'ping', 'keepalive', 'heartbeat', 'metrics_collection', 'log_rotation')"


@query("siem_noise_filter", "sec_events", f"""
SELECT event_id, NOT (severity_score < 0.05 OR {_NOISE}) AS passed, CASE WHEN severity_score < 0.05 THEN 'low_severity' WHEN {_NOISE} THEN 'noise_event' ELSE 'approved' END AS reason FROM sec_events""")
def _(v):
    return filters.siem_noise_filter(v.sec_events).select("event_id", "passed", "reason")


@query("strict_filter", "sec_events", f"""
SELECT event_id, reason = 'approved' AS passed, reason FROM (SELECT event_id, CASE WHEN severity_score < 0.05 THEN 'low_severity' WHEN {_NOISE} THEN 'noise_event'
  WHEN ip IN ('127.0.0.1', '::1', '192.168.14.137') AND severity_score < 0.5 THEN 'trusted_ip' ELSE 'approved' END AS reason
FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN '192.168.14.137' ELSE src_ip END AS ip FROM sec_events))""")
def _(v):
    ip = F.when(F.col("event_id") % 5 == 0, "192.168.14.137").otherwise(F.col("src_ip"))
    return filters.strict_filter(v.sec_events.withColumn("src_ip", ip)).select("event_id", "passed", "reason")


def _scored(v):
    """Scores per event for the escalation rules, spread over their thresholds."""
    e = F.col("event_id")
    return v.sec_events.withColumns({
        "is_scan": e % 17 == 0, "river_score": F.col("severity_score"), "river_warmup": e % 5 == 0,
        "nmap_score": F.col("command_risk"), "dst_port": F.when(e % 3 == 0, F.lit(443)),
        "correlation_count": e % 9,
        "correlation_pattern": F.when(e % 19 == 0, "brute_force").when(e % 23 == 0, "port_scan").otherwise("none"),
    }).withColumn("combined_score", t.combined_score("river_score", "nmap_score", "src_ip", "dst_port"))


_SCORED = """scored AS (SELECT *, event_id % 17 = 0 AS is_scan, severity_score AS river_score, event_id % 5 = 0 AS warm, event_id % 9 AS cnt,
  CASE WHEN event_id % 19 = 0 THEN 'brute_force' WHEN event_id % 23 = 0 THEN 'port_scan' ELSE 'none' END AS pat,
  CASE WHEN event_id % 3 = 0 THEN severity_score * 0.4::DOUBLE + command_risk * 0.6::DOUBLE ELSE severity_score END AS combined FROM sec_events),
ruled AS (SELECT *, concat_ws('+', CASE WHEN is_scan THEN 'nmap_scan' END, CASE WHEN NOT warm AND river_score >= 0.45 THEN 'river' END,
  CASE WHEN NOT warm AND combined > 0.55 THEN 'combined' END, CASE WHEN cnt >= 5 OR pat IN ('brute_force', 'brute_force_success') THEN 'correlation' END) AS via FROM scored)"""


@query("combined_score", "sec_events", f"WITH {_SCORED} SELECT event_id, combined AS combined_score FROM scored")
def _(v):
    return _scored(v).select("event_id", "combined_score")


@query("escalation_rule", "sec_events", f"WITH {_SCORED} SELECT event_id, via, via <> '' AS should_escalate FROM ruled")
def _(v):
    return filters.escalation(_scored(v)).select("event_id", "via", "should_escalate")


@query("route", "sec_events", f"""
WITH {_SCORED} SELECT event_id, CASE WHEN event_id % 31 = 0 THEN 'skipped' WHEN via <> '' THEN 'escalated' ELSE 'normal' END AS route FROM ruled""")
def _(v):
    anon = F.when(F.col("event_id") % 31 != 0, F.col("client_id"))
    return filters.route(filters.escalation(_scored(v)).withColumn("client_id", anon)).select("event_id", "route")


@query("ingest_metrics", "sec_events", f"""
WITH {_SCORED} SELECT client_id, count(*) AS processed, count(*) FILTER (via = '') AS persisted, count(*) FILTER (via <> '') AS escalated, 0::BIGINT AS skipped_no_client,
  count(DISTINCT asset_id) AS models FROM ruled GROUP BY 1""")
def _(v):
    return filters.ingest_metrics(filters.route(filters.escalation(_scored(v))))


@query("incident_status", "incidents", "SELECT id, CASE WHEN status = 'SHADOW' THEN 'SHADOW' ELSE 'PENDING' END AS opened_as FROM incidents")
def _(v):
    return v.incidents.select("id", filters.incident_status("status").alias("opened_as"))


def _reason_sql():
    cases = " ".join(f"WHEN pattern = '{k}' THEN '{_q(x)}'" for k, x in rules.RESULT_REASONS.items())
    return f"CASE WHEN pattern = 'brute_force' THEN concat('Múltiples intentos fallidos (', cnt, ' intentos).') {cases} ELSE '{rules.RESULT_REASON_NONE}' END"


@query("risk_label", "sec_events", f"""
WITH {_SCORED}, l AS (SELECT *, event_id % 29 = 0 AS intel, CASE WHEN event_id % 29 = 0 THEN greatest(severity_score, 0.8) ELSE severity_score END AS s,
   CASE WHEN pat <> 'none' THEN pat ELSE pattern_hint END AS p0 FROM scored),
q AS (SELECT *, CASE WHEN cnt >= 5 AND p0 IN ('none', 'brute_force_attempt') THEN 'brute_force' ELSE p0 END AS pattern FROM l),
z AS (SELECT *, CASE WHEN s >= 0.75 OR pattern IN ('lateral_movement', 'brute_force_success', 'c2_beacon') THEN 'high'
   WHEN s >= 0.45 OR pattern IN ('brute_force', 'port_scan', 'suspicious_outbound') THEN 'medium' ELSE 'low' END AS risk_level FROM q)
SELECT event_id, pattern AS label_pattern, risk_level, CASE risk_level WHEN 'high' THEN 'escalate' WHEN 'medium' THEN 'review' ELSE 'ignore' END AS action,
  concat({_reason_sql()}, CASE WHEN intel THEN '{rules.RESULT_REASON_INTEL}' ELSE '' END) AS label_reason FROM z""")
def _(v):
    e = _scored(v).withColumn("threat_intel", F.col("event_id") % 29 == 0)
    return filters.result_label(e).select("event_id", "label_pattern", "risk_level", "action", "label_reason")


@query("hst_sigmoid", "sec_events", f"SELECT event_id, {r('1.0::DOUBLE / (1.0::DOUBLE + exp(-8.0::DOUBLE * (command_risk - 0.3::DOUBLE)))', 4)} AS score FROM sec_events")
def _(v):
    return v.sec_events.select("event_id", t.density_sigmoid("command_risk").alias("score"))


@query("google_asset", "sec_events", """
WITH a AS (SELECT event_id, client_id, CASE WHEN event_id % 97 = 0 AND client_id = 'client-1' THEN 'x@gmail.com' ELSE concat('user', event_id % 50, '@corp.example') END AS actor,
   CASE WHEN event_id % 3 = 0 THEN asset_id END AS parameter FROM sec_events)
SELECT event_id, CASE WHEN bool_or(regexp_matches(actor, '(?i)external|hacker|attacker|gmail\\.com|hotmail|yahoo')) OVER (PARTITION BY client_id) THEN coalesce(parameter, actor) ELSE actor END AS target_asset FROM a""")
def _(v):
    e = F.col("event_id")
    a = v.sec_events.select(
        "event_id", "client_id",
        F.when((e % 97 == 0) & (F.col("client_id") == "client-1"), "x@gmail.com")
        .otherwise(F.concat(F.lit("user"), (e % 50).cast("string"), F.lit("@corp.example"))).alias("actor"),
        F.when(e % 3 == 0, F.col("asset_id")).alias("parameter"))
    from ..operators.discovery import resolve_google_asset
    return resolve_google_asset(a, ["client_id"], "actor", "parameter").select("event_id", "target_asset")
