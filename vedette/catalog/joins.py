"""Join, feature and drift queries."""

from pyspark.sql import functions as F

from .. import rules
from ..operators import drift, features, joins
from .registry import query
from .windows import r


def _meta_first(key, name="hostname"):
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id, {key} ORDER BY id) AS rn FROM assets WHERE {name} IS NOT NULL) WHERE rn = 1)"""


@query("train_asset_join", "sec_events assets", f"""
SELECT e.event_id, e.client_id, e.asset_id, a.valor_activo FROM sec_events e LEFT JOIN {_meta_first('hostname')} a ON a.client_id = e.client_id AND a.hostname = e.asset_id""")
def _(v):
    return joins.train_asset_join(v.sec_events, v.assets).select("event_id", "client_id", "asset_id", "valor_activo")


@query("match_asset", "sec_events assets", """
WITH e AS (SELECT *, CASE event_id % 5 WHEN 0 THEN concat('tid-', event_id % 50) END AS tid,
  CASE event_id % 5 WHEN 1 THEN asset_id WHEN 2 THEN concat('ASSET ', event_id % 9) ELSE 'unknown' END AS host,
  CASE event_id % 5 WHEN 3 THEN concat('10.', event_id % 3, '.0.', event_id % 12) END AS addr FROM sec_events)
SELECT event_id, coalesce(
 (SELECT min(id) FROM assets a WHERE a.client_id = e.client_id AND a.technical_id = e.tid),
 (SELECT min(id) FROM assets a WHERE a.client_id = e.client_id AND a.hostname = e.host),
 (SELECT min(id) FROM assets a WHERE a.client_id = e.client_id AND lower(a.nombre_activo) = lower(e.host)),
 (SELECT min(id) FROM assets a WHERE a.client_id = e.client_id AND a.ip_address = e.addr)) AS matched_id FROM e""")
def _(v):
    i, s = F.col("event_id"), F.col("event_id") % 5
    e = v.sec_events.withColumns({
        "tid": F.when(s == 0, F.concat(F.lit("tid-"), (i % 50).cast("string"))),
        "host": F.when(s == 1, F.col("asset_id")).when(s == 2, F.concat(F.lit("ASSET "), (i % 9).cast("string"))).otherwise("unknown"),
        "addr": F.when(s == 3, F.concat(F.lit("10."), (i % 3).cast("string"), F.lit(".0."), (i % 12).cast("string"))),
    })
    return joins.match_asset(e, v.assets, "tid", "host", "addr").select("event_id", F.col("asset.id").alias("matched_id"))


@query("fetch_asset_meta", "sec_events assets", f"""
SELECT e.event_id, a.id IS NOT NULL AS registered, CASE WHEN a.id IS NOT NULL THEN coalesce(a.valor_activo, 0) END AS valor_activo, a.clasificacion_criticidad AS criticality,
  CASE WHEN a.id IS NOT NULL THEN coalesce(a.valor_confidencialidad, 3) END AS c, a.valor_integridad AS i, a.valor_disponibilidad AS d, a.contiene_pii AS pii
FROM sec_events e LEFT JOIN {_meta_first('hostname')} a ON a.client_id = e.client_id AND a.hostname = e.asset_id""")
def _(v):
    e = joins.fetch_asset_meta(v.sec_events, v.assets)
    m = "asset_meta."
    return e.select("event_id", F.col("asset_meta").isNotNull().alias("registered"), m + "valor_activo",
                    F.col(m + "clasificacion_criticidad").alias("criticality"), F.col(m + "valor_confidencialidad").alias("c"),
                    F.col(m + "valor_integridad").alias("i"), F.col(m + "valor_disponibilidad").alias("d"),
                    F.col(m + "contiene_pii").alias("pii"))


INTEL_SQL = """intel_at AS (SELECT e.*, (SELECT {'f': i.valid_from_us, 'u': coalesce(i.valid_to_us, 9223372036854775807), 'b': i.source = 'local_blocklist', 'c': CASE WHEN i.source = 'local_blocklist' THEN 90 ELSE i.confidence END, 's': i.source}
  FROM intel i WHERE i.ip = e.src_ip AND i.valid_from_us <= e.ts_us AND (i.source <> 'local_blocklist' OR e.ts_us < coalesce(i.valid_to_us, 9223372036854775807))
  ORDER BY i.source = 'local_blocklist' DESC, i.valid_from_us DESC, i.confidence DESC LIMIT 1) AS x FROM sec_events e)"""


@query("threat_intel_enrich", "sec_events intel", f"""
WITH {INTEL_SQL}, y AS (SELECT *, x IS NOT NULL AND ts_us < x.u AND src_ip NOT LIKE '10.%' AS ok FROM intel_at)
SELECT event_id, ok AND (x.b OR x.c >= 25) AS threat_intel, CASE WHEN ok THEN x.s END AS ti_source, CASE WHEN ok THEN x.c END AS ti_confidence FROM y""")
def _(v):
    return joins.threat_intel_enrich(v.sec_events, v.intel).select(
        "event_id", "threat_intel", F.col("ti_details.source").alias("ti_source"),
        F.col("ti_details.confidence").alias("ti_confidence"))


def shared_hashes(events):
    """Some events without a hash, and hashes that tenants share."""
    return events.withColumn("raw_hash", F.expr("CASE WHEN event_id % 17 = 0 THEN NULL ELSE md5(concat('e', event_id DIV 8)) END"))


@query("dup_check", "sec_events incidents", """
WITH h AS (SELECT * REPLACE (CASE WHEN event_id % 17 = 0 THEN NULL ELSE md5(concat('e', event_id // 8)) END AS raw_hash) FROM sec_events)
SELECT event_id, client_id, raw_hash FROM (SELECT *, row_number() OVER (PARTITION BY client_id, raw_hash ORDER BY ts_us, event_id) AS rn FROM h) h
 WHERE raw_hash IS NULL OR rn = 1 AND NOT EXISTS (SELECT 1 FROM incidents i WHERE i.status = 'APPROVED' AND i.client_id = h.client_id AND md5(concat('e', i.id)) = h.raw_hash)""")
def _(v):
    known = v.incidents.where("status = 'APPROVED'").select(
        "client_id", F.md5(F.concat(F.lit("e"), F.col("id").cast("string"))).alias("raw_hash"))
    return joins.drop_known(shared_hashes(v.sec_events), known).select("event_id", "client_id", "raw_hash")


@query("last_feature_vector", "month_events incidents", """
WITH i AS (SELECT *, created_us - 883612800000000 + 1704067200000000 AS t FROM (SELECT * REPLACE (1704067200000000 + (created_us % 2592000000000) AS created_us) FROM incidents)),
s AS (SELECT id, client_id, asset_id, created_us FROM (SELECT * REPLACE (1704067200000000 + (created_us % 2592000000000) AS created_us) FROM incidents))
SELECT s.id, f.event_id AS vector_event, f.severity_score FROM s ASOF LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id, asset_id, ts_us ORDER BY event_id DESC) AS rn FROM month_events) WHERE rn = 1) f
 ON s.client_id = f.client_id AND s.asset_id = f.asset_id AND s.created_us >= f.ts_us""")
def _(v):
    shifted = v.incidents.withColumn("created_us", F.lit(1704067200000000) + F.col("created_us") % F.lit(2592000000000))
    fv = v.month_events.withColumn("features_vector", F.struct("event_id", "severity_score"))
    return joins.last_feature_vector(shifted, fv).select(
        "id", F.col("features_vector.event_id").alias("vector_event"),
        F.col("features_vector.severity_score").alias("severity_score"))


@query("history_at_event", "sec_events assets", f"""
SELECT e.event_id, count(*) OVER (PARTITION BY e.client_id, e.asset_id ORDER BY ts_us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS epm_count,
  lag(ts_us) OVER (PARTITION BY e.client_id, e.asset_id ORDER BY ts_us, event_id) AS last_us, a.valor_activo
FROM sec_events e LEFT JOIN {_meta_first('hostname')} a ON a.client_id = e.client_id AND a.hostname = e.asset_id""")
def _(v):
    return features.history_at_event(v.sec_events, v.assets).select("event_id", "epm_count", "last_us", "valor_activo")


TRAIN = f"""tf AS (SELECT e.*, count(*) OVER (PARTITION BY client_id, asset_id ORDER BY ts_us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS n,
   lag(ts_us) OVER (PARTITION BY client_id, asset_id ORDER BY ts_us, event_id) AS p FROM sec_events e),
tg AS (SELECT tf.client_id, tf.asset_id, event_id, ts_us, severity_score,
  CASE WHEN a.valor_activo IS NOT NULL THEN least(a.valor_activo / 100000::DOUBLE, 1.0::DOUBLE) END AS av,
  CASE WHEN p IS NULL THEN 1.0::DOUBLE ELSE {r("least(1.0::DOUBLE, log10((ts_us - p) / 1000000::DOUBLE + 1.0::DOUBLE) / log10(3601.0::DOUBLE))", 4)} END AS timestamp_delta,
  CAST(('0x' || substr(md5(event_type), 1, 8)) AS BIGINT) % 1000 / 1000::DOUBLE AS event_type_id, command_risk,
  CASE WHEN numeric_value IS NULL OR numeric_value <= 0 THEN 0 ELSE {r("least(1.0::DOUBLE, log10(numeric_value + 1.0::DOUBLE) / 4.0::DOUBLE)", 4)} END AS numeric_anomaly,
  {r("sin(6.283185307179586::DOUBLE * ((ts_us // 3600000000) % 24) / 24.0::DOUBLE) / 2.0 + 0.5", 4)} AS hour_of_day,
  {r("(isodow(make_timestamp(ts_us)) - 1) / 6.0::DOUBLE", 4)} AS day_of_week,
  {r("least(1.0::DOUBLE, n / 60.0::DOUBLE)", 4)} AS events_per_minute
  FROM tf LEFT JOIN {_meta_first('hostname')} a ON a.client_id = tf.client_id AND a.hostname = tf.asset_id),
train AS (SELECT * EXCLUDE (av), coalesce(av, events_per_minute) AS asset_value FROM tg)"""


@query("train_features", "sec_events assets", f"WITH {TRAIN} SELECT * FROM train")
def _(v):
    return features.training_features(v.sec_events, v.assets, features.MIN_TRAINING_ROWS)


def _z(c):
    return f"round(({c} - avg({c}) OVER w) / CASE WHEN stddev_pop({c}) OVER w > 1e-12 THEN stddev_pop({c}) OVER w ELSE 1 END, 5) + 0.0 AS {c}"


@query("standard_scaler", "sec_events assets", f"WITH {TRAIN} SELECT event_id, client_id, {', '.join(_z(c) for c in rules.FEATURES)} FROM train WINDOW w AS (PARTITION BY client_id)")
def _(v):
    z = features.standard_scaler(features.training_features(v.sec_events, v.assets, features.MIN_TRAINING_ROWS))
    return z.select("event_id", "client_id", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in rules.FEATURES])


@query("contamination", "sec_events", """
SELECT client_id, count(*) AS n_total, count(*) FILTER (d) AS n_danger, greatest(0.005, least(0.1, count(*) FILTER (d) / count(*))) AS contamination
FROM (SELECT client_id, severity_score > 0.5 OR lower(pattern_hint) NOT IN ('none', 'reconnaissance') AS d FROM sec_events) GROUP BY 1""")
def _(v):
    return features.contamination(v.sec_events)


_PSI = """w AS (SELECT *, ts_us > (SELECT max(ts_us) FROM month_events) - 7 * 86400000000 AS recent FROM month_events WHERE ts_us > (SELECT max(ts_us) FROM month_events) - 28 * 86400000000),
u AS (SELECT t.c AS client_id, f.feature, f.value, recent FROM w, unnest([client_id, '*']) t(c),
  (SELECT unnest([{'feature': 'severity_score', 'value': severity_score}, {'feature': 'command_risk', 'value': command_risk}, {'feature': 'numeric_anomaly', 'value': numeric_anomaly}], recursive := true)) f),
n AS (SELECT client_id, feature, count(*) FILTER (recent) AS nr, count(*) FILTER (NOT recent) AS nb FROM u GROUP BY 1, 2),
h AS (SELECT n.*, b, (SELECT count(*) FROM u WHERE u.client_id = n.client_id AND u.feature = n.feature AND recent AND value >= b * 0.1::DOUBLE AND (value < (b + 1) * 0.1::DOUBLE OR (b = 9 AND value <= 1))) AS hr,
   (SELECT count(*) FROM u WHERE u.client_id = n.client_id AND u.feature = n.feature AND NOT recent AND value >= b * 0.1::DOUBLE AND (value < (b + 1) * 0.1::DOUBLE OR (b = 9 AND value <= 1))) AS hb FROM n, range(10) t(b)),
psi AS (SELECT client_id, feature, any_value(nr) AS n_recent, any_value(nb) AS n_baseline, CASE WHEN any_value(nr) >= 100 AND any_value(nb) >= 100 THEN
   floor(sum(((hr + 1) / (nr + 11) - (hb + 1) / (nb + 11)) * ln(((hr + 1) / (nr + 11)) / ((hb + 1) / (nb + 11)))) * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE ELSE 0 END AS psi FROM h GROUP BY 1, 2)"""


@query("psi", "month_events", f"WITH {_PSI} SELECT * FROM psi")
def _(v):
    return drift.psi(v.month_events)


@query("drift_gate", "month_events", f"WITH {_PSI} SELECT client_id, max(psi) AS max_psi, max(psi) > 0.2 AS drifted FROM psi GROUP BY 1")
def _(v):
    return drift.drift_gate(drift.psi(v.month_events))
