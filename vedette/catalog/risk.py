"""Risk, consolidation, change-table and inventory queries."""

from pyspark.sql import functions as F

from .. import rules
from ..functions import text as t
from ..operators import incidents, inventory, joins, ranking, risk
from .joins import _meta_first
from .registry import query
from .windows import r


def table_sql(key, table, default):
    return "CASE " + " ".join(f"WHEN {key} = '{k}' THEN {x}" for k, x in table.items()) + f" ELSE {default} END"


EF = lambda key: f"CAST({table_sql(key, {k: x[0] for k, x in rules.PATTERN_RISK.items()}, 0.10)} AS DOUBLE)"
CAP = lambda key: f"CAST({table_sql(key, {k: x[2] for k, x in rules.PATTERN_RISK.items()}, 52.0)} AS DOUBLE)"


@query("exposure_factor_table", "sec_events", f"""
SELECT pattern, {EF('pattern')} AS ef, {CAP('pattern')} AS aro_cap, count(*) AS events FROM (
  SELECT pattern_hint AS pattern FROM sec_events UNION ALL SELECT 'brute_force' FROM sec_events) GROUP BY 1""")
def _(v):
    e = v.sec_events.select(F.col("pattern_hint").alias("pattern")).unionAll(v.sec_events.select(F.lit("brute_force")))
    counts = e.groupBy("pattern").agg(F.count("*").alias("events"))
    known = risk.pattern_table(v.spark)
    return counts.join(known, "pattern", "left").select(
        "pattern", F.coalesce("ef", F.lit(0.10)).alias("ef"), F.coalesce("aro_cap", F.lit(52.0)).alias("aro_cap"), "events")


@query("sle", "incidents", f"SELECT id, {r('coalesce(valor_activo_snapshot, 0) * ' + EF('pattern'), 2)} AS sle FROM incidents")
def _(v):
    return v.incidents.select("id", risk.single_loss("valor_activo_snapshot", "pattern").alias("sle"))


_HINTS = "[" + ", ".join(f"{{'p': '{k}', 'h': '{x[3]}'}}" for k, x in rules.PATTERN_RISK.items()) + "]"
DAYS = f"""hit AS (SELECT DISTINCT client_id, asset_id, ts_us // 86400000000 AS day, src_ip, p.p AS pattern FROM (
  SELECT e.*, unnest(list_filter({_HINTS}, lambda x: contains(lower(e.event_type), x.h) OR e.pattern_hint = x.p)) AS p FROM month_events e)
  UNION SELECT DISTINCT client_id, asset_id, ts_us // 86400000000, src_ip, pattern_hint FROM month_events),
daily AS (SELECT client_id, asset_id, pattern, day, count(DISTINCT src_ip) AS ips FROM hit GROUP BY ALL),
days AS (SELECT client_id, asset_id, pattern, count(*) AS days_attacked, min(day) AS first_day, max(day) AS last_day, max(ips) AS peak_ips FROM daily GROUP BY 1, 2, 3),
rates AS (SELECT client_id, asset_id, pattern, {r(f"least(days_attacked / (least(greatest(last_day - first_day + 1, 30), 365) / 365.0::DOUBLE), {CAP('pattern')})", 4)} AS aro,
  days_attacked AS aro_sample_size, least(greatest(last_day - first_day + 1, 30), 365) AS aro_period_days,
  CASE WHEN days_attacked >= 10 AND least(greatest(last_day - first_day + 1, 30), 365) >= 180 THEN 'high'
       WHEN days_attacked >= 3 AND least(greatest(last_day - first_day + 1, 30), 365) >= 60 THEN 'medium' ELSE 'low' END AS aro_confidence FROM days)"""


@query("aro_days", "month_events", f"WITH {DAYS} SELECT * FROM days")
def _(v):
    return risk.attack_days(v.month_events)


@query("aro", "month_events", f"WITH {DAYS} SELECT * FROM rates")
def _(v):
    return risk.yearly_rate(risk.attack_days(v.month_events))


@query("aro_confidence", "incidents", """
SELECT id, CASE WHEN d >= 10 AND p >= 180 THEN 'high' WHEN d >= 3 AND p >= 60 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT id, event_count % 15 AS d, (id * 7) % 300 AS p FROM incidents)""")
def _(v):
    return v.incidents.select("id", risk.aro_confidence(F.col("event_count") % 15, (F.col("id") * 7) % 300).alias("confidence"))


@query("history_context", "incidents", """
SELECT client_id, asset_id, pattern, count(*) AS pattern_count, (SELECT count(*) FROM incidents j WHERE j.client_id = i.client_id AND j.asset_id = i.asset_id) AS attack_count
FROM incidents i GROUP BY 1, 2, 3""")
def _(v):
    return risk.history_context(v.incidents)


_RISK = f"""{DAYS}, base AS (SELECT i.id, i.client_id, i.asset_id, i.pattern, i.anomaly_score, a.id IS NOT NULL AS known, a.valor_activo, coalesce(a.valor_confidencialidad, 3) AS c, a.valor_integridad AS n, a.valor_disponibilidad AS d,
    a.clasificacion_criticidad AS crit, a.contiene_pii AS pii, rt.aro, rt.aro_sample_size, rt.aro_confidence
  FROM incidents i LEFT JOIN {_meta_first('hostname')} a ON a.client_id = i.client_id AND a.hostname = i.asset_id
  LEFT JOIN rates rt ON rt.client_id = i.client_id AND rt.asset_id = i.asset_id AND rt.pattern = i.pattern),
money AS (SELECT *, {EF('pattern')} AS ef, CASE WHEN known THEN {r('coalesce(valor_activo, 0) * ' + EF('pattern'), 2)} ELSE 0 END AS sle,
  CASE WHEN known THEN coalesce(aro, 1.0) ELSE anomaly_score END AS aro1 FROM base)"""


@query("incident_risk", "month_events incidents assets", f"""
WITH {_RISK} SELECT id, ef, sle, aro1 AS aro, CASE WHEN known THEN {r('sle * aro1', 2)} ELSE 0 END AS ale,
  CASE WHEN known THEN coalesce(aro_sample_size, 0) END AS aro_sample_size, CASE WHEN known THEN coalesce(aro_confidence, 'insufficient_data') ELSE 'insufficient_data' END AS aro_confidence,
  CASE WHEN known THEN crit END AS criticality, CASE WHEN known THEN pii END AS pii,
  CASE WHEN known THEN CASE pattern WHEN 'port_scan' THEN concat('disponibilidad=', d) WHEN 'brute_force_attempt' THEN concat('disponibilidad=', d)
    WHEN 'lateral_movement' THEN concat('confidencialidad=', c, ',disponibilidad=', d, ',integridad=', n) WHEN 'ransomware_activity' THEN concat('disponibilidad=', d, ',integridad=', n) ELSE '' END END AS impacted
FROM money""")
def _(v):
    e = joins.fetch_asset_meta(v.incidents.drop("aro", "ale", "clasificacion_criticidad"), v.assets)
    out = risk.incident_risk(e, risk.yearly_rate(risk.attack_days(v.month_events)))
    entries = F.transform(F.array_sort(F.map_entries("impacted_dimensions")),
                          lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))
    return out.select("id", "ef", "sle", "aro", "ale", F.col("aro_sample_size"), "aro_confidence",
                      F.col("clasificacion_criticidad").alias("criticality"), F.col("data_flags.pii").alias("pii"),
                      F.array_join(entries, ",").alias("impacted"))


@query("risk_fallback", "incidents", f"SELECT id, {EF('pattern')} AS ef, 0.0::DOUBLE AS sle, anomaly_score AS aro, 0.0::DOUBLE AS ale, 'insufficient_data' AS aro_confidence FROM incidents")
def _(v):
    from ..operators.risk import incident_risk
    meta = ("struct<valor_activo:double,clasificacion_criticidad:string,valor_confidencialidad:int,valor_integridad:int,"
            "valor_disponibilidad:int,contiene_pii:boolean,contiene_pci:boolean,contiene_phi:boolean,contiene_pfi:boolean>")
    rates = risk.yearly_rate(risk.attack_days(v.month_events))
    e = v.incidents.drop("aro", "ale").withColumn("asset_meta", F.lit(None).cast(meta))
    return incident_risk(e, rates).select("id", "ef", "sle", "aro", "ale", "aro_confidence")


_ISO = lambda key: table_sql(key, {k: f"'{x}'" for k, x in rules.ISO_CONTROLS.items()}, f"'{rules.ISO_CONTROL_DEFAULT}'")


@query("risk_metrics_rollup", "month_events incidents assets", f"""
WITH {DAYS}, w AS (SELECT client_id, asset_id, pattern, count(*) AS n FROM incidents WHERE created_us >= (SELECT max(created_us) FROM incidents) - 30 * 86400000000 GROUP BY 1, 2, 3)
SELECT w.client_id, w.asset_id, w.pattern AS risk_scenario, 30 AS window_days, n AS incident_count, coalesce(rt.aro, 1.0) AS calculated_aro, {EF('w.pattern')} AS exposure_factor,
  {r(r('coalesce(a.valor_activo, 0) * ' + EF('w.pattern'), 2) + ' * coalesce(rt.aro, 1.0)', 2)} AS ale_delta, {_ISO('w.pattern')} AS failed_control_id
FROM w LEFT JOIN rates rt ON rt.client_id = w.client_id AND rt.asset_id = w.asset_id AND rt.pattern = w.pattern
LEFT JOIN {_meta_first('hostname')} a ON a.client_id = w.client_id AND a.hostname = w.asset_id""")
def _(v):
    rates = risk.yearly_rate(risk.attack_days(v.month_events))
    return risk.risk_metrics_rollup(v.incidents, rates, v.assets).drop("calculated_us", "window_start_us", "window_end_us")


@query("aro_trend", "incidents", f"""
SELECT client_id, asset_id, pattern AS risk_scenario, strftime(make_timestamp(created_us), '%Y-%m') AS month,
  {r("(CAST(sum(CAST(aro AS DECIMAL(24,4))) AS DOUBLE) / nullif(count(aro), 0))", 4)} AS avg_aro, {r('max(aro)', 4)} AS max_aro, CAST(sum(event_count) AS BIGINT) AS total_incidents,
  {r("(CAST(sum(CAST(ale AS DECIMAL(22,2))) AS DOUBLE) / nullif(count(ale), 0))", 2)} AS avg_ale_delta
FROM incidents GROUP BY ALL""")
def _(v):
    m = v.incidents.withColumnsRenamed({"pattern": "risk_scenario", "created_us": "calculated_us", "aro": "calculated_aro",
                                        "event_count": "incident_count", "ale": "ale_delta"})
    return risk.aro_trend(m)


@query("inference_aro", "incidents", "SELECT id, anomaly_score * 12.0::DOUBLE AS aro_suggested FROM incidents")
def _(v):
    return v.incidents.select("id", (F.col("anomaly_score") * F.lit(12.0)).alias("aro_suggested"))


def _contained_sql(x, table, default):
    return "CASE " + " ".join(f"WHEN contains({x}, '{k}') THEN {n}" for k, n in table.items()) + f" ELSE {default} END::DOUBLE"


_NAMES = "['db-prod-1', 'web-api', 'iot-temp', 'pc-ventas', 'other', 'finance']"
_QUICK = f"""q0 AS (SELECT *, {_NAMES}[1 + event_id % 6] AS host, CASE WHEN event_id % 7 = 0 THEN CAST(event_id % 500 AS DOUBLE) END AS reading, CASE WHEN event_id % 9 = 0 THEN 0.2 ELSE 1.0 END AS pconf,
   CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 3000 AS DOUBLE) * 1000 END AS aval, event_id % 4 = 0 AS reg, CASE event_id % 8 WHEN 0 THEN 'ransomware_activity' WHEN 1 THEN 'odd_one' ELSE pattern_hint END AS pat FROM sec_events),
q1 AS (SELECT *, CASE WHEN coalesce(aval, 0) > 0 THEN least(1.0::DOUBLE, aval / 1000000::DOUBLE) ELSE {_contained_sql('host', rules.ASSET_KEYWORD_VALUES, 0.5)} END AS av FROM q0),
q2 AS (SELECT *, CASE WHEN coalesce(aval, 0) > 0 THEN aval ELSE av * 50000::DOUBLE END AS usd,
  {r("least(0.99::DOUBLE, CAST(" + table_sql('pat', rules.QUICK_EXPOSURE, 0.20) + " AS DOUBLE) * (0.5::DOUBLE + severity_score * 0.5::DOUBLE) * (0.7::DOUBLE + av * 0.3::DOUBLE))", 3)} AS ef0,
  CASE WHEN reading IS NULL THEN 0 WHEN contains(host, 'temp') THEN CASE WHEN reading <= 60 THEN 0 ELSE {r('(reading - 60::DOUBLE) / 41::DOUBLE', 3)} END
    WHEN reading > 100 THEN {r('log10(reading / 100.0::DOUBLE + 1.0::DOUBLE)', 3)} ELSE 0 END::DOUBLE AS ratio FROM q1),
q3 AS (SELECT *, CASE WHEN reg AND event_id % 8 = 0 THEN least(0.99::DOUBLE, ef0 + 0.05::DOUBLE) ELSE ef0 END AS ef1 FROM q2),
q4 AS (SELECT *, CASE WHEN ratio > 2 THEN least(0.99::DOUBLE, ef1 + (ratio - 2.0::DOUBLE) * 0.1::DOUBLE) ELSE ef1 END AS ef, CASE WHEN ratio > 2 THEN least(1.0::DOUBLE, severity_score + 0.3::DOUBLE) ELSE severity_score END AS s0 FROM q3),
q5 AS (SELECT *, CASE WHEN pconf < 0.4 THEN greatest(s0, 0.3::DOUBLE) ELSE s0 END AS s FROM q4),
q6 AS (SELECT *, usd * ef AS sle, {r("CAST(" + table_sql('pat', rules.QUICK_ARO, 1.0) + " AS DOUBLE) * (0.5::DOUBLE + s)", 2)} AS aro FROM q5),
q7 AS (SELECT *, sle * aro AS ale FROM q6),
quick AS (SELECT *, CASE WHEN pat IN {rules.CRITICAL_PATTERNS} OR s >= 0.85 OR ale >= 50000 THEN 'critical' WHEN pat IN {rules.HIGH_PATTERNS} OR s >= 0.65 OR ale >= 15000 THEN 'high'
   WHEN s >= 0.40 OR ale >= 3000 THEN 'medium' ELSE 'low' END AS lvl FROM q7)"""


def _quick(v):
    i = F.col("event_id")
    names = F.array(*[F.lit(x) for x in ("db-prod-1", "web-api", "iot-temp", "pc-ventas", "other", "finance")])
    reg = i % 4 == 0
    e = v.sec_events.withColumns({
        "asset_id": F.element_at(names, (i % 6 + 1).cast("int")),
        "numeric_value": F.when(i % 7 == 0, (i % 500).cast("double")),
        "parse_confidence": F.when(i % 9 == 0, 0.2).otherwise(1.0),
        "pattern_hint": F.when(i % 8 == 0, "ransomware_activity").when(i % 8 == 1, "odd_one").otherwise(F.col("pattern_hint")),
        "asset": F.when(reg, F.struct(
            F.when(reg, (i % 3000).cast("double") * 1000).alias("valor_activo"), (i % 8 == 0).alias("contiene_pii"),
            F.lit(False).alias("contiene_pci"), F.lit(False).alias("contiene_phi"), F.lit(False).alias("contiene_pfi"),
            (i % 5 + 1).cast("int").alias("valor_confidencialidad"), F.lit(2).alias("valor_integridad"), F.lit(4).alias("valor_disponibilidad"))),
    })
    return risk.quick_risk(e).select("event_id", "risk.*")


@query("quick_risk", "sec_events", f"""
WITH {_QUICK} SELECT event_id, {r('av', 3)} AS asset_value_score, {r('usd', 2)} AS asset_value_usd, {r('ef', 3)} AS exposure_factor, {r('sle', 2)} AS sle_usd, {r('aro', 2)} AS aro, {r('ale', 2)} AS ale_usd,
 lvl AS risk_level, CASE lvl WHEN 'critical' THEN 'contain' WHEN 'high' THEN 'escalate' WHEN 'medium' THEN 'review' ELSE 'ignore' END AS action, {_ISO('pat')} AS iso_control, {r('ratio', 3)} AS anomaly_ratio FROM quick""")
def _(v):
    return _quick(v).drop("cia_impact", "asset_info")


def _pick(col, sql, name):
    @query(name, "sec_events", f"WITH {_QUICK} SELECT event_id, {sql} AS {col} FROM quick")
    def _(v):
        return _quick(v).select("event_id", col)


_pick("asset_value_score", r("av", 3), "asset_value_keyword")
_pick("exposure_factor", r("ef", 3), "quick_exposure")
_pick("aro", r("aro", 2), "quick_aro")
_pick("anomaly_ratio", r("ratio", 3), "iot_ratio")
_pick("risk_level", "lvl", "risk_decision")
_pick("iso_control", _ISO("pat"), "iso_control")


def _cia_sql():
    imp = [table_sql("pat", {k: x[i] for k, x in rules.CIA_IMPACT.items()}, 1) for i in range(3)]
    lv = ["CASE WHEN reg THEN event_id % 5 + 1 ELSE 3 END", "CASE WHEN reg THEN 2 ELSE 3 END", "CASE WHEN reg THEN 4 ELSE 3 END"]
    cols = []
    for i, d in enumerate(("c", "i", "a")):
        dim = ("confidencialidad", "integridad", "disponibilidad")[i]
        cols.append(f"{r(f'(({imp[i]}) / 3.0::DOUBLE) * (({lv[i]}) / 5.0::DOUBLE)', 3)} AS {d}_score, ['Ninguno', 'Bajo', 'Medio', 'Alto'][1 + ({imp[i]})] AS {d}_level, "
                    f"{list(rules.CIA_TEXT[dim])}[1 + ({imp[i]})] AS {d}_text")
    return ", ".join(cols)


@query("cia_impact", "sec_events", f"WITH {_QUICK} SELECT event_id, {_cia_sql()}, CASE WHEN reg THEN 'registrado' ELSE 'estimado_default' END AS source FROM quick")
def _(v):
    c = F.col("cia_impact")
    cols = []
    for s, d in (("c", "confidencialidad"), ("i", "integridad"), ("a", "disponibilidad")):
        cols += [c[d]["score"].alias(f"{s}_score"), c[d]["nivel"].alias(f"{s}_level"), c[d]["descripcion"].alias(f"{s}_text")]
    return _quick(v).select("event_id", *cols, c["fuente_activo"].alias("source"))


_SESS_COLS = "client_id, asset_id, src_ip, pattern"
_GAP = table_sql("pattern", rules.CONSOLIDATION_MINUTES, 120) + " * 60000000::BIGINT"


def _sessions(marks: bool) -> str:
    opened = "" if not marks else """ OR EXISTS (SELECT 1 FROM decisions d WHERE d.client_id = g.client_id AND d.asset_id = g.asset_id AND d.src_ip IS NOT DISTINCT FROM g.src_ip AND d.pattern = g.pattern AND d.reviewed_us > g.p AND d.reviewed_us <= g.ts_us)"""
    return f"""WITH g AS (SELECT *, lag(ts_us) OVER (PARTITION BY {_SESS_COLS} ORDER BY ts_us, event_id) AS p FROM burst_events),
b AS (SELECT *, CASE WHEN p IS NULL OR ts_us - p > {_GAP}{opened} THEN 1 ELSE 0 END AS o FROM g),
s AS (SELECT *, sum(o) OVER (PARTITION BY {_SESS_COLS} ORDER BY ts_us, event_id) AS k FROM b),
sess AS (SELECT client_id, asset_id, src_ip, pattern, count(*) AS event_count, min(ts_us) AS first_seen_us, max(ts_us) AS last_seen_us, max(anomaly_score) AS peak_anomaly_score,
  arg_max(anomaly_score, (ts_us, event_id)) AS anomaly_score, arg_max(river_score, (ts_us, event_id)) AS river_score, arg_max(nmap_score, (ts_us, event_id)) AS nmap_score, arg_max(combined_score, (ts_us, event_id)) AS combined_score,
  arg_min(event_type, (ts_us, event_id)) AS event_type, arg_min(raw_hash, (ts_us, event_id)) AS raw_hash,
  coalesce(arg_min(aro, (ts_us, event_id)) FILTER (aro <> 0), 0) AS aro, coalesce(arg_min(ale, (ts_us, event_id)) FILTER (ale <> 0), 0) AS ale, arg_min(event_id, (ts_us, event_id)) AS opener
FROM s GROUP BY {_SESS_COLS}, k)
SELECT sha256(concat_ws('|', client_id, asset_id, coalesce(src_ip, ''), pattern, first_seen_us, opener)) AS incident_id, * EXCLUDE (opener) FROM sess"""


@query("incident_sessions", "burst_events", _sessions(False))
def _(v):
    return incidents.consolidate(v.burst_events).drop("opener_id")


@query("consolidate_incidents", "burst_events decisions", _sessions(True))
def _(v):
    return incidents.consolidate(v.burst_events, v.decisions).drop("opener_id")


@query("review_incident", "incidents reviews", """
SELECT i.id, CASE WHEN i.status = 'PENDING' AND r.id IS NOT NULL THEN r.action ELSE i.status END AS status,
  CASE WHEN i.status = 'PENDING' THEN r.note END AS review_note, CASE WHEN i.status = 'PENDING' AND r.id IS NOT NULL THEN r.reviewed_us ELSE i.reviewed_us END AS reviewed_us
FROM incidents i LEFT JOIN reviews r ON r.id = i.id""")
def _(v):
    return incidents.review_incidents(v.incidents, v.reviews).select("id", "status", "review_note", "reviewed_us")


@query("asset_page", "assets", "SELECT id, client_id, hostname FROM assets WHERE client_id = 'client-1' ORDER BY id DESC LIMIT 100 OFFSET 50")
def _(v):
    return ranking.page(v.assets.where("client_id = 'client-1'"), [F.desc("id")], 50, 100).select("id", "client_id", "hostname")


@query("asset_by_id", "assets", "SELECT id, client_id, hostname, valor_activo FROM assets WHERE client_id = 'client-1' AND id = (SELECT max(p_partkey) FROM part WHERE p_partkey % 3 = 1)")
def _(v):
    wanted = v.table("part").where("p_partkey % 3 = 1").agg(F.max("p_partkey")).scalar()
    return inventory.asset_by_id(v.assets, wanted, "client-1").select("id", "client_id", "hostname", "valor_activo")


@query("asset_info", "sec_events", f"""
WITH {_QUICK} SELECT event_id, CASE WHEN reg THEN NULL ELSE host END AS nombre, CASE WHEN reg THEN coalesce(aval, 0) END AS valor_usd, CASE WHEN reg THEN event_id % 8 = 0 END AS contiene_pii, NOT reg AS noted FROM quick""")
def _(v):
    i = F.col("asset_info")
    return _quick(v).select("event_id", i["nombre"].alias("nombre"), i["valor_usd"].alias("valor_usd"),
                            i["contiene_pii"].alias("contiene_pii"), i["nota"].isNotNull().alias("noted"))


@query("review_audit", "incidents reviews", """
SELECT CAST(i.id AS VARCHAR) AS entity_id, i.client_id AS actor, concat('RECOMMENDATION_', r.action) AS event_type, concat('{"action":"', r.action, '","note":"', r.note, '"}') AS payload
FROM incidents i JOIN reviews r ON r.id = i.id WHERE i.status = 'PENDING'""")
def _(v):
    return incidents.review_audit(v.incidents, v.reviews).drop("reviewed_us")


@query("asset_changes", "assets asset_changes", """
WITH l AS (SELECT client_id, id, arg_max(op, seq) AS op, arg_max(nombre_activo, seq) FILTER (op = 'U' AND nombre_activo IS NOT NULL) AS nm, arg_max(valor_activo, seq) FILTER (op = 'U' AND valor_activo IS NOT NULL) AS vv FROM asset_changes GROUP BY 1, 2)
SELECT a.id, a.client_id, coalesce(nm, nombre_activo) AS nombre_activo, coalesce(vv, valor_activo) AS valor_activo FROM assets a LEFT JOIN l ON l.client_id = a.client_id AND l.id = a.id WHERE coalesce(l.op, '') <> 'D'""")
def _(v):
    return inventory.apply_changes(v.assets, v.asset_changes).select("id", "client_id", "nombre_activo", "valor_activo")


@query("bulk_load_assets", "assets", """
SELECT id, client_id, hostname FROM assets UNION ALL
SELECT min(id) AS id, 'client-0' AS client_id, hostname FROM (SELECT id + 100000 AS id, concat('asset-', p_size * 20) AS hostname FROM assets JOIN part ON part.p_partkey = assets.id)
WHERE hostname NOT IN (SELECT hostname FROM assets WHERE client_id = 'client-0') GROUP BY hostname""")
def _(v):
    new = v.table("part").select((F.col("p_partkey") + 100000).alias("id"),
                                 F.concat(F.lit("asset-"), (F.col("p_size") * 20).cast("string")).alias("hostname"))
    return inventory.bulk_load(v.assets, new, "client-0").select("id", "client_id", "hostname")


_CAST = """c AS (SELECT id, nullif(trim("Nombre del Activo"), '') AS nombre_activo, "Nombre del equipo" AS hostname, "Dirección IP" AS ip_address,
  CASE WHEN "Valor" IS NULL THEN NULL WHEN regexp_matches("Valor", '\\d{1,3}(\\.\\d{3})+(,\\d+)?$') THEN TRY_CAST(replace(replace("Valor", '.', ''), ',', '.') AS DOUBLE)
    ELSE coalesce(TRY_CAST(regexp_replace("Valor", '[^\\d.]', '', 'g') AS DOUBLE), 0) END AS valor_activo,
  CASE "Confidencialidad" WHEN '3.0' THEN 3 WHEN '9' THEN 5 WHEN '0' THEN 1 WHEN 'alto' THEN 1 WHEN '2' THEN 2 ELSE 3 END AS valor_confidencialidad,
  CASE WHEN "PII" IN ('sí', 'X') THEN true WHEN "PII" = 'No' THEN false END AS contiene_pii,
  CASE WHEN contains(upper(coalesce("Clasificación", '')), 'PCI') THEN true END AS contiene_pci FROM messy_assets)"""


def _cast(v):
    m = v.messy_assets.withColumnRenamed("Nombre del Activo", "Activo").withColumnRenamed("id", "row_number")
    mapping = inventory.map_headers([c for c in m.columns if c != "row_number"])
    return inventory.cast_inventory(m, mapping)


@query("cast_inventory", "messy_assets", f"WITH {_CAST} SELECT * FROM c WHERE nombre_activo IS NOT NULL")
def _(v):
    return _cast(v).where("not rejected").select(
        F.col("row_number").alias("id"), "nombre_activo", "hostname", "ip_address", F.col("valor_activo").cast("double").alias("valor_activo"),
        "valor_confidencialidad", "contiene_pii", "contiene_pci")


@query("inventory_flags", "messy_assets", """
SELECT id, contains(u, 'PII') AS contiene_pii, contains(u, 'PCI') AS contiene_pci, contains(u, 'PHI') AS contiene_phi, contains(u, 'PFI') AS contiene_pfi
FROM (SELECT id, upper(coalesce("Clasificación", '')) AS u FROM messy_assets)""")
def _(v):
    return v.messy_assets.select("id", *[c.alias(n) for n, c in inventory.sensitivity_flags("Clasificación").items()])


@query("inventory_rejects", "messy_assets", f"WITH {_CAST} SELECT id AS row_number, 'nombre_activo es obligatorio' AS reason FROM c WHERE nombre_activo IS NULL")
def _(v):
    return inventory.inventory_rejects(_cast(v)).select("row_number", "reason")


#: "Nombre del Activo" is no known alias, and aliases match as a whole.
_MAPPED = {"hostname": "Nombre del equipo", "ip_address": "Dirección IP", "valor_activo": "Valor",
           "valor_confidencialidad": "Confidencialidad", "contiene_pii": "PII", "clasificacion_criticidad": "Clasificación"}


@query("map_inventory_columns", "messy_assets", " UNION ALL ".join(
    f"""SELECT '{field}' AS field, count("{c}") AS filled, '{c}' AS source_column FROM messy_assets""" for field, c in _MAPPED.items()))
def _(v):
    mapping = inventory.map_inventory_columns(v.messy_assets.drop("id"))
    counts = v.messy_assets.agg(*[F.count(F.col(f"`{c}`")).alias(f) for f, c in mapping.items()])
    return counts.unpivot([], list(mapping), "field", "filled").withColumn(
        "source_column", t.by_key("field", mapping, None))


@query("criticality_check", "assets", "SELECT id, clasificacion_criticidad IN ('Bajo', 'Medio', 'Alto', 'Crítico') AS ok FROM assets")
def _(v):
    return v.assets.select("id", inventory.criticality_ok("clasificacion_criticidad").alias("ok"))
