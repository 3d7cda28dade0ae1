"""Security-shaped views derived by Spark from the test tables.

Every view is a projection of whole tables, so its size grows with them. Times are
BIGINT UTC microseconds (``*_us``). ``DUCK`` holds the same views for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import in_utc

EPOCH_2024 = 1704067200000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return in_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# name -> (source table or view, select list). Both engines share the text; US(x)
# (microseconds of a timestamp), DIV and STRING are spelled per engine below.
_SPEC: dict[str, tuple[str, str]] = {
    "sec_events": ("events", """
  event_id,
  1704067200000000 + (US(ts) - 1704067200000000) DIV 150 AS ts_us,
  concat('client-', CAST(user_id % 3 AS STRING)) AS client_id,
  CASE WHEN event_id % 11 = 0 THEN 'asset-6' ELSE concat('asset-', CAST(event_id % 3 AS STRING)) END AS asset_id,
  CASE WHEN event_id % 13 = 0 THEN '10.1.2.3' ELSE concat('203.0.113.', CAST((user_id DIV 3) % 2 AS STRING)) END AS src_ip,
  CASE event_type WHEN 'error' THEN 'authentication_failed' WHEN 'signup' THEN CASE WHEN event_id % 9 = 0 THEN 'ssh_login_success' ELSE 'heartbeat' END WHEN 'click' THEN 'firewall_deny' WHEN 'purchase' THEN 'outbound_transfer' ELSE 'http_request' END AS event_type,
  least(CAST(1 AS DOUBLE), value / CAST(100 AS DOUBLE)) AS severity_score,
  CASE event_type WHEN 'error' THEN 'brute_force_attempt' WHEN 'signup' THEN 'lateral_movement' WHEN 'click' THEN 'port_scan' WHEN 'purchase' THEN 'data_exfiltration' ELSE 'none' END AS pattern_hint,
  CAST((event_id * 7919) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS command_risk,
  CASE WHEN event_id % 4 = 0 THEN value ELSE CAST(NULL AS DOUBLE) END AS numeric_value,
  CAST(event_id % 10 AS DOUBLE) / CAST(10 AS DOUBLE) AS danger_score,
  md5(concat('e', CAST(event_id DIV 2 AS STRING))) AS raw_hash"""),
    "month_events": ("events", """
  event_id,
  US(ts) AS ts_us,
  concat('client-', CAST(user_id % 3 AS STRING)) AS client_id,
  concat('asset-', CAST(event_id % 40 AS STRING)) AS asset_id,
  concat('203.0.113.', CAST(user_id % 250 AS STRING)) AS src_ip,
  CASE event_type WHEN 'error' THEN 'authentication_failed' WHEN 'signup' THEN 'login' WHEN 'click' THEN 'scan_probe' WHEN 'purchase' THEN 'file_download' ELSE 'http_request' END AS event_type,
  least(CAST(1 AS DOUBLE), value / CAST(100 AS DOUBLE)) AS severity_score,
  CASE event_type WHEN 'error' THEN 'brute_force_attempt' WHEN 'signup' THEN 'brute_force' WHEN 'click' THEN 'port_scan' WHEN 'purchase' THEN 'data_exfiltration' ELSE 'none' END AS pattern_hint,
  CAST((event_id * 7919) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS command_risk,
  CASE WHEN US(ts) > 1706000000000000 THEN least(CAST(1 AS DOUBLE), value / CAST(300 AS DOUBLE)) ELSE least(CAST(1 AS DOUBLE), value / CAST(200 AS DOUBLE)) END AS numeric_anomaly,
  md5(concat('m', CAST(event_id AS STRING))) AS raw_hash"""),
    "port_events": ("events", """
  event_id,
  1704067200000000 + (US(ts) - 1704067200000000) DIV 480 AS ts_us,
  concat('client-', CAST(user_id % 3 AS STRING)) AS client_id,
  concat('198.51.100.', CAST(user_id % 2 AS STRING)) AS src_ip,
  CASE WHEN user_id % 2 = 0 THEN CAST((event_id * 7919) % 65536 AS INT) ELSE CAST(event_id % 4 AS INT) END AS dst_port"""),
    "burst_events": ("events", """
  event_id,
  1704067200000000 + (US(ts) - 1704067200000000) DIV 20 AS ts_us,
  concat('client-', CAST(user_id % 3 AS STRING)) AS client_id,
  concat('asset-', CAST(event_id % 5 AS STRING)) AS asset_id,
  CASE WHEN event_id % 41 = 0 THEN NULL ELSE concat('203.0.113.', CAST(user_id % 4 AS STRING)) END AS src_ip,
  event_type,
  CASE event_type WHEN 'error' THEN 'brute_force_attempt' WHEN 'signup' THEN 'lateral_movement' WHEN 'click' THEN 'port_scan' WHEN 'purchase' THEN 'data_exfiltration' ELSE 'odd_pattern' END AS pattern,
  least(CAST(1 AS DOUBLE), value / CAST(100 AS DOUBLE)) AS anomaly_score,
  CAST((event_id * 13) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS river_score,
  CAST((event_id * 29) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS nmap_score,
  CAST((event_id * 31) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS combined_score,
  CASE WHEN event_id % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(event_id % 17 AS DOUBLE) END AS aro,
  CASE WHEN event_id % 2 = 0 THEN CAST(0 AS DOUBLE) ELSE value END AS ale,
  md5(CAST(event_id AS STRING)) AS raw_hash"""),
    "decisions": ("supplier", """
  concat('client-', CAST(s_suppkey % 3 AS STRING)) AS client_id,
  concat('asset-', CAST(s_suppkey % 5 AS STRING)) AS asset_id,
  concat('203.0.113.', CAST(s_suppkey % 4 AS STRING)) AS src_ip,
  CASE s_suppkey % 2 WHEN 0 THEN 'brute_force_attempt' ELSE 'port_scan' END AS pattern,
  1704067200000000 + ((s_suppkey * 7919) % 129600) * 1000000 AS reviewed_us"""),
    "messy_assets": ("part", """
  p_partkey AS id,
  CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 19 = 0 THEN NULL ELSE concat(' ', p_name, ' ') END AS `Nombre del Activo`,
  concat('host-', CAST(p_partkey AS STRING)) AS `Nombre del equipo`,
  concat('10.1.', CAST(p_partkey % 250 AS STRING), '.7') AS `Dirección IP`,
  CASE p_partkey % 5 WHEN 0 THEN '1.500,00' WHEN 1 THEN concat('$1,', CAST(100 + p_partkey % 900 AS STRING), '.00') WHEN 2 THEN CAST(p_partkey AS STRING) WHEN 3 THEN 'n/a' ELSE NULL END AS `Valor`,
  CASE p_partkey % 6 WHEN 0 THEN '3.0' WHEN 1 THEN '9' WHEN 2 THEN '0' WHEN 3 THEN 'alto' WHEN 4 THEN NULL ELSE '2' END AS `Confidencialidad`,
  CASE p_partkey % 4 WHEN 0 THEN 'sí' WHEN 1 THEN 'No' WHEN 2 THEN 'X' ELSE NULL END AS `PII`,
  CASE p_partkey % 3 WHEN 0 THEN 'Medio (pci, phi)' WHEN 1 THEN 'Alto' ELSE NULL END AS `Clasificación`"""),
    "asset_changes": ("lineitem", """
  concat('client-', CAST(l_partkey % 3 AS STRING)) AS client_id, l_partkey AS id,
  l_orderkey * 10 + l_linenumber AS seq,
  CASE WHEN l_quantity > 47 THEN 'D' ELSE 'U' END AS op,
  CASE WHEN l_linenumber % 2 = 0 THEN concat('owner-', CAST(l_suppkey AS STRING)) END AS nombre_activo,
  CASE WHEN l_linenumber % 3 = 0 THEN l_extendedprice END AS valor_activo"""),
    "assets": ("part", """
  p_partkey AS id,
  concat('client-', CAST(p_partkey % 3 AS STRING)) AS client_id,
  CASE WHEN p_partkey DIV 3 = 6 THEN 'host-6' ELSE concat('asset-', CAST(p_partkey DIV 3 AS STRING)) END AS hostname,
  concat('Asset ', CAST(p_partkey DIV 3 AS STRING)) AS nombre_activo,
  p_type AS tipo_activo,
  concat('tid-', CAST(p_partkey AS STRING)) AS technical_id,
  concat('10.', CAST(p_partkey % 3 AS STRING), '.', CAST((p_partkey DIV 3) DIV 250 AS STRING), '.', CAST((p_partkey DIV 3) % 250 AS STRING)) AS ip_address,
  CASE WHEN p_partkey % 29 = 0 THEN CAST(NULL AS DOUBLE) ELSE p_retailprice * p_size END AS valor_activo,
  CASE WHEN p_partkey % 31 = 0 THEN CAST(NULL AS INT) ELSE CAST(1 + p_partkey % 5 AS INT) END AS valor_confidencialidad,
  CAST(1 + (p_partkey * 2) % 5 AS INT) AS valor_integridad,
  CAST(1 + (p_partkey * 3) % 5 AS INT) AS valor_disponibilidad,
  p_partkey % 2 = 0 AS contiene_pii, p_partkey % 3 = 0 AS contiene_pci, p_partkey % 5 = 0 AS contiene_phi, p_partkey % 7 = 0 AS contiene_pfi,
  CASE p_partkey % 5 WHEN 0 THEN 'Alto' WHEN 1 THEN 'Bajo' WHEN 2 THEN 'Medio' WHEN 3 THEN 'Crítico' ELSE 'Otro' END AS clasificacion_criticidad"""),
    "incidents": ("orders", """
  o_orderkey AS id, concat('client-', CAST(o_custkey % 3 AS STRING)) AS client_id,
  concat('asset-', CAST(o_orderkey % 7 AS STRING)) AS asset_id,
  CASE WHEN o_orderkey % 17 = 0 THEN '0.0.0.0' WHEN o_orderkey % 19 = 0 THEN NULL ELSE concat('203.0.113.', CAST(o_custkey % 40 AS STRING)) END AS src_ip,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('10.0.0.', CAST(o_orderkey % 7 AS STRING)) END AS victim_ip,
  CASE o_orderkey % 5 WHEN 0 THEN 'port_scan' WHEN 1 THEN 'brute_force_attempt' WHEN 2 THEN 'lateral_movement' WHEN 3 THEN 'ransomware_activity' ELSE 'none' END AS pattern,
  o_orderpriority AS event_type,
  CAST((o_orderkey * 37) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS anomaly_score,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_totalprice END AS ale, CAST(o_orderkey % 52 AS DOUBLE) AS aro,
  CAST((o_orderkey * 53) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS peak_anomaly_score,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST(1000 * (o_orderkey % 7) AS DOUBLE) END AS valor_activo_snapshot,
  CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'O' THEN 'PENDING' ELSE 'SHADOW' END AS status,
  US(o_orderdate) + (o_orderkey % 1440) * 60000000 AS created_us,
  US(o_orderdate) + (o_orderkey % 1440) * 60000000 - (o_orderkey % 90) * 60000000 AS first_seen_us,
  CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE US(o_orderdate) + (o_orderkey % 1440) * 60000000 + (o_orderkey % 50) * 60000000 END AS last_seen_us,
  CASE WHEN o_orderstatus = 'F' THEN US(o_orderdate) + (o_orderkey % 1440) * 60000000 + (o_custkey % 600) * 60000000 END AS reviewed_us,
  o_orderkey % 100 + 1 AS event_count, o_orderkey % 5 = 2 AS lateral_movement_detected,
  CASE WHEN o_orderkey % 4 = 0 THEN concat('explained ', CAST(o_orderkey AS STRING)) END AS explanation,
  CASE o_orderkey % 7 WHEN 0 THEN 'Alto' WHEN 1 THEN 'Bajo' ELSE 'Medio' END AS clasificacion_criticidad"""),
    "raw_logs": ("sec_events", """
  event_id, client_id, ts_us, severity_score, CASE event_id % 5
 WHEN 0 THEN concat('{"rule":{"level":10,"description":"', event_type, ' blocked"},"agent":{"name":"', asset_id, '","ip":"10.0.0.7"},"data":{"srcip":"', src_ip, '"}}')
 WHEN 1 THEN concat('{"eventSource":"ec2","awsRegion":"us-east-1","eventName":"', CASE WHEN event_id % 2 = 0 THEN 'DeleteBucket' ELSE 'ListBuckets' END, '","sourceIPAddress":"', src_ip, '"}')
 WHEN 2 THEN concat('{"_time":"', CAST(ts_us DIV 1000000 AS STRING), '","sourcetype":"syslog","host":"', asset_id, '","event_type":"', event_type, '"}')
 WHEN 3 THEN concat('{"topic":"factory/boiler/temp","d_id":"', asset_id, '","val":', CAST(event_id % 140 AS STRING), '}')
 ELSE concat('{"device":"fw1","dst_port":', CAST(event_id % 1024 AS STRING), ',"description":"<script>alert(1)</script> failed","src_ip":"', src_ip, '"}') END AS raw"""),
    "audit_log": ("sec_events", """
  event_id AS id, client_id AS chain,
  event_type, asset_id AS entity_id, client_id AS actor, concat('{"n":', CAST(event_id AS STRING), '}') AS payload"""),
    "intel": ("supplier", """
  concat('203.0.113.', CAST(s_suppkey % 50 AS STRING)) AS ip,
  CAST((s_suppkey * 37) % 101 AS INT) AS confidence,
  CASE s_suppkey % 4 WHEN 0 THEN 'local_blocklist' ELSE 'feed' END AS source,
  1704067200000000 + s_suppkey * 97000000 AS valid_from_us,
  CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 1704067200000000 + s_suppkey * 97000000 + CASE s_suppkey % 5 WHEN 0 THEN 604800000000 ELSE 3600000000 END END AS valid_to_us"""),
    "reviews": ("orders", """
  o_orderkey AS id,
  CASE WHEN o_custkey % 2 = 0 THEN 'APPROVED' ELSE 'REJECTED' END AS action,
  concat('note ', CAST(o_custkey AS STRING)) AS note,
  US(o_orderdate) + 86400000000 AS reviewed_us"""),
}


def _spark_text(text: str) -> str:
    return text.replace("US(", "unix_micros(").replace("unix_micros(ts)", "unix_micros(CAST(ts AS TIMESTAMP))").replace(
        "unix_micros(o_orderdate)", "unix_micros(CAST(o_orderdate AS TIMESTAMP))")


def _duck_text(text: str) -> str:
    return text.replace("US(", "epoch_us(").replace(" DIV ", " // ").replace("AS STRING)", "AS VARCHAR)").replace("`", '"')


def derive(base: DataFrame, name: str) -> DataFrame:
    """The view's projection over any frame of its source's shape, also a stream."""
    text = _spark_text(_SPEC[name][1]).replace("{", "{{").replace("}", "}}")
    return base.sparkSession.sql("SELECT " + text + " FROM {base}", base=base)


def stream_view(spark: SparkSession, sf_dir: str, name: str, max_files: int = 1) -> DataFrame:
    """A view whose root table arrives as a file stream."""
    source = _SPEC[name][0]
    if source in _SPEC:
        return derive(stream_view(spark, sf_dir, source, max_files), name)
    schema = table(spark, sf_dir, source).schema
    files = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
             .option("pathGlobFilter", f"{source}.parquet").parquet(sf_dir))
    return derive(files, name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived view as a DataFrame."""
    source = _SPEC[name][0]
    base = view(spark, sf_dir, source) if source in _SPEC else table(spark, sf_dir, source)
    return derive(base, name)


def duck_ctes(names: str) -> str:
    """``WITH`` prefix that defines the named views for DuckDB."""
    done: list[str] = []

    def add(name: str) -> None:
        if name in _SPEC and name not in done:
            add(_SPEC[name][0])
            done.append(name)

    for name in names.split():
        add(name)
    return "WITH RECURSIVE " + ",\n".join(
        f"{n} AS (SELECT {_duck_text(_SPEC[n][1])} FROM {_SPEC[n][0]})" for n in done)
