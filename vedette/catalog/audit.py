"""Audit, JSON and discovery queries."""

from pyspark.sql import functions as F

from .. import rules
from ..functions import jsontree as j
from ..operators import audit, discovery
from ..session import cut_lineage, widen
from ..sources import raw as raw_sources
from .registry import query

_PREFIX = """concat('{"actor": "', actor, '", "entity_id": "', entity_id, '", "event_type": "', event_type, '", "payload": ', replace(payload, ':', ': '), ', "previous_hash": "')"""
BLOCK_IDS = 500
CHAIN = f"""a AS (SELECT *, {_PREFIX} AS px, row_number() OVER (PARTITION BY chain ORDER BY id) AS k
  FROM (SELECT * REPLACE (concat(chain, '/', id // {BLOCK_IDS}) AS chain) FROM audit_log)),
c AS (SELECT id, chain, k, px, 'GENESIS' AS ph, sha256(px || 'GENESIS' || '"}}') AS ch FROM a WHERE k = 1
 UNION ALL SELECT a.id, a.chain, a.k, a.px, c.ch, sha256(a.px || c.ch || '"}}') FROM c JOIN a ON a.chain = c.chain AND a.k = c.k + 1)"""


@query("build_hash_chain", "audit_log", f"WITH {CHAIN} SELECT chain, count(*) AS records, arg_max(ch, id) AS head FROM c GROUP BY chain")
def _(v):
    return audit.chain_heads(audit.build_hash_chain(v.audit_log, block_ids=BLOCK_IDS))


def _tampered(v):
    """Built chains in which every 997th record had its actor changed afterwards."""
    built = audit.build_hash_chain(v.audit_log, block_ids=BLOCK_IDS)
    return built.withColumn("actor", F.when(F.col("id") % 997 == 5, F.lit("mallory")).otherwise(F.col("actor")))


_BAD = "id % 997 = 5 AND NOT contains(px, '\"actor\": \"mallory\"')"


@query("verify_hash_chain", "audit_log", f"""
WITH {CHAIN} SELECT chain, count(*) AS records, min(id) FILTER ({_BAD}) AS broken_at, CASE WHEN count(*) FILTER ({_BAD}) > 0 THEN 'COMPROMISED' ELSE 'INTACT' END AS status, arg_max(ch, id) AS latest_hash FROM c GROUP BY chain""")
def _(v):
    return audit.verify_hash_chain(_tampered(v))


@query("tamper_report", "audit_log", f"""
WITH {CHAIN}, t AS (SELECT *, CASE WHEN id % 991 = 7 THEN sha256('x') ELSE ch END AS stored FROM c)
SELECT chain, count(*) FILTER (id % 991 = 7) AS content_changed, count(*) FILTER (id % 991 <> 7 AND ph <> l) AS link_broken, min(id) FILTER (id % 991 = 7) AS first_changed
FROM (SELECT *, coalesce(lag(stored) OVER (PARTITION BY chain ORDER BY id), 'GENESIS') AS l FROM t) GROUP BY chain""")
def _(v):
    built = audit.build_hash_chain(v.audit_log, block_ids=BLOCK_IDS).withColumn(
        "current_hash", F.when(F.col("id") % 991 == 7, F.sha2(F.lit("x"), 256)).otherwise(F.col("current_hash")))
    return audit.tamper_report(built)


#: Small here, so that a few blocks make several levels.
FAN_OUT, LEVELS = 4, 2


def _levels() -> str:
    """The tree over the blocks as CTEs t0 (leaves) to the root."""
    out = ["""t0 AS (SELECT log, 0 AS level, pos, records, first_id, last_id, sha256(concat_ws('|', log, pos, records, first_id, last_id, head)) AS hash
 FROM (SELECT split_part(chain, '/', 1) AS log, CAST(split_part(chain, '/', 2) AS BIGINT) AS pos, count(*) AS records, min(id) AS first_id, max(id) AS last_id, arg_max(ch, id) AS head FROM c GROUP BY chain))"""]
    for k in range(1, LEVELS + 2):
        place = f"pos // {FAN_OUT}" if k <= LEVELS else "0"
        out.append(f"""t{k} AS (SELECT log, {k} AS level, {place} AS pos, CAST(sum(records) AS BIGINT) AS records, min(first_id) AS first_id, max(last_id) AS last_id,
 sha256(string_agg(pos || ':' || hash, ',' ORDER BY pos)) AS hash FROM t{k - 1} GROUP BY ALL)""")
    return ",\n".join(out)


@query("hash_tree", "audit_log", f"WITH {CHAIN}, {_levels()} " + " UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(LEVELS + 2)))
def _(v):
    return audit.hash_tree(audit.build_hash_chain(v.audit_log, block_ids=BLOCK_IDS), fan_out=FAN_OUT, levels=LEVELS)


#: Blocks that vanish from the log, and one record changed in another.
_GONE, _CHANGED = "id // 500 % 5 = 2", "id % 2500 = 1700"


@query("verify_log", "audit_log", f"""
SELECT chain AS log, count(*) FILTER (NOT ({_GONE})) AS records, count(*) AS sealed_records, CAST(0 AS BIGINT) AS unsealed_records,
  min(id) FILTER ({_GONE} OR {_CHANGED}) AS broken_at, CASE WHEN min(id) FILTER ({_CHANGED}) < coalesce(min(id) FILTER ({_GONE}), 1e18) THEN 'record' WHEN min(id) FILTER ({_GONE}) IS NOT NULL THEN 'block' END AS reason,
  CASE WHEN count(*) FILTER ({_GONE} OR {_CHANGED}) > 0 THEN 'COMPROMISED' ELSE 'INTACT' END AS status FROM audit_log GROUP BY chain""")
def _(v):
    built = audit.build_hash_chain(v.audit_log, block_ids=BLOCK_IDS)
    tree = audit.hash_tree(built, fan_out=FAN_OUT, levels=LEVELS)
    now = built.where(F.floor(F.col("id") / BLOCK_IDS) % 5 != 2).withColumn(
        "actor", F.when(F.col("id") % 2500 == 1700, F.lit("mallory")).otherwise(F.col("actor")))
    return audit.verify_log(now, tree, audit.tree_roots(tree), fan_out=FAN_OUT)


@query("event_hash_json", "raw_logs", """
SELECT event_id, sha256(CASE event_id % 5 WHEN 2 THEN concat('{"_time": "', json_extract_string(raw, '$._time'), '", "event_type": "', json_extract_string(raw, '$.event_type'), '", "host": "', json_extract_string(raw, '$.host'), '", "sourcetype": "syslog"}')
  WHEN 3 THEN concat('{"d_id": "', json_extract_string(raw, '$.d_id'), '", "topic": "factory/boiler/temp", "val": ', json_extract_string(raw, '$.val'), '}')
  WHEN 0 THEN concat('{"agent": {"ip": "10.0.0.7", "name": "', json_extract_string(raw, '$.agent.name'), '"}, "data": {"srcip": "', json_extract_string(raw, '$.data.srcip'), '"}, "rule": {"description": "', json_extract_string(raw, '$.rule.description'), '", "level": 10}}')
  WHEN 1 THEN concat('{"awsRegion": "us-east-1", "eventName": "', json_extract_string(raw, '$.eventName'), '", "eventSource": "ec2", "sourceIPAddress": "', json_extract_string(raw, '$.sourceIPAddress'), '"}')
  ELSE concat('{"description": "<script>alert(1)</script> failed", "device": "fw1", "dst_port": ', json_extract_string(raw, '$.dst_port'), ', "src_ip": "', json_extract_string(raw, '$.src_ip'), '"}') END) AS raw_hash FROM raw_logs""")
def _(v):
    return v.raw_logs.select("event_id", F.sha2(j.canonical_json("raw").cast("binary"), 256).alias("raw_hash"))


@query("sanitize_json", "raw_logs", """
SELECT event_id, CASE event_id % 5 WHEN 4 THEN replace(raw, '<script>alert(1)</script>', '[REDACTED]') ELSE raw END AS clean FROM raw_logs""")
def _(v):
    compact = F.regexp_replace(F.regexp_replace("c", '": ', '":'), ', "', ',"')
    return v.raw_logs.select("event_id", j.sanitize_json("raw").alias("c")).select("event_id", compact.alias("clean"))


@query("extract_entities", "raw_logs", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN json_extract_string(raw, '$.data.srcip') WHEN 1 THEN json_extract_string(raw, '$.sourceIPAddress') WHEN 4 THEN json_extract_string(raw, '$.src_ip') END AS src_ip,
  CASE event_id % 5 WHEN 0 THEN '10.0.0.7' END AS victim_ip,
  CASE event_id % 5 WHEN 0 THEN json_extract_string(raw, '$.agent.name') ELSE 'unknown' END AS asset_id,
  CASE WHEN event_id % 5 = 0 THEN json_extract_string(raw, '$.rule.description') WHEN event_id % 5 = 2 AND json_extract_string(raw, '$.event_type') = 'authentication_failed' THEN 'authentication_failed'
     WHEN event_id % 5 = 4 THEN '<script>alert(1)</script> failed' ELSE 'Security Event' END AS event_type FROM raw_logs""")
def _(v):
    e = v.raw_logs.select("event_id", j.text_leaves("raw").alias("leaves"))
    return e.select("event_id", *[c.alias(n) for n, c in discovery.extract_entities(F.col("leaves")).items()])


_FLAT = """kv AS (SELECT event_id, k.path, k.value FROM raw_logs, (SELECT unnest(CASE event_id % 5
  WHEN 0 THEN [{'path': 'rule_level', 'value': '10'}, {'path': 'rule_description', 'value': json_extract_string(raw, '$.rule.description')}, {'path': 'agent_name', 'value': json_extract_string(raw, '$.agent.name')}, {'path': 'agent_ip', 'value': '10.0.0.7'}, {'path': 'data_srcip', 'value': json_extract_string(raw, '$.data.srcip')}]
  ELSE list_transform(json_keys(raw), lambda x: {'path': x, 'value': json_extract_string(raw, '$.' || x)}) END, recursive := true)) k),
profile AS (SELECT path, count(*) AS rows, count(value) AS filled, sum(length(value)) / count(value) AS mean_length, count(TRY_CAST(value AS DOUBLE)) / count(value) AS number_share,
  count(*) FILTER (regexp_matches(value, '^(\\d{1,3}\\.){3}\\d{1,3}$')) / count(value) AS ipv4_share, max(TRY_CAST(value AS DOUBLE)) AS max_number FROM kv GROUP BY path)"""


def _flat(v):
    return widen(v.raw_logs).select("event_id", "client_id", "raw", j.flatten_json("raw").alias("fields"))


@query("flatten_json", "raw_logs", f"WITH {_FLAT} SELECT event_id, path, value FROM kv")
def _(v):
    return _flat(v).select("event_id", F.explode("fields").alias("path", "value"))


@query("profile_paths", "raw_logs", f"WITH {_FLAT} SELECT * FROM profile")
def _(v):
    return discovery.profile_paths(_flat(v))


@query("discover_asset_column", "raw_logs", f"""
WITH {_FLAT} SELECT arg_min(path, p) AS asset_column FROM (SELECT path, list_position({list(rules.ASSET_COLUMNS)}, lower(path)) AS p FROM profile WHERE mean_length <= 80) WHERE p > 0""")
def _(v):
    return discovery.discover_asset_column(discovery.profile_paths(_flat(v)))


@query("discover_time_column", "raw_logs", f"""
WITH {_FLAT} SELECT min(path) AS time_column, arg_min(CASE WHEN number_share = 1 AND max_number > 4102444800 THEN 'ms' WHEN number_share = 1 THEN 's' ELSE 'text' END, path) AS unit
FROM profile WHERE regexp_matches(lower(path), 'time|date|timestamp|createdat|occurred')""")
def _(v):
    return discovery.discover_time_column(discovery.profile_paths(_flat(v)))


@query("discover_event_column", "raw_logs", f"""
WITH {_FLAT} SELECT arg_min(path, p) AS event_column FROM (SELECT path, list_position({list(rules.EVENT_COLUMNS)}, lower(path)) AS p FROM profile) WHERE p > 0""")
def _(v):
    return discovery.discover_event_column(discovery.profile_paths(_flat(v)))


@query("vectorise_columns", "raw_logs", f"""
WITH {_FLAT}, cells AS (SELECT event_id, CAST('0x' || substr(md5(path), 1, 15) AS BIGINT) AS feature,
  CASE WHEN number_share = 1 THEN CAST(value AS DOUBLE) ELSE (CAST('0x' || substr(md5(value), 1, 8) AS BIGINT) % 1000)::DOUBLE END AS value
  FROM kv JOIN profile USING (path) WHERE value IS NOT NULL)
SELECT * FROM cells WHERE value != 0""")
def _(v):
    flat = cut_lineage(_flat(v))
    vectors = discovery.sparse_vector(flat, discovery.profile_paths(flat), "event_id")
    return vectors.select("event_id", F.inline("vector"))


@query("json_quality", "raw_logs", """
SELECT client_id, count(*) FILTER (json_valid(x)) AS good, count(*) FILTER (NOT json_valid(x)) AS bad
FROM (SELECT client_id, CASE WHEN event_id % 7 = 0 THEN substr(raw, 1, 20) ELSE raw END AS x FROM raw_logs) GROUP BY 1""")
def _(v):
    broken = v.raw_logs.withColumn("value", F.when(F.col("event_id") % 7 == 0, F.substring("raw", 1, 20)).otherwise(F.col("raw")))
    return raw_sources.json_quality(broken, ["client_id"])


@query("read_json_lines", "raw_logs", """
SELECT client_id, kind, count(*) AS records FROM (
 SELECT client_id, event_id % 4 AS kind, unnest(range(CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 1 END)) FROM raw_logs) GROUP BY 1, 2""")
def _(v):
    k = F.col("event_id") % 4
    texts = v.raw_logs.withColumn("kind", k).withColumn(
        "value", F.when(k == 0, F.col("raw")).when(k == 1, F.concat(F.lit("["), "raw", F.lit(","), "raw", F.lit("]")))
        .when(k == 2, F.concat(F.lit('{"records":['), "raw", F.lit(","), "raw", F.lit("]}")))
        .otherwise(F.concat("raw", F.lit("\n{broken\n"))))
    return raw_sources.read_json_lines(texts.drop("raw")).groupBy("client_id", "kind").agg(F.count("*").alias("records"))
