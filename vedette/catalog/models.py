"""Model queries. Trees are random, so these are checked by properties, not by SQL."""

from pyspark.sql import functions as F

from .. import rules
from ..operators import features, hst, iforest
from ..plans import train
from .registry import query
from .windows import r

KEYS = ["client_id"]


def _train(v):
    return features.training_features(v.sec_events, v.assets, features.MIN_TRAINING_ROWS)


def _trained(v):
    return train.train(_train(v), features.contamination(v.sec_events))


@query("isolation_forest_fit", "", None)
def _(v):
    return _trained(v).model.select("client_id", "tree", "sample", F.size("feature").alias("nodes"))


@query("isolation_forest_score", "", None)
def _(v):
    return _trained(v).decided


@query("stability_score", "", None)
def _(v):
    return _trained(v).stability


@query("stability_given_flags", "sec_events", """
SELECT client_id, count(*) AS n_samples, count(*) FILTER (a) / count(*) AS anomaly_rate, greatest(0.005, least(0.1, count(*) FILTER (d) / count(*))) AS contamination,
  greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(count(*) FILTER (a) / count(*) - greatest(0.005, least(0.1, count(*) FILTER (d) / count(*))))) AS stability_score
FROM (SELECT *, command_risk > 0.93 AS a, severity_score > 0.5 OR pattern_hint NOT IN ('none', 'reconnaissance') AS d FROM sec_events) GROUP BY 1""")
def _(v):
    flagged = v.sec_events.withColumn("is_anomaly", F.col("command_risk") > 0.93)
    return iforest.stability(flagged, features.contamination(v.sec_events), KEYS)


@query("offset_quantile", "sec_events", """
SELECT client_id, round(quantile_cont(command_risk, 0.937), 9) AS quantile FROM sec_events GROUP BY 1""")
def _(v):
    q = iforest.quantile_per_key(v.sec_events.withColumn("_q", F.lit(0.937)), KEYS, "command_risk", "_q")
    return q.select("client_id", F.round("quantile", 9).alias("quantile"))


@query("half_space_trees", "", None)
def _(v):
    x = _train(v).join(v.sec_events.select("event_id", "danger_score"), "event_id")
    return hst.half_space_trees(x, window=100).select("event_id", "client_id", "asset_id", "seq", "raw_score", "river_score",
                                          "river_warmup", "is_anomaly", "river_escalates", "learned")


@query("hst_flags", "sec_events", f"""
WITH s AS (SELECT *, row_number() OVER (PARTITION BY client_id, asset_id ORDER BY ts_us, event_id) AS seq, row_number() OVER (ORDER BY ts_us, event_id) AS total,
   danger_score < 0.9 AS learned FROM sec_events),
t AS (SELECT *, seq < 30 AS warm, CASE WHEN seq < 30 THEN {r('severity_score', 4)} ELSE {r('1.0::DOUBLE / (1.0::DOUBLE + exp(-8.0::DOUBLE * (command_risk - 0.3::DOUBLE)))', 4)} END AS score,
   CASE WHEN total < 500 THEN 0.38 ELSE 0.45 END AS bar FROM s)
SELECT event_id, seq, score AS river_score, warm AS river_warmup, CASE WHEN warm THEN severity_score >= 0.5 ELSE score >= 0.3 END AS is_anomaly,
  CASE WHEN warm THEN severity_score >= 0.7 ELSE score >= bar END AS river_escalates,
  CASE WHEN warm THEN 'warmup' WHEN NOT learned THEN 'destructive' WHEN score >= bar THEN 'escalating' WHEN score >= 0.3 THEN 'suspicious' ELSE 'normal' END AS reason FROM t""")
def _(v):
    s = hst.sequence(v.sec_events).withColumn("raw_score", F.col("command_risk"))
    return hst.flags(s).select("event_id", "seq", "river_score", "river_warmup", "is_anomaly", "river_escalates", "reason")


@query("shap_attribution", "", None)
def _(v):
    return train.explain(_trained(v))


@query("attribution_fallback", "sec_events", f"""
SELECT event_id, {r('(severity_score - 0.5::DOUBLE) * 0.6::DOUBLE', 4)} AS severity_score, {r('-(300.0 * command_risk) / 10000.0::DOUBLE', 4)} AS timestamp_delta FROM sec_events""")
def _(v):
    return v.sec_events.select("event_id", *[c.alias(n) for n, c in iforest.attribution_fallback(
        "severity_score", F.lit(300.0) * F.col("command_risk")).items()])


@query("explain_incident", "sec_events", f"""
SELECT event_id, CASE WHEN a >= b AND a >= c THEN '{rules.EXPLANATIONS["severity_score"]}' WHEN b >= c THEN '{rules.EXPLANATIONS["timestamp_delta"]}' ELSE '{rules.EXPLANATION_DEFAULT}' END AS explanation
FROM (SELECT event_id, abs(severity_score - 0.5) AS a, abs(-command_risk / 2) AS b, abs(danger_score / 3) AS c FROM sec_events)""")
def _(v):
    return v.sec_events.select("event_id", iforest.explain_incident({
        "severity_score": F.col("severity_score") - 0.5, "timestamp_delta": -F.col("command_risk") / 2,
        "command_risk": F.col("danger_score") / 3}).alias("explanation"))


@query("dummy_or_fallback_score", "sec_events", """
SELECT event_id, CASE WHEN m = 'DUMMY' THEN 0.5 WHEN event_id % 3 = 0 THEN command_risk ELSE severity_score END AS anomaly_score,
  CASE WHEN m = 'DUMMY' THEN 0.5 ELSE 12.0 * CASE WHEN event_id % 3 = 0 THEN command_risk ELSE severity_score END END AS aro_suggested,
  CASE WHEN m = 'DUMMY' THEN 'DUMMY' WHEN event_id % 3 = 0 THEN m ELSE 'FALLBACK_ISO27005' END AS model_used
FROM (SELECT *, CASE event_id % 5 WHEN 0 THEN 'DUMMY' WHEN 1 THEN 'LIVE' ELSE 'SHADOW' END AS m FROM sec_events)""")
def _(v):
    i = F.col("event_id")
    mode = F.when(i % 5 == 0, "DUMMY").when(i % 5 == 1, "LIVE").otherwise("SHADOW")
    return v.sec_events.select("event_id", *[c.alias(n) for n, c in iforest.fallback_score(
        "severity_score", mode, i % 3 == 0, F.col("command_risk")).items()])


@query("lateral_flag", "sec_events", "SELECT event_id, pattern_hint IN ('lateral_movement', 'brute_force_success') OR severity_score >= 0.8 AS lateral FROM sec_events")
def _(v):
    return v.sec_events.select("event_id", iforest.lateral_flag("pattern_hint", "severity_score").alias("lateral"))


@query("model_versions", "", """
SELECT client_id, version, CAST(p AS INT) AS position, p = 1 AS is_active, p > 3 AS to_delete FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY version DESC) AS p FROM (
  SELECT DISTINCT concat('client-', o_custkey % 3) AS client_id, concat('v_', strftime(o_orderdate, '%Y%m')) AS version FROM orders))""")
def _(v):
    versions = v.table("orders").select(
        F.concat(F.lit("client-"), (F.col("o_custkey") % 3).cast("string")).alias("client_id"),
        F.concat(F.lit("v_"), F.date_format("o_orderdate", "yyyyMM")).alias("version")).distinct()
    return iforest.model_versions(versions).select("client_id", "version", "position", "is_active", "to_delete")
