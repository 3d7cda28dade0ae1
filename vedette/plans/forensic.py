"""Forensic scan of one upload of raw logs: anomalies and money per asset, and a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions import text as t
from ..functions.jsontree import flatten_json
from ..functions.numeric import exact_sum, round_to
from ..operators import discovery, iforest
from ..operators.ranking import first_per_key
from ..operators.risk import sandbox_asset_score
from ..session import cut_lineage, small_side

ANOMALY_AT = 0.5  # isolation above one half, the forest's automatic contamination


def prepare(logs: DataFrame, raw: str = "raw", row_id: str = "event_id") -> DataFrame:
    """Flat fields, target asset, danger scores, and ``vector``: the cells of all paths but the asset's.

    The driver learns the names of four columns and of the paths that hold numbers and other
    texts (up to a limit, see ``sparse_vector``); logs may have any number of paths.
    """
    flat = cut_lineage(logs.select(row_id, F.col(raw), flatten_json(raw).alias("fields")).where("fields is not null"))
    profile = cut_lineage(discovery.profile_paths(flat))
    asset = discovery.discover_asset_column(profile).first()["asset_column"]
    event = discovery.discover_event_column(profile).first()["event_column"]
    time = discovery.discover_time_column(profile).first()

    def field(path: str | None) -> Column:
        return F.try_element_at("fields", F.lit(path)) if path else F.lit(None).cast("string")

    scored = flat.withColumn("actor", field(asset))
    if asset == "actor_email":
        lowered = F.lower("path")
        parameter = profile.where(lowered.contains("parameters") & lowered.contains("value")).agg(F.min("path").alias("path")).first()["path"]
        scored = scored.withColumn("parameter", field(parameter))
        scored = discovery.resolve_google_asset(scored, [], "actor", "parameter").drop("parameter")
    else:
        scored = scored.withColumn("target_asset", F.col("actor"))
    value = field("val").try_cast("double")
    scored = scored.withColumns({
        "target_asset": F.coalesce("target_asset", F.lit("unknown_asset" if asset is None else "nan")),
        "event_name": field(event),
        "event_us": discovery.parsed_time(field(time["time_column"]), time["unit"] or "text"),
        "danger_score": t.danger_score(field(event)) if event else F.lit(rules.DANGER_DEFAULT),
        "iot_danger": F.when(field("topic").isNotNull(), t.sensor_danger(F.coalesce(field("topic"), F.lit("")), F.coalesce(value, F.lit(0.0)))),
    }).drop("actor")
    return discovery.sparse_vector(scored, profile, row_id, leave_out=asset)


def flag_anomalies(prepared: DataFrame, row_id: str = "event_id") -> DataFrame:
    """Forest per asset with forced anomalies; assets with fewer than two rows are left out."""
    keys = ["target_asset"]
    own = [F.col("danger_score"), F.coalesce("iot_danger", F.lit(0.0)), sandbox_asset_score("target_asset")]
    own = F.array(*[F.struct(F.lit(i).cast("bigint").alias("feature"), F.coalesce(c, F.lit(0.0)).cast("double").alias("value"))
                    for i, c in enumerate(own)])
    x = prepared.select(row_id, *keys, F.concat(own, "vector").alias("vector"))
    sizes = small_side(x.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n >= 2").drop("_n"))
    x = cut_lineage(x.join(sizes, keys, "left_semi"))
    model = cut_lineage(iforest.fit_sparse(x, keys, row_id))
    scores = iforest.sparse_scores(x, model, keys, row_id)
    forced = (F.coalesce("danger_score", F.lit(0.0)) >= rules.FORCED_DANGER) | (
        F.coalesce("iot_danger", F.lit(0.0)) >= rules.FORCED_SENSOR_DANGER)
    return prepared.drop("vector").join(scores.select(row_id, "isolation"), row_id).withColumn(
        "is_anomaly", forced | (F.col("isolation") > ANOMALY_AT))


def asset_money(flagged: DataFrame) -> DataFrame:
    """Per asset with anomalies: value, exposure, loss, rate, yearly loss."""
    per = flagged.groupBy("target_asset").agg(F.count("*").alias("events"), F.count_if("is_anomaly").alias("anomalies")).where("anomalies > 0")
    av = sandbox_asset_score("target_asset")
    density = F.col("anomalies") / F.col("events")
    out = per.withColumns({"av_usd": round_to(av * rules.DEFAULT_ASSET_USD, 2),
                           "ef": round_to(F.least(F.lit(0.99), av * 0.6 + density * 0.8), 2),
                           "aro": F.col("anomalies") * F.lit(12.0)})
    out = out.withColumn("sle_usd", round_to(F.col("av_usd") * F.col("ef"), 2))
    return out.withColumn("ale_cost", round_to(F.col("sle_usd") * F.col("aro"), 2))


def health(events: DataFrame, money: DataFrame) -> DataFrame:
    """One-row report: health, total yearly loss, number of critical assets."""
    totals = money.agg(F.coalesce(F.sum("anomalies"), F.lit(0)).alias("anomalies"),
                       F.coalesce(exact_sum("ale_cost"), F.lit(0.0)).alias("total_ale_risk"),
                       F.count("*").alias("critical_assets_count"))
    n = events.agg(F.greatest(F.count("*"), F.lit(1))).scalar()
    left = F.lit(1.0) - F.col("anomalies") / n
    return totals.select(
        round_to(F.greatest(F.lit(5.0), F.lit(100.0) * F.pow(left, F.lit(2.5))), 1).alias("global_health"),
        "total_ale_risk", "critical_assets_count")


def top_threats(money: DataFrame, limit: int = 5) -> DataFrame:
    return money.orderBy(F.desc("ale_cost"), "target_asset").limit(limit)


def event_top3(flagged: DataFrame, event: str = "event_name") -> DataFrame:
    """Three most frequent event names among the anomalies of each asset, as one text."""
    counts = flagged.where(F.col("is_anomaly") & F.col(event).isNotNull() & (F.col(event) != "")).groupBy(
        "target_asset", event).agg(F.count("*").alias("n"))
    top = first_per_key(counts, ["target_asset"], [F.desc("n"), F.asc(event)], 3, rank_as="_r")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_r", event))), lambda x: x[event])
    return top.groupBy("target_asset").agg(F.array_join(listed, ", ").alias("top_events"))


def explain_assets(flagged: DataFrame, row_id: str = "event_id") -> DataFrame:
    """Sentence per asset: destructive acts, a dangerous command, top events, an outside address, density."""
    def first_of(keys) -> Column:
        return F.coalesce(*[F.nullif(F.try_element_at("fields", F.lit(k)), F.lit("")) for k in keys])

    command = F.coalesce(*[F.when(F.try_element_at("fields", F.lit(k)).rlike(rules.DANGEROUS_COMMAND),
                                  F.substring(F.try_element_at("fields", F.lit(k)), 1, 70)) for k in rules.EXPLAIN_COMMAND_KEYS])
    ip = first_of(rules.EXPLAIN_IP_KEYS)
    rows = flagged.withColumns({"_cmd": command, "_ip": F.when(t.external_ip(ip), ip), "_name": first_of(rules.EXPLAIN_EVENT_KEYS)})
    bad = F.col("is_anomaly")
    per = rows.groupBy("target_asset").agg(
        F.count("*").alias("events"), F.count_if(bad).alias("anomalies"), F.max(F.when(bad, F.col("danger_score"))).alias("danger"),
        F.min(F.when(bad & F.col("_cmd").isNotNull(), F.struct(F.col(row_id), F.col("_cmd").alias("x")))).alias("cmd"),
        F.min(F.when(bad & F.col("_ip").isNotNull(), F.struct(F.col(row_id), F.col("_ip").alias("x")))).alias("ip"),
    ).where("anomalies > 0").join(event_top3(rows, "_name"), "target_asset", "left")
    parts = F.concat_ws(". ", F.when(F.col("danger") >= rules.FORCED_DANGER, rules.EXPLAIN_DESTRUCTIVE),
                        F.concat(F.lit("Comando peligroso: "), F.trim("cmd.x")),
                        F.concat(F.lit("Eventos: "), "top_events"), F.concat(F.lit("IP externa: "), "ip.x"))
    density = F.floor(F.col("anomalies") * 100 / F.col("events")).cast("string")
    return per.select("target_asset", F.concat(
        F.when(parts == "", rules.EXPLAIN_FALLBACK).otherwise(parts), F.lit(". Densidad de anomalías: "), density, F.lit("%.")).alias("motive"))


def forensic_scan(logs: DataFrame, raw: str = "raw", row_id: str = "event_id") -> dict[str, DataFrame]:
    """All result frames of one scan."""
    flagged = cut_lineage(flag_anomalies(prepare(logs, raw, row_id), row_id))
    money = asset_money(flagged)
    return {"flagged": flagged, "assets": money.join(explain_assets(flagged, row_id), "target_asset", "left"),
            "report": health(logs, money), "top_threats": top_threats(money)}
