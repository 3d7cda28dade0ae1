"""Row filters, escalation rules and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions.numeric import as_col
from ..functions.text import effective_pattern
from .sweep import IP, address_key, live_counts


def _noise(severity: Column, event_type: Column) -> Column:
    return (
        F.when(severity < rules.MIN_SEVERITY, "low_severity")
        .when(F.lower(event_type).isin(*rules.NOISE_EVENT_TYPES), "noise_event")
    )


def siem_noise_filter(events: DataFrame) -> DataFrame:
    """Adds ``passed`` and ``reason``."""
    reason = _noise(F.coalesce("severity_score", F.lit(0.3)), F.coalesce("event_type", F.lit("")))
    return events.withColumns({"passed": reason.isNull(), "reason": F.coalesce(reason, F.lit("approved"))})


def strict_reason() -> Column:
    severity = F.coalesce("severity_score", F.lit(0.3))
    trusted = F.coalesce(F.col("src_ip"), F.lit("")).isin(*rules.TRUSTED_IPS) & (severity < 0.5)
    return F.coalesce(_noise(severity, F.coalesce("event_type", F.lit(""))), F.when(trusted, "trusted_ip"))


def strict_filter(events: DataFrame) -> DataFrame:
    reason = strict_reason()
    return events.withColumns({"passed": reason.isNull(), "reason": F.coalesce(reason, F.lit("approved"))})


def ip_rate_limit(events: DataFrame, per_minute: int = rules.MAX_EVENTS_PER_IP_PER_MINUTE,
                  keep: Column | None = None) -> DataFrame:
    """Strict filter, then at most ``per_minute`` low-severity events per address in (t-60 s, t].

    Every event that reaches this step counts, also those it drops. Above the limit one
    in ten is kept by hash of the event's id (``keep`` overrides the choice).
    """
    keep = keep if keep is not None else F.pmod(F.xxhash64("event_id"), F.lit(10)) == 0
    judged = strict_filter(events)
    reached = F.col("passed") & (F.coalesce(F.col("src_ip"), F.lit("")) != "")
    counted = live_counts(judged.withColumns({"_one": reached.cast("bigint"), IP: address_key("src_ip", "ts_us")}), [IP],
                          "ts_us", 60_000_000, {"ip_per_minute": "_one"}).drop("_one", IP)
    severity = F.coalesce("severity_score", F.lit(0.3))
    flood = reached & (severity < rules.HIGH_SEVERITY) & (F.col("ip_per_minute") > per_minute)
    return counted.withColumns({
        "reason": F.when(flood & keep, "flood_sampled").when(flood, "flood_dropped").otherwise(F.col("reason")),
        "sampled": F.coalesce(flood & keep, F.lit(False)),
        "passed": F.col("passed") & ~F.coalesce(flood & ~keep, F.lit(False)),
    })


def escalation(events: DataFrame) -> DataFrame:
    """Adds ``should_escalate`` and ``via`` from scan, density, combined and correlation evidence."""
    ripe = ~F.col("river_warmup")
    ways = {
        "nmap_scan": F.col("is_scan"),
        "river": ripe & (F.col("river_score") >= 0.45),
        "combined": ripe & (F.col("combined_score") > 0.55),
        "correlation": (F.col("correlation_count") >= 5) | F.coalesce(
            F.col("correlation_pattern").isin("brute_force", "brute_force_success"), F.lit(False)),
    }
    via = F.concat_ws("+", *[F.when(test, name) for name, test in ways.items()])
    return events.withColumns({"via": via, "should_escalate": via != ""})


def route(events: DataFrame) -> DataFrame:
    """Adds ``route``: skipped (no tenant), escalated or normal."""
    return events.withColumn("route", F.when(F.coalesce("client_id", F.lit("")) == "", "skipped")
                             .when(F.col("should_escalate"), "escalated").otherwise("normal"))


def incident_status(mode: str | Column) -> Column:
    return F.when(as_col(mode) == "SHADOW", "SHADOW").otherwise("PENDING")


def result_label(events: DataFrame) -> DataFrame:
    """Risk level, action and reason from correlation, hint, severity and threat intelligence."""
    intel = F.coalesce("threat_intel", F.lit(False)) if "threat_intel" in events.columns else F.lit(False)
    score = F.when(intel, F.greatest(F.coalesce("severity_score", F.lit(0.3)), F.lit(0.8))).otherwise(
        F.coalesce("severity_score", F.lit(0.3)))
    pattern = effective_pattern("correlation_pattern", "pattern_hint")
    pattern = F.when((F.col("correlation_count") >= 5) & pattern.isin("none", "brute_force_attempt"),
                     "brute_force").otherwise(pattern)
    p = F.col("label_pattern")
    level = (
        F.when((F.col("_score") >= 0.75) | p.isin("lateral_movement", "brute_force_success", "c2_beacon"), "high")
        .when((F.col("_score") >= 0.45) | p.isin("brute_force", "port_scan", "suspicious_outbound"), "medium")
        .otherwise("low")
    )
    reason = F.when(p == "brute_force", F.concat(F.lit("Múltiples intentos fallidos ("),
                                                 F.col("correlation_count").cast("string"), F.lit(" intentos).")))
    for name, text in rules.RESULT_REASONS.items():
        reason = reason.when(p == name, text)
    described = F.col("description") if "description" in events.columns else F.lit(None).cast("string")
    reason = reason.otherwise(F.coalesce(described, F.lit(rules.RESULT_REASON_NONE)))
    reason = F.concat(reason, F.when(intel, rules.RESULT_REASON_INTEL).otherwise(""))
    return (
        events.withColumns({"_score": score, "label_pattern": pattern})
        .withColumns({"risk_level": level, "label_reason": reason})
        .withColumn("action", F.when(F.col("risk_level") == "high", "escalate")
                    .when(F.col("risk_level") == "medium", "review").otherwise("ignore"))
        .drop("_score")
    )


def ingest_metrics(routed: DataFrame) -> DataFrame:
    """Counts of one batch per tenant, in one pass."""
    r = F.col("route")
    return routed.groupBy("client_id").agg(
        F.count("*").alias("processed"),
        F.count_if(r == "normal").alias("persisted"),
        F.count_if(r == "escalated").alias("escalated"),
        F.count_if(r == "skipped").alias("skipped_no_client"),
        F.countDistinct("asset_id").alias("models"),
    )
