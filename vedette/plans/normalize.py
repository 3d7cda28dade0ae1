"""Raw vendor logs to canonical events: one select over a table or a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as t
from ..functions.jsontree import analyse_json
from ..functions.numeric import round_to
from ..operators.discovery import extract_entities


def normalize_events(raw: DataFrame, severity: Column | None = None, command: Column | None = None,
                     numeric_value: Column | None = None, timestamp: Column | None = None,
                     parse_confidence: Column | None = None, received_us: Column | None = None) -> DataFrame:
    """Canonical events from the column ``raw``; the other columns are kept.

    Severity, command, reading, time text and parse confidence come from the caller's
    columns. Text that is no JSON becomes a parse_error row with severity 0.1.
    """
    null = F.lit(None).cast("string")
    severity = F.lit(0.3) if severity is None else F.coalesce(severity, F.lit(0.3))
    command = null if command is None else command
    numeric_value = F.lit(None).cast("double") if numeric_value is None else numeric_value.cast("double")
    received = F.unix_micros(F.current_timestamp()) if received_us is None else received_us
    stamp = received if timestamp is None else F.coalesce(t.normalize_timestamp(timestamp), received)
    kept = [c for c in raw.columns if c not in ("severity_score",)]

    staged = raw.select(
        *kept, severity.alias("_sev"), command.alias("_cmd"), numeric_value.alias("_num"), stamp.alias("_ts"),
        received.alias("_received"), (F.lit(1.0) if parse_confidence is None else parse_confidence).alias("_conf"),
        analyse_json("raw").alias("_json"))
    staged = staged.withColumns({"_clean": F.col("_json.clean"), "_canon": F.col("_json.canonical"),
                                 "_leaves": F.col("_json.leaves")})
    entities = F.struct(*[c.alias(n) for n, c in extract_entities(F.col("_leaves")).items()])
    staged = staged.withColumns({"_e": entities, "_ok": F.col("_clean").isNotNull(),
                                 "_score": F.when(F.col("_clean").isNotNull(), round_to("_sev", 3)).otherwise(0.1)})
    staged = staged.withColumn("_p", t.classify_pattern(
        F.concat_ws(" ", "_e.event_type", "_cmd", "_clean"), "_sev", F.coalesce("_cmd", F.lit(""))))
    ok, e, p = F.col("_ok"), F.col("_e"), F.col("_p")
    event_type = F.when(ok, e["event_type"]).otherwise("parse_error")
    digest = F.sha2(F.coalesce("_canon", "raw").cast("binary"), 256)
    feature = F.struct(
        F.col("_score").alias("severity_score"), F.lit(0.5).alias("asset_value"), F.lit(0.0).alias("timestamp_delta"),
        F.when(ok, t.event_type_id(event_type)).otherwise(0.0).alias("event_type_id"),
        F.when(ok, t.numeric_feature("_num")).otherwise(0.0).alias("numeric_anomaly"),
        F.when(ok, t.command_feature("_cmd")).otherwise(0.0).alias("command_risk"))
    return staged.select(
        *kept,
        F.when(ok, t.detect_source("_clean")).otherwise("error").alias("source"),
        F.when(ok, e["asset_id"]).otherwise("unknown").alias("asset_id"),
        F.when(ok, e["src_ip"]).alias("src_ip"), F.when(ok, e["victim_ip"]).alias("victim_ip"),
        F.substring(digest, 1, 24).alias("external_event_id"),
        t.severity_level("_score").alias("severity"), F.col("_score").alias("severity_score"),
        event_type.alias("event_type"), F.when(ok, p["pattern"]).otherwise("none").alias("pattern_hint"),
        F.when(ok, p["confidence"]).otherwise(0.0).alias("pattern_confidence"),
        F.when(ok, p["reason"]).otherwise("Error en normalización").alias("description"),
        F.col("_cmd").alias("command"), F.col("_num").alias("numeric_value"),
        F.col("_ts").alias("event_us"), F.col("_received").alias("received_us"),
        F.when(ok, F.col("_conf")).otherwise(0.0).alias("parse_confidence"), digest.alias("raw_hash"),
        feature.alias("features_vector"))
