"""Loss expectancy per incident: exposure factor, yearly rate and money (ISO 27005)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import rules
from ..functions.numeric import DAY_US, as_col, div_us, exact_sum, round_to
from ..functions.text import by_contained, by_key
from .chunked import earlier_rows

PATTERN_SCHEMA = "pattern string, ef double, dimensions array<string>, aro_cap double, event_hint string"


def pattern_table(spark: SparkSession, table=None) -> DataFrame:
    """Exposure factor, impacted dimensions, yearly cap and event hint per pattern (20 rows)."""
    rows = [(k, *v[:1], list(v[1]), *v[2:]) for k, v in (table or rules.PATTERN_RISK).items()]
    return spark.createDataFrame(rows, PATTERN_SCHEMA)


def exposure_factor(pattern: str | Column) -> Column:
    return by_key(pattern, {k: x[0] for k, x in rules.PATTERN_RISK.items()}, rules.PATTERN_RISK["none"][0])


def aro_cap(pattern: str | Column) -> Column:
    return by_key(pattern, {k: x[2] for k, x in rules.PATTERN_RISK.items()}, rules.ARO_DEFAULT_CAP)


def single_loss(value: str | Column, pattern: str | Column) -> Column:
    return round_to(F.coalesce(as_col(value), F.lit(0.0)) * exposure_factor(pattern), 2)


def matched_patterns(event_type: Column, hint: Column) -> Column:
    """Every known pattern whose event hint occurs in the event type, and the event's own pattern."""
    kind = F.lower(event_type)
    known = F.filter(F.array(*[F.when(kind.contains(x[3]), F.lit(k)) for k, x in rules.PATTERN_RISK.items()]),
                     lambda p: p.isNotNull())
    return F.array_distinct(F.concat(known, F.array(F.coalesce(hint, F.lit("none")))))


def attack_days(events: DataFrame, as_of: int | None = None) -> DataFrame:
    """Attack days per (client, asset, pattern) in the last 365 days.

    Events are first reduced to distinct (client, asset, day, type, pattern, address), so
    that the pattern expansion and both later counts work on that small frame.
    """
    now = events.agg(F.max("ts_us")).scalar() if as_of is None else F.lit(as_of)
    daily = (
        events.where(F.col("ts_us") >= now - F.lit(365 * DAY_US))
        .select("client_id", "asset_id", div_us("ts_us", DAY_US).alias("day"), "event_type", "pattern_hint", "src_ip")
        .distinct()
        .withColumn("pattern", F.explode(matched_patterns(F.col("event_type"), F.col("pattern_hint"))))
        .groupBy("client_id", "asset_id", "pattern", "day").agg(F.countDistinct("src_ip").alias("attacking_ips"))
    )
    return daily.groupBy("client_id", "asset_id", "pattern").agg(
        F.count("*").alias("days_attacked"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.max("attacking_ips").alias("peak_ips"))


def aro_confidence(days: str | Column, period: str | Column) -> Column:
    d, p = as_col(days), as_col(period)
    return F.when((d >= 10) & (p >= 180), "high").when((d >= 3) & (p >= 60), "medium").otherwise("low")


def yearly_rate(days: DataFrame) -> DataFrame:
    """Attack days per year of observation (30 to 365 days), capped per pattern."""
    period = F.least(F.greatest(F.col("last_day") - F.col("first_day") + 1, F.lit(rules.ARO_MIN_DAYS)),
                     F.lit(rules.ARO_MAX_DAYS)).cast("bigint")
    out = days.withColumn("aro_period_days", period)
    raw = F.col("days_attacked") / (F.col("aro_period_days") / F.lit(365.0))
    return out.select("client_id", "asset_id", "pattern", round_to(F.least(raw, aro_cap("pattern")), 4).alias("aro"),
                      F.col("days_attacked").alias("aro_sample_size"), "aro_period_days",
                      aro_confidence("days_attacked", "aro_period_days").alias("aro_confidence"))


def history_context(incidents: DataFrame) -> DataFrame:
    """Incidents per (client, asset, pattern) and per (client, asset), as of now."""
    per = incidents.groupBy("client_id", "asset_id", "pattern").agg(F.count("*").alias("pattern_count"))
    total = per.groupBy("client_id", "asset_id").agg(F.sum("pattern_count").alias("attack_count"))
    return per.join(total, ["client_id", "asset_id"])


def history_before(incidents: DataFrame) -> DataFrame:
    """Adds attack_count, first_occurrence and recurrence as they stood before each incident."""
    day = div_us("created_us", DAY_US)
    order = ["created_us", "id"]
    out = earlier_rows(incidents, ["client_id", "asset_id"], order, day, "attack_count")
    out = earlier_rows(out, ["client_id", "asset_id", "pattern"], order, day, "_same")
    return out.withColumns({"first_occurrence": F.col("_same") == 0, "recurrence": F.col("_same") > 0}).drop("_same")


def impacted(pattern: str | Column, snapshot: Column) -> Column:
    """The snapshot's dimensions that the pattern hits, as a map."""
    dims = by_key(pattern, {k: ",".join(x[1]) for k, x in rules.PATTERN_RISK.items()}, "")
    return F.map_filter(snapshot, lambda k, _: F.array_contains(F.split(dims, ","), k))


def incident_risk(incidents: DataFrame, rates: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """Adds the money columns. Needs ``asset_meta`` (NULL = unregistered) and ``pattern``.

    Unregistered assets fall back to the exposure factor, the score as yearly rate and no
    money. Assets without matching events have a rate of 1.0, "insufficient_data".
    """
    m = F.col("asset_meta")
    known = m.isNotNull()
    out = incidents.join(rates, ["client_id", "asset_id", "pattern"], "left")
    aro = F.when(known, F.coalesce("aro", F.lit(1.0))).otherwise(F.col(score))
    snapshot = F.create_map(*[x for d in ("confidencialidad", "integridad", "disponibilidad")
                              for x in (F.lit(d), m[f"valor_{d}"])])
    out = out.withColumns({
        "ef": exposure_factor("pattern"),
        "sle": F.when(known, single_loss(m["valor_activo"], "pattern")).otherwise(0.0),
        "aro": aro,
        "aro_sample_size": F.when(known, F.coalesce("aro_sample_size", F.lit(0))),
        "aro_period_days": F.when(known, F.coalesce("aro_period_days", F.lit(0))),
        "aro_confidence": F.when(known, F.coalesce("aro_confidence", F.lit("insufficient_data"))).otherwise("insufficient_data"),
        "valor_activo_snapshot": F.when(known, m["valor_activo"]),
        "clasificacion_criticidad": m["clasificacion_criticidad"],
        "cia_snapshot": F.when(known, snapshot),
        "impacted_dimensions": F.when(known, impacted("pattern", snapshot)),
        "data_flags": F.when(known, F.struct(*[m[f"contiene_{x}"].alias(x) for x in ("pii", "pci", "phi", "pfi")])),
    })
    return out.withColumn("ale", F.when(known, round_to(F.col("sle") * F.col("aro"), 2)).otherwise(0.0))


def iso_control(pattern: str | Column) -> Column:
    return by_key(pattern, rules.ISO_CONTROLS, rules.ISO_CONTROL_DEFAULT)


def risk_metrics_rollup(incidents: DataFrame, rates: DataFrame, assets: DataFrame, as_of: int | None = None,
                        days: int = 30) -> DataFrame:
    """One risk_metrics row per (client, asset, pattern) seen in the window."""
    from .joins import train_asset_join

    now = incidents.agg(F.max("created_us")).scalar() if as_of is None else F.lit(as_of)
    counted = (
        incidents.where(F.col("created_us") >= now - F.lit(days * DAY_US))
        .groupBy("client_id", "asset_id", "pattern").agg(F.count("*").alias("incident_count"))
    )
    out = train_asset_join(counted, assets).join(rates, ["client_id", "asset_id", "pattern"], "left")
    aro = F.coalesce("aro", F.lit(1.0))
    return out.select(
        "client_id", "asset_id", F.col("pattern").alias("risk_scenario"), F.lit(days).alias("window_days"),
        "incident_count", aro.alias("calculated_aro"), exposure_factor("pattern").alias("exposure_factor"),
        round_to(single_loss("valor_activo", "pattern") * aro, 2).alias("ale_delta"),
        iso_control("pattern").alias("failed_control_id"), now.alias("calculated_us"),
        (now - F.lit(days * DAY_US)).alias("window_start_us"), now.alias("window_end_us"))


def aro_trend(metrics: DataFrame) -> DataFrame:
    """Monthly yearly-rate trend per (client, asset, scenario)."""
    from ..functions.numeric import exact_avg

    month = F.date_format(F.timestamp_micros("calculated_us"), "yyyy-MM")
    return metrics.groupBy("client_id", "asset_id", "risk_scenario", month.alias("month")).agg(
        round_to(exact_avg("calculated_aro", 4), 4).alias("avg_aro"),
        round_to(F.max("calculated_aro"), 4).alias("max_aro"),
        F.sum("incident_count").alias("total_incidents"),
        round_to(exact_avg("ale_delta", 2), 2).alias("avg_ale_delta"))


# --- quick risk: one row in, one row out ---

def quick_asset_score(asset_id: str | Column) -> Column:
    return by_contained(F.lower(as_col(asset_id)), rules.ASSET_KEYWORD_VALUES, rules.ASSET_KEYWORD_DEFAULT)


def quick_exposure(pattern, severity: Column, value_score: Column) -> Column:
    base = by_key(pattern, rules.QUICK_EXPOSURE, rules.QUICK_EXPOSURE_DEFAULT)
    return round_to(F.least(F.lit(0.99), base * (F.lit(0.5) + severity * F.lit(0.5))
                            * (F.lit(0.7) + value_score * F.lit(0.3))), 3)


def quick_aro(pattern, severity: Column) -> Column:
    return round_to(by_key(pattern, rules.QUICK_ARO, rules.QUICK_ARO_DEFAULT) * (F.lit(0.5) + severity), 2)


def sensor_ratio(value: str | Column, topic: str | Column, asset_id: str | Column) -> Column:
    """How far a reading is above its sensor's range; 0 inside it or without a reading."""
    v, topic, asset = as_col(value), F.lower(as_col(topic)), F.lower(as_col(asset_id))
    out = None
    for word, (normal, critical) in rules.QUICK_SENSOR_THRESHOLDS.items():
        ratio = F.when(v <= normal, F.lit(0.0)).otherwise(
            round_to((v - F.lit(normal)) / F.lit(critical - normal + 1.0), 3))
        hit = topic.contains(word) | asset.contains(word)
        out = F.when(v.isNull(), F.lit(0.0)).when(hit, ratio) if out is None else out.when(hit, ratio)
    return out.when(v > 100.0, round_to(F.log10(v / F.lit(100.0) + F.lit(1.0)), 3)).otherwise(F.lit(0.0))


def risk_decision(severity: Column, pattern: Column, ale: Column) -> Column:
    return (
        F.when(pattern.isin(*rules.CRITICAL_PATTERNS) | (severity >= 0.85) | (ale >= 50_000.0), "critical")
        .when(pattern.isin(*rules.HIGH_PATTERNS) | (severity >= 0.65) | (ale >= 15_000.0), "high")
        .when((severity >= 0.40) | (ale >= 3_000.0), "medium").otherwise("low")
    )


ACTIONS = {"critical": "contain", "high": "escalate", "medium": "review", "low": "ignore"}


def cia_impact(pattern: str | Column, asset: Column) -> Column:
    """struct per dimension of (asset level, impact, level name, score, text); unregistered assets count as 3."""
    fields = []
    for i, dim in enumerate(("confidencialidad", "integridad", "disponibilidad")):
        hit = by_key(pattern, {k: x[i] for k, x in rules.CIA_IMPACT.items()}, rules.CIA_IMPACT_DEFAULT[i])
        level = F.coalesce(asset[f"valor_{dim}"], F.lit(3))
        fields.append(F.struct(
            level.alias("valor_activo_configurado"), hit.alias("impacto_ataque"),
            F.element_at(F.array(*[F.lit(x) for x in rules.CIA_LEVELS]), hit + 1).alias("nivel"),
            round_to((hit / F.lit(3.0)) * (level / F.lit(5.0)), 3).alias("score"),
            F.element_at(F.array(*[F.lit(x) for x in rules.CIA_TEXT[dim]]), hit + 1).alias("descripcion"),
        ).alias(dim))
    fields.append(F.when(asset.isNotNull(), "registrado").otherwise("estimado_default").alias("fuente_activo"))
    return F.struct(*fields)


UNREGISTERED = "Activo no registrado. Carga tu inventario"


def asset_info(events: DataFrame, asset: str, asset_id: Column) -> Column:
    """Descriptive fields of the matched asset; name and a note when it is not registered."""
    present = events.schema[asset].dataType.fieldNames()
    a = F.col(asset)

    def get(name: str, kind: str = "string") -> Column:
        return a[name] if name in present else F.lit(None).cast(kind)

    known = a.isNotNull()
    flags = [F.when(known, F.coalesce(get(f, "boolean"), F.lit(False))).alias(f) for f in rules.SENSITIVE_UPLIFT]
    return F.struct(
        get("id", "bigint").alias("id"), F.when(known, get("nombre_activo")).otherwise(asset_id).alias("nombre"),
        get("tipo_activo").alias("tipo"), get("hostname").alias("hostname"), get("ip_address").alias("ip_address"),
        get("clasificacion_criticidad").alias("clasificacion"), get("departamento").alias("departamento"),
        get("propietario").alias("propietario"),
        F.when(known, F.coalesce(get("valor_activo", "double"), F.lit(0.0))).alias("valor_usd"), *flags,
        F.when(~known, UNREGISTERED).alias("nota"))


def quick_risk(events: DataFrame, asset: str = "asset") -> DataFrame:
    """Adds the struct ``risk``. ``asset`` is a struct column from match_asset, NULL when unregistered.

    Uses asset_id, severity_score, pattern_hint and, when present, numeric_value,
    event_name and parse_confidence.
    """
    def have(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in events.columns else F.lit(default)

    a = F.col(asset)
    real = F.coalesce(a["valor_activo"], F.lit(0.0)) > 0
    score = F.when(real, F.least(F.lit(1.0), a["valor_activo"] / F.lit(1_000_000.0))).otherwise(
        quick_asset_score(have("asset_id", "unknown")))
    usd = F.when(real, a["valor_activo"]).otherwise(F.col("_av") * F.lit(rules.DEFAULT_ASSET_USD))
    value = F.col("numeric_value") if "numeric_value" in events.columns else F.lit(None).cast("double")
    e = events.withColumns({"_av": score, "_sev": have("severity_score", 0.2), "_pat": have("pattern_hint", "none")})
    e = e.withColumns({
        "_usd": usd, "_ef": quick_exposure("_pat", F.col("_sev"), F.col("_av")),
        "_ratio": sensor_ratio(value, have("event_name", ""), have("asset_id", "unknown")),
    })
    ef = F.col("_ef")
    for flag, extra in rules.SENSITIVE_UPLIFT.items():
        ef = F.when(F.coalesce(a[flag], F.lit(False)), F.least(F.lit(0.99), ef + F.lit(extra))).otherwise(ef)
    e = e.withColumn("_ef", ef)
    hot = F.col("_ratio") > 2.0
    e = e.withColumns({
        "_ef": F.when(hot, F.least(F.lit(0.99), F.col("_ef") + (F.col("_ratio") - F.lit(2.0)) * F.lit(0.1))).otherwise(F.col("_ef")),
        "_sev": F.when(hot, F.least(F.lit(1.0), F.col("_sev") + F.lit(0.3))).otherwise(F.col("_sev")),
    })
    e = e.withColumn("_sev", F.when(have("parse_confidence", 1.0) < 0.4, F.greatest(F.col("_sev"), F.lit(0.3))).otherwise(F.col("_sev")))
    e = e.withColumn("_sle", F.col("_usd") * F.col("_ef")).withColumn("_aro", quick_aro("_pat", F.col("_sev")))
    e = e.withColumn("_ale", F.col("_sle") * F.col("_aro"))
    e = e.withColumn("_level", risk_decision(F.col("_sev"), F.col("_pat"), F.col("_ale")))
    return e.withColumn("risk", F.struct(
        round_to("_av", 3).alias("asset_value_score"), round_to("_usd", 2).alias("asset_value_usd"),
        round_to("_ef", 3).alias("exposure_factor"), round_to("_sle", 2).alias("sle_usd"),
        round_to("_aro", 2).alias("aro"), round_to("_ale", 2).alias("ale_usd"), F.col("_level").alias("risk_level"),
        by_key("_level", ACTIONS, "ignore").alias("action"), iso_control("_pat").alias("iso_control"),
        round_to("_ratio", 3).alias("anomaly_ratio"), cia_impact("_pat", a).alias("cia_impact"),
        asset_info(events, asset, have("asset_id", "unknown")).alias("asset_info"),
    )).drop("_av", "_sev", "_pat", "_usd", "_ef", "_ratio", "_sle", "_aro", "_ale", "_level")


def sandbox_asset_score(asset: str | Column) -> Column:
    from ..functions.text import any_word

    out = None
    for words, value in rules.SANDBOX_ASSET_VALUES:
        hit = any_word(asset, words)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(F.lit(rules.SANDBOX_ASSET_DEFAULT))
