"""Incident reports per tenant.

All reports take ``as_of`` (microseconds, default: newest ``created_us``) instead of
the wall clock, and answer for every tenant at once unless ``client_id`` is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import DAY_US, HOUR_US, MINUTE_US, exact_avg, exact_sum, floor_us, round_to
from ..session import cut_lineage
from .ranking import first_per_key

ACTIVE_US = 10 * MINUTE_US
LOOPBACK = ("127.0.0.1", "::1")
TIMELINE = ("client_id", "attacker_ip", "id", "asset_id", "victim_ip", "pattern", "event_type", "event_count", "ale",
            "first_seen_us", "last_seen_us")


def newest(df: DataFrame, column: str) -> Column:
    """Scalar subquery: the greatest value of one column."""
    return df.agg(F.max(column)).scalar()


def _as_of(incidents: DataFrame, as_of: int | None) -> Column:
    return newest(incidents, "created_us") if as_of is None else F.lit(as_of)


def _tenant(incidents: DataFrame, client_id: str | None) -> DataFrame:
    return incidents if client_id is None else incidents.where(F.col("client_id") == client_id)


def _since(incidents: DataFrame, as_of: Column, span_us: int, client_id: str | None) -> DataFrame:
    return _tenant(incidents, client_id).where(F.col("created_us") >= as_of - F.lit(span_us))


def still_active(as_of: Column) -> Column:
    return F.col("last_seen_us") >= as_of - F.lit(ACTIVE_US)


def stats_summary(incidents: DataFrame, hours: int = 24, as_of: int | None = None,
                  client_id: str | None = None) -> DataFrame:
    score = F.col("anomaly_score")
    return (
        _since(incidents, _as_of(incidents, as_of), hours * HOUR_US, client_id)
        .groupBy("client_id")
        .agg(
            F.count("*").alias("total_alerts"),
            F.count_if(score >= 0.8).alias("critical_alerts"),
            F.count_if((score >= 0.5) & (score < 0.8)).alias("medium_alerts"),
            F.coalesce(exact_sum("ale"), F.lit(0.0)).alias("ale_impact"),
            round_to(F.coalesce(exact_avg(score), F.lit(0.0)), 6).alias("avg_confidence"),
        )
    )


def attack_trends(incidents: DataFrame, days: int = 7, as_of: int | None = None,
                  client_id: str | None = None) -> DataFrame:
    mean = exact_avg("anomaly_score")
    return (
        _since(incidents, _as_of(incidents, as_of), days * DAY_US, client_id)
        .groupBy("client_id", floor_us("created_us", HOUR_US).alias("hour_us"))
        .agg(
            F.count("*").alias("incidents"),
            F.when(mean >= 0.8, "high").when(mean >= 0.5, "medium").otherwise("low").alias("risk_level"),
        )
    )


def top_entities(incidents: DataFrame, field: str = "src_ip", limit: int = 5,
                 client_id: str | None = None) -> DataFrame:
    """Busiest attackers or assets per tenant; ties go to the smaller name."""
    if field not in ("src_ip", "asset_id"):
        raise ValueError("field must be src_ip or asset_id")
    counts = (
        _tenant(incidents, client_id)
        .where(F.col(field).isNotNull() & ~F.col(field).isin(*LOOPBACK))
        .groupBy("client_id", F.col(field).alias("entity"))
        .agg(F.count("*").alias("incidents"))
    )
    return first_per_key(counts, ["client_id"], [F.desc("incidents"), F.asc("entity")], limit, rank_as="position")


def _attackers(incidents: DataFrame, as_of: Column, days: int, client_id: str | None) -> DataFrame:
    return _since(incidents, as_of, days * DAY_US, client_id).where(
        F.col("src_ip").isNotNull() & (F.col("src_ip") != "0.0.0.0"))


def attacker_profiles(incidents: DataFrame, days: int = 7, limit: int = 20, as_of: int | None = None,
                      client_id: str | None = None) -> DataFrame:
    """Top attackers per tenant by machines hit, then money at risk."""
    now = _as_of(incidents, as_of)
    profiles = (
        _attackers(incidents, now, days, client_id)
        .groupBy("client_id", F.col("src_ip").alias("attacker_ip"))
        .agg(
            F.countDistinct("asset_id").alias("machines_targeted"),
            F.count("*").alias("total_incidents"),
            F.coalesce(exact_sum("ale"), F.lit(0.0)).alias("total_financial_risk"),
            F.min("first_seen_us").alias("campaign_start_us"),
            F.max("last_seen_us").alias("campaign_last_seen_us"),
            F.bool_or(still_active(now)).alias("campaign_active"),
            F.bool_or("lateral_movement_detected").alias("lateral_movement_confirmed"),
        )
    )
    order = [F.desc("machines_targeted"), F.desc_nulls_last("total_financial_risk"), F.asc("attacker_ip")]
    return first_per_key(profiles, ["client_id"], order, limit, rank_as="position")


def attacker_timelines(incidents: DataFrame, days: int = 7, limit: int = 20, as_of: int | None = None,
                       client_id: str | None = None) -> DataFrame:
    """Incident rows of the top attackers.

    One row per incident rather than one array per attacker: an attacker may own any
    share of the table. Read it ordered by (client_id, attacker_ip, last_seen_us desc).
    """
    now = _as_of(incidents, as_of)
    top = attacker_profiles(incidents, days, limit, as_of, client_id).select("client_id", "attacker_ip")
    return (
        _attackers(incidents, now, days, client_id)
        .withColumnRenamed("src_ip", "attacker_ip")
        .join(top, ["client_id", "attacker_ip"], "left_semi")
        .select(*TIMELINE, still_active(now).alias("still_active"))
    )


def executive_metrics(incidents: DataFrame, as_of: int | None = None, client_id: str | None = None) -> DataFrame:
    now = _as_of(incidents, as_of)
    score, created = F.col("anomaly_score"), F.col("created_us")
    week = created >= now - F.lit(7 * DAY_US)

    def minutes(later: str, earlier: str) -> Column:
        return (F.col(later) - F.col(earlier)) / F.lit(float(MINUTE_US))

    return (
        _since(incidents, now, 30 * DAY_US, client_id)
        .groupBy("client_id")
        .agg(
            F.count_if(score >= 0.85).alias("critical_count"),
            F.count_if((score >= 0.65) & (score < 0.85)).alias("high_count"),
            F.count_if((score >= 0.40) & (score < 0.65)).alias("medium_count"),
            F.count_if(score < 0.40).alias("low_count"),
            F.coalesce(exact_sum(F.when(F.col("status").isin("PENDING", "SHADOW"), F.col("ale"))), F.lit(0.0))
            .alias("total_active_financial_risk"),
            F.count_if((F.col("status") == "PENDING") & (score >= 0.65) & (created < now - F.lit(DAY_US)))
            .alias("high_alerts_unattended_24h"),
            round_to(exact_avg(minutes("created_us", "first_seen_us")), 1).alias("avg_mttd_minutes"),
            round_to(exact_avg(minutes("reviewed_us", "created_us")), 1).alias("avg_mttr_minutes"),
            F.countDistinct(F.when(week, F.col("src_ip"))).alias("unique_attackers_7d"),
            F.countDistinct(F.when(week, F.col("asset_id"))).alias("assets_affected_7d"),
        )
    )


def risk_by_asset(incidents: DataFrame, as_of: int | None = None, client_id: str | None = None) -> DataFrame:
    """Money at risk per asset over 30 days. The pattern list has at most one entry per known pattern."""
    now = _as_of(incidents, as_of)
    return (
        _since(incidents, now, 30 * DAY_US, client_id)
        .groupBy("client_id", "asset_id", "clasificacion_criticidad")
        .agg(
            F.count("*").alias("total_incidents"),
            F.coalesce(exact_sum("ale"), F.lit(0.0)).alias("total_ale"),
            F.coalesce(F.max("valor_activo_snapshot"), F.lit(0.0)).alias("asset_value"),
            F.max("peak_anomaly_score").alias("max_risk_score"),
            F.sum("event_count").alias("total_raw_events"),
            F.max("last_seen_us").alias("last_attack_us"),
            F.bool_or(still_active(now)).alias("under_attack_now"),
            F.array_sort(F.collect_set("pattern")).alias("patterns"),
            F.countDistinct("src_ip").alias("unique_attackers"),
            F.bool_or("lateral_movement_detected").alias("lateral_movement"),
        )
    )


def risk_summary(incidents: DataFrame, client_id: str | None = None) -> DataFrame:
    """Totals per asset; the most frequent pattern takes the smaller name on ties."""
    return (
        _tenant(incidents, client_id)
        .where(F.col("ale").isNotNull())
        .groupBy("client_id", "asset_id")
        .agg(
            F.count("*").alias("total_incidents"),
            exact_sum("ale").alias("total_ale"),
            round_to(exact_avg("aro"), 6).alias("avg_aro"),
            round_to(exact_avg("anomaly_score"), 6).alias("avg_anomaly"),
            F.max("created_us").alias("last_incident_us"),
            F.mode("pattern", True).alias("most_frequent_pattern"),
        )
    )


def latest_explanation(incidents: DataFrame, client_id: str | None = None) -> DataFrame:
    """Newest explained incident per tenant (ties: greatest id)."""
    return (
        _tenant(incidents, client_id)
        .where(F.col("explanation").isNotNull())
        .groupBy("client_id")
        .agg(F.max_by(F.struct("id", "created_us", "explanation"), F.struct("created_us", "id")).alias("x"))
        .select("client_id", "x.*")
    )


def incident_list(incidents: DataFrame, status: str = "PENDING", limit: int = 50, as_of: int | None = None,
                  client_id: str | None = None) -> DataFrame:
    """Newest incidents of one status per tenant with the derived columns."""
    now = _as_of(incidents, as_of)
    rows = _tenant(incidents, client_id).where(F.col("status") == status.upper())
    picked = first_per_key(rows, ["client_id"], [F.desc("created_us"), F.desc("id")], limit, rank_as="position")
    return derived_columns(picked, now)


def derived_columns(incidents: DataFrame, now: Column) -> DataFrame:
    """attack_still_active and attack_duration_minutes."""
    ended = F.coalesce(F.col("last_seen_us"), now)
    return incidents.withColumns({
        "attack_still_active": still_active(now),
        "attack_duration_minutes": round_to((ended - F.col("first_seen_us")) / F.lit(float(MINUTE_US)), 1),
    })


def incident_by_id(incidents: DataFrame, incident_id: int, client_id: str) -> DataFrame:
    return incidents.where((F.col("id") == incident_id) & (F.col("client_id") == client_id))


def pending_by_id(incidents: DataFrame, incident_id: int, client_id: str) -> DataFrame:
    return incident_by_id(incidents, incident_id, client_id).where(F.col("status") == "PENDING")


def asset_behavior(incidents: DataFrame, limit: int = 50, client_id: str | None = None) -> DataFrame:
    """Last ``limit`` incidents of every asset."""
    return first_per_key(_tenant(incidents, client_id), ["client_id", "asset_id"],
                         [F.desc("created_us"), F.desc("id")], limit, rank_as="position")


def _cells(incidents: DataFrame, now: Column, days: int) -> DataFrame:
    """One scan of the incidents, added up by (tenant, hour) and by (tenant, attacker, asset, criticality).

    Everything a report needs is a sum, a count, an extreme or a set of known patterns, so rows
    are folded before the shuffle and the reports below add cells up further. Sums stay
    decimals: the reports equal those computed from the incidents.
    """
    score, created = F.col("anomaly_score"), F.col("created_us")
    money = F.col("ale").cast("decimal(22,2)")

    def minutes(later: str, earlier: str) -> Column:
        return (F.col(later) - F.col(earlier)) / F.lit(float(MINUTE_US))

    near, month, week = (created >= now - F.lit(n * DAY_US) for n in (days, 30, 7))
    summary, monthly = F.col("_near"), F.col("_month")  # conditions of the reports

    def counted(condition: Column, name: str) -> Column:
        return F.count_if(condition).alias(name)

    def total(flag: Column, value: Column, name: str) -> Column:
        return F.sum(F.when(flag, value)).alias(name)

    exact = score.cast("decimal(26,6)")
    detect, review = minutes("created_us", "first_seen_us"), minutes("reviewed_us", "created_us")
    explained = F.struct("id", "created_us", "explanation")
    attacker = summary & (F.col("src_ip") != "0.0.0.0")
    rows = incidents.withColumns({"_near": near, "_month": month, "_week": week, "hour_us": floor_us("created_us", HOUR_US),
                                  "_active": still_active(now), "_late": created < now - F.lit(DAY_US)})
    return rows.groupingSets(
        [["client_id", "hour_us"], ["client_id", "src_ip", "asset_id", "clasificacion_criticidad"]],
        "client_id", "hour_us", "src_ip", "asset_id", "clasificacion_criticidad",
    ).agg(
        (F.grouping("hour_us") == 0).alias("by_hour"),
        F.count("*").alias("n"),
        # the last ``days``
        counted(summary, "near"), counted(summary & (score >= 0.8), "near_critical"),
        counted(summary & (score >= 0.5) & (score < 0.8), "near_medium"),
        total(summary, money, "near_ale"), total(summary, exact, "near_score"), F.count(F.when(summary, score)).alias("near_scored"),
        F.min(F.when(attacker, F.col("first_seen_us"))).alias("near_first"),
        F.max(F.when(attacker, F.col("last_seen_us"))).alias("near_last"),
        F.bool_or(F.when(attacker, F.col("_active"))).alias("near_active"),
        F.bool_or(F.when(attacker, F.col("lateral_movement_detected"))).alias("near_lateral"),
        # the last month
        counted(monthly, "month"), counted(monthly & (score >= 0.85), "critical"),
        counted(monthly & (score >= 0.65) & (score < 0.85), "high"), counted(monthly & (score >= 0.40) & (score < 0.65), "medium"),
        counted(monthly & (score < 0.40), "low"), total(monthly, money, "month_ale"),
        total(monthly & F.col("status").isin("PENDING", "SHADOW"), money, "open_ale"),
        counted(monthly & (F.col("status") == "PENDING") & (score >= 0.65) & F.col("_late"), "unattended"),
        total(monthly, detect.cast("decimal(26,6)"), "detect"), F.count(F.when(monthly, detect)).alias("detected"),
        total(monthly, review.cast("decimal(26,6)"), "review"), F.count(F.when(monthly, review)).alias("reviewed"),
        F.max(F.when(monthly, F.col("valor_activo_snapshot"))).alias("month_value"),
        F.max(F.when(monthly, F.col("peak_anomaly_score"))).alias("month_peak"),
        total(monthly, F.col("event_count"), "month_events"), F.max(F.when(monthly, F.col("last_seen_us"))).alias("month_last"),
        F.bool_or(F.when(monthly, F.col("_active"))).alias("month_active"),
        F.collect_set(F.when(monthly, F.col("pattern"))).alias("month_patterns"),
        F.bool_or(F.when(monthly, F.col("lateral_movement_detected"))).alias("month_lateral"),
        counted(F.col("_week"), "week"),
        F.max_by(explained, F.when(F.col("explanation").isNotNull(), F.struct("created_us", "id"))).alias("explained"),
    )


def _mean(total: str, count: str) -> Column:
    return F.sum(total).cast("double") / F.nullif(F.sum(count), F.lit(0)).cast("double")


def _money(column: str) -> Column:
    return F.coalesce(F.sum(column).cast("double"), F.lit(0.0))


def _top_cells(pairs: DataFrame, field: str, limit: int = 5) -> DataFrame:
    counts = (pairs.where(F.col(field).isNotNull() & ~F.col(field).isin(*LOOPBACK))
              .groupBy("client_id", F.col(field).alias("entity")).agg(F.sum("n").alias("incidents")))
    return first_per_key(counts, ["client_id"], [F.desc("incidents"), F.asc("entity")], limit, rank_as="position")


def dashboard(incidents: DataFrame, days: int = 7, as_of: int | None = None,
              client_id: str | None = None) -> dict[str, DataFrame]:
    """All report frames of one dashboard call, equal to the single reports.

    The incidents are scanned once into cells (grouping sets), which are written to the shared
    folder; eight frames add cells up. The timelines are incident rows: they read the rows of
    the last ``days`` once more, those of the top attackers (at most 20 a tenant).
    """
    now = _as_of(incidents, as_of)
    cells = cut_lineage(_cells(_tenant(incidents, client_id), now, days))
    hours, pairs = cells.where("by_hour"), cells.where(~F.col("by_hour"))
    mean = _mean("near_score", "near_scored")
    summary = hours.where("near > 0").groupBy("client_id").agg(
        F.sum("near").alias("total_alerts"), F.sum("near_critical").alias("critical_alerts"),
        F.sum("near_medium").alias("medium_alerts"), _money("near_ale").alias("ale_impact"),
        round_to(F.coalesce(mean, F.lit(0.0)), 6).alias("avg_confidence"))
    trends = hours.where("near > 0").groupBy("client_id", "hour_us").agg(
        F.sum("near").alias("incidents"),
        F.when(mean >= 0.8, "high").when(mean >= 0.5, "medium").otherwise("low").alias("risk_level"))
    latest = (hours.where("explained.explanation IS NOT NULL").groupBy("client_id")
              .agg(F.max_by("explained", F.struct("explained.created_us", "explained.id")).alias("x")).select("client_id", "x.*"))
    attackers = pairs.where("near > 0 AND src_ip IS NOT NULL AND src_ip != '0.0.0.0'")
    profiles = attackers.groupBy("client_id", F.col("src_ip").alias("attacker_ip")).agg(
        F.countDistinct("asset_id").alias("machines_targeted"), F.sum("near").alias("total_incidents"),
        _money("near_ale").alias("total_financial_risk"), F.min("near_first").alias("campaign_start_us"),
        F.max("near_last").alias("campaign_last_seen_us"), F.bool_or("near_active").alias("campaign_active"),
        F.bool_or("near_lateral").alias("lateral_movement_confirmed"))
    order = [F.desc("machines_targeted"), F.desc_nulls_last("total_financial_risk"), F.asc("attacker_ip")]
    profiles = first_per_key(profiles, ["client_id"], order, 20, rank_as="position")
    timelines = (_attackers(incidents, now, days, client_id).withColumnRenamed("src_ip", "attacker_ip")
                 .join(profiles.select("client_id", "attacker_ip"), ["client_id", "attacker_ip"], "left_semi")
                 .select(*TIMELINE, still_active(now).alias("still_active")))
    month = hours.where("month > 0").groupBy("client_id").agg(
        F.sum("critical").alias("critical_count"), F.sum("high").alias("high_count"), F.sum("medium").alias("medium_count"),
        F.sum("low").alias("low_count"), _money("open_ale").alias("total_active_financial_risk"),
        F.sum("unattended").alias("high_alerts_unattended_24h"), round_to(_mean("detect", "detected"), 1).alias("avg_mttd_minutes"),
        round_to(_mean("review", "reviewed"), 1).alias("avg_mttr_minutes"))
    met = pairs.where("month > 0").groupBy("client_id").agg(
        F.countDistinct(F.when(F.col("week") > 0, F.col("src_ip"))).alias("unique_attackers_7d"),
        F.countDistinct(F.when(F.col("week") > 0, F.col("asset_id"))).alias("assets_affected_7d"))
    both = month.withColumnRenamed("client_id", "_client").join(met, F.col("_client").eqNullSafe(F.col("client_id"))).drop("_client")
    assets = pairs.where("month > 0").groupBy("client_id", "asset_id", "clasificacion_criticidad").agg(
        F.sum("month").alias("total_incidents"), _money("month_ale").alias("total_ale"),
        F.coalesce(F.max("month_value"), F.lit(0.0)).alias("asset_value"), F.max("month_peak").alias("max_risk_score"),
        F.sum("month_events").alias("total_raw_events"), F.max("month_last").alias("last_attack_us"),
        F.bool_or("month_active").alias("under_attack_now"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("month_patterns")))).alias("patterns"),
        F.countDistinct("src_ip").alias("unique_attackers"), F.bool_or("month_lateral").alias("lateral_movement"))
    return {
        "summary": summary, "trends": trends, "top_attackers": _top_cells(pairs, "src_ip"), "top_assets": _top_cells(pairs, "asset_id"),
        "latest_explanation": latest, "attacker_profiles": profiles, "attacker_timelines": timelines,
        "executive_metrics": both.select("client_id", *[c for c in both.columns if c != "client_id"]), "risk_by_asset": assets,
    }
