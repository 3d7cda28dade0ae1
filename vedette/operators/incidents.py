"""Incident consolidation: gaps and islands over keys of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import rules
from ..functions.numeric import MINUTE_US, div_us
from ..functions.text import by_key

KEY = ["client_id", "asset_id", "src_ip", "pattern"]
LATEST = ("anomaly_score", "river_score", "nmap_score", "combined_score")


def gap_minutes(pattern: str | Column, table=None) -> Column:
    return by_key(pattern, table or rules.CONSOLIDATION_MINUTES, rules.CONSOLIDATION_DEFAULT_MINUTES)


def _islands(rows: DataFrame, keys: Sequence[str], gap: Column) -> DataFrame:
    """Numbers the islands within ``keys``.

    Rows have _start, _end (NULL for a review decision) and _tie. A new island starts
    where the gap is exceeded or a decision lies in between; a decision comes before an
    event of the same time.
    """
    w = Window.partitionBy(*keys).orderBy("_start", "_side", "_tie")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.withColumns({
        "_prev_end": F.last("_end", ignorenulls=True).over(past),
        "_marks": F.sum(F.when(F.col("_side") == 0, 1).otherwise(0)).over(upto),
    }).withColumn("_prev_marks", F.last(F.when(F.col("_side") == 1, F.col("_marks")), ignorenulls=True).over(past))
    opens = F.col("_prev_end").isNull() | (F.col("_start") - F.col("_prev_end") > gap) | (
        F.col("_marks") != F.col("_prev_marks"))
    return (
        marked.withColumn("_island", F.sum(F.when((F.col("_side") == 1) & opens, 1).otherwise(0)).over(upto))
        .where("_side = 1").drop("_prev_end", "_marks", "_prev_marks", "_side")
    )


def consolidate(events: DataFrame, reviews: DataFrame | None = None, gaps=None) -> DataFrame:
    """One row per incident of (client, asset, src_ip, pattern).

    Events chain while the gap is at most the pattern's window; a review decision
    (client_id, asset_id, src_ip, pattern, reviewed_us) closes the incident.

    Two levels keep a hot key out of one task: islands are found per (key, time chunk)
    and folded to one row each, then the folded rows are joined up per key. Folded rows
    of one key are at least a chunk or a gap apart, so their number is bounded by the
    time span, not by the events.
    """
    table = gaps or rules.CONSOLIDATION_MINUTES
    at = [F.col("ts_us"), F.col("event_id")]

    def have(c: str) -> Column:
        return F.col(c).cast("double") if c in events.columns else F.lit(0.0)

    def first_nonzero(c: str) -> Column:
        return F.when(have(c) != 0, F.struct(*at, have(c).alias("x")))

    rows = events.select(
        *KEY, F.lit(1).alias("_side"), F.col("ts_us").alias("_start"), F.col("ts_us").alias("_end"),
        F.col("event_id").alias("_tie"),
        F.struct(*at, F.col("event_type"), F.col("raw_hash")).alias("opener"),
        F.struct(*at, *[have(c).alias(c) for c in LATEST]).alias("latest"),
        have("anomaly_score").alias("peak"), first_nonzero("aro").alias("aro"), first_nonzero("ale").alias("ale"))
    marks = _marks(reviews)
    gap, chunk_us = _gap(table)
    local = _islands(_with(rows, marks).withColumn("_chunk", div_us("_start", chunk_us)), [*KEY, "_chunk"], gap)
    folded = _fold(local, [*KEY, "_chunk"], F.lit(1).cast("bigint")).drop("_island", "_chunk").withColumn("_side", F.lit(1))
    return _finish(_fold(_islands(_with(folded, marks), KEY, gap), KEY, F.col("n")))


def _gap(table) -> tuple[Column, int]:
    longest = max([*table.values(), rules.CONSOLIDATION_DEFAULT_MINUTES]) * MINUTE_US
    return gap_minutes("pattern", table).cast("bigint") * F.lit(MINUTE_US), longest


def _marks(reviews: DataFrame | None) -> DataFrame | None:
    if reviews is None:
        return None
    return reviews.select(*KEY, F.lit(0).alias("_side"), F.col("reviewed_us").alias("_start"),
                          F.lit(0).cast("bigint").alias("_tie"))


def _with(rows: DataFrame, marks: DataFrame | None) -> DataFrame:
    return rows if marks is None else rows.unionByName(marks, allowMissingColumns=True)


def _fold(df: DataFrame, keys: Sequence[str], n: Column) -> DataFrame:
    return df.groupBy(*keys, "_island").agg(
        F.min("_start").alias("_start"), F.max("_end").alias("_end"), F.min("_tie").alias("_tie"),
        F.min("opener").alias("opener"), F.max("latest").alias("latest"), F.max("peak").alias("peak"),
        F.min("aro").alias("aro"), F.min("ale").alias("ale"), F.sum(n).alias("n"))


def _finish(whole: DataFrame) -> DataFrame:
    return whole.select(
        F.sha2(F.concat_ws("|", *[F.coalesce(k, F.lit("")) for k in KEY], F.col("_start").cast("string"),
                           F.col("opener.event_id").cast("string")), 256).alias("incident_id"),
        *KEY, F.col("opener.event_id").alias("opener_id"), F.col("opener.event_type").alias("event_type"),
        F.col("opener.raw_hash").alias("raw_hash"), F.col("n").alias("event_count"),
        F.col("_start").alias("first_seen_us"), F.col("_end").alias("last_seen_us"),
        F.col("peak").alias("peak_anomaly_score"), *[F.col(f"latest.{c}").alias(c) for c in LATEST],
        F.coalesce("aro.x", F.lit(0.0)).alias("aro"), F.coalesce("ale.x", F.lit(0.0)).alias("ale"))


def merge_incidents(stored: DataFrame, new: DataFrame, reviews: DataFrame | None = None, gaps=None) -> DataFrame:
    """Joins newly found incidents to stored open ones of the same key within the gap.

    Both are incident rows already, so their number per key is bounded by the time span.
    """
    first, last = F.col("first_seen_us"), F.col("last_seen_us")

    def rows(df: DataFrame) -> DataFrame:
        def money(c: str) -> Column:
            return F.when(F.col(c) != 0, F.struct(first.alias("ts_us"), F.col("opener_id").alias("event_id"), F.col(c).alias("x"))).alias(c)

        return df.select(
            *KEY, F.lit(1).alias("_side"), first.alias("_start"), last.alias("_end"), F.col("opener_id").alias("_tie"),
            F.struct(first.alias("ts_us"), F.col("opener_id").alias("event_id"), "event_type", "raw_hash").alias("opener"),
            F.struct(last.alias("ts_us"), F.col("opener_id").alias("event_id"), *LATEST).alias("latest"),
            F.col("peak_anomaly_score").alias("peak"), money("aro"), money("ale"), F.col("event_count").alias("n"))

    gap, _ = _gap(gaps or rules.CONSOLIDATION_MINUTES)
    both = _with(rows(stored).unionByName(rows(new)), _marks(reviews))
    return _finish(_fold(_islands(both, KEY, gap), KEY, F.col("n")))


def _last_review(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("id").agg(
        F.max_by(F.struct("action", "note", "reviewed_us"), F.struct("reviewed_us", "action")).alias("_r"))


def review_audit(incidents: DataFrame, reviews: DataFrame) -> DataFrame:
    """Audit records (to be chained) of the decisions that take effect."""
    return (
        incidents.where("status = 'PENDING'").join(_last_review(reviews), "id")
        .select(F.col("id").cast("string").alias("entity_id"), F.col("client_id").alias("actor"),
                F.concat(F.lit("RECOMMENDATION_"), F.col("_r.action")).alias("event_type"),
                F.to_json(F.struct("_r.action", "_r.note")).alias("payload"), F.col("_r.reviewed_us").alias("reviewed_us"))
    )


def review_incidents(incidents: DataFrame, reviews: DataFrame) -> DataFrame:
    """Applies decisions (id, action, note, reviewed_us) to PENDING incidents; the newest decision wins."""
    last = _last_review(reviews)
    hit = (F.col("status") == "PENDING") & F.col("_r").isNotNull()
    return incidents.join(last, "id", "left").withColumns({
        "review_note": F.when(hit, F.col("_r.note")),
        "reviewed_us": F.when(hit, F.col("_r.reviewed_us")).otherwise(F.col("reviewed_us")),
        "status": F.when(hit, F.col("_r.action")).otherwise(F.col("status")),
    }).drop("_r")
