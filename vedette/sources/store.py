"""Feature store, incident store and report store on Parquet."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.numeric import DAY_US, HOUR_US
from ..functions.text import asset_value_norm
from ..session import drop_folder, names_in

DATE = "created_date"


def _date(us: str | Column) -> Column:
    c = F.col(us) if isinstance(us, str) else us
    return F.to_date(F.timestamp_micros(c))


KEY = ("client_id", "row_key")


def feature_rows(events: DataFrame) -> DataFrame:
    """Store rows with ``row_key``: one per tenant and hash (else event), the earliest; asset value in [0, 1], day column."""
    rows = events.withColumn("asset_value", asset_value_norm("asset_value")) if "asset_value" in events.columns else events
    rows = rows.withColumn("row_key", F.coalesce("raw_hash", F.concat(F.lit("row:"), F.col("event_id").cast("string"))))
    first = rows.groupBy(*KEY).agg(F.min(F.struct("ts_us", "event_id")).alias("_first"))
    first = first.select(*KEY, F.col("_first.event_id").alias("event_id"), F.col("_first.ts_us").alias("ts_us"))
    kept = rows.join(first, [*KEY, "event_id", "ts_us"], "left_semi").dropDuplicates([*KEY])
    return kept.withColumn(DATE, _date("ts_us"))


def sink_features(events: DataFrame, path: str) -> None:
    """Appends events whose (tenant, ``row_key``) the store does not hold yet, partitioned by day.

    A redelivered event adds nothing, whatever its hash, day or order of arrival: keys are
    looked up over all days, which reads two narrow columns.
    """
    spark = events.sparkSession
    rows = feature_rows(events)
    try:
        stored = spark.read.parquet(path)
    except Exception as exc:  # first write: there is no store yet
        if "PATH_NOT_FOUND" not in str(exc) and "UNABLE_TO_INFER" not in str(exc):
            raise
        stored = None
    if stored is not None:
        rows = rows.join(stored.select(*KEY), [*KEY], "left_anti")
    rows.write.mode("append").partitionBy(DATE).parquet(path)


def scan_features(store: DataFrame, client_id: str | None = None, since_us: int | Column | None = None,
                  until_us: int | Column | None = None) -> DataFrame:
    """Tenant and time range scan. The day predicate prunes partitions, the rest is pushed to Parquet."""
    out = store if client_id is None else store.where(F.col("client_id") == client_id)
    for bound, test in ((since_us, "ge"), (until_us, "lt")):
        if bound is None:
            continue
        b = F.lit(bound) if isinstance(bound, int) else bound
        out = out.where(F.col("ts_us") >= b) if test == "ge" else out.where(F.col("ts_us") < b)
        if DATE in store.columns:
            out = out.where(F.col(DATE) >= _date(b)) if test == "ge" else out.where(F.col(DATE) <= _date(b))
    return out


def retention(store: DataFrame, as_of: int | Column, days: int = 90, ts: str = "ts_us") -> DataFrame:
    """Rows inside the window; write the result to replace the store."""
    now = F.lit(as_of) if isinstance(as_of, int) else as_of
    kept = store.where(F.col(ts) >= now - F.lit(days * DAY_US))
    return kept.where(F.col(DATE) >= _date(now - F.lit(days * DAY_US))) if DATE in store.columns else kept


def drop_expired_days(spark: SparkSession, path: str, as_of_us: int, days: int = 90) -> list[str]:
    """Deletes the day folders of a store that lie wholly outside the window; returns their names."""
    first = datetime.fromtimestamp((as_of_us - days * DAY_US) / 1e6, UTC).date().isoformat()
    gone = sorted(n for n in names_in(spark, path) if n.startswith(f"{DATE}=") and n.removeprefix(f"{DATE}=") < first)
    for name in gone:
        drop_folder(spark, f"{path}/{name}")
    return gone


def expire_reports(reports: DataFrame, as_of: int | Column, hours: int = 24) -> DataFrame:
    now = F.lit(as_of) if isinstance(as_of, int) else as_of
    return reports.where(F.col("created_us") > now - F.lit(hours * HOUR_US))
