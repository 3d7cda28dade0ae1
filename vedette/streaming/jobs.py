"""Streaming twins of the batch operators.

Event time throughout. Late rows (older than the watermark or the kept history) are
dropped; the windowed jobs write them aside so that they can be counted.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.numeric import exact_avg
from .. import rules
from ..operators import detector, filters, incidents as inc, joins, sweep
from ..plans import pipeline
from ..plans.normalize import normalize_events
from ..session import drop_folder, make_folder, newest_number, shared_folder

DELAY = "6 minutes"
#: Before any event, in the years that timestamps reach.
NEVER_US = -(2**55)


def event_time(stream: DataFrame, ts: str = "ts_us", delay: str = DELAY) -> DataFrame:
    return stream.withColumn("ts", F.timestamp_micros(ts)).withWatermark("ts", delay)


class Clock:
    """Control rows that move the watermark of a stream whose source is idle, so that its last windows close.

    ``joined`` puts the control rows of a folder beside the events, before the watermark;
    ``tick`` writes one: no event older than its time less the stream's delay is awaited any
    more. A scheduler ticks while the source is quiet; late events are dropped as usual. The
    rows take part in the watermark only and leave right after it.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def joined(self, stream: DataFrame, ts: str = "ts_us", delay: str = DELAY) -> DataFrame:
        """The events with their watermark, moved by ticks as well; for use in place of ``event_time``."""
        spark = stream.sparkSession
        make_folder(spark, self.folder)
        ticks = spark.readStream.schema("tick_us long").parquet(self.folder).select(
            F.col("tick_us").alias(ts), F.lit(True).alias("_tick"))
        # a batch without ticks, or with nothing else, must have the column types of every other one: all nullable
        events = stream.withColumns({ts: F.when(F.col(ts) > NEVER_US, F.col(ts)), "_tick": F.lit(False)})
        both = event_time(events.unionByName(ticks, allowMissingColumns=True), ts, delay)
        # names the event time, or the optimizer would drop the ticks before the watermark sees them
        never = F.timestamp_micros(F.lit(NEVER_US))
        both = both.where(~F.col("_tick") | (F.col("ts") < never))
        return both.select(*[F.when(F.col("ts") > never, F.col(c)).alias(c) for c in stream.columns if c != "ts"], "ts")

    def tick(self, spark: SparkSession, until_us: int) -> None:
        spark.range(1).select(F.lit(until_us).alias("tick_us")).coalesce(1).write.mode("append").parquet(self.folder)


def normalize_filter(stream: DataFrame, **columns) -> DataFrame:
    """Stateless: canonical events with ``passed``, ``reason``."""
    return filters.siem_noise_filter(normalize_events(stream, **columns))


def write_routes(stream: DataFrame, target: str, checkpoint: str, split: str = "passed") -> StreamingQuery:
    """Two outputs from one pass per batch: ``target/<split>=true|false/batch=<id>``.

    A batch that runs again overwrites its own folders.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        flag = F.coalesce(F.col(split), F.lit(False))
        batch.withColumn("_side", flag).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("_side", "batch").parquet(target)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _timed(stream: DataFrame, clock: Clock | None) -> DataFrame:
    return event_time(stream) if clock is None else clock.joined(stream)


def trend(stream: DataFrame, width: str = "1 hour", clock: Clock | None = None) -> DataFrame:
    """Count and risk level per tenant and hour (append: an hour appears once it is closed, by a later event or a tick)."""
    mean = exact_avg("anomaly_score")
    return (
        _timed(stream, clock).groupBy("client_id", F.window("ts", width).alias("w"))
        .agg(F.count("*").alias("incidents"),
             F.when(mean >= 0.8, "high").when(mean >= 0.5, "medium").otherwise("low").alias("risk_level"))
        .select("client_id", F.unix_micros("w.start").alias("hour_us"), "incidents", "risk_level")
    )


def sessions(stream: DataFrame, gaps=None, clock: Clock | None = None) -> DataFrame:
    """Incidents as session windows with the gap of their pattern (append: once closed, by a later event or a tick).

    A reviewed incident is not closed here; the store merge applies decisions.
    """
    gap = F.concat(inc.gap_minutes("pattern", gaps).cast("string"), F.lit(" minutes"))
    at = F.struct("ts_us", "event_id")
    return (
        _timed(stream, clock).groupBy(*inc.KEY, F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("event_count"), F.min("ts_us").alias("first_seen_us"), F.max("ts_us").alias("last_seen_us"),
             F.max("anomaly_score").alias("peak_anomaly_score"), F.max_by("anomaly_score", at).alias("anomaly_score"))
        .drop("w")
    )


def dedup(stream: DataFrame, key: str = "raw_hash", delay: str = "1 hour") -> DataFrame:
    """First arrival of each tenant's hash within the delay; events without a hash all pass."""
    own = F.coalesce(key, F.concat(F.lit("row:"), F.col("event_id").cast("string")))
    return event_time(stream, delay=delay).withColumn("_key", own).dropDuplicatesWithinWatermark(
        ["client_id", "_key"]).drop("_key")


def enrich(stream: DataFrame, assets: DataFrame, intel: DataFrame) -> DataFrame:
    """Stream-static joins with threat intelligence and the inventory."""
    return joins.match_asset(joins.threat_intel_enrich(stream, intel), assets, hostname="asset_id")


def run_to_folder(stream: DataFrame, name: str, mode: str = "append", clock: Clock | None = None,
                  until_us: int | None = None) -> DataFrame:
    """Runs a stream over what is available now into Parquet and returns that as a table.

    With a clock, the source counts as idle after that: a tick to ``until_us`` is written and
    the query goes on from its checkpoint, so that windows up to there close as well.
    """
    spark = stream.sparkSession
    base = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")

    def run() -> None:
        (stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start(f"{base}/out").awaitTermination())

    run()
    if clock is not None:
        clock.tick(spark, until_us)
        run()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


class Windowed:
    """A batch window operator applied to each micro-batch with the history it needs.

    A row may come up to ``lateness_us`` after a newer one; older ones are set aside in
    ``late``. The history, a small table written per batch in the shared folder, reaches
    back by horizon and lateness, so an accepted late row sees its whole window, and the
    rows after it, whose windows it entered, are computed and written again; ``results``
    takes each row's last version. The operator itself cuts hot keys by time, which a
    keyed state store cannot: there one key lives in one task. Every folder is named by
    its batch, so a batch that runs again after a failure overwrites what it left.
    """

    def __init__(self, op: Callable[[DataFrame], DataFrame], horizon_us: int, folder: str, ts: str = "ts_us",
                 lateness_us: int | None = None, row_id: str = "event_id"):
        self.op, self.horizon_us, self.folder, self.ts, self.row_id = op, horizon_us, folder, ts, row_id
        self.lateness_us = horizon_us if lateness_us is None else lateness_us

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()  # read by the late, result and history outputs
        new, at = batch.withColumn("_new", F.lit(True)), F.col(self.ts)
        if batch_id > 0:
            old = spark.read.parquet(f"{self.folder}/history/{batch_id - 1}").withColumn("_new", F.lit(False))
            newest = old.agg(F.max(self.ts)).first()[0]
            floor = -(2**62) if newest is None else newest - self.lateness_us
            new.where(at < floor).drop("_new").write.mode("overwrite").parquet(f"{self.folder}/late/batch={batch_id}")
            new = new.where(at >= floor)
            both = old.unionByName(new)
        else:
            both = new
        since = new.agg(F.min(self.ts)).first()[0]
        again = F.col("_new") | (at >= since) if since is not None else F.col("_new")
        self.op(both).where(again).drop("_new").write.mode("overwrite").parquet(f"{self.folder}/out/batch={batch_id}")
        newest = both.agg(F.max(self.ts)).scalar()
        both.where(at >= newest - F.lit(self.horizon_us + self.lateness_us)).drop("_new").write.mode("overwrite").parquet(
            f"{self.folder}/history/{batch_id}")
        drop_folder(spark, f"{self.folder}/history/{batch_id - 2}")
        batch.unpersist()

    def start(self, stream: DataFrame) -> StreamingQuery:
        return (stream.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.folder}/checkpoint")
                .trigger(availableNow=True).start())

    def results(self, spark: SparkSession) -> DataFrame:
        """Each row once, as the last batch that wrote it left it."""
        rows = spark.read.parquet(f"{self.folder}/out")
        last = rows.groupBy(self.row_id).agg(F.max("batch").alias("batch"))
        return rows.join(last, [self.row_id, "batch"], "left_semi").drop("batch")


def correlate(spark: SparkSession, folder: str | None = None) -> Windowed:
    """Attack patterns on a stream, six minutes of history."""
    return Windowed(sweep.correlate, 360_000_000, folder or os.path.join(shared_folder(spark), f"correlate-{uuid.uuid4().hex}"))


def port_scan(spark: SparkSession, folder: str | None = None) -> Windowed:
    """Port-scan scores on a stream, one minute of history."""
    return Windowed(sweep.port_scan_score, 60_000_000, folder or os.path.join(shared_folder(spark), f"ports-{uuid.uuid4().hex}"))


class IncidentStore:
    """Incidents on a stream with inclusive gaps and review decisions.

    Open incidents (seen within the longest gap) are rewritten per batch; the others are
    appended to ``closed`` once. The open table is bounded by that gap, not by history.
    """

    def __init__(self, folder: str, reviews: DataFrame | None = None, gaps=None):
        self.folder, self.reviews, self.gaps = folder, reviews, gaps

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        found = inc.consolidate(batch, self.reviews, self.gaps)
        if batch_id > 0:
            found = inc.merge_incidents(spark.read.parquet(f"{self.folder}/open/{batch_id - 1}"), found, self.reviews, self.gaps)
        _, longest = inc._gap(self.gaps or inc.rules.CONSOLIDATION_MINUTES)
        found = found.persist()  # split into the open and the closed output
        seen = batch.agg(F.max("ts_us")).scalar()
        is_open = F.coalesce(F.col("last_seen_us") >= seen - F.lit(longest), F.lit(True))
        found.where(is_open).write.mode("overwrite").parquet(f"{self.folder}/open/{batch_id}")
        found.where(~is_open).write.mode("overwrite").parquet(f"{self.folder}/closed/batch={batch_id}")
        drop_folder(spark, f"{self.folder}/open/{batch_id - 2}")
        found.unpersist()
        batch.unpersist()

    def start(self, stream: DataFrame) -> StreamingQuery:
        return (stream.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.folder}/checkpoint")
                .trigger(availableNow=True).start())

    def table(self, spark: SparkSession) -> DataFrame:
        now_open = spark.read.parquet(f"{self.folder}/open/{newest_number(spark, f'{self.folder}/open')}")
        closed = spark.read.schema(now_open.schema).parquet(f"{self.folder}/closed").select(*now_open.columns)
        return closed.unionByName(now_open)


class Ingest:
    """Density, port scan, flags, escalation and route on a stream of correlated events.

    Each micro-batch is scored after the state that the one before it left (see
    ``detector``) with the batch operators, which cut a hot asset into blocks and time chunks,
    so no key lives in one task. Output and state are named by batch: one that runs again
    after a failure starts from the same state and overwrites what it left. Events are taken in
    order of their batches; within ``lateness_us`` an older one still finds its windows.
    """

    def __init__(self, folder: str, window: int = rules.HST_WINDOW, lateness_us: int = 0):
        self.folder, self.window, self.lateness_us = folder, window, lateness_us

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        state = detector.load(spark, f"{self.folder}/state", batch_id)
        out, state = pipeline.ingest_after(batch, state, self.window, self.lateness_us)
        out.write.mode("overwrite").parquet(f"{self.folder}/out/batch={batch_id}")
        detector.save(state, f"{self.folder}/state", batch_id)
        drop_folder(spark, f"{self.folder}/state/{batch_id - 2}")
        batch.unpersist()

    def start(self, stream: DataFrame) -> StreamingQuery:
        return (stream.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.folder}/checkpoint")
                .trigger(availableNow=True).start())

    def results(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/out").drop("batch")
