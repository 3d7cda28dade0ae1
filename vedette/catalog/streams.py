"""Streaming queries: a file stream run over what is available, compared with the batch SQL."""

import os
import uuid

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.numeric import DAY_US
from ..operators import sweep
from ..session import shared_folder, widen
from ..sources.views import stream_view
from ..streaming import density, jobs
from .joins import shared_hashes
from .registry import query
from .risk import _GAP, _sessions
from .windows import CORR, r


def _stream(v, name):
    return stream_view(v.spark, v.sf_dir, name)


def _closed(v, job, name):
    """The windows of a stream job, those too that only a tick a day after the newest event closes."""
    clock = jobs.Clock(os.path.join(shared_folder(v.spark), f"clock-{uuid.uuid4().hex}"))
    until = v.burst_events.agg(F.max("ts_us")).first()[0] + DAY_US
    return jobs.run_to_folder(job(_stream(v, "burst_events"), clock=clock), name, clock=clock, until_us=until)


@query("stream_normalize_filter", "raw_logs", """
SELECT client_id, CASE WHEN severity_score < 0.05 THEN 'low_severity' ELSE 'approved' END AS reason, count(*) AS events FROM (
 SELECT client_id, floor(severity_score * 1000::DOUBLE + 0.5::DOUBLE) / 1000::DOUBLE AS severity_score FROM raw_logs) GROUP BY 1, 2""")
def _(v):
    base = os.path.join(shared_folder(v.spark), f"routes-{uuid.uuid4().hex}")
    s = jobs.normalize_filter(_stream(v, "raw_logs"), severity=F.col("severity_score"), received_us=F.col("ts_us"))
    jobs.write_routes(s, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return v.spark.read.parquet(f"{base}/out").groupBy("client_id", "reason").agg(F.count("*").alias("events"))


@query("stream_trend", "burst_events", f"""
SELECT client_id, ts_us // 3600000000 * 3600000000 AS hour_us, count(*) AS incidents,
 CASE WHEN CAST(sum(CAST(anomaly_score AS DECIMAL(26,6))) AS DOUBLE) / count(*) >= 0.8 THEN 'high' WHEN CAST(sum(CAST(anomaly_score AS DECIMAL(26,6))) AS DOUBLE) / count(*) >= 0.5 THEN 'medium' ELSE 'low' END AS risk_level
FROM burst_events GROUP BY 1, 2""")
def _(v):
    return _closed(v, jobs.trend, "trend")


@query("stream_incidents", "burst_events", f"""
SELECT client_id, asset_id, src_ip, pattern, event_count, first_seen_us, last_seen_us, peak_anomaly_score, anomaly_score FROM ({_sessions(False)})""")
def _(v):
    return _closed(v, jobs.sessions, "sessions")


@query("stream_incident_store", "burst_events decisions", _sessions(True))
def _(v):
    folder = os.path.join(shared_folder(v.spark), f"incidents-{uuid.uuid4().hex}")
    store = jobs.IncidentStore(folder, v.decisions)
    store.start(_stream(v, "burst_events")).awaitTermination()
    return store.table(v.spark).drop("opener_id")


@query("stream_correlate", "sec_events", f"WITH {CORR} SELECT event_id, correlation_pattern, correlation_count FROM correlated")
def _(v):
    job = jobs.correlate(v.spark)
    job.start(_stream(v, "sec_events")).awaitTermination()
    return job.results(v.spark).select("event_id", "correlation_pattern", "correlation_count")


@query("stream_dedup", "sec_events", """
SELECT client_id, raw_hash, count(DISTINCT coalesce(raw_hash, CAST(event_id AS VARCHAR))) AS kept
FROM (SELECT client_id, event_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE md5(concat('e', event_id // 8)) END AS raw_hash FROM sec_events) GROUP BY 1, 2""")
def _(v):
    kept = jobs.run_to_folder(jobs.dedup(shared_hashes(_stream(v, "sec_events"))).select("client_id", "raw_hash", "event_id"), "dedup")
    return kept.groupBy("client_id", "raw_hash").agg(F.count("*").alias("kept"))


def hst_input(events):
    return events.select("client_id", "asset_id", "event_id", "ts_us", "severity_score", F.lit(0.5).alias("asset_value"),
                         t.event_type_id("event_type").alias("event_type_id"), "command_risk",
                         t.numeric_feature("numeric_value").alias("numeric_anomaly"), "danger_score",
                         F.lit(None).cast("string").alias("control"))


@query("stream_hst", "", None)
def _(v):
    return jobs.run_to_folder(density.stream_hst(hst_input(_stream(v, "sec_events"))), "density")


@query("stream_ingest", "", None)
def _(v):
    events = sweep.correlate(widen(v.sec_events)).withColumn("dst_port", F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 1000).cast("int")))
    base = os.path.join(shared_folder(v.spark), f"ingest-{uuid.uuid4().hex}")
    cut = v.sec_events.agg(F.percentile_approx("ts_us", 0.6)).scalar()  # two files, two micro-batches
    parts = events.withColumn("part", (F.col("ts_us") > cut).cast("int")).persist()
    for part in (0, 1):
        parts.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{base}/in/{part}")
    parts.unpersist()
    stream = (v.spark.readStream.schema(events.schema).option("recursiveFileLookup", "true")
              .option("maxFilesPerTrigger", len(v.spark.read.parquet(f"{base}/in/0").inputFiles())).parquet(f"{base}/in"))
    job = jobs.Ingest(f"{base}/job", window=100)
    job.start(stream).awaitTermination()
    return job.results(v.spark).select("event_id", "client_id", "river_score", "river_warmup", "is_anomaly", "nmap_score", "combined_score", "via", "route")


@query("stream_port_scan", "port_events", """
SELECT event_id, CASE WHEN n >= 5 THEN n ELSE 0 END AS rate_per_min FROM (SELECT event_id, CAST(count(*) OVER (PARTITION BY src_ip ORDER BY ts_us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS DOUBLE) AS n FROM port_events)""")
def _(v):
    job = jobs.port_scan(v.spark)
    job.start(_stream(v, "port_events")).awaitTermination()
    return job.results(v.spark).select("event_id", "rate_per_min")


@query("stream_enrich", "sec_events intel assets", """
SELECT e.event_id, (SELECT min(id) FROM assets a WHERE a.client_id = e.client_id AND a.hostname = e.asset_id) AS asset_row FROM sec_events e""")
def _(v):
    s = jobs.enrich(_stream(v, "sec_events"), v.assets, v.intel)
    return jobs.run_to_folder(s.select("event_id", F.col("asset.id").alias("asset_row")), "enrich")


@query("queue_source", "sec_events", "SELECT client_id, count(*) AS events FROM sec_events GROUP BY 1")
def _(v):
    from ..sources.raw import queue_stream

    base = os.path.join(shared_folder(v.spark), f"queue-{uuid.uuid4().hex}")
    v.sec_events.select(F.to_json(F.struct("event_id", "client_id", "ts_us")).alias("value")).write.text(f"{base}/in")
    s = queue_stream(v.spark, f"{base}/in", "event_id long, client_id string, ts_us long")
    return jobs.run_to_folder(s, "queue").groupBy("client_id").agg(F.count("*").alias("events"))
