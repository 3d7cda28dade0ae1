"""Streams in several micro-batches against their batch twins."""

from pyspark.sql import functions as F

from vedette.functions.numeric import US
from vedette.operators import incidents, sweep
from vedette.streaming import density, jobs

from test_models import hst_events
from test_windows import SCHEMA, as_tuples, incident_rows, INC, make, sessions_by_hand


def files(df, folder, parts=4, ts="ts_us"):
    """One file per time slice, in order."""
    edges = [r[0] for r in df.select(ts).orderBy(ts).collect()]
    cuts = [edges[len(edges) * i // parts] for i in range(1, parts)] + [edges[-1] + 1]
    low = edges[0]
    for i, high in enumerate(cuts):
        df.where((F.col(ts) >= low) & (F.col(ts) < high)).coalesce(1).write.mode("append").parquet(f"{folder}/s{i}")
        low = high
    reader = df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    return reader.parquet(str(folder))


def test_correlate_over_batches(spark, tmp_path):
    df = spark.createDataFrame(make(400), SCHEMA)
    job = jobs.correlate(spark, str(tmp_path / "job"))
    job.start(files(df, tmp_path / "in")).awaitTermination()
    got = job.results(spark).select(*sweep.correlate(df).columns)
    assert len(list((tmp_path / "job" / "history").glob("[0-9]*"))) == 2  # older ones are gone
    assert got.exceptAll(sweep.correlate(df)).count() == 0 and got.count() == 400


def test_port_scan_over_batches(spark, tmp_path):
    df = spark.createDataFrame([r for r in make(300, span=300) if r[4]], SCHEMA)
    job = jobs.port_scan(spark, str(tmp_path / "job"))
    job.start(files(df, tmp_path / "in")).awaitTermination()
    want = sweep.port_scan_score(df)
    assert job.results(spark).select(*want.columns).exceptAll(want).count() == 0


def test_incidents_over_batches(spark, tmp_path):
    rows = incident_rows()
    store = jobs.IncidentStore(str(tmp_path / "store"))
    store.start(files(spark.createDataFrame(rows, INC), tmp_path / "in")).awaitTermination()
    assert as_tuples(store.table(spark)) == sessions_by_hand(rows)
    again = jobs.IncidentStore(str(tmp_path / "store"))  # as after a restart
    assert as_tuples(again.table(spark)) == sessions_by_hand(rows)


def test_late_rows_within_the_lateness_change_what_came_before(spark, tmp_path):
    rows = sorted(make(300), key=lambda r: r[1])
    df = spark.createDataFrame(rows, SCHEMA)
    job = jobs.correlate(spark, str(tmp_path / "job"))
    early, late = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    job.lateness_us = 10**12
    for k, part in enumerate((early[:100], late[:40], early[100:], late[40:])):
        job(spark.createDataFrame(part, SCHEMA), k)
    want = sweep.correlate(df)
    got = job.results(spark).select(*want.columns)
    assert got.count() == 300 and got.exceptAll(want).count() == 0


def test_late_rows_are_set_aside(spark, tmp_path):
    job = jobs.correlate(spark, str(tmp_path / "job"))
    job(spark.createDataFrame([(1, 1000 * US, "c", "s", "a", "x", 0.1, "h", 1)], SCHEMA), 0)
    job(spark.createDataFrame([(2, 100 * US, "c", "s", "a", "x", 0.1, "h", 1), (3, 1001 * US, "c", "s", "a", "x", 0.1, "h", 1)], SCHEMA), 1)
    assert {r["event_id"] for r in job.results(spark).collect()} == {1, 3}
    assert spark.read.parquet(str(tmp_path / "job" / "late")).count() == 1


def test_density_over_batches_equals_batch(spark, tmp_path):
    from vedette.operators import hst
    from vedette.operators.features import temporal_features
    df = hst_events(spark)
    got = jobs.run_to_folder(density.stream_hst(files(df, tmp_path / "in", 3)), "density")
    want = hst.half_space_trees(temporal_features(df)).select("event_id", "seq", F.col("raw_score").alias("raw"), F.col("river_warmup").alias("w"))
    both = got.join(want.withColumnRenamed("seq", "seq2"), "event_id")
    assert both.count() == 2600
    assert both.where("seq <> seq2 or w <> river_warmup or abs(raw - raw_score) > 1e-9").count() == 0


def test_reset_clears_a_key(spark, tmp_path):
    df = hst_events(spark, 100)
    reset = df.where("event_id = 60").withColumns({"event_id": F.lit(1000).cast("long"), "control": F.lit("reset"), "asset_id": F.lit("hot")})
    got = jobs.run_to_folder(density.stream_hst(files(df.unionByName(reset), tmp_path / "in", 1)), "density")
    assert got.where("asset_id = 'hot' and event_id = 61").first()["seq"] == 1


def test_sessions_close_by_watermark(spark, tmp_path):
    rows = incident_rows(200)
    df = spark.createDataFrame(rows, INC)
    got = jobs.run_to_folder(jobs.sessions(files(df, tmp_path / "in")), "sessions")
    assert set(as_tuples(got)) <= set(as_tuples(incidents.consolidate(df))) and got.count() > 0


def test_feature_store(spark, tmp_path):
    from vedette.sources import store
    df = spark.createDataFrame(make(50), SCHEMA).withColumn("asset_value", F.lit(50000.0))
    path = str(tmp_path / "features")
    store.sink_features(df, path)
    store.sink_features(df, path)
    assert spark.read.parquet(path).count() == 50
    assert store.scan_features(spark.read.parquet(path), "c0", 10 * US, 2000 * US).where("asset_value <> 0.5 or client_id <> 'c0'").count() == 0


def test_ticks_close_the_windows_of_an_idle_source(spark, tmp_path):
    rows = incident_rows()
    df = spark.createDataFrame(rows, INC)
    newest = max(r["ts_us"] for r in rows)
    for name, job in (("trend", jobs.trend), ("sessions", jobs.sessions)):
        clock = jobs.Clock(str(tmp_path / name / "clock"))
        source = files(df, tmp_path / name / "in")
        open_ = jobs.run_to_folder(job(source), name)  # without a clock the last windows stay open
        out = jobs.run_to_folder(job(source, clock=clock), name, clock=clock, until_us=newest + 2 * 86_400 * US)
        if name == "trend":
            want = df.groupBy("client_id", (F.col("ts_us") - F.col("ts_us") % (3600 * US)).alias("hour_us")).agg(F.count("*").alias("incidents"))
            got = out.select(want.columns)
            assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
        assert out.count() > open_.count()
        assert out.agg(F.sum("incidents" if name == "trend" else "event_count")).first()[0] == len(rows)


def test_a_tick_makes_older_events_late(spark, tmp_path):
    schema = "ts_us long, client_id string, anomaly_score double"
    at = 1_700_000_000 * US // (3600 * US) * (3600 * US)
    clock, folder = jobs.Clock(str(tmp_path / "clock")), str(tmp_path / "in")

    def events(*times):
        spark.createDataFrame([(at + t * US, "a", 0.9) for t in times], schema).coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = spark.readStream.schema(schema).parquet(folder)
        (jobs.trend(stream, clock=clock).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
         .trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination())
        return sorted((r["hour_us"] - at, r["incidents"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    events(10, 20)
    assert run() == []
    clock.tick(spark, at + 3900 * US)  # the delay of six minutes is not over yet
    assert run() == []
    events(30)
    assert run() == []
    clock.tick(spark, at + 3960 * US)
    assert run() == [(0, 3)]
    events(40, 3700)  # the first is late, the second opens the next hour
    assert run() == [(0, 3)]
    clock.tick(spark, at + 9000 * US)
    assert run() == [(0, 3), (3600 * US, 1)]
