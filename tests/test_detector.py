"""Batches in a row against one joint batch."""

import numpy as np
from pyspark.sql import functions as F

from vedette.operators import detector, sweep
from vedette.plans import pipeline
from vedette.streaming import jobs

from test_streaming import files

US = 1_000_000


def events(spark, n=1_500):
    r = np.random.default_rng(5)
    t, rows = 0, []
    for i in range(n):
        t += int(r.choice([0, 1, 5, 70, 4_000], p=[0.2, 0.3, 0.4, 0.09, 0.01])) * US
        asset = f"a{int(r.integers(0, 3))}" if i % 3 else "hot"
        rows.append((i, t, "" if i % 211 == 0 else f"c{i % 2}", f"10.0.0.{int(r.integers(0, 4))}" if i % 7 else None, asset,
                     str(r.choice(["login", "scan", "failed password"])), float(r.random()), float(r.random()) / 2, float(r.random()),
                     0.95 if i % 17 == 0 else 0.3, int(r.integers(1, 400)) if i % 3 else None, i % 9 == 0))
    return sweep.correlate(spark.createDataFrame(rows, "event_id long, ts_us long, client_id string, src_ip string, asset_id string, event_type string, "
                                       "severity_score double, command_risk double, numeric_anomaly double, danger_score double, dst_port int, "
                                       "is_outbound boolean")).persist()


def answers(df):
    names = ["event_id", "river_score", "river_warmup", "is_anomaly", "nmap_score", "combined_score", "via", "route"]
    return {r["event_id"]: tuple(r) for r in df.select(*names).collect()}


def test_batches_in_a_row_score_as_one(spark, tmp_path):
    e, path, got = events(spark), str(tmp_path / "state"), {}
    joint = answers(pipeline.ingest_batch(e, window=100))
    assert len({x[1] for x in joint.values()}) > 200
    for batch, (a, b) in enumerate([(0, 400), (400, 401), (401, 900), (900, 900), (900, 1_500)]):
        part = e.where((F.col("event_id") >= a) & (F.col("event_id") < b))
        for _ in range(2 if batch == 2 else 1):  # delivered twice
            out, state = pipeline.ingest_after(part, detector.load(spark, path, batch), window=100)
            got |= answers(out)
            detector.save(state, path, batch)
    assert got == joint
    last = detector.load(spark, path, 99)
    assert last.total.first()[0] == len(joint) == last.counters.agg(F.sum("seen")).first()[0]
    held = last.learned.groupBy(*detector.KEYS).agg(F.sum("_weight").alias("n"))
    assert held.where("n >= 203").count() == 0 and last.recent.count() < 200


def test_a_broken_state_is_passed_over(spark, tmp_path):
    path = str(tmp_path / "state")
    assert detector.load(spark, path, 3).total.count() == 0
    state = detector.empty(spark)
    detector.save(detector.State(state.counters, state.learned, state.recent, spark.createDataFrame([(7,)], "events bigint")), path, 1)
    state.counters.write.parquet(f"{path}/2/counters")  # stopped half-way
    assert detector.load(spark, path, 3).total.first()[0] == 7
    both = detector.merged(detector.load(spark, path, 3), detector.load(spark, path, 3))
    assert both.total.first()[0] == 14


def test_stream_routes_as_the_batch_does(spark, tmp_path):
    e = events(spark, 900)
    e = e.withColumn("asset_id", F.when(F.col("event_id") % 2 == 0, "hot").otherwise(F.col("asset_id"))).persist()  # half of all rows
    job = jobs.Ingest(str(tmp_path / "job"), window=100)
    job.start(files(e, tmp_path / "in", 3)).awaitTermination()
    assert len(list((tmp_path / "job" / "out").glob("batch=*"))) == 3
    got = job.results(spark)
    joint = pipeline.ingest_batch(e, window=100)
    assert answers(got) == answers(joint)
    flags = ["event_id", "learned", "is_scan", "unique_ports", "rate_per_min"]
    assert got.select(*flags).exceptAll(joint.select(*flags)).count() == 0
    assert sorted(p.name for p in (tmp_path / "job" / "state").glob("[0-9]*")) == ["1", "2"]
