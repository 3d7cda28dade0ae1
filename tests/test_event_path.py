"""The whole path in batches against one joint run."""

import json

import numpy as np
from pyspark.sql import functions as F

from vedette.plans.event_path import EventPath

US = 1_000_000


def logs(spark, n=500):
    r, t, rows = np.random.default_rng(3), 1_700_000_000 * US, []
    for i in range(n):
        t += int(r.choice([0, 2, 20, 900], p=[0.2, 0.4, 0.35, 0.05])) * US
        host, kind = f"host-{int(r.integers(0, 4))}", str(r.choice(["login failed", "login success", "port scan blocked", "ping"]))
        raw = {"agent": {"name": host, "ip": "10.0.0.7" if i % 2 else "10.9.9.9"}, "data": {"srcip": f"185.0.0.{int(r.integers(0, 3))}"},
               "rule": {"description": kind, "level": 10}, "n": i - (i % 50 == 49)}
        rows.append((i, "" if i % 97 == 0 else f"c{i % 2}", t, json.dumps(raw) if i % 61 else "{broken", float(r.random())))
    return spark.createDataFrame(rows, "event_id long, client_id string, ts_us long, raw string, severity_score double").persist()


def tables(spark):
    assets = spark.createDataFrame(
        [(1, "c0", "host-0", "web", None, None, 9000.0, "alta"), (2, "c1", None, "HOST-1", None, None, 500.0, "baja"), (3, "c1", None, "x", None, "10.0.0.7", 70.0, "media")],
        "id long, client_id string, hostname string, nombre_activo string, technical_id string, ip_address string, valor_activo double, clasificacion_criticidad string")
    for c in ("valor_confidencialidad", "valor_integridad", "valor_disponibilidad"):
        assets = assets.withColumn(c, F.lit(3))
    for c in ("contiene_pii", "contiene_pci", "contiene_phi", "contiene_pfi"):
        assets = assets.withColumn(c, F.lit(False))
    intel = spark.createDataFrame([("185.0.0.2", "local_blocklist", 100, 0, None, "listed")],
                                  "ip string, source string, confidence int, valid_from_us long, valid_to_us long, details string")
    return assets, intel


def told(df, names):
    return sorted(tuple("" if x is None else x for x in r) for r in df.select(*names).collect())


EVENT = ["event_id", "asset.id", "correlation_pattern", "correlation_count", "river_score", "combined_score", "via", "route"]
INCIDENT = ["client_id", "asset_id", "src_ip", "pattern", "event_count", "first_seen_us", "last_seen_us", "peak_anomaly_score", "opener_id", "status"]


def test_two_batches_equal_one(spark, tmp_path):
    e, (assets, intel) = logs(spark), tables(spark)

    def path(name):
        return EventPath(str(tmp_path / name), assets, intel, window=50, columns=lambda: {"severity": F.col("severity_score"), "received_us": F.col("ts_us")})

    joint, parts, cut = path("joint"), path("parts"), 300
    want = told(joint(e, 0), EVENT)
    assert {x[1] for x in want} >= {1, 2, 3, ""} and {x[-1] for x in want} == {"escalated", "normal"}
    got = told(parts(e.where(F.col("event_id") < cut), 0), EVENT)
    parts(e.where(F.col("event_id") >= cut), 1)
    again = told(parts(e.where(F.col("event_id") >= cut), 1), EVENT)  # delivered twice
    assert sorted(got + again) == want
    one, two = told(joint.incidents(spark), INCIDENT), told(parts.incidents(spark), INCIDENT)
    assert len(one) > 20 and one == two
    for name in ("features", "escalated"):
        stores = [spark.read.parquet(str(tmp_path / p / name)) for p in ("joint", "parts")]
        assert told(stores[0], ["client_id", "event_id", "route"]) == told(stores[1], ["client_id", "event_id", "route"])
        assert stores[1].groupBy("client_id", "raw_hash").count().where("count > 1").count() == 0
