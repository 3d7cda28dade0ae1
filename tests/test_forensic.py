"""Sparse vectors and forests, and a scan of logs with more field names than a plan could hold."""

import hashlib
import json

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from vedette.operators import discovery, iforest
from vedette.plans import forensic


def sparse(x):
    return [np.flatnonzero(r) * 7 + 3 for r in x], [r[r != 0] for r in x]


def filled(rows, columns, share, seed):
    rng = np.random.default_rng(seed)
    return np.where(rng.random((rows, columns)) < share, rng.integers(-3, 4, (rows, columns)).astype(float), 0.0)


@settings(max_examples=40, deadline=None)
@given(rows=st.integers(1, 60), columns=st.integers(1, 12), share=st.sampled_from([0.0, 0.1, 0.5, 1.0]), seed=st.integers(0, 10_000))
def test_sparse_tree_is_the_dense_tree(rows, columns, share, seed):
    x = filled(rows, columns, share, seed)
    dense = iforest.grow(x, np.random.default_rng(seed))
    got = iforest.grow_sparse(*sparse(x), np.random.default_rng(seed))
    assert [f * 7 + 3 if f >= 0 else -1 for f in dense[0]] == got[0]
    assert list(map(list, dense[1:])) == list(map(list, got[1:]))


@settings(max_examples=20, deadline=None)
@given(seed=st.integers(0, 10_000), cells=st.sampled_from([1, 50, 4_000_000]))
def test_sparse_scores_are_the_dense_scores(seed, cells):
    x = filled(80, 9, 0.4, seed)
    names = ("feature", "threshold", "left", "right", "rows")
    grown = [iforest.grow(x, np.random.default_rng(seed + k)) for k in range(5)]
    dense = [{"sample": 80, **dict(zip(names, t))} for t in grown]
    wide = [{**t, "feature": [f * 7 + 3 if f >= 0 else -1 for f in t["feature"]]} for t in dense]
    index, value = sparse(np.vstack([x, np.zeros((1, 9))]))
    got = iforest.sparse_isolation(index, value, wide, cells)
    assert np.array_equal(got, iforest.isolation_score(np.vstack([x, np.zeros((1, 9))]), dense))


LOGS = [{"n": "1", "t": "a", "m": "5"}, {"n": "2.5", "t": "b", "m": "x"}, {"n": "0", "t": None, "m": "NaN"}, {}, {"n": "Infinity", "host": "h"}]


def expected_vectors():
    md5 = lambda s, n: int(hashlib.md5(s.encode()).hexdigest()[:n], 16)
    number = lambda v: max(-1e300, min(1e300, float(v)))
    out = {}
    for i, log in enumerate(LOGS):
        cells = [(md5(p, 15), number(v) if p == "n" else float(md5(v, 8) % 1000)) for p, v in log.items() if v is not None and p != "host"]
        out[i] = sorted(c for c in cells if c[1] != 0)
    return out


def test_vectors_with_named_and_with_joined_paths(spark):
    flat = spark.createDataFrame(list(enumerate(LOGS)), "id long, fields map<string,string>")
    profile = discovery.profile_paths(flat)
    for listed in (1000, 0):
        got = discovery.sparse_vector(flat, profile, "id", leave_out="host", listed=listed).collect()
        assert {r["id"]: [tuple(e) for e in r["vector"]] for r in got} == expected_vectors()


def test_scan_of_eight_thousand_paths(spark):
    rows = []
    for i in range(80):
        log = {"host": f"srv-{i % 2}", "eventName": "ListBuckets", "level": 1}
        log.update({f"k{i}_{j}": j if j % 3 else f"text {j}" for j in range(100)})
        rows.append((i, json.dumps(log)))
    rows.append((80, json.dumps({"host": "alone", "eventName": "DeleteBucket"})))
    logs = spark.createDataFrame(rows, "event_id long, raw string")
    frames = forensic.forensic_scan(logs)
    flagged = frames["flagged"].select("event_id", "target_asset", "isolation", "is_anomaly").collect()
    assert sorted(r["event_id"] for r in flagged) == list(range(80))  # an asset with one row is left out
    assert {r["target_asset"] for r in flagged} == {"srv-0", "srv-1"} and all(0 < r["isolation"] < 1 for r in flagged)
    anomalies = {a: sum(r["is_anomaly"] for r in flagged if r["target_asset"] == a) for a in ("srv-0", "srv-1")}
    money = {r["target_asset"]: r for r in frames["assets"].collect()}
    assert {a: money[a]["anomalies"] for a in money} == {a: n for a, n in anomalies.items() if n}
    assert frames["report"].first()["critical_assets_count"] == len(money)


def test_scan_finds_the_odd_row(spark):
    logs = [(i, json.dumps({"host": "db", "eventName": "Read", "bytes": 100 + i % 5, "user": "u1"})) for i in range(200)]
    logs.append((200, json.dumps({"host": "db", "eventName": "Read", "bytes": 900_000, "user": "zz", "odd": "field"})))
    prepared = forensic.prepare(spark.createDataFrame(logs, "event_id long, raw string"))
    flagged = forensic.flag_anomalies(prepared)
    assert flagged.agg(F.max_by("event_id", "isolation")).first()[0] == 200
    assert flagged.where("is_anomaly").where("event_id = 200").count() == 1
