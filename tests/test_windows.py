"""Window operators against brute force, with ties, edges, NULL keys and a hot key."""

import math
import random

from pyspark.sql import functions as F

from vedette import rules
from vedette.functions.numeric import US
from vedette.operators import chunked, filters, incidents, sweep

SCHEMA = ("event_id long, ts_us long, client_id string, asset_id string, src_ip string, event_type string, "
          "severity_score double, raw_hash string, dst_port int")
TYPES = ["login_failed", "ssh_login_success", "firewall_deny", "outbound_transfer", "http", "login"]


def make(n=600, hot=0.5, seed=1, span=3000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ip = "hot" if rng.random() < hot else rng.choice(["a", "b", None, ""])
        t = rng.randrange(span) * US if rng.random() < 0.9 else rng.choice([0, 60, 360, 720]) * US
        rows.append((i, t, f"c{rng.randrange(2)}", f"s{rng.randrange(3)}", ip, rng.choice(TYPES), rng.random(), f"h{i}",
                     rng.randrange(40)))
    return rows


def has(e, words):
    return any(w in e for w in words)


def test_correlate(spark):
    rows = make()
    got = {r["event_id"]: r for r in sweep.correlate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for r in rows:
        hist = [h for h in rows if h[2] == r[2] and h[4] == r[4] and r[1] - 360 * US <= h[1] <= r[1]] if r[4] else []
        fa = {h[3] for h in hist if has(h[5], rules.FAILURE_WORDS)}
        sa = {h[3] for h in hist if has(h[5], rules.SUCCESS_WORDS)}
        own = [h for h in hist if h[3] == r[3]]
        f = sum(has(h[5], rules.FAILURE_WORDS) for h in own)
        s = sum(has(h[5], rules.SUCCESS_WORDS) for h in own)
        blocked = sum(has(h[5], rules.BLOCKED_WORDS) for h in hist)
        if fa and sa and not fa <= sa:
            want = ("lateral_movement", len(fa) + len(sa))
        elif f >= 3 and s:
            want = ("brute_force_success", f)
        elif f >= 5:
            want = ("brute_force", f)
        elif blocked >= 10:
            want = ("port_scan", blocked)
        elif has(r[5], rules.OUTBOUND_WORDS):
            want = ("suspicious_outbound", 1)
        else:
            want = ("none", len(hist))
        assert (got[r[0]]["correlation_pattern"], got[r[0]]["correlation_count"]) == want, r


def test_threat_match_is_a_beacon(spark):
    df = spark.createDataFrame(make(5), SCHEMA).withColumn("threat_intel", F.lit(True))
    assert {(r["correlation_pattern"], r["correlation_count"]) for r in sweep.correlate(df).collect()} == {("c2_beacon", 1)}


def test_port_scan(spark):
    rows = [r for r in make(500, span=400) if r[4]]
    got = {r["event_id"]: r for r in sweep.port_scan_score(spark.createDataFrame(rows, SCHEMA)).collect()}
    for r in rows:
        ports = [h[8] for h in rows if h[4] == r[4] and r[1] - 60 * US < h[1] <= r[1]]
        n, u = len(ports), len(set(ports))
        if n < 5:
            assert got[r[0]]["nmap_score"] == 0.0 and got[r[0]]["unique_ports"] == 0
            continue
        h = -sum(ports.count(p) / n * math.log2(ports.count(p) / n) for p in set(ports)) / math.log2(65535)
        score = u / n * .5 + h * .3 + min(n / 500, 1) * .2
        assert abs(got[r[0]]["nmap_score"] - score) < 1e-4
        assert got[r[0]]["unique_ports"] == u


def test_window_edges(spark):
    rows = [(i, t * US + d, "c", "s", "a", "x", 0.1, str(i), 1) for i, (t, d) in enumerate([(0, 0), (60, 0), (60, 1), (120, 0), (120, 0)])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("one", F.lit(1).cast("bigint"))
    got = {r["event_id"]: r["n"] for r in sweep.live_counts(df, ["src_ip"], "ts_us", 60 * US, {"n": "one"}).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 3, 4: 3}
    wide = {r["event_id"]: r["n"] for r in sweep.live_counts(df, ["src_ip"], "ts_us", 60 * US, {"n": "one"}, inclusive=True).collect()}
    assert wide[1] == 2


def test_rate_limit(spark):
    rows = [(i, i * 100_000, "c", "s", "a", "x", 0.1, f"h{i}", 1) for i in range(300)]
    out = filters.ip_rate_limit(spark.createDataFrame(rows, SCHEMA)).orderBy("event_id").collect()
    assert all(r["passed"] for r in out[:100])
    assert sum(r["passed"] for r in out[100:]) < 60
    assert all(r["reason"] in ("flood_sampled", "flood_dropped") for r in out[100:])


def test_lateral_history(spark):
    rows = make()
    got = {r["event_id"]: r["lateral_history"] for r in sweep.lateral_movement_history(spark.createDataFrame(rows, SCHEMA)).collect()}
    for r in rows:
        want = bool(r[4]) and r[6] >= 0.6 and any(
            h[2] == r[2] and h[4] == r[4] and h[3] != r[3] and "ssh" in h[5] and r[1] - 300 * US < h[1] < r[1] for h in rows)
        assert got[r[0]] == want


def test_previous_and_running(spark):
    rows = make()
    df = spark.createDataFrame(rows, SCHEMA)
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    prev, count = {}, {}
    last, n = {}, {}
    for r in ordered:
        k = (r[2], r[4])
        prev[r[0]] = last.get(k) if k in last and r[1] - last[k] <= 50 * US else None
        count[r[0]] = n.get(k, 0)
        last[k], n[k] = r[1], n.get(k, 0) + 1
    got = {r["event_id"]: r["prev_us"] for r in chunked.previous_within(df, ["client_id", "src_ip"], "ts_us", "event_id", 50 * US).collect()}
    assert got == prev
    chunk = F.floor(F.col("ts_us") / (100 * US))
    got = {r["event_id"]: r["earlier"] for r in chunked.earlier_rows(df, ["client_id", "src_ip"], ["ts_us", "event_id"], chunk).collect()}
    assert got == count


def sessions_by_hand(rows, marks=()):
    out, open_ = [], {}
    for r in sorted(rows, key=lambda r: (r["ts_us"], r["event_id"])):
        k = (r["client_id"], r["asset_id"], r["src_ip"], r["pattern"])
        gap = rules.CONSOLIDATION_MINUTES.get(r["pattern"], 120) * 60 * US
        cur = open_.get(k)
        closed = cur and any(m[0] == k and cur[2] < m[1] <= r["ts_us"] for m in marks)
        if cur is None or r["ts_us"] - cur[2] > gap or closed:
            cur = [k, r["ts_us"], r["ts_us"], 0]
            open_[k] = cur
            out.append(cur)
        cur[2], cur[3] = r["ts_us"], cur[3] + 1
    return sorted((str(k), a, b, n) for k, a, b, n in out)


def incident_rows(n=400, seed=3):
    rng = random.Random(seed)
    return [dict(event_id=i, ts_us=rng.randrange(2000) * 60 * US, client_id="c", asset_id=f"s{rng.randrange(2)}",
                 src_ip="hot" if rng.random() < .7 else None, pattern=rng.choice(["port_scan", "c2_beacon", "odd"]),
                 event_type="x", raw_hash=str(i), anomaly_score=rng.random(), river_score=0.1, nmap_score=0.2,
                 combined_score=0.3, aro=float(i % 3), ale=0.0) for i in range(n)]


def as_tuples(df):
    return sorted((str((r["client_id"], r["asset_id"], r["src_ip"], r["pattern"])), r["first_seen_us"], r["last_seen_us"], r["event_count"])
                  for r in df.collect())


INC = ("event_id long, ts_us long, client_id string, asset_id string, src_ip string, pattern string, event_type string, raw_hash string, "
       "anomaly_score double, river_score double, nmap_score double, combined_score double, aro double, ale double")


def test_consolidation_and_merge(spark):
    rows = incident_rows()
    df = spark.createDataFrame(rows, INC)
    assert as_tuples(incidents.consolidate(df)) == sessions_by_hand(rows)
    k = ("c", "s0", "hot", "port_scan")
    marks = [(k, 500 * 60 * US), (k, 900 * 60 * US)]
    reviews = spark.createDataFrame([(*m[0], m[1]) for m in marks], "client_id string, asset_id string, src_ip string, pattern string, reviewed_us long")
    assert as_tuples(incidents.consolidate(df, reviews)) == sessions_by_hand(rows, marks)
    cut = 1000 * 60 * US
    a, b = incidents.consolidate(df.where(f"ts_us < {cut}")), incidents.consolidate(df.where(f"ts_us >= {cut}"))
    assert as_tuples(incidents.merge_incidents(a, b)) == sessions_by_hand(rows)


def test_exact_gap_joins(spark):
    rows = incident_rows(2)
    for r, t in zip(rows, (0, 120 * 60 * US)):
        r.update(ts_us=t, asset_id="s", src_ip="i", pattern="port_scan")
    assert len(as_tuples(incidents.consolidate(spark.createDataFrame(rows, INC)))) == 1
    rows[1]["ts_us"] += 1
    assert len(as_tuples(incidents.consolidate(spark.createDataFrame(rows, INC)))) == 2
