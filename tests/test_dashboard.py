"""The dashboard's frames from one scan against the single reports."""

import random

import pytest

from vedette.operators import dashboards as d

DAY = 86_400_000_000
SCHEMA = ("id long, client_id string, asset_id string, src_ip string, victim_ip string, pattern string, event_type string, "
          "anomaly_score double, ale double, peak_anomaly_score double, valor_activo_snapshot double, status string, created_us long, "
          "first_seen_us long, last_seen_us long, reviewed_us long, event_count long, lateral_movement_detected boolean, "
          "explanation string, clasificacion_criticidad string")


def incidents(n, seed=5):
    r = random.Random(seed)

    def some(x):
        return None if r.random() < 0.1 else x

    rows = []
    for i in range(n):
        at = 1_700_000_000_000_000 + r.randint(0, 40 * DAY)
        client = "c1" if r.random() < 0.6 else some(f"c{r.randint(2, 4)}")  # one tenant holds most rows
        rows.append((i, client, some(f"a{r.randint(0, 6)}"), r.choice([None, "0.0.0.0", "127.0.0.1", *[f"9.9.9.{k}" for k in range(30)]]),
                     some("10.0.0.1"), some(r.choice(["port_scan", "none", "lateral_movement"])), "x", some(r.randint(0, 100) / 100),
                     some(r.randint(0, 10**7) / 100), some(r.random()), some(float(r.randint(0, 9))),
                     some(r.choice(["PENDING", "SHADOW", "APPROVED"])), at, some(at - r.randint(0, DAY)), some(at + r.randint(0, DAY)),
                     some(at + r.randint(0, DAY)), some(r.randint(1, 9)), some(r.random() < 0.2), some(f"e{i}") if i % 3 else None,
                     r.choice(["Alto", "Bajo", None])))
    return rows


@pytest.mark.parametrize("n, client_id, as_of", [(600, None, None), (600, "c1", None), (300, None, 1_700_000_000_000_000 + 20 * DAY), (0, None, None)])
def test_frames_equal_the_single_reports(spark, n, client_id, as_of):
    df = spark.createDataFrame(incidents(n), SCHEMA).repartition(4)
    got = d.dashboard(df, 7, as_of, client_id)
    want = {
        "summary": d.stats_summary(df, 7 * 24, as_of, client_id), "trends": d.attack_trends(df, 7, as_of, client_id),
        "top_attackers": d.top_entities(df, "src_ip", client_id=client_id),
        "top_assets": d.top_entities(df, "asset_id", client_id=client_id),
        "latest_explanation": d.latest_explanation(df, client_id),
        "attacker_profiles": d.attacker_profiles(df, 7, as_of=as_of, client_id=client_id),
        "attacker_timelines": d.attacker_timelines(df, 7, as_of=as_of, client_id=client_id),
        "executive_metrics": d.executive_metrics(df, as_of, client_id), "risk_by_asset": d.risk_by_asset(df, as_of, client_id)}
    assert set(got) == set(want)
    for name, frame in want.items():
        assert got[name].dtypes == frame.dtypes, name
        rows = sorted(map(repr, got[name].collect()))
        assert rows == sorted(map(repr, frame.collect())), name
        assert rows or not n, name
