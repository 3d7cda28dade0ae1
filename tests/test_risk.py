from datetime import date

from pyspark.sql import functions as F
import pytest

from vedette.functions.numeric import DAY_US
from vedette.operators import inventory, joins, risk

META = ("asset_meta struct<valor_activo:double,clasificacion_criticidad:string,valor_confidencialidad:int,valor_integridad:int,"
        "valor_disponibilidad:int,contiene_pii:boolean,contiene_pci:boolean,contiene_phi:boolean,contiene_pfi:boolean>")
RATES = "client_id string, asset_id string, pattern string, aro double, aro_sample_size long, aro_period_days long, aro_confidence string"


def incident(spark, pattern, value, cia, aro):
    meta = (value, "Alto", *cia, False, False, False, False)
    inc = spark.createDataFrame([("c", "a", pattern, 0.7, meta)], f"client_id string, asset_id string, pattern string, anomaly_score double, {META}")
    return risk.incident_risk(inc, spark.createDataFrame([("c", "a", pattern, aro, 1, 30, "low")], RATES)).first()


def test_loss_of_a_ransomware_incident(spark):
    r = incident(spark, "ransomware_activity", 10000.0, (5, 1, 1), 0.5)
    assert (r["ef"], r["sle"], r["ale"]) == (0.90, 9000.0, 4500.0)
    assert set(r["impacted_dimensions"]) == {"disponibilidad", "integridad"}
    assert r["cia_snapshot"]["confidencialidad"] == 5


def test_no_value_no_loss(spark):
    r = incident(spark, "none", 0.0, (3, 3, 3), 1.0)
    assert (r["ef"], r["sle"], r["ale"], r["impacted_dimensions"]) == (0.10, 0.0, 0.0, {})


@pytest.mark.parametrize("days,aro", [(1, 12.1667), (5, 52.0)])
def test_yearly_rate(spark, days, aro):
    df = spark.createDataFrame([("c", "a", "port_scan", days, 0, days - 1, 1)],
                               "client_id string, asset_id string, pattern string, days_attacked long, first_day long, last_day long, peak_ips long")
    assert risk.yearly_rate(df).first()["aro"] == aro


def test_attack_days_expand_hints(spark):
    rows = [("c", "a", d * DAY_US, "port scan", "none", ip) for d, ip in ((1, "x"), (1, "y"), (3, "x"))]
    df = spark.createDataFrame(rows, "client_id string, asset_id string, ts_us long, event_type string, pattern_hint string, src_ip string")
    got = {r["pattern"]: (r["days_attacked"], r["peak_ips"]) for r in risk.attack_days(df).collect()}
    assert got == {"port_scan": (2, 2), "reconnaissance": (2, 2), "none": (2, 2)}


@pytest.mark.parametrize("text,value", [("1.500,00", 1500.0), ("$1,500.00", 1500.0), ("n/a", 0.0), (" ", None), (None, None), ("1.234.567", 1234567.0)])
def test_decimal(spark, text, value):
    r = spark.createDataFrame([(text,)], "x string").select(inventory.cast_field("x", "decimal").alias("y")).first()["y"]
    assert (None if r is None else float(r)) == value


@pytest.mark.parametrize("text,value", [("3.0", 3), ("9", 5), ("0", 1), ("nivel 4", 4), ("", None)])
def test_level(spark, text, value):
    assert spark.createDataFrame([(text,)], "x string").select(inventory.cast_field("x", "int").alias("y")).first()["y"] == value


def test_inventory_file(spark, tmp_path):
    from vedette.sources.raw import read_inventory
    (tmp_path / "a.csv").write_text("﻿Nombre,Dirección IP,Nombre del equipo,Valor,Clasificación,PII\nweb,10.0.0.1,h1,\"1.500,00\",Alto PCI,sí\n"
                                    ",10.0.0.2,h2,$1,x,no\n,,,,,\n", encoding="utf-8")
    df = read_inventory(spark, str(tmp_path))
    assert df.count() == 2
    mapping = inventory.map_inventory_columns(df.drop("row_number"))
    assert mapping["ip_address"] == "Dirección IP" and mapping["hostname"] == "Nombre del equipo"
    cast = inventory.cast_inventory(df, mapping, {"departamento": "TI"})
    good = cast.where("not rejected").first()
    assert (good["nombre_activo"], float(good["valor_activo"]), good["contiene_pii"], good["contiene_pci"], good["valor_integridad"]) == ("web", 1500.0, True, True, 3)
    bad = inventory.inventory_rejects(cast).first()
    assert bad["row_number"] == 3 and bad["reason"] == "nombre_activo es obligatorio"


def test_content_mapping(spark):
    df = spark.createDataFrame([("10.1.1.1", "00:11:22:33:44:55", 500.0)], "q string, w string, e double")
    assert inventory.map_inventory_columns(df) == {"ip_address": "q", "mac_address": "w", "valor_activo": "e"}


def test_threat_intel(spark):
    intel = spark.createDataFrame(
        [("8.8.8.8", 10, "local_blocklist", 0, 100), ("1.1.1.1", 24, "feed", 0, 100), ("2.2.2.2", 25, "feed", 0, 100),
         ("10.0.0.1", 99, "feed", 0, 100), ("3.3.3.3", 99, "feed", 0, 10), ("4.4.4.4", 99, "feed", 0, 100), ("4.4.4.4", 1, "feed", 40, 100),
         ("5.5.5.5", 0, "local_blocklist", 0, None), ("5.5.5.5", 0, "feed", 40, None), ("6.6.6.6", 80, "feed", 3, None),
         ("7.7.7.7", 0, "local_blocklist", 0, 10), ("7.7.7.7", 0, "local_blocklist", 5, 90), ("7.7.7.7", 0, "local_blocklist", 6, 7)],
        "ip string, confidence int, source string, valid_from_us long, valid_to_us long")
    events = spark.createDataFrame([(i, 50, ip) for i, ip in enumerate(
        ["8.8.8.8", "1.1.1.1", "2.2.2.2", "10.0.0.1", "3.3.3.3", "4.4.4.4", None, "x", "5.5.5.5", "6.6.6.6", "7.7.7.7"])], "event_id long, ts_us long, src_ip string")
    got = {r["event_id"]: (r["threat_intel"], r["ti_details"]["confidence"] if r["ti_details"] else None)
           for r in joins.threat_intel_enrich(events, intel).collect()}
    assert got == {0: (True, 90), 1: (False, 24), 2: (True, 25), 3: (False, None), 4: (False, None), 5: (False, 1), 6: (False, None), 7: (False, None),
                   8: (True, 90), 9: (True, 80), 10: (True, 90)}


def test_match_priority(spark):
    assets = spark.createDataFrame([(1, "c", "h1", "Web", "t1", "9.9.9.9"), (2, "c", "h2", "h1", "t2", "8.8.8.8"), (3, "c", "h3", "Db", "t3", "7.7.7.7")],
                                   "id long, client_id string, hostname string, nombre_activo string, technical_id string, ip_address string")
    events = spark.createDataFrame([(1, "c", "t3", "h1", "8.8.8.8"), (2, "c", "x", "h1", "8.8.8.8"), (3, "c", None, "DB", None), (4, "c", None, None, "8.8.8.8"), (5, "d", "t1", "h1", None)],
                                   "event_id long, client_id string, tid string, host string, ip string")
    got = {r["event_id"]: r["asset"]["id"] if r["asset"] else None for r in joins.match_asset(events, assets, "tid", "host", "ip").collect()}
    assert got == {1: 3, 2: 1, 3: 3, 4: 2, 5: None}


def test_dedupe_keeps_tenants_and_events_without_hash(spark, tmp_path):
    from vedette.sources import store
    rows = [(1, "a", "h", 5), (2, "a", "h", 3), (3, "b", "h", 9), (4, "a", None, 1), (5, "a", None, 1)]
    events = spark.createDataFrame(rows, "event_id long, client_id string, raw_hash string, ts_us long")
    assert sorted(r["event_id"] for r in joins.drop_known(events).collect()) == [2, 3, 4, 5]
    known = spark.createDataFrame([("b", "h")], "client_id string, raw_hash string")
    assert sorted(r["event_id"] for r in joins.drop_known(events, known).collect()) == [2, 4, 5]
    path = str(tmp_path / "store")
    for _ in range(2):
        store.sink_features(events, path)
    store.sink_features(events.withColumn("ts_us", events["ts_us"] + 10**11), path)
    assert sorted(r["event_id"] for r in spark.read.parquet(path).collect()) == [2, 3, 4, 5]


def test_few_events_are_scored_too(spark, views):
    from vedette.operators import features
    few = views.sec_events.limit(3)
    assert features.training_features(few, views.assets).count() == 3
    assert features.training_features(few, views.assets, features.MIN_TRAINING_ROWS).count() == 0


def test_old_days_are_dropped(spark, tmp_path):
    from vedette.sources import store
    day = 86_400_000_000
    events = spark.createDataFrame([(i, "a", None, i * 10 * day) for i in range(12)], "event_id long, client_id string, raw_hash string, ts_us long")
    path = str(tmp_path / "store")
    store.sink_features(events, path)
    gone = store.drop_expired_days(spark, path, 110 * day, 90)
    assert gone == ["created_date=1970-01-01", "created_date=1970-01-11"]
    assert spark.read.parquet(path).count() == 10


def test_rejected_lines_are_kept(spark):
    from vedette.sources import raw
    texts = spark.createDataFrame([("f", '{"a":1}\nnope\n\n{"a":2}\n{x'), ("g", '{"a":1}'), ("h", None), ("i", "nope")], "file string, value string")
    assert raw.read_json_lines(texts).count() == 3
    assert sorted(tuple(r) for r in raw.rejected_lines(texts).collect()) == [("f", "nope", 2), ("f", "{x", 5), ("i", "nope", 1)]
    assert raw.queue_rejects(texts).count() == 2
