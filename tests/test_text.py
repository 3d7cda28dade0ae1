import random

from pyspark.sql import functions as F
import pytest

from vedette import rules
from vedette.functions import jsontree as j, text as t


def one(spark, value, expr, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("y")).first()["y"]


@pytest.mark.parametrize("text", [
    "../../etc/passwd", "<script>alert('x')</script>", "<SCRIPT src=x>", "JavaScript:alert(1)", "<img onerror = x>",
    "< iframe src=x>", "${jndi:ldap://x}", "__proto__", "constructor ['x']", "union  all select 1", "DROP TABLE users",
    "delete from t", "TRUNCATE database d"])
def test_injections_are_redacted(spark, text):
    assert rules.REDACTED in one(spark, text, t.sanitize_text("x"))
    assert rules.REDACTED in j.clean_text(text)
    assert one(spark, text, t.sanitize_text("x")) == j.clean_text(text)


def test_marks_leave_no_injection_out():
    """A pattern is only tried on texts that hold its mark; the result is that of trying all."""
    def all_tried(s):
        s = j._CONTROL.sub("", s)
        for _, p in j._INJECTIONS:
            s = p.sub(rules.REDACTED, s)
        return s

    bits = ["../", "<", "script", "SCRIPT", ">", "</script>", "javascript:", "on", "load", "=", " ", "iframe", "${", "}", "__proto__", "\t",
            "constructor", "[", "union", "ALL", "select", "Drop", "table", "delete", "From", "truncate", "DATABASE", "\x00", "ſ", "ı", "İ", "]"]
    r, found = random.Random(1), 0
    for _ in range(20_000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 9)))
        found += rules.REDACTED in all_tried(text)
        assert j.clean_text(text) == all_tried(text)
    assert found > 5_000


def test_control_characters_and_length(spark):
    assert one(spark, "hello\x00world", t.sanitize_text("x")) == "helloworld"
    assert one(spark, "test\x1fbuzz", t.sanitize_text("x")) == "testbuzz"
    assert one(spark, "a\n\tb", t.sanitize_text("x")) == "a\n\tb"
    assert one(spark, "A" * 3000, t.sanitize_text("x")) == "A" * 3000
    long = one(spark, "A" * 3000, t.sanitize_text("x", 2000))
    assert len(long) == 2005 and long.endswith("[...]")


def test_nested_json(spark):
    deep = "1"
    for _ in range(12):
        deep = '{"a":' + deep + "}"
    assert one(spark, deep, j.sanitize_json("x")) == deep.replace(":", ": ")
    assert rules.TOO_DEEP in one(spark, deep, j.sanitize_json("x", depth=10))
    assert one(spark, '{"d": "{\\"Role\\":\\"Admin\\"}"}', j.sanitize_json("x")) == '{"d": {"Role": "Admin"}}'
    assert one(spark, '{"d": "{broken"}', j.sanitize_json("x")) == '{"d": "{broken"}'
    assert one(spark, "{broken", j.sanitize_json("x")) is None
    many = "{" + ",".join(f'"k{i}":1' for i in range(300)) + "}"
    assert one(spark, many, j.sanitize_json("x")).count(":") == 300
    assert one(spark, many, j.sanitize_json("x", entries=200)).count(":") == 200
    assert len(one(spark, '{"a": "' + "b" * 9000 + '"}', j.sanitize_json("x"))) == 9009


def test_payload_size(spark):
    assert one(spark, "x" * 1024, t.payload_size_ok("x"))
    assert not one(spark, "x" * 2048, t.payload_size_ok("x", 1024))


def test_json_lines(spark):
    from vedette.sources.raw import read_json_lines
    rows = [('{"a":1,"b":2}',), ('[{"a":1},{"a":2}]',), ('{"logs":[{"a":1},{"a":2},{"a":3}]}',), ('{"a":1}\nnope\n\n{"a":2}',)]
    got = read_json_lines(spark.createDataFrame(rows, "value string")).groupBy("value").count().collect()
    assert sorted(r["count"] for r in got) == [1, 2, 2, 3]


def test_flatten(spark):
    got = one(spark, '{"user":{"name":"a"},"events":[{"name":"login"},{"name":"x"}],"a":{"b":{"c":{"d":{"e":1}}}}}', j.flatten_json("x"))
    assert got == {"user_name": "a", "events_0_name": '["login", "x"]', "a_b_c_d_e": "1"}


def test_whole_events_are_analysed(spark):
    from vedette.plans.normalize import normalize_events
    deep = '{"data":{"srcip":"198.51.100.7"}}'
    for _ in range(15):
        deep = '{"x":[' + deep + "]}"
    rows = [('{"log":"' + "y" * 5000 + ' mimikatz from 203.0.113.5"}',), (deep,), ("{broken",)]
    got = {r["raw"]: r for r in normalize_events(spark.createDataFrame(rows, "raw string")).collect()}
    assert got[rows[0][0]]["pattern_hint"] == "credential_theft" and got[rows[0][0]]["src_ip"] == "203.0.113.5"
    assert got[deep]["src_ip"] == "198.51.100.7" and got["{broken"]["event_type"] == "parse_error"


@pytest.mark.parametrize("name,score", [("DeleteDBInstance", 1.0), ("CreateUser", 0.5), ("ListBuckets", 0.1), ("SomeUnknown", 0.3)])
def test_danger(spark, name, score):
    assert one(spark, name, t.danger_score("x")) == score


@pytest.mark.parametrize("value,score", [(45.0, 0.1), (90.0, 0.812), (130.0, 1.0)])
def test_sensor(spark, value, score):
    assert one(spark, value, t.sensor_danger(F.lit("factory/boiler/temp"), "x"), "x double") == score


@pytest.mark.parametrize("raw,score", [(0.05, 0.1192), (0.15, 0.2315), (0.3, 0.5), (0.5, 0.832)])
def test_sigmoid(spark, raw, score):
    assert one(spark, raw, t.density_sigmoid("x"), "x double") == score


@pytest.mark.parametrize("text,us", [
    ("20250101000000", 1735689600000000), ("1735689600", 1735689600000000), ("1735689600123", 1735689600000000),
    ("1735689600123456", 1735689600000000), ("1735689600123456789", 1735689600000000), ("1735689600.75", 1735689600000000),
    ("2025-01-01T00:00:00Z", 1735689600000000), ("2025-01-01T00:00:00+00:00", 1735689600000000), ("garbage", None), (None, None)])
def test_timestamps(spark, text, us):
    assert one(spark, text, t.normalize_timestamp("x")) == us


@pytest.mark.parametrize("text,pattern", [
    ("mimikatz and whoami", "credential_theft"), ("whoami", "reconnaissance"), ("c2 exfil", "c2_reverse_shell"),
    ("exfil", "data_exfiltration"), ("vssadmin delete shadows c2", "ransomware_activity"), ("hello", "none"),
    ("DeleteBucket", "cloud_attack"), ("port 4445", "c2_reverse_shell"), ("\\.bashrc edited", "persistence")])
def test_classify(spark, text, pattern):
    assert one(spark, text, t.classify_pattern("x", F.lit(0.1)))["pattern"] == pattern


def test_classify_by_severity(spark):
    assert one(spark, "hello", t.classify_pattern("x", F.lit(0.8)))["pattern"] == "high_severity_event"


@pytest.mark.parametrize("ip,private", [("10.1.2.3", True), ("172.31.0.1", True), ("172.32.0.1", False), ("8.8.8.8", False), ("x", True), ("1.2.3.400", True)])
def test_private(spark, ip, private):
    assert one(spark, ip, t.is_private_ip("x")) is private


def test_sources(spark):
    raws = {'{"kind":"admin#reports#x"}': "google_workspace", '{"kind":"other"}': "unknown", '{"sensor":1}': "honeypot",
            '{"occurredAt":1,"apMac":2}': "meraki", '{"rule":1,"agent":2,"eventSource":1,"awsRegion":2}': "wazuh"}
    for raw, name in raws.items():
        assert one(spark, raw, t.detect_source("x")) == name


def test_entities(spark):
    from vedette.operators.discovery import extract_entities
    raw = ('{"agent":{"name":"srv-1","ip":"10.0.0.9"},"full_log":"failed login from 203.0.113.5",'
           '"data":{"srcip":"198.51.100.7"}}')
    df = spark.createDataFrame([(raw,)], "raw string").select(j.text_leaves("raw").alias("l"))
    got = df.select(*[c.alias(n) for n, c in extract_entities(F.col("l")).items()]).first()
    assert (got["src_ip"], got["victim_ip"], got["asset_id"]) == ("198.51.100.7", "10.0.0.9", "srv-1")
    assert got["event_type"] == "failed login from 203.0.113.5"
