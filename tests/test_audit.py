import hashlib
import json

from pyspark.sql import functions as F

from vedette.operators import audit

SCHEMA = "chain string, id long, event_type string, entity_id string, actor string, payload string"
ROWS = [("m", i, "review", "ñ-7", "ana", '{"b": 2, "a": "é"}' if i % 2 else "") for i in range(1, 7)]


def by_hand(rows):
    prev, out = "GENESIS", {}
    for r in rows:
        text = json.dumps({"event_type": r[2], "entity_id": r[3], "actor": r[4], "payload": json.loads(r[5]) if r[5] else {},
                           "previous_hash": prev}, sort_keys=True)
        prev = out[r[1]] = hashlib.sha256(text.encode()).hexdigest()
    return out


def test_build_matches_by_hand(spark):
    built = audit.build_hash_chain(spark.createDataFrame(ROWS, SCHEMA))
    assert {r["id"]: r["current_hash"] for r in built.collect()} == by_hand(ROWS)
    assert audit.verify_hash_chain(built).first()["status"] == "INTACT"


def test_tampered_record_is_found(spark):
    built = audit.build_hash_chain(spark.createDataFrame(ROWS, SCHEMA))
    bad = built.withColumn("actor", F.when(F.col("id") == 2, "eve").otherwise(F.col("actor")))
    got = audit.verify_hash_chain(bad).first()
    assert (got["status"], got["broken_at"]) == ("COMPROMISED", 2)
    report = audit.tamper_report(bad).first()
    assert (report["content_changed"], report["link_broken"], report["first_changed"]) == (1, 0, 2)


def test_long_chain_is_cut_by_id(spark):
    built = audit.build_hash_chain(spark.createDataFrame(ROWS, SCHEMA))
    assert audit.checked(built, chunk_ids=2).where("not ok").count() == 0


def test_no_records(spark):
    empty = audit.build_hash_chain(spark.createDataFrame([], SCHEMA))
    assert audit.verify_hash_chain(empty).count() == 0


def sealed(spark, n=40, logs=("m", "o/1")):
    rows = [(log, i, "review", f"e{i}", "ana", "") for log in logs for i in range(1, n + 1)]
    built = audit.build_hash_chain(spark.createDataFrame(rows, SCHEMA), block_ids=5).persist()
    tree = audit.hash_tree(built, fan_out=3, levels=3).persist()
    return built, tree, audit.tree_roots(tree)


def verdict(log, tree, roots=None):
    return {r["log"]: (r["status"], r["broken_at"], r["reason"]) for r in audit.verify_log(log, tree, roots, fan_out=3).collect()}


def test_blocks_are_tied_together(spark):
    logs = ("good", "deleted", "cut", "last", "record", "moved", "all")
    built, tree, roots = sealed(spark, logs=logs)
    moved = {"moved/2": 10, "moved/4": -10}
    step = F.coalesce(F.create_map(*[F.lit(x) for kv in moved.items() for x in kv])[F.col("chain")], F.lit(0))
    log = built.where("""chain != 'deleted/3' AND NOT (chain = 'cut/4' AND id > 22) AND chain != 'last/8'
                         AND NOT (chain = 'record/2' AND id = 12) AND chain NOT LIKE 'all%'""")
    log = log.withColumn("id", F.col("id") + step).withColumn("chain", F.when(F.col("chain") == "moved/2", "moved/4").when(
        F.col("chain") == "moved/4", "moved/2").otherwise(F.col("chain"))).persist()
    broken = audit.verify_hash_chain(log).where("status != 'INTACT'")
    assert [r["chain"] for r in broken.collect()] == ["record/2"]  # the others are right chain by chain
    assert verdict(log, tree, roots) == {
        "good": ("INTACT", None, None), "deleted": ("COMPROMISED", 15, "block"), "cut": ("COMPROMISED", 20, "block"),
        "last": ("COMPROMISED", 40, "block"), "record": ("COMPROMISED", 10, "block"), "moved": ("COMPROMISED", 10, "block"),
        "all": ("COMPROMISED", 1, "block")}


def test_records_behind_the_seal(spark):
    rows = [("m", i, "review", f"e{i}", "ana", "") for i in range(1, 31)]
    built = audit.build_hash_chain(spark.createDataFrame(rows, SCHEMA), block_ids=5)
    tree = audit.hash_tree(built.where("id <= 17"), fan_out=3, levels=3)
    got = audit.verify_log(built, tree, audit.tree_roots(tree), fan_out=3).first()
    assert (got["status"], got["records"], got["sealed_records"], got["unsealed_records"]) == ("INTACT", 30, 17, 13)
    gap = built.where("id NOT BETWEEN 10 AND 14")
    sparse = audit.hash_tree(gap, fan_out=3, levels=3)
    assert verdict(built, sparse) == {"m": ("COMPROMISED", 10, "inserted")}


def test_a_changed_tree_is_found(spark):
    built, tree, roots = sealed(spark, logs=("m",))
    less = built.where("chain != 'm/3'")
    no_leaf = tree.where("NOT (level = 0 AND pos = 3)")
    status, at, reason = verdict(less, no_leaf, roots)["m"]
    assert (status, reason) == ("COMPROMISED", "tree") and at <= 15
    made_anew = audit.hash_tree(less, fan_out=3, levels=3)
    assert verdict(less, made_anew)["m"][0] == "INTACT"  # nothing kept apart
    assert verdict(less, made_anew, roots)["m"] == ("COMPROMISED", None, "root")
    assert verdict(built.limit(0), tree.limit(0), roots)["m"] == ("COMPROMISED", None, "root")
