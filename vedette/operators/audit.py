"""Tamper-evident audit chains.

A chain is serial, so a log is kept as one chain per block of ids. What ties the blocks
together is a hash tree over their heads: a leaf says which block it is, how many records it
holds, where they begin and end and what the last one's hash is; inner nodes hash the nodes
below with their places. One root per log stands for all of it, so a block that is deleted,
moved, cut short or slipped in shows, also where every chain is right by itself.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.jsontree import canonical_json, json_string
from ..functions.numeric import div_us
from ..session import cut_lineage, spread
from .chunked import previous_value

GENESIS = "GENESIS"
CHUNK_IDS = 1_000_000
BLOCK_IDS = 50_000
#: Nodes below one node, and levels above the leaves: enough for blocks of any 64-bit id.
FAN_OUT, LEVELS = 4_096, 4


def content_prefix() -> Column:
    """Sorted-key JSON text of a record up to its previous hash."""
    payload = F.coalesce(canonical_json(F.when(F.col("payload") != "", F.col("payload"))), F.lit("{}"))
    return F.concat(F.lit('{"actor": '), json_string("actor"), F.lit(', "entity_id": '), json_string("entity_id"),
                    F.lit(', "event_type": '), json_string("event_type"), F.lit(', "payload": '), payload,
                    F.lit(', "previous_hash": "'))


def record_hash(prefix: Column, previous: Column) -> Column:
    return F.sha2(F.concat(prefix, previous, F.lit('"}')).cast("binary"), 256)


def build_hash_chain(events: DataFrame, chain: str = "chain", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Adds previous_hash and current_hash along ``id`` within each chain.

    A chain is serial by nature, so each is kept as one chain per block of ids, of bounded
    length, and built in one group; ``chain`` becomes ``<chain>/<block>``. Blocks are tied
    together by ``hash_tree``.
    """
    block = F.floor(F.col("id") / F.lit(block_ids)).cast("string")
    rows = events.withColumn(chain, F.concat_ws("/", F.col(chain), block)).withColumn("_prefix", content_prefix())
    names = events.columns

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        previous, before, after = GENESIS, [], []
        for prefix in pdf["_prefix"]:
            before.append(previous)
            previous = hashlib.sha256(f'{prefix}{previous}"}}'.encode()).hexdigest()
            after.append(previous)
        return pdf[names].assign(previous_hash=before, current_hash=after)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    return spread(rows, chain).groupBy(chain).applyInPandas(link, f"{schema}, previous_hash string, current_hash string")


def chain_heads(chained: DataFrame, chain: str = "chain") -> DataFrame:
    return chained.groupBy(chain).agg(F.count("*").alias("records"), F.max_by("current_hash", "id").alias("head"))


def checked(chained: DataFrame, chain: str = "chain", chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """Adds ``link`` (hash of the record before, GENESIS first) and ``ok``.

    Up to the first break every stored hash is right, so the running hash equals the
    stored hash of the row before and all rows can be checked in parallel; the smallest id
    that fails is the break. Chains of any length are cut by id, see chunked.
    """
    rows = previous_value(chained, [chain], "id", div_us("id", chunk_ids), "current_hash", "link")
    rows = rows.withColumn("link", F.coalesce("link", F.lit(GENESIS)))
    return rows.withColumn("ok", record_hash(content_prefix(), F.col("link")) == F.col("current_hash"))


def verify_hash_chain(chained: DataFrame, chain: str = "chain") -> DataFrame:
    """Per chain: records, first broken id, status INTACT or COMPROMISED. No rows: no chains."""
    broken = F.min(F.when(~F.coalesce("ok", F.lit(False)), F.col("id")))
    return checked(chained, chain).groupBy(chain).agg(
        F.count("*").alias("records"), broken.alias("broken_at"),
        F.when(broken.isNull(), "INTACT").otherwise("COMPROMISED").alias("status"),
        F.max_by("current_hash", "id").alias("latest_hash"))


def tamper_report(chained: DataFrame, chain: str = "chain") -> DataFrame:
    """Per chain: records whose own content was changed, and records that only lost their link."""
    rows = checked(chained, chain).withColumn(
        "own", record_hash(content_prefix(), F.col("previous_hash")) == F.col("current_hash"))
    return rows.groupBy(chain).agg(
        F.count_if(~F.col("own")).alias("content_changed"),
        F.count_if(F.col("own") & (F.col("previous_hash") != F.col("link"))).alias("link_broken"),
        F.min(F.when(~F.col("own"), F.col("id"))).alias("first_changed"))


def _leaf(log: str, block: str, records: str, first: str, last: str, head: str) -> Column:
    text = F.concat_ws("|", F.col(log), F.col(block).cast("string"), F.col(records).cast("string"),
                       F.col(first).cast("string"), F.col(last).cast("string"), F.col(head))
    return F.sha2(text.cast("binary"), 256)


def _log_and_block(chained: DataFrame, chain: str) -> DataFrame:
    """Adds ``_log`` and ``_block``, the two parts of the name that ``build_hash_chain`` gives a chain."""
    return chained.withColumns({"_log": F.regexp_extract(chain, "^(.*)/(-?[0-9]+)$", 1),
                                "_block": F.regexp_extract(chain, "^(.*)/(-?[0-9]+)$", 2).cast("bigint")})


def _parents(nodes: DataFrame, by: list[str], at: Column) -> DataFrame:
    below = F.sort_array(F.collect_list(F.struct("pos", "hash")))
    text = F.array_join(F.transform(below, lambda n: F.concat_ws(":", n["pos"].cast("string"), n["hash"])), ",")
    return nodes.groupBy(*by, at.alias("_at")).agg(
        F.sum("records").alias("records"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"),
        F.sha2(text.cast("binary"), 256).alias("hash")).withColumnRenamed("_at", "pos")


def hash_tree(chained: DataFrame, chain: str = "chain", fan_out: int = FAN_OUT, levels: int = LEVELS) -> DataFrame:
    """(log, level, pos, records, first_id, last_id, hash): every node of the tree over each log's blocks.

    Leaves (level 0) stand for blocks, ``pos`` is the block's number, so places are fixed and a
    gap is part of what is hashed. Each level groups up to ``fan_out`` neighbours, the root
    (level ``levels`` + 1, place 0) what is left. A node never gathers more than ``fan_out`` hashes;
    records only pass a grouping by block. An empty table gives no nodes.
    """
    leaves = _log_and_block(chained, chain).groupBy("_log", "_block").agg(
        F.count("*").alias("records"), F.min("id").alias("first_id"), F.max("id").alias("last_id"),
        F.max_by("current_hash", "id").alias("_head"))
    node = ["log", "level", "pos", "records", "first_id", "last_id", "hash"]
    at = leaves.select(F.col("_log").alias("log"), F.lit(0).alias("level"), F.col("_block").alias("pos"), "records", "first_id",
                       "last_id", _leaf("_log", "_block", "records", "first_id", "last_id", "_head").alias("hash"))
    at = out = cut_lineage(at)
    for level in range(1, levels + 2):
        place = F.floor(F.col("pos") / fan_out) if level <= levels else F.lit(0).cast("bigint")
        at = _parents(at, ["log"], place).withColumn("level", F.lit(level)).select(*node)
        out = out.union(at)
    return out


def tree_roots(tree: DataFrame) -> DataFrame:
    """(log, records, root): what has to be kept where the log's keeper cannot write."""
    top = tree.groupBy("log").agg(F.max("level").alias("level"))
    return tree.join(top, ["log", "level"]).select("log", "records", F.col("hash").alias("root"))


def verify_log(chained: DataFrame, tree: DataFrame, roots: DataFrame | None = None, chain: str = "chain",
               fan_out: int = FAN_OUT) -> DataFrame:
    """Per log: records, sealed_records, unsealed_records, broken_at, reason, status.

    ``tree`` is the stored hash tree, ``roots`` the roots kept apart from it. Checked are every
    record in its block (as ``verify_hash_chain``), every sealed block against its leaf, every
    stored node against those below it, and the stored root against the one kept apart.
    ``broken_at`` is the smallest id at which any of it fails: the first of a deleted, moved or
    shortened block; ``reason`` says what failed there: record, block, inserted, tree or root.
    Records behind the last sealed one are unsealed and only checked by themselves. A log that
    has a tree but no record is COMPROMISED, one without a tree has only unsealed records.
    """
    top = tree.where("level > 0").agg(F.max("level").alias("l")).scalar()
    sealed = tree.where("level = 0").select(F.col("log").alias("_log"), F.col("pos").alias("_block"), F.col("records").alias("_n"),
                                            F.col("first_id").alias("_first"), F.col("last_id").alias("_last"), F.col("hash").alias("_hash"))
    ends = sealed.groupBy("_log").agg(F.max("_last").alias("_end"))
    rows = _log_and_block(checked(chained, chain), chain).join(sealed.select("_log", "_block", "_last"), ["_log", "_block"], "left")
    inside = F.col("id") <= F.col("_last")
    blocks = cut_lineage(rows.groupBy("_log", "_block").agg(
        F.count("*").alias("all"), F.min("id").alias("first"), F.count_if(inside).alias("records"),
        F.min(F.when(inside, F.col("id"))).alias("first_id"), F.max(F.when(inside, F.col("id"))).alias("last_id"),
        F.max_by("current_hash", F.when(inside, F.col("id"))).alias("head"),
        F.min(F.when(~F.coalesce("ok", F.lit(False)), F.col("id"))).alias("bad")))
    met = blocks.join(sealed, ["_log", "_block"], "full").join(ends, "_log", "left")
    leaf = _leaf("_log", "_block", "records", "first_id", "last_id", "head")
    at = lambda when, id_, reason: F.when(when, F.struct(F.col(id_).alias("id"), F.lit(reason).alias("reason")))
    wrong = F.array_compact(F.array(
        at(F.col("bad").isNotNull(), "bad", "record"),
        at(F.col("_hash").isNotNull() & ~(leaf.eqNullSafe(F.col("_hash"))), "_first", "block"),
        at(F.col("_hash").isNull() & (F.col("first") <= F.col("_end")), "first", "inserted")))
    found = met.groupBy("_log").agg(
        F.coalesce(F.sum("all"), F.lit(0)).alias("records"), F.coalesce(F.sum("_n"), F.lit(0)).alias("sealed_records"),
        F.sum(F.coalesce(F.col("all"), F.lit(0)) - F.coalesce(F.col("records"), F.lit(0))).alias("unsealed_records"),
        F.min(F.array_min(wrong)).alias("_wrong"))
    # stored nodes against the stored nodes below them
    place = F.when(F.col("level") + 1 < top, F.floor(F.col("pos") / fan_out)).otherwise(0)
    below = tree.where(F.col("level") < top).withColumn("_up", place).withColumn("level", F.col("level") + 1)
    above = _parents(below, ["log", "level"], F.col("_up")).select(
        "log", "level", "pos", F.col("hash").alias("_made"), F.col("first_id").alias("_made_first"))
    odd = tree.where("level > 0").join(above, ["log", "level", "pos"], "full").where(~F.col("hash").eqNullSafe(F.col("_made")))
    odd = odd.groupBy(F.col("log").alias("_log")).agg(F.min(F.coalesce(F.least("first_id", "_made_first"), "first_id", "_made_first")).alias("_odd"))
    out = found.join(odd, "_log", "left")
    if roots is None:
        out = out.withColumns({"_kept": F.lit(None).cast("string"), "_root": F.lit(None).cast("string")})
    else:
        out = out.join(tree_roots(tree).select(F.col("log").alias("_log"), F.col("root").alias("_root")), "_log", "left")
        out = out.join(roots.select(F.col("log").alias("_log"), F.col("root").alias("_kept")), "_log", "full")
    first = F.array_min(F.array_compact(F.array(F.col("_wrong"), at(F.col("_odd").isNotNull(), "_odd", "tree"))))
    replaced = F.col("_kept").isNotNull() & ~F.col("_kept").eqNullSafe(F.col("_root"))
    out = out.withColumn("_first", first)
    return out.select(
        F.col("_log").alias("log"), F.coalesce("records", F.lit(0)).alias("records"),
        F.coalesce("sealed_records", F.lit(0)).alias("sealed_records"), F.coalesce("unsealed_records", F.lit(0)).alias("unsealed_records"),
        F.col("_first.id").alias("broken_at"), F.coalesce("_first.reason", F.when(replaced, "root")).alias("reason"),
        F.when(F.col("_first").isNotNull() | replaced, "COMPROMISED").otherwise("INTACT").alias("status"))
