"""What the density detector carries from one batch to the next.

Four tables, none of which grows with the history: sums per (tenant, asset), the learned
vectors of the block that is filling and of the one before it, the events of the last minute
(with the last event of every asset of the last hour) and the number of events seen. Sums and
rows of two states add up, so a state can be merged, and a batch reads it, adds to it and
writes it under its own number: a batch that is delivered twice starts from the same state.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import rules
from ..functions.numeric import HOUR_US, US
from ..session import cut_lineage, names_in

KEYS = ["client_id", "asset_id"]
COUNTERS = "client_id string, asset_id string, seen bigint, learned bigint"
LEARNED = ("client_id string, asset_id string, event_id bigint, seq bigint, learned boolean, _weight int, learned_before bigint, "
           + ", ".join(f"{f} double" for f in rules.FEATURES))
RECENT = "client_id string, asset_id string, event_id bigint, ts_us bigint, src_ip string, dst_port int"
TOTAL = "events bigint"


@dataclass
class State:
    """``counters``: events and learned weights so far per key; ``learned``: rows of the last two
    blocks; ``recent``: events that later windows still see; ``total``: events of the whole stream."""

    counters: DataFrame
    learned: DataFrame
    recent: DataFrame
    total: DataFrame


def empty(spark: SparkSession) -> State:
    return State(*(spark.createDataFrame([], kind) for kind in (COUNTERS, LEARNED, RECENT, TOTAL)))


def save(state: State, path: str, batch: int) -> None:
    """Writes the state after a batch; ``total`` comes last and marks it as whole."""
    for f in fields(State):
        getattr(state, f.name).write.mode("overwrite").parquet(f"{path}/{batch}/{f.name}")


def load(spark: SparkSession, path: str, batch: int) -> State:
    """The state of the newest whole batch before this one; an empty one if there is none."""
    try:
        there = names_in(spark, path)
    except Exception as exc:  # no folder yet
        if "FileNotFound" not in str(exc):
            raise
        there = []
    for number in sorted((int(n) for n in there if n.isdigit() and int(n) < batch), reverse=True):
        if "total" in names_in(spark, f"{path}/{number}") and "_SUCCESS" in names_in(spark, f"{path}/{number}/total"):
            kinds = (COUNTERS, LEARNED, RECENT, TOTAL)
            return State(*(spark.read.schema(k).parquet(f"{path}/{number}/{f.name}") for f, k in zip(fields(State), kinds, strict=True)))
    return empty(spark)


def grown(state: State, events: DataFrame, sequenced: DataFrame, window: int = rules.HST_WINDOW,
          lateness_us: int = 0) -> State:
    """The state after a batch: ``events`` as they came, ``sequenced`` with seq, learned, _weight and learned_before.

    Later events may be ``lateness_us`` older than the newest one seen and still find their minute.
    """
    now = sequenced.groupBy(*KEYS).agg(F.count("*").alias("seen"), F.sum("_weight").alias("learned"))
    counters = state.counters.unionByName(now).groupBy(*KEYS).agg(F.sum("seen").alias("seen"), F.sum("learned").alias("learned"))
    counters = cut_lineage(counters)
    block = lambda c: F.floor(F.col(c) / window)
    names = [c.split()[0] for c in LEARNED.split(", ")]
    rows = state.learned.unionByName(sequenced.where("learned").select(*names))
    first = counters.select(*KEYS, (block("learned") - 1).alias("_first"))
    learned = rows.join(first, KEYS).where(block("learned_before") >= F.col("_first")).select(*names)
    port = F.col("dst_port").cast("int") if "dst_port" in events.columns else F.lit(None).cast("int")
    seen = state.recent.unionByName(events.select(*KEYS, "event_id", "ts_us", "src_ip", port.alias("dst_port")))
    newest = seen.agg(F.max("ts_us")).scalar() - F.lit(lateness_us)
    hour = seen.where(F.col("ts_us") > newest - F.lit(HOUR_US))
    last = hour.groupBy(*KEYS).agg(F.max(F.struct("ts_us", "event_id")).alias("_last"))
    last = last.select(*KEYS, "_last.*").join(hour.select("event_id", *KEYS, "src_ip", "dst_port"), ["event_id", *KEYS])
    fresh = F.col("ts_us") > newest - F.lit(60 * US) - 1
    recent = hour.where(fresh).unionByName(last.where(~fresh).select(*hour.columns))
    total = state.total.unionByName(events.agg(F.count("*").alias("events"))).agg(F.coalesce(F.sum("events"), F.lit(0)).alias("events"))
    return State(counters, cut_lineage(learned), cut_lineage(recent), cut_lineage(total))


def merged(one: State, other: State) -> State:
    """Both states as one: of streams that share no asset, or a state and what was added to it apart."""
    both = one.counters.unionByName(other.counters).groupBy(*KEYS).agg(F.sum("seen").alias("seen"), F.sum("learned").alias("learned"))
    total = one.total.unionByName(other.total).agg(F.sum("events").alias("events"))
    return State(both, one.learned.unionByName(other.learned), one.recent.unionByName(other.recent), total)
