"""Half-space trees (Tan, Ting, Liu 2011) per (client, asset).

The splits do not depend on data, so a leaf number is a pure function of a feature
vector. An event is scored with the masses of the block of 2000 learned events before
its own. Both blocks form one bounded group, small blocks with their neighbours; a block swollen
by events that are never learned is cut into parts, each with its copy of the learned block.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .. import rules
from ..functions.numeric import HOUR_US, div_us, round_to
from ..functions.text import density_sigmoid
from ..session import cut_lineage, spread
from .chunked import earlier_rows
from .detector import State

KEYS = ["client_id", "asset_id"]
#: Events of a block that are scored together, and learned rows of neighbouring blocks that share a group.
PART_ROWS, SPAN_ROWS = 4096, 4096


@lru_cache(maxsize=4)
def splits(trees: int = rules.HST_TREES, height: int = rules.HST_HEIGHT, n_features: int = len(rules.FEATURES),
           seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Feature and cut of every inner node, heap order, per tree.

    Each tree draws its own work range per feature around a random point and halves the
    range of a random feature at every node.
    """
    inner = 2**height - 1
    feature = np.zeros((trees, inner), dtype=np.int16)
    cut = np.zeros((trees, inner))
    for t in range(trees):
        rng = np.random.default_rng(seed * 7919 + t)
        point = rng.random(n_features)
        reach = 2.0 * np.maximum(point, 1.0 - point)
        low, high = (point - reach)[None, :], (point + reach)[None, :]
        at = 0
        for _ in range(height):
            n = len(low)
            f = rng.integers(0, n_features, size=n)
            rows = np.arange(n)
            middle = (low[rows, f] + high[rows, f]) / 2.0
            feature[t, at:at + n], cut[t, at:at + n] = f, middle
            new_low, new_high = np.repeat(low, 2, axis=0), np.repeat(high, 2, axis=0)
            new_high[2 * rows, f] = middle
            new_low[2 * rows + 1, f] = middle
            low, high, at = new_low, new_high, at + n
    return feature, cut


def _bounds(rows: np.ndarray, of: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value of each feature per block; blocks without rows lie beyond everything."""
    low, high = np.full((blocks, rows.shape[1]), np.inf), np.full((blocks, rows.shape[1]), -np.inf)
    if len(rows):
        order = np.argsort(of, kind="stable")
        there, first = np.unique(of[order], return_index=True)
        low[there], high[there] = np.minimum.reduceat(rows[order], first), np.maximum.reduceat(rows[order], first)
    return low, high


def density(x: np.ndarray, learned: np.ndarray, window: int = rules.HST_WINDOW, height: int = rules.HST_HEIGHT,
            trees: int = rules.HST_TREES, of: np.ndarray | None = None, learned_of: np.ndarray | None = None) -> np.ndarray:
    """Anomaly 1 - mass score of each row, given the learned rows of the block before.

    The walk adds mass * 2**depth and stops below a tenth of the window; the sum is
    normalised by its largest possible value. ``of`` and ``learned_of`` number the block of
    each row, 0 if there is one only; each block has its own masses.

    Only nodes that a walk reaches are made, level by level for all blocks and trees. At a node
    whose cut lies beyond all rows of its block every walk turns the same way: it becomes its child.
    The sums are whole numbers, so their order does not matter.
    """
    feature, cut = splits(trees, height, x.shape[1])
    of = np.zeros(len(x), np.int64) if of is None else of
    learned_of = np.zeros(len(learned), np.int64) if learned_of is None else learned_of
    blocks = 1 + int(max(of.max(initial=0), learned_of.max(initial=0)))
    low, high = _bounds(np.concatenate([x, learned]), np.concatenate([of, learned_of]), blocks)

    # node: feature, cut, first child (-1: the walk ends here) and sum so far; a root per block and tree
    mass = np.repeat(np.bincount(learned_of, minlength=blocks), trees).astype(float)
    feature_of, cut_of, child, total = [], [], [], []
    block, tree = np.divmod(np.arange(blocks * trees), trees)
    at, sums, first = np.zeros(blocks * trees, np.int64), mass.copy(), 0
    row = np.repeat(np.arange(len(learned)), trees)  # a walk per learned row and tree, and its node in this level
    node = (learned_of[:, None] * trees + np.arange(trees)).ravel()
    while len(at):
        split, f, c = np.zeros(len(at), bool), np.zeros(len(at), np.int64), np.zeros(len(at))
        open_ = np.flatnonzero(mass >= 0.1 * window)
        depth = np.log2(at + 1).astype(np.int64)
        open_ = open_[depth[open_] < height]
        while len(open_):
            ft, ct = feature[tree[open_], at[open_]], cut[tree[open_], at[open_]]
            right, left = ct <= low[block[open_], ft], ct > high[block[open_], ft]
            own = ~(right | left)
            split[open_[own]], f[open_[own]], c[open_[own]] = True, ft[own], ct[own]
            at[open_] = np.where(own, at[open_], 2 * at[open_] + 1 + right)
            open_ = open_[~own]
            depth[open_] += 1
            sums[open_] += mass[open_] * 2.0 ** depth[open_]
            open_ = open_[depth[open_] < height]
        halved = np.flatnonzero(split)
        child.append(np.where(split, first + len(at) + 2 * (np.cumsum(split) - 1), -1))
        feature_of.append(f)
        cut_of.append(c)
        total.append(sums)
        walks = np.flatnonzero(split[node])
        row, node = row[walks], node[walks]
        node = 2 * (np.cumsum(split) - 1)[node] + (learned[row, f[node]] >= c[node])
        first += len(at)
        mass = np.bincount(node, minlength=2 * len(halved)).astype(float)
        at = np.repeat(2 * at[halved] + 1, 2)
        at[1::2] += 1
        block, tree = np.repeat(block[halved], 2), np.repeat(tree[halved], 2)
        sums = np.repeat(sums[halved], 2) + mass * 2.0 ** np.repeat(depth[halved] + 1, 2)
    feature_of, cut_of, child, total = (np.concatenate(a) if a else np.zeros(0) for a in (feature_of, cut_of, child, total))

    out = np.zeros(len(x))
    for start in range(0, len(x), 4096):
        part = x[start:start + 4096]
        row = np.repeat(np.arange(len(part)), trees)
        node = (of[start:start + 4096, None] * trees + np.arange(trees)).ravel()
        while len(row):
            ended = child[node] < 0
            out[start:start + 4096] += np.bincount(row[ended], total[node[ended]], len(part))
            row, node = row[~ended], node[~ended]
            node = child[node] + (part[row, feature_of[node]] >= cut_of[node])
    return 1.0 - out / (trees * window * float(2 ** (height + 1) - 1))


def sequence(events: DataFrame, chunk_us: int = HOUR_US, state: State | None = None) -> DataFrame:
    """Adds seq (place of the event in its key), in_burn_in and learned.

    Learned events before this one number the blocks. Warm-up events are learned twice. A
    ``state`` says how many came before the batch.
    """
    order = ["ts_us", "event_id"]
    e = events.withColumn("learned", F.coalesce("danger_score", F.lit(0.3)) < rules.FORCED_DANGER)
    e = earlier_rows(e, KEYS, order, div_us("ts_us", chunk_us), "_seq")
    if state is not None:
        before = state.counters.select(*KEYS, F.col("seen").alias("_seen"), F.col("learned").alias("_learned"))
        e = e.join(before, KEYS, "left").fillna(0, ["_seen", "_learned"]).withColumn("_seq", F.col("_seq") + F.col("_seen")).drop("_seen")
    e = e.withColumn("seq", F.col("_seq") + 1).drop("_seq")
    e = e.withColumn("_weight", F.when(F.col("learned"), F.when(F.col("seq") < rules.WARMUP_EVENTS, 2).otherwise(1)).otherwise(0))
    e = earlier_rows(e, KEYS, order, div_us("ts_us", chunk_us), {"learned_before": F.col("_weight")})
    if state is not None:
        e = e.withColumn("learned_before", F.col("learned_before") + F.col("_learned")).drop("_learned")
        row = state.total.first()
        return burn_in(e, already=row[0] if row else 0)
    return burn_in(e)


def burn_in(events: DataFrame, events_needed: int = rules.BURN_IN_EVENTS, already: int = 0) -> DataFrame:
    """Adds ``in_burn_in``: the event is among the first 499 of the whole stream, of which ``already`` came before.

    Only the place of event 499 is needed, a top-k that keeps 499 rows per task.
    """
    place = F.struct("ts_us", "event_id")
    first = events.select(place.alias("p")).orderBy("p").limit(max(0, events_needed - 1 - already))
    return events.withColumn("in_burn_in", F.coalesce(place <= first.agg(F.max("p")).scalar(), F.lit(False)))


def raw_density(sequenced: DataFrame, columns=rules.FEATURES, window: int = rules.HST_WINDOW,
                earlier: DataFrame | None = None) -> DataFrame:
    """(key, event_id, raw_score); 0 in the first block, which has no reference masses.

    ``earlier`` holds learned rows from before the batch, see ``detector.State``.
    """
    columns = list(columns)
    block = F.floor(F.col("learned_before") / window)
    rows = sequenced.select(*KEYS, "event_id", "seq", "learned", "_weight", *columns, "learned_before", block.alias("block"))
    w_sizes = rows.groupBy(*KEYS, "block").agg(F.count("*").alias("_n"), F.min("seq").alias("_first"))
    parts = w_sizes.withColumn("_parts", F.ceil(F.col("_n") / PART_ROWS).cast("int"))
    scored = rows.join(parts.select(*KEYS, "block", "_first"), [*KEYS, "block"]).withColumn(
        "part", F.floor((F.col("seq") - F.col("_first")) / PART_ROWS).cast("int")).drop("_first")
    # an event whose two warm-up copies straddle a border counts in the block of its first copy
    known = rows.where("learned")
    if earlier is not None:
        known = known.unionByName(earlier.withColumn("block", block).select(*rows.columns))
    masses = (
        known.withColumn("block", F.col("block") + 1)
        .join(parts.select(*KEYS, "block", "_parts"), [*KEYS, "block"])
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    )
    kinds = dict(sequenced.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in KEYS) + f", event_id {kinds['event_id']}, raw_score double"

    def run(events: pd.DataFrame, learned: pd.DataFrame) -> pd.DataFrame:
        out = events[[*KEYS, "event_id"]].copy()
        out["raw_score"] = 0.0
        if len(learned) and len(events):
            times = learned["m__weight"].to_numpy(dtype=int)
            there, old_of = np.unique(learned["m_block"].to_numpy(dtype=np.int64), return_inverse=True)
            block = events["block"].to_numpy(dtype=np.int64)
            of = np.minimum(np.searchsorted(there, block), len(there) - 1)
            told = there[of] == block
            old, x = learned[mass_columns].to_numpy(dtype=float), events[columns].to_numpy(dtype=float)
            out.loc[told, "raw_score"] = density(x[told], np.repeat(old, times, axis=0), window, of=of[told],
                                                 learned_of=np.repeat(old_of, times))
        return out

    on = [*KEYS, "span", "part"]
    mass_columns = [f"m_{c}" for c in columns]
    span = F.floor(F.col("block") / max(1, SPAN_ROWS // window)).alias("span")
    scored = scored.select("*", span)
    masses = masses.select("*", span).select(*[F.col(c).alias(f"m_{c}") for c in [*on, "block", "_weight", *columns]])
    mass_on = [f"m_{k}" for k in on]
    scored, masses = spread(scored, *on), spread(masses, *mass_on)
    return scored.groupBy(*on).cogroup(masses.groupBy(*mass_on)).applyInPandas(run, schema)


def flags(scored: DataFrame) -> DataFrame:
    """Warm-up, score, thresholds and reason from raw_score, seq and in_burn_in.

    Warm-up events use severity. The escalation threshold rises once 500 events of the
    whole stream have passed.
    """
    warm = F.col("seq") < rules.WARMUP_EVENTS
    severity = F.coalesce("severity_score", F.lit(0.2))
    bar = F.when(F.col("in_burn_in"), rules.ESCALATE_AT_BURN_IN).otherwise(rules.ESCALATE_AT)
    s = F.col("river_score")
    return (
        scored.withColumn("river_score", F.when(warm, round_to(severity, 4)).otherwise(density_sigmoid("raw_score")))
        .withColumns({
            "river_warmup": warm,
            "is_anomaly": F.when(warm, severity >= 0.5).otherwise(s >= rules.ANOMALY_AT),
            "river_escalates": F.when(warm, severity >= 0.7).otherwise(s >= bar),
            "reason": F.when(warm, "warmup").when(~F.col("learned"), "destructive").when(s >= bar, "escalating")
            .when(s >= rules.ANOMALY_AT, "suspicious").otherwise("normal"),
        })
    )


def half_space_trees(features: DataFrame, window: int = rules.HST_WINDOW) -> DataFrame:
    """Raw density, score and flags per event. ``features`` holds the nine features and danger_score."""
    return half_space_trees_after(features, None, window)[0]


def half_space_trees_after(features: DataFrame, state: State | None, window: int = rules.HST_WINDOW) -> tuple[DataFrame, DataFrame]:
    """``half_space_trees`` of a batch that comes after ``state``, and its sequenced rows, with which the state grows."""
    s = cut_lineage(sequence(cut_lineage(features), state=state))
    raw = raw_density(s, window=window, earlier=None if state is None else state.learned)
    return flags(s.join(raw, [*KEYS, "event_id"])), s
