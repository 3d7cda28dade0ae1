"""Isolation forest (Liu, Ting, Zhou 2008) fitted and applied per key on Spark.

Fit: each tree sees at most 256 rows of its key, and what is shuffled and grouped for a
key is bounded whatever its size. Score: keys are cut into groups of about
50 000 rows and each group meets a copy of its key's trees.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import rules
from ..functions.numeric import as_col
from ..session import small_side, spread

SAMPLE = 256
TREES = 100
GROUP_ROWS = 50_000
BLOCK = 25  # trees fitted by one group
SHAP_ROWS = 200_000  # rows explained with one set of tables
STATES = 4_096  # rows of a table at most


def mean_path(n) -> np.ndarray:
    """Average path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    return np.where(n > 2, 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe,
                    np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, rng: np.random.Generator) -> tuple[list, list, list, list, list]:
    """One tree as arrays (feature, threshold, left, right, rows); feature -1 marks a leaf."""
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    feature, threshold, left, right, rows = [], [], [], [], []

    def node(part: np.ndarray, depth: int) -> int:
        at = len(feature)
        for column, value in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (rows, len(part))):
            column.append(value)
        low, high = part.min(axis=0), part.max(axis=0)
        splittable = np.flatnonzero(high > low)
        if depth >= limit or len(part) <= 1 or not len(splittable):
            return at
        f = int(splittable[rng.integers(len(splittable))])
        cut = rng.uniform(low[f], high[f])
        goes_left = part[:, f] <= cut
        if goes_left.all() or not goes_left.any():
            return at
        feature[at], threshold[at] = f, float(cut)
        left[at] = node(part[goes_left], depth + 1)
        right[at] = node(part[~goes_left], depth + 1)
        return at

    node(x, 0)
    return feature, threshold, left, right, rows


def grow_sparse(index: Sequence[np.ndarray], value: Sequence[np.ndarray], rng: np.random.Generator) -> tuple[list, list, list, list, list]:
    """``grow`` on sparse rows, where features without an entry are 0; nodes name feature ids."""
    size = [len(i) for i in index]
    f = np.concatenate([np.zeros(0, np.int64), *index]).astype(np.int64)
    row, v = np.repeat(np.arange(len(size)), size), np.concatenate([np.zeros(0), *value])
    order = np.argsort(f, kind="stable")
    limit = int(np.ceil(np.log2(max(len(size), 2))))
    feature, threshold, left, right, rows = [], [], [], [], []

    def node(members: np.ndarray, f: np.ndarray, row: np.ndarray, v: np.ndarray, depth: int) -> int:
        at = len(feature)
        for column, start in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (rows, len(members))):
            column.append(start)
        if depth >= limit or len(members) <= 1 or not len(f):
            return at
        first = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
        end = np.append(first[1:], len(f))
        low, high = np.minimum.reduceat(v, first), np.maximum.reduceat(v, first)
        absent = end - first < len(members)
        low, high = np.where(absent, np.minimum(low, 0.0), low), np.where(absent, np.maximum(high, 0.0), high)
        splittable = np.flatnonzero(high > low)
        if not len(splittable):
            return at
        chosen = int(splittable[rng.integers(len(splittable))])
        cut = rng.uniform(low[chosen], high[chosen])
        x = np.zeros(len(size))
        x[row[first[chosen]:end[chosen]]] = v[first[chosen]:end[chosen]]
        goes_left = x <= cut
        here = goes_left[members]
        if here.all() or not here.any():
            return at
        feature[at], threshold[at] = int(f[first[chosen]]), float(cut)
        own = goes_left[row]
        left[at] = node(members[here], f[own], row[own], v[own], depth + 1)
        right[at] = node(members[~here], f[~own], row[~own], v[~own], depth + 1)
        return at

    node(np.arange(len(size)), f[order], row[order], v[order], 0)
    return feature, threshold, left, right, rows


def path_lengths(x: np.ndarray, tree) -> np.ndarray:
    """Path length of every row in one tree."""
    feature, threshold = np.asarray(tree["feature"]), np.asarray(tree["threshold"])
    left, right, rows = np.asarray(tree["left"]), np.asarray(tree["right"]), np.asarray(tree["rows"])
    at = np.zeros(len(x), dtype=int)
    depth = np.zeros(len(x))
    index = np.arange(len(x))
    while True:
        inner = feature[at] >= 0
        if not inner.any():
            return depth + mean_path(rows[at])
        i, n = index[inner], at[inner]
        at[i] = np.where(x[i, feature[n]] <= threshold[n], left[n], right[n])
        depth[i] += 1


def _typed(df: DataFrame, names: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def places(row_hash: np.ndarray, trees: int) -> np.ndarray:
    """Place in [0, 1) of every row in the draw of every tree: (rows, trees)."""
    own = _mixed(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (_mixed(row_hash.view(np.uint64)[:, None] ^ own) >> np.uint64(11)) * 2.0**-53


def candidates(features: DataFrame, keys: Sequence[str], row_id: str, trees: int, sample: int, seed: int,
               block_trees: int = BLOCK) -> DataFrame:
    """Rows from which the trees of each (key, block of trees) draw their samples.

    A tree's sample is the ``sample`` rows of its key with the smallest places. That many lie
    under (2 * sample + 64) / rows but for a chance below 1e-9, so only rows with a place
    under it leave their task, once for each block of trees that may take them: whatever the
    key's size, about trees * (2 * sample + 64) rows at most. ``_trees`` and ``_places`` say for which.
    """
    sizes = small_side(features.groupBy(*keys).agg(F.count("*").alias("_rows")))

    @F.arrow_udf("array<struct<block:int,trees:array<int>,places:array<double>>>")
    def drawn(row_hash: pa.Array, rows: pa.Array) -> pa.Array:
        place = places(row_hash.to_numpy(zero_copy_only=False), trees)
        at, tree = np.nonzero(place < (2 * sample + 64) / rows.to_numpy(zero_copy_only=False)[:, None])
        block = tree // block_trees
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (block[1:] != block[:-1])])) if len(at) else np.zeros(0, int)
        cuts = pa.array(np.append(first, len(at)), pa.int32())
        entry = pa.StructArray.from_arrays(
            [pa.array(block[first], pa.int32()), pa.ListArray.from_arrays(cuts, pa.array(tree, pa.int32())),
             pa.ListArray.from_arrays(cuts, pa.array(place[at, tree]))], ["block", "trees", "places"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(at[first], np.arange(len(place) + 1)), pa.int32()), entry)

    found = features.join(sizes, list(keys)).withColumn("_draws", drawn(F.xxhash64(as_col(row_id), F.lit(seed)), F.col("_rows")))
    return found.withColumn("_draw", F.explode("_draws")).select(
        *features.columns, F.col("_draw.block").alias("_block"), F.col("_draw.trees").alias("_trees"), F.col("_draw.places").alias("_places"))


def _fitted(features: DataFrame, keys: Sequence[str], row_id: str, grower, kind: str, trees: int, sample: int, seed: int,
            block_trees: int = BLOCK) -> DataFrame:
    """Trees table of ``features``; ``grower(pdf)`` gives what grows a tree from row numbers of ``pdf``."""
    keys = list(keys)
    rows = candidates(features, keys, row_id, trees, sample, seed, block_trees)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row_id, kind="stable")
        grown = grower(pdf)
        at = np.repeat(np.arange(len(pdf)), pdf["_trees"].str.len().to_numpy())
        tree, place = np.concatenate(pdf["_trees"].to_list()), np.concatenate(pdf["_places"].to_list())
        order = np.lexsort((place, tree))
        at, tree = at[order], tree[order]
        out = []
        for t in np.unique(tree).tolist():
            i = int(np.searchsorted(tree, t))
            picked = at[i:min(i + sample, int(np.searchsorted(tree, t, side="right")))]
            out.append([pdf[k].iloc[0] for k in keys] + [t, len(picked), *grown(picked, np.random.default_rng(seed * 100_003 + t))])
        return pd.DataFrame(out, columns=[*keys, "tree", "sample", "feature", "threshold", "left", "right", "rows"])

    schema = (_typed(features, keys) + f", tree int, sample int, feature array<{kind}>, threshold array<double>, "
              "left array<int>, right array<int>, rows array<int>")
    return spread(rows, *keys, "_block").groupBy(*keys, "_block").applyInPandas(build, schema)


def fit(features: DataFrame, keys: Sequence[str], row_id: str, columns: Sequence[str] = rules.FEATURES,
        trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """Trees table: one row per (key, tree) with node arrays. The sampling rule is one for keys of any size."""
    columns = list(columns)

    def grower(pdf: pd.DataFrame):
        x = pdf[columns].to_numpy(dtype=float)
        return lambda picked, rng: grow(x[picked], rng)

    return _fitted(features.select(*keys, row_id, *columns), keys, row_id, grower, "int", trees, sample, seed)


def fit_sparse(features: DataFrame, keys: Sequence[str], row_id: str, vector: str = "vector",
               trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """``fit`` on sparse rows: ``vector`` holds (feature, value) by feature, what it leaves out is 0.

    No feature is a column, so their number is not limited; a task holds the candidates of
    five trees of a key.
    """
    def grower(pdf: pd.DataFrame):
        index, value = pdf["_index"].to_numpy(), pdf["_value"].to_numpy()
        return lambda picked, rng: grow_sparse(index[picked], value[picked], rng)

    return _fitted(_as_arrays(features, keys, row_id, vector), keys, row_id, grower, "bigint", trees, sample, seed, block_trees=5)


def _as_arrays(features: DataFrame, keys: Sequence[str], row_id: str, vector: str) -> DataFrame:
    return features.select(*keys, row_id, F.col(f"{vector}.feature").alias("_index"), F.col(f"{vector}.value").alias("_value"))


def packed(model: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key with its trees (100 trees of at most 511 nodes)."""
    return model.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct("tree", "sample", "feature", "threshold", "left", "right", "rows"))).alias("trees"))


def with_model(features: DataFrame, model: DataFrame, keys: Sequence[str], row_id: str, apply, schema: str,
               group_rows: int = GROUP_ROWS, weight: Column | None = None) -> DataFrame:
    """Runs ``apply(pdf, trees) -> pdf`` on groups of about ``group_rows`` rows (or of that ``weight``) of one key."""
    keys = list(keys)
    size = F.count("*") if weight is None else F.sum(weight)
    sizes = small_side(features.groupBy(*keys).agg(F.ceil(size / group_rows).cast("int").alias("_groups")))
    left = features.join(sizes, keys).withColumn("_group", F.pmod(F.xxhash64(row_id), F.col("_groups")).cast("int"))
    right = (packed(model, keys).join(sizes, keys)
             .withColumn("_group", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1))).drop("_groups"))

    def run(rows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        return apply(rows, list(trees["trees"].iloc[0]) if len(trees) else [])

    on = [*keys, "_group"]
    left, right = spread(left.drop("_groups"), *on), spread(right, *on)
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(run, schema)


def isolation_score(x: np.ndarray, trees) -> np.ndarray:
    """2 ** (-mean path / expected path): near 1 for rows that are easy to isolate."""
    total = np.zeros(len(x))
    for tree in trees:
        total += path_lengths(x, tree)
    expected = max(float(mean_path(max(t["sample"] for t in trees))), 1e-9)
    return 2.0 ** (-(total / len(trees)) / expected)


def raw_scores(features: DataFrame, model: DataFrame, keys: Sequence[str], row_id: str,
               columns: Sequence[str] = rules.FEATURES) -> DataFrame:
    """(key, row id, isolation) for every row."""
    keys, columns = list(keys), list(columns)

    def run(rows: pd.DataFrame, trees: list) -> pd.DataFrame:
        x = rows[columns].to_numpy(dtype=float)
        s = isolation_score(x, trees) if trees and len(rows) else np.full(len(rows), 0.5)
        return rows[[*keys, row_id]].assign(isolation=s)

    schema = _typed(features, [*keys, row_id]) + ", isolation double"
    return with_model(features.select(*keys, row_id, *columns), model, keys, row_id, run, schema)


def sparse_isolation(index: Sequence[np.ndarray], value: Sequence[np.ndarray], trees, cells: int = 4_000_000) -> np.ndarray:
    """``isolation_score`` of sparse rows; only features that a tree asks for are laid out, ``cells`` at a time."""
    used = np.unique(np.concatenate([np.asarray(t["feature"], np.int64) for t in trees]))
    used = used[used >= 0]
    names = ("sample", "threshold", "left", "right", "rows")
    local = []
    for t in trees:
        f = np.asarray(t["feature"], np.int64)
        local.append({**{n: t[n] for n in names}, "feature": np.where(f >= 0, np.searchsorted(used, f), -1)})
    step, out = max(1, cells // max(len(used), 1)), np.zeros(len(index))
    for a in range(0, len(index), step):
        part, numbers = index[a:a + step], value[a:a + step]
        x = np.zeros((len(part), max(len(used), 1)))
        row = np.repeat(np.arange(len(part)), [len(i) for i in part])
        f, v = np.concatenate([np.zeros(0, np.int64), *part]).astype(np.int64), np.concatenate([np.zeros(0), *numbers])
        at = np.searchsorted(used, f)
        asked = at < len(used)
        asked[asked] = used[at[asked]] == f[asked]
        x[row[asked], at[asked]] = v[asked]
        out[a:a + step] = isolation_score(x, local)
    return out


def sparse_scores(features: DataFrame, model: DataFrame, keys: Sequence[str], row_id: str, vector: str = "vector") -> DataFrame:
    """(key, row id, isolation) for every row with a ``vector`` of (feature, value); groups are cut by entries as well as rows."""
    keys = list(keys)

    def run(rows: pd.DataFrame, trees: list) -> pd.DataFrame:
        known = trees and len(rows)
        s = sparse_isolation(rows["_index"].to_numpy(), rows["_value"].to_numpy(), trees) if known else np.full(len(rows), 0.5)
        return rows[[*keys, row_id]].assign(isolation=s)

    schema = _typed(features, [*keys, row_id]) + ", isolation double"
    weight = F.lit(1) + F.size("_index") / 32
    return with_model(_as_arrays(features, keys, row_id, vector), model, keys, row_id, run, schema, weight=weight)


def quantile_per_key(values: DataFrame, keys: Sequence[str], value: str, q: str, bins: int = 4096) -> DataFrame:
    """Exact interpolated quantile per key of values in [0, 1]; ``q`` is a column constant per key.

    One pass counts values per fixed bin; the bins that hold the wanted ranks are then the
    only rows looked at closely. Equal values are counted together first.
    """
    keys = list(keys)
    counts = (values.groupBy(*keys, q, value).agg(F.count("*").alias("n"))
              .withColumn("_bin", F.least(F.floor(F.col(value) * bins), F.lit(bins - 1))))
    bins_df = counts.groupBy(*keys, q, "_bin").agg(F.sum("n").alias("n"))
    run = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    placed = bins_df.withColumns({"_before": F.coalesce(F.sum("n").over(run), F.lit(0)), "_total": F.sum("n").over(whole)})
    rank = F.col(q) * (F.col("_total") - 1)
    placed = placed.withColumns({"_low": F.floor(rank), "_high": F.ceil(rank), "_part": rank - F.floor(rank)})
    wanted = placed.where((F.col("_before") + F.col("n") > F.col("_low")) & (F.col("_before") <= F.col("_high"))).drop("n", q)
    close = counts.join(wanted, [*keys, "_bin"])
    inside = Window.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    close = close.withColumn("_start", F.col("_before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    covers = lambda r: (F.col("_start") <= F.col(r)) & (F.col("_start") + F.col("n") > F.col(r))
    picked = close.groupBy(*keys).agg(F.max(F.when(covers("_low"), F.col(value))).alias("_a"),
                                      F.max(F.when(covers("_high"), F.col(value))).alias("_b"), F.max("_part").alias("_part"))
    return picked.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).alias("quantile"))


def offsets(scores: DataFrame, contamination: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Decision offset per key: the contamination quantile of minus the isolation score."""
    joined = scores.join(contamination.select(*keys, (F.lit(1.0) - F.col("contamination")).alias("_q")), list(keys))
    return quantile_per_key(joined, keys, "isolation", "_q").select(*keys, (-F.col("quantile")).alias("offset"))


def decide(scores: DataFrame, offset: DataFrame, keys: Sequence[str]) -> DataFrame:
    """decision (negative = anomaly), anomaly_score in [0, 1] and confidence."""
    d = F.col("decision")
    return (
        scores.join(offset, list(keys)).withColumn("decision", -F.col("isolation") - F.col("offset"))
        .withColumns({
            "anomaly_score": F.lit(1.0) / (F.lit(1.0) + F.exp(d * 20.0)),
            "confidence": F.least(F.abs(d) / F.lit(0.15), F.lit(1.0)),
            "is_anomaly": d < 0,
        }).drop("offset")
    )


def stability(decided: DataFrame, contamination: DataFrame, keys: Sequence[str]) -> DataFrame:
    """1 - |anomaly rate - contamination| per key."""
    rate = F.count_if("is_anomaly") / F.count("*")
    rates = decided.groupBy(*keys).agg(F.count("*").alias("n_samples"), rate.alias("anomaly_rate"))
    return rates.join(contamination.select(*keys, "contamination"), list(keys)).withColumn(
        "stability_score", F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(F.col("anomaly_rate") - F.col("contamination"))))


def fallback_score(severity: str | Column, mode: str | Column, has_model: Column, model_score: Column) -> dict[str, Column]:
    """Scores where no model applies: DUMMY mode is .5 throughout, no model uses severity."""
    dummy = as_col(mode) == "DUMMY"
    s = F.coalesce(as_col(severity), F.lit(0.5))
    score = F.when(dummy, 0.5).when(has_model, model_score).otherwise(s)
    return {
        "anomaly_score": score,
        "aro_suggested": F.when(dummy, 0.5).otherwise(score * 12.0),
        "model_used": F.when(dummy, "DUMMY").when(has_model, as_col(mode)).otherwise("FALLBACK_ISO27005"),
    }


def lateral_flag(pattern: str | Column, severity: str | Column) -> Column:
    return F.coalesce(as_col(pattern).isin("lateral_movement", "brute_force_success"), F.lit(False)) | (
        F.coalesce(as_col(severity), F.lit(0.0)) >= 0.8)


# --- attribution ---

def _leaf_games(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Shapley values of leaves with m path conditions, for every subset a row may meet.

    A leaf's game is a product over its features: factor 1 or 0 when the feature is known,
    its share of rows when it is not. The values follow from the polynomial in the number
    of known features. Result [leaf, c] belongs to rows whose met conditions are the bits
    of c.
    """
    leaves, m = weights.shape
    met = ((np.arange(2**m)[:, None] >> np.arange(m)) & 1).astype(float)
    out = np.zeros((leaves, 2**m, m))
    for j in range(m):
        poly = [np.ones((leaves, 2**m))]  # poly[s] = sum over sets of s known features without j
        for k in range(m):
            if k == j:
                continue
            grown = [c * weights[:, k, None] for c in poly] + [np.zeros((leaves, 2**m))]
            for s, c in enumerate(poly):
                grown[s + 1] = grown[s + 1] + c * met[:, k]
            poly = grown
        total, share = np.zeros((leaves, 2**m)), 1.0 / m  # share = s!(m-s-1)!/m!
        for s, c in enumerate(poly):
            total += share * c
            if s + 1 < m:
                share *= (s + 1) / (m - s - 1)
        out[:, :, j] = values[:, None] * (met[:, j] - weights[:, j, None]) * total
    return out


def _branches(tree, paths: dict, missing: bool, states: int) -> list:
    """Nodes whose branches part the leaves, each with the states that a row can have in it.

    A feature's state in a branch: outside the branch (if its path asks for the feature, or numbers
    may be missing), or the range between the branch's own thresholds. A branch is taken whole while
    its combinations of states are ``states`` at most, and otherwise its two halves are.
    """
    feature, threshold, left, right = tree["feature"], tree["threshold"], tree["left"], tree["right"]
    cuts: dict[int, dict] = {}
    for n in reversed(range(len(feature))):  # children come after their parent
        own: dict[int, set] = {}
        if feature[n] >= 0:
            own = {f: set(c) for f, c in cuts[left[n]].items()}
            for f, c in (*cuts[right[n]].items(), (feature[n], {threshold[n]})):
                own[f] = own[f] | c if f in own else set(c)
        cuts[n] = own
    out, stack = [], [0]
    while stack:
        n = stack.pop()
        kinds = [(f, np.array(sorted(cuts[n].get(f, ()))), missing or f in paths[n]) for f in sorted({*cuts[n], *paths[n]})]
        if feature[n] < 0 or np.prod([len(c) + 1.0 + outside for _, c, outside in kinds]) <= states:
            if kinds:
                out.append((n, kinds))
        else:
            stack += [left[n], right[n]]
    return out


def _tree_games(tree, n_features: int, missing: bool = False, states: int = STATES):
    """(places per feature, first table row of each branch, tables, base) of one tree.

    A feature's thresholds part its values into ranges; ``places`` says for each range (and last for
    no number) and branch what it adds to the row of the branch's table. Rows of the tables hold the
    sums over a branch's leaves of their values by feature, and last of the path length.
    """
    feature, threshold = np.asarray(tree["feature"]), np.asarray(tree["threshold"], dtype=float)
    left, right, rows = tree["left"], tree["right"], tree["rows"]
    paths: dict[int, dict] = {0: {}}
    by_size: dict[int, list] = {}
    for n in range(len(feature)):
        path = paths[n]
        if feature[n] < 0:
            by_size.setdefault(len(path), []).append(n)
            continue
        f = int(feature[n])
        low, high, weight = path.get(f, (-np.inf, np.inf, 1.0))
        paths[left[n]] = {**path, f: (low, min(high, threshold[n]), weight * rows[left[n]] / rows[n])}
        paths[right[n]] = {**path, f: (max(low, threshold[n]), high, weight * rows[right[n]] / rows[n])}
    depth = np.zeros(len(feature))
    for n in np.flatnonzero(feature >= 0).tolist():
        depth[[left[n], right[n]]] = depth[n] + 1
    value = depth + mean_path(np.asarray(rows))
    games, base = {}, 0.0
    for m, leaves in by_size.items():
        weights = np.array([[p[2] for p in paths[n].values()] for n in leaves]).reshape(len(leaves), m)
        base += float((value[leaves] * weights.prod(axis=1)).sum())
        if m:
            for n, game in zip(leaves, _leaf_games(value[leaves], weights), strict=True):
                games[n] = np.zeros((2**m, n_features + 1))
                games[n][:, list(paths[n])] = game
                games[n][-1, n_features] = value[n]

    branches = _branches(tree, paths, missing, states)
    used = {int(f): np.unique(threshold[feature == f]) for f in np.unique(feature[feature >= 0])}
    places = {f: np.zeros((len(cuts) + 2, len(branches)), np.int32) for f, cuts in used.items()}
    first, tables, at = [], [np.zeros((0, n_features + 1))], 0
    for k, (top, kinds) in enumerate(branches):
        shape = [len(c) + 1 + outside for _, c, outside in kinds]
        strides = np.append(np.cumprod(shape[::-1])[::-1][1:], 1).astype(np.int64)
        for (f, c, outside), stride in zip(kinds, strides.tolist(), strict=True):
            low, high, _ = paths[top].get(f, (-np.inf, np.inf, 1.0))
            begin = int(np.searchsorted(used[f], low)) + 1 if low > -np.inf else 0
            end = int(np.searchsorted(used[f], high)) + 1 if high < np.inf else len(used[f]) + 1
            ranges = np.arange(begin, end)
            places[f][begin:end, k] = (outside + np.searchsorted(np.searchsorted(used[f], c), ranges)) * stride
        table = np.zeros((int(np.prod(shape)), n_features + 1))
        stack = [top]
        while stack:
            n = stack.pop()
            if feature[n] >= 0:
                stack += [left[n], right[n]]
                continue
            met, bit = np.zeros(1, np.int64), 0
            for f, c, outside in kinds:
                one = np.zeros(len(c) + 1 + outside, np.int64)
                if f in paths[n]:
                    low, high, _ = paths[n][f]
                    one[outside + np.searchsorted(c, low, side="right"):outside + np.searchsorted(c, high) + 1] = 1 << list(paths[n]).index(f)
                met = np.add.outer(met, one).ravel()
            table += games[n].take(met, axis=0)
        first.append(at)
        tables.append(table)
        at += len(table)
    return [(f, cuts, places[f]) for f, cuts in used.items()], np.array(first, np.int32), np.concatenate(tables), base


def explained(x: np.ndarray, trees, n_features: int, step: int = 2_048, states: int = STATES) -> tuple[np.ndarray, float, np.ndarray]:
    """``shapley`` of each row, the mean path length that no feature is known for, and the mean path length of each row."""
    phi, base = np.zeros((len(x), n_features + 1)), 0.0
    missing = bool(np.isnan(x).any())
    for tree in trees:
        ranges, first, tables, alone = _tree_games(tree, n_features, missing, states)
        base += alone
        if not len(first):
            phi[:, n_features] += alone
            continue
        for a in range(0, len(x), step):
            part, out = x[a:a + step], phi[a:a + step]
            row = np.repeat(first[:, None], len(part), axis=1)
            for f, cuts, places in ranges:
                at = np.searchsorted(cuts, part[:, f])
                if missing:
                    at[np.isnan(part[:, f])] = len(cuts) + 1
                row += places.T.take(at, axis=1)
            for r in row:
                out += tables.take(r, axis=0)
    n = max(len(trees), 1)
    whole = np.mean([path_lengths(x, t) for t in trees], axis=0) if missing else phi[:, n_features] / n
    return phi[:, :n_features] / n, base / n, whole


def shapley(x: np.ndarray, trees, n_features: int, step: int = 2_048) -> np.ndarray:
    """Path-dependent Shapley values of the mean path length (Lundberg et al. 2018).

    A leaf has at most eight path conditions, so its values are tabulated per subset of
    met conditions; the tables of the leaves of a branch are added up per combination of the
    ranges that tell them apart, and every row just looks its combination up.
    """
    return explained(x, trees, n_features, step)[0]


def shap_attribution(features: DataFrame, model: DataFrame, keys: Sequence[str], row_id: str,
                     columns: Sequence[str] = rules.FEATURES) -> DataFrame:
    """Contribution of each feature to the mean path length (negative = more anomalous).

    ``features`` holds the rows to explain (incidents). ``base`` + the contributions =
    the row's mean path length, given as ``mean_path``.
    """
    keys, columns = list(keys), list(columns)

    def run(rows: pd.DataFrame, trees: list) -> pd.DataFrame:
        out = rows[[*keys, row_id]].copy()
        x = rows[columns].to_numpy(dtype=float)
        phi, base, whole = explained(x, trees, len(columns)) if trees and len(rows) else (np.zeros((len(rows), len(columns))), 0.0, 0.0)
        for i, c in enumerate(columns):
            out[c] = phi[:, i]
        out["base"], out["mean_path"] = base, whole
        return out

    schema = _typed(features, [*keys, row_id]) + ", " + ", ".join(f"{c} double" for c in columns) + ", base double, mean_path double"
    return with_model(features.select(*keys, row_id, *columns), model, keys, row_id, run, schema, group_rows=SHAP_ROWS)


def attribution_fallback(severity: str | Column, delta: str | Column) -> dict[str, Column]:
    from ..functions.numeric import round_to

    return {"severity_score": round_to((F.coalesce(as_col(severity), F.lit(0.5)) - 0.5) * 0.6, 4),
            "timestamp_delta": round_to(-F.coalesce(as_col(delta), F.lit(300.0)) / 10000.0, 4)}


def explain_incident(contributions: dict[str, Column]) -> Column:
    """Sentence for the feature with the largest absolute contribution; the first on ties."""
    from ..functions.text import by_key

    ranked = F.array(*[F.struct(F.abs(c).alias("size"), F.lit(-i).alias("o"), F.lit(name).alias("feature"))
                       for i, (name, c) in enumerate(contributions.items())])
    return by_key(F.array_max(ranked)["feature"], rules.EXPLANATIONS, rules.EXPLANATION_DEFAULT)


def model_versions(versions: DataFrame, keep: int = 3) -> DataFrame:
    """Versions per client, newest first, with is_active (newest) and to_delete (beyond ``keep``)."""
    w = Window.partitionBy("client_id").orderBy(F.desc("version"))
    ranked = versions.withColumn("position", F.row_number().over(w))
    return ranked.withColumns({"is_active": F.col("position") == 1, "to_delete": F.col("position") > keep})
