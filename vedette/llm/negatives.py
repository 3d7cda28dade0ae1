"""Hard negatives by threshold joins over an inverted index with norm bounds.

Rows are dealt into packs of bounded size, anchors into chunks; every pack meets every chunk
(a stated query set against all rows, in blocks). Inside such a block:

* the pack's dimensions are ordered by their weight, and a row is listed only under those that
  come before the point where the norm of its remaining suffix falls under the threshold that
  the chunk still asks for, divided by the anchor's norm: a pair that reaches the threshold
  must then share a listed dimension (Cauchy-Schwarz);
* partial scores are added up list by list, and a pair is dropped as soon as its partial score
  plus the product of the two remaining norms is under its anchor's threshold;
* what is left is scored exactly, in whole numbers, and only the first rows that a window can
  still use leave the block, so what is shuffled is bounded by anchors and packs.

Thresholds begin high. Anchors whose windows are full are done; for the others the threshold is
lowered and the join runs again, in the end down to where nothing can be missed. A threshold
only says where the search stops: the rows above it are all seen, so results are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage, spread, widen
from .common import stored

#: Bytes of numbers in a pack, and anchors in a chunk.
PACK, CHUNK = 4_000_000, 1_024
#: Dimensions whose lists are added up between two prunings, and anchors that go through them together.
LISTS, TOGETHER = 8, 16
#: Thresholds as shares of the largest score that norms allow; from the last one nothing is left out.
SHARES = (0.6, 0.4, 0.25, 0.0, -1.0)
#: Components beyond this are set to it, so that scores stay whole 64-bit numbers.
LARGEST = 2**25

_index: dict[int, tuple] = {}


def whole_vector(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double; null if the vector or a component is null or not finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    numbers = F.transform(vector, lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), F.lit(-LARGEST)), F.lit(LARGEST)))
    return F.when(vector.isNotNull() & ~odd, numbers)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors as rows, in the smallest whole numbers that hold them; short ones end in zeros."""
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64), vectors.value_lengths().to_numpy(zero_copy_only=False)
    width = int(ends.max()) if len(ends) else 0
    if (ends == width).all():
        out = flat.reshape(len(ends), width)
    else:
        out = np.zeros((len(ends), width), np.int64)
        out[np.arange(width) < ends[:, None]] = flat
    most = np.abs(out).max(initial=0)
    return out.astype(np.int16 if most < 2**15 else np.int32)


def _packed(size: int):
    """Rows (id, label, vector) laid together, ``size`` bytes of numbers or CHUNK rows at a time."""
    def one(number: int, rows: pa.Table):
        m = _matrix(rows["vector"].combine_chunks())
        column = {c: pa.array([rows[c].to_pylist()], pa.list_(rows.schema.field(c).type)) for c in rows.column_names if c != "vector"}
        return pa.record_batch({"pack": pa.array([number]), **column, "width": pa.array([m.shape[1]], pa.int32()),
                                "bytes": pa.array([m.itemsize], pa.int32()), "numbers": pa.array([m.tobytes()], pa.binary())})

    def run(batches):
        held, n, weight = [], 0, 0
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            for start in range(0, len(batch), CHUNK):
                part = batch.slice(start, CHUNK)
                held.append(part)
                weight += 4 * len(part["vector"].flatten()) + 64 * len(part)
                if weight >= size or not size:
                    yield one(number + n, pa.Table.from_batches(held))
                    held, n, weight = [], n + 1, 0
        if held:
            yield one(number + n, pa.Table.from_batches(held))

    return run


def _numbers(row: dict, n: int) -> np.ndarray:
    return np.frombuffer(row["numbers"], np.int16 if row["bytes"] == 2 else np.int32).reshape(n, row["width"])


def _rest(squares: np.ndarray) -> np.ndarray:
    """Norm of what remains from each group of lists on, along axis 0."""
    groups = np.add.reduceat(squares, np.arange(0, len(squares), LISTS), axis=0) if len(squares) else squares
    return np.sqrt(np.concatenate([np.cumsum(groups[::-1], axis=0)[::-1], np.zeros((1, squares.shape[1]))]))


class Index:
    """A pack: lists by dimension, heaviest first, and the norms that remain after each group of them."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, labels: list[str]):
        self.numbers, self.ids = numbers, ids
        self.codes = {v: k for k, v in enumerate(dict.fromkeys(labels))}
        self.labels = np.array([self.codes[v] for v in labels])
        self.order = np.argsort(-(numbers.astype(np.float64) ** 2).sum(axis=0), kind="stable")
        self.lists = numbers[:, self.order].T.astype(np.float64)
        self.rest = _rest(self.lists**2)

    def candidates(self, anchors: np.ndarray, floors: np.ndarray):
        """(anchor, row) of all pairs whose score may reach the anchor's floor, some at a time."""
        q = anchors[:, self.order].T.astype(np.float64)  # dimension, anchor
        q_rest = _rest(q**2)
        norm = np.maximum(q_rest[0], 1e-300)
        slack = 1e-9 * (q_rest[0].max(initial=0) * self.rest[0].max(initial=0) + 1)
        asked = (floors - slack) / norm
        listed = (self.rest[:-1] >= asked.min()).sum(axis=0) if len(self.rest) > 1 else np.zeros(len(self.ids), np.int64)
        by_length = np.argsort(-listed, kind="stable")
        if asked.min() > 0:
            by_length = by_length[:int((listed > 0).sum())]  # what no list holds cannot reach any floor
        for at in range(0, len(floors), TOGETHER):
            mine = slice(at, at + TOGETHER)
            rows, length = by_length, listed[by_length]
            lists, rest = self.lists[:, rows], self.rest[:, rows]
            total, floor = np.zeros((len(floors[mine]), len(rows))), floors[mine, None] - slack
            alive = total + q_rest[0][mine, None] * rest[0] >= floor
            for g in range(len(self.rest) - 1):
                n = int(np.searchsorted(-length, -g, side="left"))  # rows listed in this group come first
                if n == 0:
                    break
                dims = slice(g * LISTS, (g + 1) * LISTS)
                total[:, :n] += q[dims, mine].T @ lists[dims, :n]
                alive[:, :n] &= total[:, :n] + q_rest[g + 1][mine, None] * rest[g + 1, :n] >= floor
                kept = alive.any(axis=0)
                if 2 * kept.sum() < len(kept):
                    rows, length, total, alive = rows[kept], length[kept], total[:, kept], alive[:, kept]
                    lists, rest = lists[:, kept], rest[:, kept]
            a, r = np.nonzero(alive)
            yield a + at, rows[r]

    def scores(self, anchors: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), np.int64)
        for i in range(0, len(a), 50_000):
            part = slice(i, i + 50_000)
            out[part] = np.einsum("ij,ij->i", self.numbers[r[part]].astype(np.int64), anchors[a[part]].astype(np.int64))
        return out


def _search(most: int, low: int, high: int):
    """For each block, the first ``most`` rows of each window: (anchor, ceiling, score, id).

    An anchor without ceilings asks for its own label, at any score from its floor on; with
    ceilings, for other labels, each window from ``low`` to ``high`` hundredths of a ceiling.
    """
    def index(row: dict) -> Index:
        if row["pack"] not in _index:
            _index.clear()
            _index[row["pack"]] = Index(_numbers(row, len(row["id"])), np.array(row["id"], np.int64), row["label"])
        return _index[row["pack"]]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                here = index(row)
                asked = _numbers({"numbers": row["a_numbers"], "width": row["a_width"], "bytes": row["a_bytes"]}, len(row["anchor"]))
                width = here.numbers.shape[1]
                anchors = np.zeros((len(asked), width), np.int64)
                anchors[:, :min(width, row["a_width"])] = asked[:, :width]
                floors, own = np.array(row["floor"], np.float64), np.array(row["a_id"], np.int64)
                mine = np.array([here.codes.get(v, -1) for v in row["a_label"]])
                out = []
                for a, r in here.candidates(anchors, floors):
                    other = here.ids[r] != own[a]
                    same = here.labels[r] == mine[a]
                    ceilings = np.array([row["ceilings"][k] is not None for k in range(len(asked))])[a]
                    a, r = (x[other & (same != ceilings)] for x in (a, r))
                    s = here.scores(anchors, a, r)
                    good = s >= floors[a]
                    a, r, s = a[good], r[good], s[good]
                    order = np.lexsort((here.ids[r], -s, a))
                    a, r, s = a[order], r[order], s[order]
                    for k in np.unique(a).tolist():
                        i, j = np.searchsorted(a, [k, k + 1])
                        for top in row["ceilings"][k] or [None]:
                            first, last = i, j
                            if top is not None:  # scores fall
                                first = i + int(np.searchsorted(-s[i:j], -(high * top // 100)))
                                last = i + int(np.searchsorted(-s[i:j], low * -top // 100, side="right"))
                            for x in range(first, min(last, first + most)):
                                out.append((row["anchor"][k], top, int(s[x]), int(here.ids[r[x]])))
                yield pa.record_batch([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 4)],
                                      names=["anchor", "ceiling", "score", "id"])

    return run


def _join(packs: DataFrame, groups: int, anchors: DataFrame, most: int, low: int, high: int) -> DataFrame:
    """First rows of each window over all packs: (anchor, ceiling, score, id, rank)."""
    kind = ("pack long, anchor array<long>, a_id array<long>, a_label array<string>, floor array<double>, "
            "ceilings array<array<long>>, width int, bytes int, numbers binary")
    asked = anchors.select("anchor", F.col("id").alias("a_id"), F.col("label").alias("a_label"), "floor", "ceilings", "vector")
    chunks = asked.mapInArrow(_packed(0), kind).withColumnsRenamed({"width": "a_width", "bytes": "a_bytes", "numbers": "a_numbers"})
    chunks = chunks.drop("pack").withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    packs = packs.withColumn("_g", F.pmod(F.xxhash64("pack"), F.lit(groups)).cast("int"))
    blocks = spread(packs, "_g").join(spread(chunks, "_g"), "_g").drop("_g")  # few bytes, much work: not to be merged
    found = blocks.mapInArrow(_search(most, low, high), "anchor long, ceiling long, score long, id long")
    first = Window.partitionBy("anchor", "ceiling").orderBy(F.desc("score"), "id")
    return cut_lineage(found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most))


def hard_negatives(rows: DataFrame, anchors: Column, id: str = "id", vector: str = "vector", label: str = "label",
                   positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                   shares: Sequence[float] = SHARES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``anchors`` marks.

    ``vector`` holds whole numbers; a score is the inner product with the anchor (what one vector
    lacks in length counts as 0), higher ones come first, ties by the smaller id. An anchor's
    positives are its first ``positives`` rows of the same label and another id; for each of them
    come the first ``negatives`` rows of other labels with ``low * positive score <= 100 * score
    <= high * positive score``. Rows with a null id, label, vector or component take no part.
    Every other row counts, also if it repeats an id or a whole row; anchors repeated as a whole
    are one. A positive score under 0 has an empty window, one of 0 takes scores of 0. Without
    anchors or rows the result is empty. Other columns are not looked at.
    """
    if shares[-1] > -1:
        raise ValueError("the last threshold must leave nothing out")
    here = rows.select(F.col(id).cast("long").alias("id"), F.col(label).cast("string").alias("label"),
                       F.col(vector).cast("array<long>").alias("vector"), anchors.alias("asks"))
    here = here.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
                      & ~F.exists("vector", lambda x: x.isNull()))
    wide = widen(here.select("id", "label", "vector"))
    kind = "pack long, id array<long>, label array<string>, width int, bytes int, numbers binary"
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    with stored(wide.mapInArrow(_packed(PACK), kind)) as packs:
        groups = max(1, packs.count())
        largest = here.agg(F.max(norm)).first()[0] or 0.0
        asked = cut_lineage(here.where("asks").select("id", "label", "vector").distinct()
                            .withColumn("anchor", F.monotonically_increasing_id()))
        none = F.lit(None).cast("array<long>")
        todo, near = asked, None
        for share in shares:
            floor = F.floor(norm * (largest * share * (1 + 1e-9))) - 1 if share < 0 else F.ceil(norm * (largest * share))
            found = _join(packs, groups, todo.withColumns({"floor": floor.cast("double"), "ceilings": none}), positives, low, high)
            if share == shares[-1]:
                near = found if near is None else near.union(found)
                break
            full = found.where(F.col("rank") == positives).select("anchor")
            kept = found.join(full, "anchor", "left_semi")
            near = kept if near is None else near.union(kept)
            todo = cut_lineage(todo.join(full, "anchor", "left_anti"))
            if todo.isEmpty():
                break
        near = near.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        windows = near.where("positive_score >= 0").groupBy("anchor").agg(
            F.sort_array(F.collect_set("positive_score")).alias("ceilings"))  # at most one for each positive
        todo, hard = asked.join(windows, "anchor"), None
        for share in ((low + 3 * high) / 400, low / 100):
            last = share == low / 100
            bottom = F.floor(F.element_at("ceilings", 1) * (share * (1 - 1e-9))) - 1  # under the lowest window
            at = todo.withColumn("floor", (bottom if last else F.ceil(F.element_at("ceilings", -1) * share)).cast("double"))
            found = _join(packs, groups, at, negatives, low, high)
            if last:
                hard = found if hard is None else hard.union(found)
                break
            full = found.where(F.col("rank") == negatives).groupBy("anchor").agg(F.count("*").alias("full"))
            full = at.join(full, "anchor").where(F.col("full") == F.size("ceilings")).select("anchor")
            hard = found.join(full, "anchor", "left_semi")
            todo = cut_lineage(todo.join(full, "anchor", "left_anti"))
            if todo.isEmpty():
                break
        out = near.join(hard.withColumnRenamed("ceiling", "positive_score"), ["anchor", "positive_score"])
        out = out.join(asked.select("anchor", F.col("id").alias("anchor_id")), "anchor")
        return cut_lineage(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
                                      F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
