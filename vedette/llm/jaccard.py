"""Exact n-gram Jaccard join in the metric space of shingle sets.

Jaccard distance is a metric. Texts link where the distance of their sets of word shingles is
at most t; what is asked for is the groups that links connect, so two texts that a third
already connects need no comparison of their own.

1. Every text becomes a set of hashed shingles; equal sets are one point. A point's sketch
   counts its shingles by the upper bits of the hash. The absolute differences of two sketches
   sum up to a metric that never exceeds the symmetric difference of the sets, so a pair whose
   sketches differ too much cannot link.
2. Unrelated texts are at distance 1 from every pivot, so pivots alone part nothing. The space
   is first cut by the pivots that can tell texts apart, single shingles: two sets that link
   share one of the first n - ceil((1 - t) n) + 1 shingles of each in any common order. Shingles
   that are frequent in some task's share of the texts come last in that order, so passages
   that many texts share do not gather them.
3. Within the cell of a shingle, points of like size are paired (cells of up to ``small``
   points). In larger cells pivots are drawn one after the other; each is compared by sketch
   with the points that nothing connects to it yet and connects those within reach. In cells too
   large for a task it takes the points within reach out of the next rounds, and connects
   those within two reaches, where partners of the points it took must lie.
4. Connected by pairs that pass the sketches, points form regions that no link leaves. In each,
   distances to pivots are computed exactly and kept: a later pivot is compared only with the
   points whose known distances differ from its own by at most t (triangle inequality), and not
   with points that links already connect to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .common import only_memory, whole_text

MULTIPLIER, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Frequent shingles that are put last, at most (1.6 MB); it affects the work, never the result.
DEMOTED = 200_000

def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\r\x0b\x0c")] = True
#: A number for each byte, the same for A-Z and a-z.
_LETTER = _mixed(_mixed(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER))
_LETTER[65:91] = _LETTER[97:123]
#: Words up to so many bytes are hashed together, as polynomials; repetitive longer ones could collide in those.
SHORT = 64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


#: Bytes of texts that are hashed together.
TOGETHER = 1 << 17

#: Powers of an odd number and of its inverse modulo 2 ** 64, for places in a stretch of text.
STRETCH = 1 << 14
_BASE = 0xD1342543DE82EF95
_UP, _DOWN = _powers(_BASE, STRETCH + 1), _powers(pow(_BASE, -1, 1 << 64), STRETCH + 1)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and start of each word of a text in UTF-8, A-Z in lower case; words stand between ASCII blanks.

    Hashes of short words are differences of prefix sums of one polynomial, shifted to place 0.
    """
    codes = np.frombuffer(data, np.uint8)
    blank = np.ones(len(codes) + 2, bool)
    blank[1:-1] = _BLANK[codes]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edges[::2], edges[1::2]
    size = end - start
    out = np.empty(len(start), np.uint64)
    letters = _LETTER[codes]
    short = np.flatnonzero(size <= SHORT)
    first, last = start[short], end[short]
    cut = 0
    while cut < len(short):
        at = int(first[cut])
        after = int(np.searchsorted(last, at + STRETCH, side="right"))  # words that end within the stretch
        part = letters[at:int(last[after - 1])]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _UP[:len(part)], out=sums[1:])
        a, b = first[cut:after] - at, last[cut:after] - at
        out[short[cut:after]] = _mixed((sums[b] - sums[a]) * _DOWN[a] + (b - a).astype(np.uint64) * MULTIPLIER)
        cut = after
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i]:end[i]].lower())
    return out, start


def _runs_of(h: np.ndarray, k: int) -> np.ndarray:
    s = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        s = _mixed(s * MULTIPLIER + h[i:len(h) - k + 1 + i])
    return s


def _distinct(s: np.ndarray) -> np.ndarray:
    s = np.sort(s)
    fresh = s[1:] != s[:-1]
    return s if fresh.all() else s[np.append(True, fresh)]


def shingle_sets(texts: Iterable[str], words: int = 5) -> Iterator[np.ndarray]:
    """``shingles`` of each text; short texts are hashed together, up to ``TOGETHER`` bytes at a time."""
    def sets(parts: list[bytes]):
        h, start = word_hashes(b" ".join(parts))
        cuts = np.searchsorted(start, np.cumsum([0, *[len(p) + 1 for p in parts]])).tolist()
        runs = _runs_of(h, words) if len(h) >= words else h[:0]
        for a, b in zip(cuts, cuts[1:]):
            if b - a >= words:
                yield _distinct(runs[a:b - words + 1])
            else:
                yield _runs_of(h[a:b], b - a) if b > a else h[:0]

    held, size = [], 0
    for text in texts:
        held.append(text.encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= TOGETHER:
            yield from sets(held)
            held, size = [], 0
    if held:
        yield from sets(held)


def shingles(text: str, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words, A-Z in lower case.

    Words are what stands between blanks, tabs and line breaks. Fewer words than that are
    one shingle, none give an empty set.
    """
    return next(shingle_sets([text], words))


def signature(s: np.ndarray) -> int:
    """Hash of a whole set, as a signed number."""
    return int(np.frombuffer(xxhash.xxh3_64_digest(s.tobytes()), ">i8")[0])


def sketch(s: np.ndarray) -> bytes:
    bits = max(4, (len(s) // 8).bit_length())
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    x, y = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (a, b))
    while len(x) > len(y):
        x = x.reshape(-1, 2).sum(axis=1)
    while len(y) > len(x):
        y = y.reshape(-1, 2).sum(axis=1)
    return int(np.abs(x - y).sum())


class Threshold:
    """Similarity of at least ``percent`` in a hundred, in whole numbers."""

    def __init__(self, percent: int):
        self.percent = percent

    def links(self, common: int, n: int, m: int) -> bool:
        return 100 * common >= self.percent * (n + m - common)

    def may_differ(self, n: int, m: int) -> int:
        """Largest symmetric difference of linked sets of these sizes."""
        return (100 - self.percent) * (n + m) // (100 + self.percent)

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1


def _points(text: pa.Array, doc_id: pa.Array, words: int):
    only_memory("jaccard", lambda: None)
    sets = list(shingle_sets((t.as_py() or "" for t in text), words))
    return pa.record_batch({
        "doc_id": doc_id, "sig": pa.array([signature(s) if len(s) else None for s in sets], pa.int64()),
        "n": pa.array([len(s) for s in sets], pa.int64()), "sketch": pa.array([sketch(s) for s in sets], pa.binary()),
        "frequent": pa.array([None] * len(sets), pa.int64()), "times": pa.array([None] * len(sets), pa.int64()),
        "md5": pa.array([hashlib.md5(t.as_py() or b"").digest() for t in text.cast(pa.binary())], pa.binary())}), sets


def _describe(words: int, percent: int, id_type: pa.DataType):
    """One row per text, and the shingles that are frequent in this task's share, among those that can come first."""
    limit = Threshold(percent)

    def run(batches):
        held, counts, seen, texts = [], (np.zeros(0, np.uint64), np.zeros(0, np.int64)), set(), 0

        def fold(counts):
            keys, times = np.unique(np.concatenate(held), return_counts=True) if held else counts
            if held:
                keys, where = np.unique(np.concatenate([counts[0], keys]), return_inverse=True)
                times = np.bincount(where, np.concatenate([counts[1], times])).astype(np.int64)
                held.clear()
            return keys, times

        size = 0
        for batch in batches:
            rows, sets = _points(batch["text"], batch["doc_id"], words)
            yield rows
            for s, sig in zip(sets, rows["sig"].to_pylist(), strict=True):
                texts += 1
                if sig is not None and sig not in seen:  # copies do not make a shingle frequent
                    seen.add(sig)
                    held.append(s[:limit.prefix(len(s)) * 3 // 2 + 8])
                    size += len(held[-1])
            if size > 3_000_000:
                counts = fold(counts)
                keep = counts[1] > 1 if len(counts[0]) > 3_000_000 else np.ones(len(counts[0]), bool)
                counts, size = (counts[0][keep], counts[1][keep]), 0
        keys, times = fold(counts)
        often = times >= max(4, texts // 2_000)
        keys, times = keys[often], times[often]
        none = pa.array([None] * len(keys), pa.int64())
        yield pa.record_batch({
            "doc_id": pa.array([None] * len(keys), id_type), "sig": none, "n": none,
            "sketch": pa.array([None] * len(keys), pa.binary()), "frequent": pa.array(keys.view(np.int64)),
            "times": pa.array(times), "md5": pa.array([None] * len(keys), pa.binary())})

    return run


def _cells(words: int, percent: int, last: np.ndarray):
    """(shingle, point, size) for the shingles of each point that come first; a point once per task."""
    limit = Threshold(percent)

    def run(batches):
        seen = set()
        for batch in batches:
            keys, sigs, sizes = [np.zeros(0, np.uint64)], [], []
            for s in shingle_sets((t.as_py() or "" for t in batch["text"]), words):
                if len(s) == 0 or (sig := signature(s)) in seen:
                    continue
                seen.add(sig)
                at = np.minimum(np.searchsorted(last, s), max(0, len(last) - 1))
                late = last[at] == s if len(last) else np.zeros(len(s), bool)
                first = np.concatenate([s[~late], s[late]])[:limit.prefix(len(s))]
                keys.append(first)
                sigs += [sig] * len(first)
                sizes += [len(s)] * len(first)
            yield pa.record_batch({"key": pa.array(np.concatenate(keys).view(np.int64)), "sig": pa.array(sigs, pa.int64()),
                                   "n": pa.array(sizes, pa.int32())})

    return run


def _pairs(percent: int, small: int):
    """Pairs of like size in each small cell (a < b), and the points of larger cells; rows come sorted by key and size."""
    def emit(key, sig, n):
        if len(key) == 0:
            return None
        fresh = np.ones(len(key), bool)  # a point that several tasks sent
        fresh[1:] = (key[1:] != key[:-1]) | (sig[1:] != sig[:-1]) | (n[1:] != n[:-1])
        key, sig, n = key[fresh], sig[fresh], n[fresh]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.repeat(np.diff(np.append(begin, len(key))), np.diff(np.append(begin, len(key))))
        large, few = size > small, (size > 1) & (size <= small)
        k, s, m = key[few], sig[few], n[few]
        left, right = [], []
        for d in range(1, small):
            same = np.flatnonzero(k[d:] == k[:-d]) if len(k) > d else np.zeros(0, np.int64)
            if len(same) == 0:
                break
            same = same[100 * m[same] >= percent * m[same + d]]
            left.append(np.minimum(s[same], s[same + d]))
            right.append(np.maximum(s[same], s[same + d]))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        _, once = np.unique(a.view(np.uint64) * MULTIPLIER + _mixed(b.view(np.uint64)), return_index=True)
        a, b = a[once], b[once]
        return pa.record_batch({
            "a": pa.array(np.concatenate([a, sig[large]])),
            "b": pa.array(np.concatenate([b, np.zeros(large.sum(), np.int64)])),
            "cell": pa.array(np.concatenate([np.zeros(len(a), np.int64), key[large]]),
                             mask=np.concatenate([np.ones(len(a), bool), np.zeros(large.sum(), bool)]))})

    def run(batches):
        rest = None
        for batch in batches:
            now = [batch[c].to_numpy(zero_copy_only=False) for c in ("key", "sig", "n")]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            rest = [x[cut:] for x in now]
            if (out := emit(*[x[:cut] for x in now])) is not None:
                yield out
        if rest is not None and (out := emit(*rest)) is not None:
            yield out

    return run


def _forest(batches):
    """Of what this task's edges connect, each node with the smallest one."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        top = i
        while (up := root.get(top, top)) != top:
            top = up
        while i != top:
            root[i], i = top, root.get(i, i)
        return top

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = list(root)  # smallest ones are not among them
    for i in range(0, len(nodes), 10_000):
        part = nodes[i:i + 10_000]
        yield pa.record_batch({"a": pa.array([find(k) for k in part], pa.int64()), "b": pa.array(part, pa.int64())})


def thinned(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """Edges (a, b) that connect the same nodes: a dense group keeps about as many as it has nodes.

    Partitions (``parts`` of them; counting those of a plan that is not stored yet runs it) are
    taken sixteen at a time, so that edges of a group meet.
    """
    parts = edges.rdd.getNumPartitions() if parts is None else parts
    return edges.coalesce(max(1, parts // 16)).mapInArrow(_forest, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the undirected edges (a, b): the smallest node that a path reaches.

    Each round every node takes the smallest root around it, then the root of its root.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    roots = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root"))
                        .select(F.col("a").alias("node"), "root"))
    while True:
        around = (both.join(roots, both["b"] == roots["node"]).groupBy("a").agg(F.min("root").alias("near")))
        near = (roots.join(around, roots["node"] == around["a"])
                .select("node", "root", F.least("root", "near").alias("next")))
        jump = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        moved = cut_lineage(near.join(jump, near["next"] == jump["_n"], "left")
                            .select("node", "root", F.least("next", F.coalesce("_r", "next")).alias("next")))
        if not moved.where(F.col("next") != F.col("root")).limit(1).count():
            return moved.select("node", F.col("next").alias("root"))
        roots = moved.select("node", F.col("next").alias("root"))


def _passes(percent: int, between: bool = False):
    """Whether sketches leave room for a link; ``between``: for links of both to a third point."""
    limit = Threshold(percent)

    def fits(x: int, y: int) -> int:
        if not between:
            return limit.may_differ(x, y) if 100 * min(x, y) >= percent * max(x, y) else -1
        third = 100 * min(x, y) // percent  # the largest that links with both
        return limit.may_differ(x, third) + limit.may_differ(third, y) if 100 * third >= percent * max(x, y) else -1

    @F.arrow_udf("boolean")
    def ok(n: pa.Array, a: pa.Array, m: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([(most := fits(x, y)) >= 0 and sketch_distance(p, q) <= most
                         for x, p, y, q in zip(n.to_pylist(), a.to_pylist(), m.to_pylist(), b.to_pylist(), strict=True)])

    return ok


def _cell(percent: int):
    """Pairs that connect what lies within sketch reach in one cell; each point is a pivot for those not connected to it yet."""
    limit = Threshold(percent)

    def fold(m: np.ndarray) -> np.ndarray:
        return m.reshape(len(m), -1, 2).sum(axis=2)

    def run(cell: pa.Table) -> pa.Table:
        sig, n = cell["sig"].to_numpy(), cell["n"].to_numpy()
        sketches = cell["sketch"].to_pylist()
        size = np.array([len(x) for x in sketches])
        level, place = {}, np.zeros(len(sig), np.int64)
        for m in np.unique(size).tolist():  # points by the length of their sketch
            mine = np.flatnonzero(size == m)
            place[mine] = np.arange(len(mine))
            own = np.frombuffer(b"".join(sketches[i] for i in mine), np.uint8).reshape(len(mine), m).astype(np.int32)
            level[m] = (mine, own, fold(own))
        group = np.arange(len(sig))
        left, right = [], []
        for p in np.argsort(_mixed(sig.view(np.uint64))).tolist():
            m = int(size[p])
            own = level[m][1][place[p]]
            for other, points, pivot in ((m, 1, own), (2 * m, 2, own), (m // 2, 1, fold(own[None])[0])):
                if other not in level:
                    continue
                mine = level[other][0]
                todo = np.flatnonzero((group[mine] != group[p]) & (100 * np.minimum(n[mine], n[p]) >= percent * np.maximum(n[mine], n[p])))
                if len(todo) == 0:
                    continue
                mine = mine[todo]
                near = np.abs(level[other][points][todo] - pivot).sum(axis=1)
                reached = mine[near <= (100 - limit.percent) * (n[mine] + n[p]) // (100 + limit.percent)]
                if len(reached) == 0:
                    continue
                group[np.isin(group, group[reached])] = group[p]
                left.append(np.minimum(sig[reached], sig[p]))
                right.append(np.maximum(sig[reached], sig[p]))
        if not left:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        return pa.table({"a": pa.array(np.concatenate(left), pa.int64()), "b": pa.array(np.concatenate(right), pa.int64())})

    return run


def _large_cells(members: DataFrame, points: DataFrame, percent: int, medium: int) -> DataFrame:
    """Pairs (a, b) that connect what lies within sketch reach in cells (cell, sig) of any size.

    Cells of up to ``medium`` points are one group each. In larger ones a round draws one pivot
    per cell, and the join meets the cell's points with that one row, so the cell is spread over
    tasks; points in nobody's reach become pivots in turn. A point that links with one in a
    pivot's reach lies within two reaches of the pivot (triangle inequality) and is connected
    with it too, so no link leaves a region.
    """
    members = cut_lineage(members.distinct())
    huge = cut_lineage(members.groupBy("cell").count().where(F.col("count") > medium).select("cell"))
    usual = members.join(huge, "cell", "left_anti").join(points, "sig")
    out = usual.groupBy("cell").applyInArrow(_cell(percent), "a long, b long").distinct()
    every = cut_lineage(members.join(huge, "cell").join(points, "sig"))
    left, ok, may = every, _passes(percent), _passes(percent, between=True)
    while left.limit(1).count():
        pivots = left.groupBy("cell").agg(F.min(F.struct(F.xxhash64("sig").alias("h"), "sig", "n", "sketch")).alias("p"))
        sides = [F.col("n"), F.col("sketch"), F.col("p.n"), F.col("p.sketch")]
        near = cut_lineage(every.join(pivots, "cell").where(may(*sides)).select("cell", "sig", F.col("p.sig").alias("pivot"), ok(*sides).alias("taken")))
        out = out.union(near.where("sig != pivot").select(F.least("sig", "pivot").alias("a"), F.greatest("sig", "pivot").alias("b")))
        left = cut_lineage(left.join(near.where("taken").select("cell", "sig"), ["cell", "sig"], "left_anti"))
    return out


def join_region(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set the place of the first one that links connect it to, by pivots and the triangle inequality."""
    n = len(sets)
    group = np.arange(n)  # place of the first known member
    size = np.array([len(s) for s in sets])
    _, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    by_token = np.argsort(tokens, kind="stable")
    start = np.searchsorted(tokens[by_token], np.arange(tokens.max() + 2))
    at = np.cumsum(size) - size
    known = np.zeros((0, n))  # distances of earlier pivots to all points
    reach = 1 - percent / 100 + 1e-9
    for p in range(n):
        todo = group != group[p]
        todo[:p] = False  # earlier pivots have been compared with this point
        if len(known):
            todo &= (np.abs(known - known[:, p:p + 1]) <= reach).all(axis=0)
        if not todo.any():
            continue
        near = np.concatenate([owner[by_token[start[x]:start[x + 1]]] for x in tokens[at[p]:at[p] + size[p]]])
        common = np.bincount(near, minlength=n)
        for i in np.flatnonzero(todo & (100 * common >= percent * (size + size[p] - common))):
            a, b = sorted((group[i], group[p]))
            if a != b:
                group[group == b] = a
        if len(known) < 16:
            known = np.vstack([known, 1 - common / (size + size[p] - common)])
    return group.tolist()


def _region(words: int, percent: int):
    def run(region: pa.Table) -> pa.Table:
        points = {}
        for sig, text in zip(region["sig"].to_pylist(), region["text"], strict=True):
            if sig not in points and signature(s := shingles(text.as_py(), words)) == sig:  # ids may repeat
                points[sig] = s
        sigs = sorted(points)
        first = join_region([points[sig] for sig in sigs], percent)
        return pa.table({"sig": pa.array(sigs, pa.int64()), "root": pa.array([sigs[i] for i in first], pa.int64())})

    return run


def near_groups(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80,
                small: int = 64, medium: int = 8_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the size of its set and the smallest id that links reach.

    Texts link where ``100 * common >= percent * union`` of their shingles. Null and empty
    texts and texts without words have size 0, link with nothing and are their own component;
    rows that share an id and a text are returned each. Rows without an id belong to the
    component of their text, whose id is null only if no row of it has one. Shingles are
    told apart by 64-bit hashes.
    """
    return _groups(docs, doc, text, words, percent, small, medium).drop("md5")


def _groups(docs: DataFrame, doc: str, text: str, words: int = 5, percent: int = 80, small: int = 64, medium: int = 8_000) -> DataFrame:
    """The rows of ``near_groups``, with the MD5 of their text."""
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    kind = "doc_id long, sig long, n long, sketch binary, frequent long, times long, md5 binary"
    described = cut_lineage(rows.mapInArrow(_describe(words, percent, pa.int64()), kind))
    texts = described.where("n is not null").select("doc_id", "sig", "n", "sketch", "md5")
    often = (described.where("frequent is not null").groupBy("frequent").agg(F.sum("times").alias("times"))
             .orderBy(F.desc("times"), "frequent").limit(DEMOTED))
    last = np.sort(np.array([r[0] for r in often.select("frequent").collect()], dtype=np.int64).view(np.uint64))
    points = texts.where("sig is not null").groupBy("sig").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    cells = (rows.mapInArrow(_cells(words, percent, last), "key long, sig long, n int")
             .repartition("key").sortWithinPartitions("key", "n", "sig"))
    found = cut_lineage(cells.mapInArrow(_pairs(percent, small), "a long, b long, cell long"))
    pairs = found.where("cell is null").select("a", "b").distinct()
    narrow = points.select("sig", "n", "sketch")

    def side(c: str) -> DataFrame:
        return narrow.select(F.col("sig").alias(c), F.struct("n", "sketch").alias(f"{c}_"))

    ok = _passes(percent)
    near = (pairs.join(side("a"), "a").join(side("b"), "b")
            .where(ok(F.col("a_.n"), F.col("a_.sketch"), F.col("b_.n"), F.col("b_.sketch"))).select("a", "b"))
    large = found.where("cell is not null").select("cell", F.col("a").alias("sig"))
    edges = cut_lineage(near.union(_large_cells(large, narrow, percent, medium)).distinct())
    regions = components(thinned(edges))
    # one text per point travels to its region
    wanted = regions.join(points.select("sig", "doc_id"), regions["node"] == points["sig"]).select(
        F.col("doc_id").alias("_id"), "sig", F.col("root").alias("region"))
    members = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["_id"])).select("region", "sig", "text")
    linked = members.groupBy("region").applyInArrow(_region(words, percent), "sig long, root long")
    labelled = texts.join(linked.withColumnsRenamed({"sig": "_sig"}), F.col("sig") == F.col("_sig"), "left")
    labelled = labelled.select("doc_id", "n", "md5", F.coalesce("root", "sig").alias("root"))
    labelled = cut_lineage(labelled)
    smallest = labelled.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = labelled.join(smallest, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "md5")


def one_of_each(docs: DataFrame, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their component; rows without an id stay.

    Rows are told apart by id and text: of rows that share an id, those go whose own text is a
    near copy of a smaller id's. Columns of any name stay as they are.
    """
    groups = _groups(docs.where(F.col(doc).isNotNull()), doc, text, **options)
    gone = groups.where("doc_id != component_id").select(F.col("doc_id").alias("_gone"), F.col("md5").alias("_md5")).distinct()
    same = (docs[doc].cast("long") == gone["_gone"]) & (F.unhex(F.md5(F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary"))) == gone["_md5"])
    return docs.join(gone, same, "left_anti")
