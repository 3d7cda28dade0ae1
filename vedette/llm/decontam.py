"""Benchmark passages in documents, by embedding edit distance into Hamming distance.

The random walk of Chakraborty, Goldenberg and Koucky (CGK) reads a string with a pointer that
stays or moves on by a coin fixed for (step, character); two strings read with the same coins
fall back into step after an edit, so the sequences read differ in few places if the edit
distance is small. Sampled places of these sequences are the keys of locality-sensitive
hashing: an item-sized window of a text is a candidate if it agrees with the item on all
sampled places of at least one of several tables, whose number follows from the recall asked
for. Candidates are verified by exact edit distance.

Windows are taken wherever an item within the wanted edits may lie, none is left out:

* ``k`` edits over ``k // 2 + 1`` pieces leave some piece at most one edit, so one half of this
  piece unchanged. Places of a text that hold such a half are looked up, and the other half beside
  it is compared with at most one edit.
* The pieces are leaves of a binary tree. A part of ``m`` of ``p`` pieces with at most ``k * m / p``
  edits has a child with at most its share, so some path from the whole item to a leaf keeps to it
  in every part. Places are followed from the leaf up this path, part by part, by exact edit
  distance on parts of up to 64 characters.

What is left are item-sized windows. Those that agree in a table are verified first; those that the
tables leave out are verified by the same exact distance, up to the best distance found.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StructField, StructType

from .common import free_name, hex_digest, whole_text

#: Characters of items that one scan of the documents looks for.
BATCH_CHARS = 2_000_000
STEPS, BITS, WALKS = 3, 3, 8
MULTIPLIER, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def plain(text: str) -> str:
    """Lower case, runs of white space as one space."""
    return " ".join(text.lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


#: Characters of texts, seed hits and parts that are looked at in one go; classes of characters in the parts' tables.
PLACES, HITS, CHECKED, CLASSES, MARGIN = 1 << 18, 1 << 18, 1 << 12, 64, 1_024
ONE = np.uint64(1)
EACH_BYTE = np.uint64(0x0101010101010101)
#: Masks of the first bytes of a number, by how many.
LOW_BYTES = np.array([(1 << 8 * j) - 1 for j in range(9)], np.uint64)


def _classes(codes: np.ndarray) -> np.ndarray:
    """A byte for each character: equal characters have equal bytes."""
    return ((codes.astype(np.uint64) + ONE) * MULTIPLIER >> np.uint64(56)).astype(np.uint8)


def _packed(classes: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros beyond the end."""
    padded = np.concatenate([classes, np.zeros(8, np.uint8)])
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view("<u8")[:, 0]


def _one_edit(word: np.ndarray, mask: np.ndarray, here: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Whether bytes ``here`` (``after``: from one place on) are ``word`` under ``mask`` but for one edit."""
    differ = (here ^ word) & mask
    bits = differ | (differ >> np.uint64(4))
    bits |= bits >> np.uint64(2)
    bits |= bits >> ONE
    bits &= EACH_BYTE
    first = bits & (~bits + ONE)  # the lowest bit of the first byte that differs
    behind = ~(first - ONE)  # from this byte on
    near = (differ & ~((first << np.uint64(8)) - ONE)) == 0
    near |= ((after ^ word) & mask & behind) == 0
    near |= ((here ^ (word >> np.uint64(8))) & (mask >> np.uint64(8)) & behind) == 0
    return near


def _gathered(found, least: int):
    """The tuples of arrays put together until they hold this many rows; none is empty."""
    held, rows = [], 0
    for arrays in found:
        if len(arrays[0]):
            held.append(arrays)
            rows += len(arrays[0])
        if rows >= least:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, rows = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def tables_for(recall: float, agreement: float, bits: int) -> int:
    """Tables after which a pair that agrees at each place with this chance is missed at most 1 - recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - agreement ** bits))


def _coin(seed: int, step: int, chars: np.ndarray) -> np.ndarray:
    h = (chars.astype(np.uint64) + np.uint64(seed * 1_000_003 + step + 1)) * MULTIPLIER
    return ((h ^ (h >> np.uint64(32))) * MIX >> np.uint64(63)).astype(np.int64)


def embedded(strings: np.ndarray, lengths: np.ndarray, seed: int, steps: int) -> np.ndarray:
    """Characters that the walk ``seed`` reads at each step; strings are rows padded with zeros."""
    at = np.zeros(len(strings), np.int64)
    rows = np.arange(len(strings))
    out = np.zeros((steps, len(strings)), np.uint32)
    for step in range(steps):
        read = np.where(at < lengths, strings[rows, np.minimum(at, strings.shape[1] - 1)], 0)
        out[step] = read
        at += _coin(seed, step, read)
    return out


def distance_within(item: str, text: str, most: int) -> tuple[int, int] | None:
    """(least edit distance of the item to any part of the text, end of that part), if at most ``most``.

    Bit-parallel dynamic programming (Myers), one step per character of the text.
    """
    n = len(item)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best, end = n, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        plus = mh | (full & ~(xv | ph))
        minus = ph & xv
        if score < best:
            best, end = score, j + 1
    return (best, end) if best <= most else None


class _Marks:
    """Whether a mixed number may be among those given, by its first bits."""

    def __init__(self, numbers: np.ndarray):
        self.shift = np.uint64(64 - min(20, 5 + len(numbers).bit_length()))
        self.there = np.zeros(1 << 64 - int(self.shift), bool)
        self.there[numbers >> self.shift] = True

    def places(self, asked: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.there.take((asked >> self.shift).view(np.int64), mode="clip"))


class _Seeds:
    """Entries by a number of each."""

    def __init__(self, numbers: np.ndarray):
        numbers = numbers * MIX
        self.order = np.argsort(numbers, kind="stable")
        self.numbers, self.first, self.times = np.unique(numbers[self.order], return_index=True, return_counts=True)
        self.there = _Marks(numbers)

    def found(self, asked: np.ndarray):
        """(place in ``asked``, entry of this number), some at a time."""
        asked = asked * MIX
        place = self.there.places(asked)
        asked = asked[place]
        of = np.minimum(np.searchsorted(self.numbers, asked), len(self.numbers) - 1)
        held = self.numbers[of] == asked
        place, of = place[held], of[held]
        portion = np.cumsum(self.times[of]) // HITS
        for b in range(int(portion[-1]) + 1 if len(portion) else 0):
            mine = of[portion == b]
            n = self.times[mine]
            e = np.repeat(self.first[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield np.repeat(place[portion == b], n), self.order[e]


@dataclass
class Items:
    """Items of one batch, their seeds, and the sampled places of their embeddings."""

    ids: list
    texts: list[str]
    share: float
    tables: int

    def __post_init__(self):
        self.most = np.array([int(self.share * len(t)) for t in self.texts], np.int64)
        self.always: list[int] = []  # items too short for halves
        halves: dict[tuple[int, int, int], list[tuple]] = defaultdict(list)
        parts: list[tuple[int, int, int, int]] = []  # (parent, edits, length, shift): the parts of items above the leaves
        starts: list[int] = []
        tables: list[np.ndarray] = []
        for i, t in enumerate(self.texts):
            n, k = len(t), int(self.most[i])
            p = k // 2 + 1
            cut = [n * x // p for x in range(p + 1)]
            if min(b - a for a, b in zip(cut, cut[1:])) < 2:
                self.always.append(i)
                continue
            classes = _classes(_codes(t))
            ahead, back = _packed(classes), _packed(classes[::-1])
            stack = [(0, p, -1)]
            while stack:
                x, y, above = stack.pop()
                a, b = cut[x], cut[y]
                if y - x > 1:
                    if b - a <= 64:
                        parts.append((above, k * (y - x) // p, b - a, b - a - 1))
                        starts.append(a)
                        table = np.zeros(CLASSES, np.uint64)
                        np.bitwise_or.at(table, classes[a:b] % CLASSES, ONE << np.arange(b - a, dtype=np.uint64))
                        tables.append(table)
                        above = len(parts) - 1
                    middle = (x + y) // 2
                    stack += [(x, middle, above), (middle, y, above)]
                    continue
                m = a + (b - a) // 2
                h, o = min(m - a, 8), min(b - m, 8)  # of a half at most eight characters, those next to the other half
                halves[h, 0, o].append((ahead[m - h], i, m - h, ahead[m], above))
                halves[o, 1, h].append((ahead[m], i, m, back[n - m], above))
        self.parts = np.array(parts, np.int64).reshape(-1, 4)
        self.starts, self.tables_of = np.array(starts, np.int64), np.array(tables, np.uint64).reshape(-1, CLASSES)
        self.halves = {}
        for (h, left, o), rows in sorted(halves.items()):
            key, item, at, word, above = (np.array(x, np.uint64 if j in (0, 3) else np.int64) for j, x in enumerate(zip(*rows, strict=True)))
            key, word = (key & LOW_BYTES[h]) * MULTIPLIER, word & LOW_BYTES[o]
            there = _Marks(key)
            # an edit leaves the first characters of the other half as they are, or the rest, which it may move by one
            front = _Seeds(key + (word & LOW_BYTES[o // 2]))
            rest = _Seeds(key + (word >> np.uint64(8 * (o // 2))))
            looks = [(0, o // 2, front)] + [(o // 2 + by, o - o // 2, rest) for by in (-1, 0, 1) if o > 1]
            self.halves[h, left, o] = (there, looks, item, at, word, above)

    def places(self, n: int) -> list[np.ndarray]:
        """Sampled places per walk for items of length ``n``: tables times bits."""
        each = math.ceil(self.tables / WALKS)
        out = []
        for walk in range(WALKS):
            h = (np.arange(each * BITS, dtype=np.uint64) + np.uint64(97 * walk + 1)) * MULTIPLIER
            h = (h ^ (h >> np.uint64(33))) * MIX
            out.append((h >> np.uint64(20)).astype(np.int64) % max(1, 2 * n - n // 4))
        return out

    def _seeded(self, classes: np.ndarray):
        """(place, item, place in the item, part) of halves whose piece has at most one edit, some at a time."""
        for begin in range(0, len(classes), PLACES):
            early = max(0, begin - 16)
            some = classes[early:begin + PLACES + 32]
            ahead, back = _packed(some), _packed(some[::-1])
            count = min(PLACES, len(classes) - begin)
            every, of = None, 0
            for (h, left, o), (there, looks, item, at, word, above) in self.halves.items():
                if h != of:
                    every, of = (ahead[begin - early:begin - early + count] & LOW_BYTES[h]) * MULTIPLIER, h
                place = there.places(every)
                read = every[place]
                place += begin - early
                words, y = (back, len(some) - place) if left else (ahead, np.minimum(place + h, len(some)))
                here = words[y]
                for skip, width, seeds in looks:
                    beside = here >> np.uint64(8 * skip) if skip + width <= 8 else words[np.minimum(y + skip, len(some))]
                    for which, e in seeds.found(read + (beside & LOW_BYTES[width])):
                        near = _one_edit(word[e], LOW_BYTES[o], here[which], words[np.minimum(y[which] + 1, len(some))])
                        e, which = e[near], which[near]
                        yield place[which] + early, item[e], at[e], above[e]

    def _holds(self, classes: np.ndarray, place: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Whether each part lies within its edits about ``place``, where its item would start (Myers, many at once).

        ``classes`` has a margin before and behind.
        """
        _, edits, length, shift = self.parts[part].T
        begin, steps = place + self.starts[part] - edits + MARGIN, length + 2 * edits
        plus, minus = np.full(len(part), 0xFFFFFFFFFFFFFFFF, np.uint64), np.zeros(len(part), np.uint64)
        score, top = length.copy(), shift.astype(np.uint64)
        best, row = score.copy(), part * CLASSES
        table = self.tables_of.ravel()
        for j in range(int(steps.max(initial=0))):
            eq = table[row + classes[begin + j]]
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph, mh = minus | ~(xh | plus), plus & xh
            score += ((ph >> top) & ONE).astype(np.int64) - ((mh >> top) & ONE).astype(np.int64)
            ph, mh, xv = ph << ONE, mh << ONE, eq | minus
            plus, minus = mh | ~(xv | ph), ph & xv
            np.minimum(best, score, out=best)
        return best <= edits

    def windows(self, texts: list[str]) -> list[set[tuple[int, int]]]:
        """Per text: (item, start) where the item would lie, to a grid of eight characters."""
        out: list[set[tuple[int, int]]] = [set() for _ in texts]
        first = np.cumsum([0] + [len(t) + 1 for t in texts])
        classes = _classes(_codes("\0".join(texts)))
        padded = np.pad(classes % np.uint8(CLASSES), MARGIN)
        for place, item, at, part in _gathered(self._seeded(classes), HITS // 8):
            text = np.searchsorted(first, place, side="right") - 1
            start, item, part, text = np.unique(np.stack([place - at, item, part, text]), axis=1)
            while len(start) and (part >= 0).any():
                kept = part < 0
                asked = np.flatnonzero(~kept)
                asked = asked[np.argsort(self.parts[part[asked], 2], kind="stable")]  # as many steps each
                for a in range(0, len(asked), CHECKED):
                    some = asked[a:a + CHECKED]
                    kept[some] = self._holds(padded, start[some], part[some])
                start, item, part, text = start[kept], item[kept], part[kept], text[kept]
                part = np.where(part >= 0, self.parts[part, 0], -1)
            for d, i, a in zip(text.tolist(), item.tolist(), ((start - first[text]) // 8 * 8).tolist(), strict=True):
                out[d].add((i, a))
        return out

    def candidates(self, found: list[tuple[int, int, str]]) -> list[bool]:
        """Whether each (item, .., window) agrees with its item in at least one table."""
        hit = np.zeros(len(found), bool)
        if not found:
            return hit.tolist()
        by_length = defaultdict(list)
        for k, (i, _, _) in enumerate(found):
            by_length[len(self.texts[i])].append(k)
        places = {n: self.places(n) for n in by_length}
        steps = 1 + max(int(p.max()) for walks in places.values() for p in walks)
        rows = [self.texts[i] for i, _, _ in found] + [w for _, _, w in found]
        lengths = np.array([len(t) for t in rows])
        grid = np.zeros((len(rows), max(1, int(lengths.max()))), np.uint32)
        for r, t in enumerate(rows):
            grid[r, :len(t)] = _codes(t)
        for walk in range(WALKS):
            read = embedded(grid, lengths, walk, steps)
            same = read[:, :len(found)] == read[:, len(found):]
            for n, ks in by_length.items():
                agree = same[places[n][walk]][:, ks].reshape(-1, BITS, len(ks))
                hit[ks] |= agree.all(axis=1).any(axis=0)
        return hit.tolist()

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per text: (item, end of the passage in the plain text, edit distance), the best of each item."""
        texts = [plain(t) for t in texts]
        out: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        found, owner = [], []
        for d, (text, windows) in enumerate(zip(texts, self.windows(texts), strict=True)):
            for i in {*self.always, *(i for i, _ in windows)}:
                at = text.find(self.texts[i])
                if at >= 0:
                    out[d][i] = (0, at + len(self.texts[i]))
                elif i in self.always:
                    self._verify(out[d], i, text, 0, len(text))
            for i, start in sorted(windows):
                if i not in out[d] and self.most[i]:
                    # the grid puts the start up to seven characters early
                    found.append((i, start, text[max(0, start):max(0, start) + len(self.texts[i]) + 8]))
                    owner.append(d)
        agree = [hit for a in range(0, len(found), 4_096) for hit in self.candidates(found[a:a + 4_096])]
        for wanted in (True, False):  # those that the tables leave out come last
            spans: dict[tuple[int, int], list[list[int]]] = defaultdict(list)
            for (i, start, _), d, hit in zip(found, owner, agree, strict=True):
                if hit == wanted:
                    n, most = len(self.texts[i]), int(self.most[i])
                    a, b, held = max(0, start - most), start + n + 8 + most, spans[d, i]
                    if held and a <= held[-1][1]:
                        held[-1][1] = b
                    else:
                        held.append([a, b])
            for (d, i), held in spans.items():
                for a, b in held:
                    self._verify(out[d], i, texts[d], a, b)
        return [[(i, end, dist) for i, (dist, end) in sorted(x.items())] for x in out]

    def _verify(self, best: dict[int, tuple[int, int]], i: int, text: str, a: int, b: int) -> None:
        """Keeps the least (distance, end) of the item in this stretch of the text, if it is within its edits."""
        near = distance_within(self.texts[i], text[a:b], best[i][0] if i in best else int(self.most[i]))
        if near and (i not in best or (near[0], a + near[1]) < best[i]):
            best[i] = (near[0], a + near[1])


def _scanned(docs: DataFrame, items: Items, doc: str, text: str, id_type: DataType) -> DataFrame:
    kind = ArrayType(StructType([StructField("item_no", IntegerType()), StructField("end", IntegerType()),
                                 StructField("distance", IntegerType())]))

    @F.arrow_udf(kind)
    def matches(texts: pa.Array) -> pa.Array:
        out = []
        for a in range(0, len(texts), 2_048):
            out += items.scan([t or "" for t in texts[a:a + 2_048].to_pylist()])
        arrow = pa.list_(pa.struct([("item_no", pa.int32()), ("end", pa.int32()), ("distance", pa.int32())]))
        return pa.array([[{"item_no": i, "end": e, "distance": d} for i, e, d in x] for x in out], arrow)

    names = docs.sparkSession.createDataFrame(list(enumerate(items.ids)), StructType(
        [StructField("item_no", IntegerType()), StructField("item_id", id_type)]))
    rows = docs.select(F.col(doc).alias("doc_id"), F.inline(matches(whole_text(text))))
    return rows.join(F.broadcast(names), "item_no").select("doc_id", "item_id", "end", "distance")  # one row per item


def leaks(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id",
          item_text: str = "text", share: float = 0.2, recall: float = 0.99,
          agreement: float = 0.35) -> DataFrame:
    """(doc_id, item_id, end, distance): the passages of items that texts hold.

    Texts are compared in lower case with single spaces. A text holds an item if some part
    of it is within ``share`` of the item's length in edit distance; ``end`` is where the best
    part ends. Items are taken in batches of two million characters, one scan of the
    documents each, so any number of items can be looked for. Empty and null items are in
    no text, null and empty texts hold nothing, repeated rows are reported alike, repeated
    items (same id and text) once.
    """
    rows = (items.select(F.col(item).alias("i"), F.col(item_text).alias("t")).where("t is not null")
            .distinct().withColumn("n", F.length("t")))
    total = rows.agg(F.sum("n")).first()[0] or 0
    batches = max(1, -(-total // BATCH_CHARS))
    tables = tables_for(recall, agreement, BITS)
    out = None
    for b in range(batches):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(batches)) == b).orderBy("i", "t").collect()
        texts = [(r["i"], plain(r["t"])) for r in part]
        texts = [(i, t) for i, t in texts if t]
        batch = Items([i for i, _ in texts], [t for _, t in texts], share, tables)
        found = _scanned(docs, batch, doc, text, items.schema[item].dataType)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, whatever other rows with their id or without one hold."""
    mark = docs.select(F.struct(F.col(doc).alias("id"), hex_digest(whole_text(text)).alias("sha")).alias("_row"), F.col(text))
    found = leaks(mark, items, "_row", text, **options).select(
        F.col("doc_id.id").alias("_leaky"), F.col("doc_id.sha").alias("_leaky_sha")).distinct()
    sha = free_name(docs, "_sha")
    rows = docs.withColumn(sha, hex_digest(whole_text(text)))
    return rows.join(found, (rows[sha] == found["_leaky_sha"]) & rows[doc].eqNullSafe(found["_leaky"]), "left_anti").drop(sha)
