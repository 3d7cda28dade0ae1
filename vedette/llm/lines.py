"""Removal of passages that repeat within and across documents, by winnowing over line hashes.

Texts break their lines anywhere and passages are pasted mid-line, so a line here is a running
line: ``line`` words in a row, hashed at every word. Of each ``window`` neighbouring line
hashes the smallest is selected. Two texts that share a run of at least
``line + 2 * window - 1`` words select the same lines inside it, two of them at least, and so
share the span from one selected line to the end of the next: a link.

Links are joined on the hash of their span: the first occurrence (lowest id, then position)
against each later one, a star and not all pairs. Later links that overlap are one chain. Of
each link less than ``window`` words from an end of its chain, the words beyond it are compared
with those beyond every earlier occurrence, and the longest run that an earlier occurrence has
as well extends the chain (selection leaves less than ``window`` words of a run uncovered on
either side). Occurrences whose next links lie as around the first occurrence, or as around
another, have the same words beyond them, so the earliest stands for these. Runs of ``least`` words or more are deleted
from the later text; the first occurrence stays.
"""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, IntegralType, LongType, StringType, StructField, StructType

from ..session import cut_lineage
from .common import free_name, stored, whole_text

LINE, WINDOW, LEAST = 10, 20, 50
#: Words of several texts that are worked on at once, and places that leave together.
WORDS, PLACES = 100_000, 20_000
WORD = re.compile(r"\S+")
BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def word_hashes(text: str) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, text.split()), np.uint64)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    for i, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
        p = _powers[i]
        while len(p) < n:
            p = np.concatenate([p, p * np.uint64(pow(b, len(p), 1 << 64))])
        _powers[i] = p
    return _powers[0], _powers[1]


def _spans(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    h = (prefix[end] - prefix[start]) * inverse[start] ^ (end - start).astype(np.uint64)
    h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


def _lowest(values: np.ndarray, window: int) -> np.ndarray:
    """Of each ``window`` neighbouring values, the place of the smallest, the last of equal ones."""
    at, width = np.arange(len(values)), 1
    while width < window:
        step = min(width, window - width)
        later = values[step:] <= values[:-step]
        values, at = np.where(later, values[step:], values[:-step]), np.where(later, at[step:], at[:-step])
        width += step
    return at


def _links(parts: list[np.ndarray], line: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, hash, first word, end) of the spans between neighbouring selected lines of each text, given its word hashes."""
    sizes = np.array([len(x) for x in parts], np.int64)
    ends = np.cumsum(sizes)
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if len(words) < line + window:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    power, inverse = _power(len(words) + 1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[:len(words)])])
    at = np.arange(len(words) - line + 1)
    low = _lowest(_spans(prefix, at, at + line, inverse), window)
    whole = at[:len(low)] + (line + window - 1) <= np.repeat(ends, sizes)[:len(low)]  # within one text
    picked = low[whole]
    picked = picked[np.append(True, picked[1:] != picked[:-1])] if len(picked) else picked
    text = np.searchsorted(ends, picked, side="right")
    pair = np.flatnonzero(text[1:] == text[:-1])
    start, end, text = picked[pair], picked[pair + 1] + line, text[pair]
    first = (ends - sizes)[text]
    return text, _spans(prefix, start, end, inverse).view(np.int64), start - first, end - first


def links(text: str, line: int = LINE, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word, end) of the spans between neighbouring selected lines."""
    return _links([word_hashes(text)], line, window)[1:]


def _links_of(line: int, window: int):
    """The links of every text, as rows (doc, key, start, end)."""
    def found(batches):
        for batch in batches:
            parts, n, first = [], 0, 0
            for row, text in enumerate(batch["text"]):
                parts.append(word_hashes(text.as_py() or ""))
                n += len(parts[-1])
                if n < WORDS and row + 1 < len(batch):
                    continue
                of, key, start, end = _links(parts, line, window)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc"].take(pa.array(first + of)), pa.array(key), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))],
                    ["doc", "key", "start", "end"])
                parts, n, first = [], 0, row + 1

    return found


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before; the first does."""
    if pa.types.is_struct(column.type):
        return np.logical_or.reduce([_changes(x) for x in column.flatten()])
    differ = pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, max(0, len(column) - 1))), True)
    return np.append(True, differ.to_numpy(zero_copy_only=False).astype(bool))[:len(column)]


def _again(batches):
    """Of links sorted by key, id and place, those whose key occurs again: with the text of its first occurrence, whether it is a later one, and how far before it lies."""
    head, held = None, False  # the first row of the last key, and whether it waits for a second one
    for batch in batches:
        if not len(batch):
            continue
        rows = batch if head is None else pa.concat_batches([head, batch])
        key, start, doc = rows["key"].to_numpy(), rows["start"].to_numpy(), np.cumsum(_changes(rows["doc"]))
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        times = np.diff(np.append(heads, len(key)))
        first, leaves = np.repeat(heads, times), np.repeat(times, times) > 1
        gone = head is not None and not held
        leaves[0] &= not gone
        later = (doc != doc[first]) | (start != start[first])
        out = pa.RecordBatch.from_arrays(
            [*(rows[c] for c in ("doc", "key", "start", "end")), rows["text"].take(pa.array(first)), pa.array(later), pa.array(start[first] - start)],
            ["doc", "key", "start", "end", "first_text", "later", "offset"])
        yield out.filter(pa.array(leaves))
        head, held = rows.slice(int(heads[-1]), 1), bool(times[-1] == 1 and not (gone and heads[-1] == 0))


def _by_text(work):
    """``work`` on tables of whole texts, of rows that come sorted by text; a text's rows may come in several batches."""
    def done(batches):
        waiting = []
        for batch in batches:
            if not len(batch):
                continue
            new = np.flatnonzero(_changes(batch["doc"]))
            if len(new) == 1 and waiting and waiting[-1]["doc"][-1] == batch["doc"][0]:
                waiting.append(batch)
                continue
            last = int(new[-1])
            whole = pa.Table.from_batches([*waiting, batch.slice(0, last)])
            waiting = [batch.slice(last)]
            if len(whole):
                yield from work(whole.combine_chunks()).to_batches()
        if waiting:
            yield from work(pa.Table.from_batches(waiting).combine_chunks()).to_batches()

    return done


def _mixed(h: np.ndarray, value: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX + value.astype(np.int64).view(np.uint64)
    return (h ^ (h >> np.uint64(29))) * np.uint64(BASE)


def _mark(window: int):
    """Of the occurrences of links, whole texts sorted by place: what lies beyond them, and the chains of later ones."""
    def column(rows: pa.Table, name: str) -> np.ndarray:
        return rows[name].combine_chunks().to_numpy(zero_copy_only=False)

    def work(rows: pa.Table) -> pa.Table:
        doc = rows["doc"].combine_chunks()
        doc = doc.combine_chunks() if isinstance(doc, pa.ChunkedArray) else doc
        text = np.cumsum(_changes(doc))
        key, first_text, offset = (column(rows, c) for c in ("key", "first_text", "offset"))
        start, end = column(rows, "start").astype(np.int64), column(rows, "end").astype(np.int64)
        later = column(rows, "later").astype(bool)
        n = len(text)

        def alike(side: int) -> tuple[np.ndarray, np.ndarray]:
            """Of a later link with ``window`` words beyond it in later links: what these are, 0 if they lie so around its first occurrence."""
            out, known = np.zeros(n, np.int64), np.zeros(n, bool)
            chained, as_first = later.copy(), np.ones(n, bool)
            names = np.full(n, side % 3, np.uint64)
            for i in range(1, 4):
                outer = np.arange(n) + side * i
                there = (outer >= 0) & (outer < n)
                outer = np.clip(outer, 0, n - 1)
                inner = np.clip(outer - side, 0, n - 1)
                there &= text[outer] == text
                reach = end[outer] - end if side > 0 else start - start[outer]
                meet = start[outer] <= end[inner] if side > 0 else end[outer] >= start[inner]
                chained &= there & later[outer] & meet
                as_first &= (first_text[outer] == first_text) & (offset[outer] == offset)
                names = _mixed(_mixed(names, key[outer]), start[outer] - start)
                now = chained & (reach >= window) & ~known
                out[now] = np.where(as_first, 0, names.view(np.int64) | 1)[now]
                known |= now
            return out, known

        far = (max(int(end.max()), int(start.max())) + 2) if n else 1
        places = np.flatnonzero(later)
        low, high = start[places] + text[places] * far, end[places] + text[places] * far
        reached = np.maximum.accumulate(high)
        gap = np.append(True, low[1:] > reached[:-1])[:len(places)]
        heads = np.flatnonzero(gap)
        chain, first, last = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        if len(places):
            of = np.cumsum(gap) - 1
            chain[places] = of + 1 - of[np.searchsorted(text[places], text[places])]
            first[places] = start[places][heads][of]
            last[places] = np.maximum.reduceat(end[places], heads)[of]
        (before, b), (after, a) = alike(-1), alike(1)
        return pa.table({
            "doc": doc, "key": key, "start": start.astype(np.int32), "end": end.astype(np.int32),
            "before": pa.array(before, mask=~b), "after": pa.array(after, mask=~a),
            "chain": chain.astype(np.int32), "first": first.astype(np.int32), "last": last.astype(np.int32)})

    return _by_text(work)


def _context(reach: int):
    """Per place (side, at, key) asked of a text: hashes of the key with the next 1, 2, .. ``reach`` words before (-1) or after (1) it.

    Of places that are no ``edge`` and have the same key and words beyond them in a text, the
    first is returned; places without a word beyond them are not. Rows leave as soon as
    ``PLACES`` are there, so a batch of texts never holds the hashes of all its places at once.
    """
    def found(batches):
        for batch in batches:
            asked = batch["asked"]
            ends, places = asked.offsets.to_numpy(), asked.values
            sides, ats, keys = (places.field(c).to_numpy() for c in ("side", "at", "key"))
            edges = places.field("edge").to_numpy(zero_copy_only=False)
            parts, n, first = [], 0, 0
            for row, text in enumerate(_unpacked(batch["text"])):
                parts.append(word_hashes(text.as_py() or ""))
                n += len(parts[-1])
                if n < WORDS and ends[row + 1] - ends[first] < PLACES and row + 1 < len(batch):
                    continue
                here = slice(ends[first], ends[row + 1])
                high = np.array(list(accumulate(len(x) for x in parts)), np.int64)
                low = high - np.array([len(x) for x in parts], np.int64)
                of = np.repeat(np.arange(len(parts)), np.diff(ends[first:row + 2]))
                out = _beyond(np.concatenate(parts), low[of], high[of], of, sides[here].astype(np.int64),
                              ats[here].astype(np.int64), keys[here], edges[here], reach)
                if len(out[0]):
                    yield _places(batch["d"], out[0] + first, *out[1:])
                parts, n, first = [], 0, row + 1

    return found


def _beyond(words: np.ndarray, low: np.ndarray, high: np.ndarray, of: np.ndarray, side: np.ndarray, at: np.ndarray, key: np.ndarray,
            edge: np.ndarray, reach: int):
    """(text, side, at, number of hashes, hashes one after the other) of the places that are returned.

    Place ``at`` is counted from the first word ``low`` of its text ``of``, which ends before word ``high``.
    """
    step = np.arange(reach)
    where = (low + at)[:, None] + np.where(side[:, None] > 0, step, -1 - step)
    inside = (where >= low[:, None]) & (where < high[:, None])
    near = words[np.clip(where, 0, len(words) - 1)] if len(words) else np.zeros(where.shape, np.uint64)
    h = key.view(np.uint64) ^ side.view(np.uint64)
    out = np.zeros(where.shape, np.uint64)
    for k in range(reach):
        h = (h ^ (h >> np.uint64(31))) * MIX + near[:, k]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(BASE)
        out[:, k] = h
    size = inside.sum(axis=1)
    other = np.flatnonzero((size == reach) & ~edge)
    other = other[np.lexsort((at[other], out[other, -1], of[other]))]
    keep = (size < reach) | edge
    new = (out[other[1:], -1] != out[other[:-1], -1]) | (of[other[1:]] != of[other[:-1]])
    keep[other[np.append(True, new)[:len(other)]]] = True
    keep &= size > 0
    return of[keep], side[keep], at[keep], size[keep], out[keep][inside[keep]]


def _places(ids: pa.Array, row: np.ndarray, side: np.ndarray, at: np.ndarray, size: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    ends = np.append(0, np.cumsum(size)).astype(np.int32)
    hashes = hashes.view(np.int64)
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(row)), pa.array(side.astype(np.int32)), pa.array(at.astype(np.int32)),
         pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes)), pa.array(hashes[ends[:-1]])],
        ["d", "side", "at", "beyond", "h"])


def _furthest(batches):
    """Per place, how many words beyond it an earlier one has as well; rows come sorted by first hash, then text and place.

    Equal hashes have the same first hash, so within a batch the first place of each hash
    tells; of the last first hash, the hashes of earlier batches are remembered.
    """
    group, seen, last, waiting = None, set(), None, []
    for batch in batches:
        if not len(batch):
            continue
        more = np.zeros(len(batch), np.int32)
        first = batch["h"].to_numpy()
        new = np.append(True, first[1:] != first[:-1])
        rows = np.flatnonzero(~new | np.append(~new[1:], True) | (np.arange(len(first)) == 0))  # a hash by itself meets none
        part = batch.take(pa.array(rows))
        first, at, ids, lists = first[rows], part["at"].to_numpy(), part["d"], part["beyond"]
        ends, hashes = lists.offsets.to_numpy(), lists.values.to_numpy()
        hashes, ends = hashes[ends[0]:ends[-1]], ends - ends[0]
        sizes = np.diff(ends)
        place = np.cumsum(_changes(ids) | np.append(True, (at[1:] != at[:-1]) | (first[1:] != first[:-1])))
        mine = np.repeat(place, sizes)
        _, once, which = np.unique(hashes, return_index=True, return_inverse=True)
        known = mine[once][which] < mine  # rows of one place count once
        if first[0] == group:  # goes on from the batch before
            n = int(ends[np.searchsorted(first != group, True)])
            same = int(ends[np.searchsorted(place > 1, True)]) if (ids[0].as_py(), int(at[0])) == last else 0
            before = hashes[:n].tolist()
            known[:same] |= np.fromiter((x in seen for x in before[:same]), bool, same)
            if same < n or not same:
                seen.update(waiting)
                waiting = []
            known[same:n] |= np.fromiter((x in seen for x in before[same:]), bool, n - same)
        else:
            seen, waiting = set(), []
        step = np.arange(len(hashes)) - np.repeat(ends[:-1], sizes)
        more[rows] = np.minimum.reduceat(np.where(known, np.repeat(sizes, sizes), step), ends[:-1])
        if first[-1] != group:
            group, seen, waiting = first[-1], set(), []
        head, tail = int(ends[np.searchsorted(first == group, True)]), int(ends[np.searchsorted(place == place[-1], True)])
        if tail > head:
            seen.update(waiting)
            waiting = []
            seen.update(hashes[head:tail].tolist())
        waiting = waiting + hashes[tail:].tolist()
        last = (ids[-1].as_py(), int(at[-1]))
        yield pa.RecordBatch.from_arrays([batch["d"], batch["side"], batch["at"], pa.array(more)], ["doc", "side", "at", "more"])


def repeated_runs(docs: DataFrame, doc: str = "doc_id", text: str = "text", line: int = LINE, window: int = WINDOW,
                  least: int = LEAST) -> DataFrame:
    """(doc, runs): word spans [start, end) of a text that occurred before, for texts that have any.

    ``docs`` must have no null ids; null texts count as empty. Rows with the same id count as one occurrence. Every run
    of at least ``max(least, line + 2 * window - 1)`` words that an earlier text has as well
    is found, whatever other texts hold of it; order is by id, then by position, so a text
    can repeat itself.
    """
    docs = docs.select(F.col(doc).alias("doc"), whole_text(text).alias("text"))
    id_field = StructField("doc", docs.schema["doc"].dataType)
    place = [id_field, StructField("key", LongType()), StructField("start", IntegerType()), StructField("end", IntegerType())]
    found = docs.mapInArrow(_links_of(line, window), StructType(place))
    of_first = [StructField("first_text", LongType()), StructField("later", BooleanType()), StructField("offset", IntegerType())]
    again = (found.select("*", _number(F.col("doc"), id_field).alias("text")).repartition("key").sortWithinPartitions("key", "doc", "start")
             .mapInArrow(_again, StructType(place + of_first)))
    marks = [StructField("before", LongType()), StructField("after", LongType()),
             *(StructField(c, IntegerType()) for c in ("chain", "first", "last"))]
    marked = again.repartition("doc").sortWithinPartitions("doc", "start", "end").mapInArrow(_mark(window), StructType(place + marks))
    with stored(marked) as marked:
        return _runs(docs, marked, window, least)


def _number(column: Column, field: StructField) -> Column:
    """Whole ids as they are, others by a hash."""
    return column.cast("long") if isinstance(field.dataType, IntegralType) else F.xxhash64(column)


def _runs(docs: DataFrame, marked: DataFrame, window: int, least: int) -> DataFrame:
    """Chains with the words beyond their ends that an earlier text has as well, as runs per text."""
    # where a run can end less than ``window`` words beyond a link, and the occurrences of such links
    chained = marked.where("chain > 0")
    sides = F.array(F.when(F.col("start") - F.col("first") < window, F.struct(F.lit(-1).alias("side"), F.col("start").alias("at"))),
                    F.when(F.col("last") - F.col("end") < window, F.struct(F.lit(1).alias("side"), F.col("end").alias("at"))))
    edges = (chained.where((F.col("start") - F.col("first") < window) | (F.col("last") - F.col("end") < window))
             .select("doc", "chain", "key", F.inline(F.filter(sides, F.isnotnull))).select("doc", "chain", "side", "at", "key"))
    asked_for = edges.groupBy("key").agg(F.min("side").alias("least"), F.max("side").alias("most"))
    both = F.array(F.when((F.col("least") < 0) & (F.col("before").isNull() | (F.col("before") != 0)),
                          F.struct(F.lit(-1).alias("side"), F.col("start").alias("at"), F.col("before").alias("alike"))),
                   F.when((F.col("most") > 0) & (F.col("after").isNull() | (F.col("after") != 0)),
                          F.struct(F.lit(1).alias("side"), F.col("end").alias("at"), F.col("after").alias("alike"))))
    places = (marked.where("before IS NULL OR before != 0 OR after IS NULL OR after != 0")
              .select("doc", "key", "start", "end", "before", "after").join(asked_for, "key")
              .select("doc", "key", F.inline(F.filter(both, F.isnotnull))))
    # places that are alike count as the first of them, the others each by itself
    alone = F.when(F.col("alike").isNull(), F.struct("doc", "at"))
    places = (places.groupBy("key", "side", "alike", alone.alias("alone")).agg(F.min(F.struct("doc", "at")).alias("p"))
              .select("p.doc", "side", "p.at", "key", F.lit(False).alias("edge")))
    places = places.union(edges.select("doc", "side", "at", "key", F.lit(True)))
    asked = places.groupBy(F.col("doc").alias("d")).agg(F.collect_set(F.struct("side", "at", "key", "edge")).alias("asked"))
    id_type = docs.schema["doc"].dataType.simpleString()
    around = (docs.withColumn("text", _packed("text")).join(asked, docs["doc"] == asked["d"]).select("d", "text", "asked")
              .mapInArrow(_context(window), f"d {id_type}, side int, at int, beyond array<bigint>, h bigint"))
    longer = cut_lineage(around.repartition("h").sortWithinPartitions("h", "d", "at")
                         .mapInArrow(_furthest, f"doc {id_type}, side int, at int, more int").where("more > 0"))
    further = (edges.join(longer, ["doc", "side", "at"]).groupBy("doc", "chain")
               .agg(F.min(F.when(F.col("side") < 0, F.col("at") - F.col("more"))).alias("low"),
                    F.max(F.when(F.col("side") > 0, F.col("at") + F.col("more"))).alias("high")))
    chains = chained.groupBy("doc", "chain").agg(F.first("first").alias("first"), F.first("last").alias("last"))
    runs = chains.join(further, ["doc", "chain"], "left").select(
        "doc", F.least("first", "low").alias("start"), F.greatest("last", "high").alias("end"))
    return cut_lineage(runs.where(F.col("end") - F.col("start") >= least).groupBy("doc")
            .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs")))


@F.arrow_udf(BinaryType())
def _packed(texts: pa.Array) -> pa.Array:
    """Texts as they are moved: their length in four bytes, then zstd."""
    codec = pa.Codec("zstd", compression_level=1)
    raw = (t.as_buffer() for t in texts.cast(pa.binary()))
    return pa.array([x if x is None else len(x).to_bytes(4, "little") + codec.compress(x, asbytes=True) for x in raw], pa.binary())


def _unpacked(packed: pa.Array) -> pa.Array:
    codec = pa.Codec("zstd")
    raw = (p.as_buffer() for p in packed)
    return pa.array([x if x is None else codec.decompress(x[4:], int.from_bytes(x[:4], "little"), asbytes=True) for x in raw], pa.binary()).cast(pa.string())


@F.arrow_udf(StringType())
def without_runs(packed: pa.Array, runs: pa.Array) -> pa.Array:
    """Each packed text without the words of its runs (and the white space after them)."""
    texts = _unpacked(packed)
    out = []
    for t, r in zip(texts, runs, strict=True):
        text, spans = t.as_py(), r.as_py()
        if spans and text is not None:
            starts = [m.start() for m in WORD.finditer(text)] + [len(text)]
            kept, at = [], 0
            for s in spans:
                a, b = starts[s["start"]], starts[min(s["end"], len(starts) - 1)]
                kept.append(text[at:max(at, a)])
                at = max(at, b)
            text = "".join(kept) + text[at:]
        out.append(text)
    return pa.array(out, pa.string())


def dedup_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", runs: str = "runs", **options) -> DataFrame:
    """Every row, its text without later repeated runs; adds ``runs``, the word spans deleted.

    A text that is repeated as a whole becomes empty; its row stays. Rows without an id are
    left as they are and compared with nothing, null texts stay null; rows that share id and
    text count as one text, rows that share only the id as texts of their own, in the order of
    a hash. An existing column ``runs`` is replaced, all others are kept.
    """
    docs = docs.drop(runs)
    known = docs.where(F.col(doc).isNotNull())
    own, text_hash = free_name(docs, "_own"), F.xxhash64(whole_text(text))
    texts = known.groupBy(doc).agg(F.min(text_hash).alias("first"), F.max(text_hash).alias("last"))
    plain = texts.where("first != last").isEmpty()  # then the id alone names a text
    known = known.withColumn(own, F.col(doc) if plain else F.struct(F.col(doc).alias("id"), text_hash.alias("hash")))
    found = repeated_runs(known, own, text, **options)
    key = free_name(known, "_doc")
    found = found.withColumnsRenamed({"doc": key, "runs": runs})
    kind = found.schema[runs].dataType
    packed = known.withColumn(text, _packed(F.col(text).cast("string")))
    cleaned = packed.join(found, packed[own] == found[key], "left").drop(key, own)
    cleaned = cleaned.withColumn(text, without_runs(F.col(text), F.col(runs))).withColumn(runs, F.coalesce(runs, F.array().cast(kind)))
    return cleaned.unionByName(docs.where(F.col(doc).isNull()).withColumn(runs, F.array().cast(kind)))
