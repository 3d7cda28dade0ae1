"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds the hash of each of its prefixes, as a polynomial in a base
modulo a prime; the hash of any span follows from two entries, so spans of equal content can
be told anywhere, and longest common extensions are found by binary search, since prefixes
agree up to one point and no further.

A fingerprint keeps what two texts need to be compared without their characters: length and
hash of the whole, the hashes of prefixes and of suffixes on a grid of 16 to 32 steps (a power
of two, so grids of texts of different length nest), and the 32 smallest mixed hashes of the
spans of 16 characters. The likeness of two fingerprints is the larger of the part that their
longest common prefix and suffix cover (binary search on the common grid) and of the share of
common spans.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import whole_text

#: (prime, base) of the two hashes.
FIRST, SECOND = (2_147_483_647, 1_103_515_245), (2_147_483_629, 69_621_007)
SPAN, SMALLEST, STEPS = 16, 32, 32
BLOCK = 65_536
#: Ranges of ids hold about so many rows at most, and a task four of them.
RANGE_ROWS = 5_000
MIX = np.uint64(0x9E3779B97F4A7C15)

_tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _powers(key: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for positions within a block."""
    if key not in _tables:
        prime, base = key
        out = []
        for b in (base, pow(base, -1, prime)):
            p = np.ones(1, np.uint64)
            while len(p) < BLOCK + SPAN:
                p = np.concatenate([p, p * np.uint64(pow(b, len(p), prime)) % np.uint64(prime)])
            out.append(p)
        _tables[key] = (out[0], out[1])
    return _tables[key]


def codes_of(text: str) -> np.ndarray:
    """Code points of a text, plus one (no character may weigh nothing)."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


class PrefixHash:
    """Prefix array of one text; equality of spans and longest common extensions."""

    def __init__(self, text: str, key: tuple[int, int] = FIRST):
        self.key, self.codes = key, codes_of(text)
        n, prime = len(self.codes), key[0]
        self.at = np.zeros(n + 1, np.uint64)
        power, _ = _powers(key)
        for a in range(0, n, BLOCK):
            part = self.codes[a:a + BLOCK]
            local = np.cumsum(part * power[:len(part)] % np.uint64(prime)) % np.uint64(prime)
            shifted = local * np.uint64(pow(key[1], a, prime)) % np.uint64(prime)
            self.at[a + 1:a + 1 + len(part)] = (self.at[a] + shifted) % np.uint64(prime)

    def span(self, start: int, end: int) -> int:
        prime, base = self.key
        return (int(self.at[end]) - int(self.at[start])) * pow(base, -start, prime) % prime

    def extension(self, start: int, other: PrefixHash, other_start: int) -> int:
        """Length of the longest common extension to the right, by binary search."""
        low, high = 0, min(len(self.codes) - start, len(other.codes) - other_start)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(start, start + mid) == other.span(other_start, other_start + mid):
                low = mid
            else:
                high = mid - 1
        return low


def _step(n: int) -> int:
    step = 1
    while step * STEPS < n:
        step *= 2
    return step


def fingerprint(text: str) -> str:
    """``length-hash-prefixes-suffixes-spans``, numbers of eight hexadecimal digits."""
    codes = codes_of(text)
    n = len(codes)
    step = _step(n)
    prime, base = FIRST
    p = np.uint64(prime)
    power, inverse = _powers(FIRST)
    wanted = np.unique(np.array([*range(0, n + 1, step), *range(n % step, n + 1, step), n]))
    prefix = {0: 0}
    total = other = 0
    smallest = np.zeros(0, np.uint64)
    width = min(SPAN, n)
    for a in range(0, n, BLOCK):
        part = codes[a:a + BLOCK + width - 1]
        local = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * power[:len(part)] % p) % p])
        size = min(BLOCK, n - a)
        shift = pow(base, a, prime)
        for at in wanted[(wanted > a) & (wanted <= a + size)].tolist():
            prefix[at] = (total + int(local[at - a]) * shift) % prime
        total = (total + int(local[size]) * shift) % prime
        starts = max(0, len(local) - width)  # none where a last block is shorter than a span
        spans = (local[width:] + p - local[:starts]) * inverse[:starts] % p
        mixed = spans * MIX >> np.uint64(32)
        if len(mixed) > 4 * SMALLEST:
            mixed = mixed[mixed <= np.partition(mixed, 4 * SMALLEST)[4 * SMALLEST]] if len(np.unique(
                mixed[:4 * SMALLEST])) > 2 * SMALLEST else mixed
        smallest = np.unique(np.concatenate([smallest, mixed]))
        if len(smallest) < SMALLEST:  # the shortcut met many repeats
            smallest = np.unique(np.concatenate([smallest, spans * MIX >> np.uint64(32)]))
        smallest = smallest[:SMALLEST]
        q, b = SECOND
        power2, _ = _powers(SECOND)
        seg = codes[a:a + size]
        other = (other + int((seg * power2[:size] % np.uint64(q)).sum() % np.uint64(q)) * pow(b, a, q)) % q
    grid = [prefix[i] for i in range(step, n + 1, step)]
    ends = [(total - prefix[n - i]) * pow(base, -(n - i), prime) % prime for i in range(step, n + 1, step)]
    listed = ["".join(f"{x:08x}" for x in xs) for xs in (grid, ends, smallest.tolist())]
    return "-".join([f"{n:x}", f"{total:08x}{other:08x}", *listed])


def _numbers(joined: str) -> list[str]:
    return [joined[i:i + 8] for i in range(0, len(joined), 8)]


def _agree(a: list[str], b: list[str], step_a: int, step_b: int) -> int:
    """Characters in common from the side where the grids begin, by binary search."""
    step = max(step_a, step_b)
    low, high = 0, min(len(a) * step_a, len(b) * step_b) // step
    while low < high:
        mid = (low + high + 1) // 2
        if a[mid * step // step_a - 1] == b[mid * step // step_b - 1]:
            low = mid
        else:
            high = mid - 1
    return low * step


def likeness(left: str, right: str) -> float:
    """0 to 1; 1 only for equal fingerprints."""
    if left == right:
        return 1.0
    (n, _, *a), (m, _, *b) = left.split("-"), right.split("-")
    n, m = int(n, 16), int(m, 16)
    if not n or not m:
        return 0.0
    a, b = [*map(_numbers, a)], [*map(_numbers, b)]
    ends = sum(_agree(a[i], b[i], _step(n), _step(m)) for i in (0, 1))
    covered = min(ends, n, m) / max(n, m)
    lowest = sorted({*a[2], *b[2]})[:SMALLEST]
    shared = len({*a[2]} & {*b[2]} & {*lowest}) / len(lowest)
    return min(max(covered, 2 * shared / (1 + shared)), 1 - 1 / (1 + max(n, m)))


@F.arrow_udf(StringType())
def fingerprints(texts: pa.Array) -> pa.Array:
    """Fingerprint of each text; null texts count as empty."""
    return pa.array([fingerprint(t.as_py() or "") for t in texts], pa.string())


@F.arrow_udf(DoubleType())
def likenesses(left: pa.Array, right: pa.Array) -> pa.Array:
    """Likeness of two columns of fingerprints; null where one is null."""
    return pa.array([None if a is None or b is None else likeness(a, b)
                     for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.float64())


def _bounds(docs: DataFrame, key: str, rows: int) -> list[int]:
    """Ids that cut the table in about equal parts, four per shuffle partition and more where these hold many rows."""
    parts = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // RANGE_ROWS)
    shares = [i / parts for i in range(1, parts)]
    found = docs.select(F.percentile_approx(key, shares, 10 * parts)).first()[0] if shares else None
    return sorted(set(found or []))


def _below(key: str, bounds: list[int]) -> Column:
    """How many of the bounds an id exceeds: first among every so many bounds, then in the stretch found there."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    longs = "array<long>"
    coarse = F.lit(bounds[step - 1::step]).cast(longs) if len(bounds) >= step else F.lit([]).cast(longs)
    fine = F.lit([bounds[i:i + step] for i in range(0, len(bounds) + 1, step)]).cast("array<array<long>>")
    above = F.size(F.filter(coarse, lambda b: b < F.col(key)))
    return above * step + F.size(F.filter(F.element_at(fine, above + 1), lambda b: b < F.col(key)))


def with_next(docs: DataFrame, key: str, carried: list[str], made: dict[str, Callable[[str], str]] | None = None) -> DataFrame:
    """Adds ``next_<c>`` for each carried column: its value in the next row by descending ``key``.

    The last row's next is the first. Rows are dealt out by ranges of ``key`` and each range
    is walked in order, so the text of a row moves once; the range's follow-up, the first
    row of the next lower range, is dealt to it as well. The driver holds one id per range.
    Repeated ids follow each other by the carried columns; null ids come last. ``made`` adds
    columns computed once per row from the first carried one, and their ``next_``. A task holds
    a batch of rows, whatever the size of its ranges.
    """
    rows = docs.count()
    bounds = _bounds(docs, key, rows)
    tagged = docs.withColumn("_part", F.when(F.col(key).isNull(), -1).otherwise(_below(key, bounds)))
    tops = {r[0]: r[1] for r in tagged.groupBy("_part").agg(F.max(key)).collect()}
    order = [*carried, *[c for c in docs.columns if c not in (key, *carried)]]
    filled = sorted(tops, reverse=True)
    return _linked(tagged, key, carried, order, filled, tops, made or {}, rows)


def _linked(tagged: DataFrame, key: str, carried: list[str], order: list[str], filled: list[int], tops: dict,
            made: dict[str, Callable[[str], str]], rows: int) -> DataFrame:
    # the first row of a range also follows the last row of the range above it
    goes = {p: filled[i - 1] for i, p in enumerate(filled)}
    ghosts = [(p, tops[p], goes[p]) for p in filled]
    spark = tagged.sparkSession
    firsts = spark.createDataFrame(ghosts, "_part long, _top long, _above long")
    firsts = F.broadcast(firsts)  # one row per range
    joined = tagged.join(firsts, "_part")
    extra = F.when(F.col(key).eqNullSafe(F.col("_top")), F.array(
        F.struct(F.col("_part").alias("to"), F.lit(0).alias("ghost")),
        F.struct(F.col("_above").alias("to"), F.lit(1).alias("ghost")))).otherwise(
        F.array(F.struct(F.col("_part").alias("to"), F.lit(0).alias("ghost"))))
    names = [c for c in tagged.columns if c != "_part"]
    dealt = joined.withColumn("_to", F.explode(extra)).select(*names, F.col("_to.to").alias("_to"), F.col("_to.ghost").alias("_ghost"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // (4 * RANGE_ROWS))
    walked = dealt.repartition(parts, "_to").sortWithinPartitions("_to", "_ghost", F.col(key).desc_nulls_last(), *order)
    added = [*made, *[f"next_{c}" for c in (*carried, *made)]]
    kinds = {f.name: f.dataType for f in dealt.schema.fields}
    schema = StructType([StructField(c, kinds[c]) for c in names] + [
        StructField(c, kinds[c.removeprefix("next_")] if c.removeprefix("next_") in carried else StringType()) for c in added])
    return walked.mapInArrow(_walk(names, carried, made), schema)


def _walk(names: list[str], carried: list[str], made: dict[str, Callable[[str], str]]):
    """Rows in order, each with what stands in the row after it; the last row of a batch waits for the next batch."""
    def linked(rows: pa.Table, last: bool):
        n = len(rows) - (not last)
        after = rows.slice(1)
        if last:
            after = pa.concat_tables([after, rows.slice(0, 1)])  # no row follows the very last one, which is a ghost
        own = rows.slice(0, n)
        keep = pc.equal(own["_ghost"], pa.scalar(0, own["_ghost"].type))
        out = [*own.select([*names, *made]).columns, *[after[c] for c in (*carried, *made)]]
        for batch in pa.table(out, [*names, *made, *[f"next_{c}" for c in (*carried, *made)]]).filter(keep).to_batches():
            yield batch

    def run(batches):
        rest = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = pa.Table.from_batches([batch])
            for c, make in made.items():
                rows = rows.append_column(c, pa.array([make(t.as_py()) for t in batch[carried[0]]], pa.string()))
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            yield from linked(rows, False)
            rest = rows.slice(len(rows) - 1)
        if rest is not None:
            yield from linked(rest, True)

    return run


def edited_text(text: Column, following: Column) -> Column:
    """The last third of the characters replaced by the first as many of the following text."""
    cut = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - cut), F.substring(following, F.lit(1), cut))


def fingerprint_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and two likenesses.

    Returns doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited and
    near_next. Null texts count as empty. A single row is its own next. Repeated ids follow
    each other by text; null ids come last. No rows give no rows.
    """
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    rows = with_next(rows, "doc_id", ["text"], {"fingerprint": fingerprint})
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"),
                       edited_text(F.col("text"), F.col("next_text")).alias("edited_text"), "fingerprint", "next_fingerprint")
    return rows.withColumn("edited_fingerprint", fingerprints("edited_text")).select(
        "doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint",
        likenesses("fingerprint", "edited_fingerprint").alias("near_edited"),
        likenesses("fingerprint", "next_fingerprint").alias("near_next"))
