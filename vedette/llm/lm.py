"""Language-model scores by stupid backoff over character n-grams.

Every character of the corpus starts one gram of ``order`` characters (padded at a text's
end), so the counts of all shorter grams are sums over the grams they begin, and one sort per
block of documents gives all of them. The count tables are relations keyed by a 64-bit hash of
the gram and partitioned by it; a block's distinct grams meet their totals there, and these
travel back to the block, where each document sums the logarithms of its characters' scores.
What is shuffled is one row per distinct gram and block, not one per occurrence.

The score of a character is count(gram) / count(gram without its last character) for the
longest gram ending there that the corpus holds at least ``least`` times, times ``backoff`` for
each order given up; a character that is itself rarer counts as seen once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import free_name, whole_text

BLOCK_CHARS, RUN_CHARS = 12_000_000, 1_000_000
MULTIPLIER, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
EMPTY = 0  # key of the empty gram, whose count is the number of characters


def _codes(texts: pa.ChunkedArray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by ``pad`` zeros; and the texts' lengths."""
    tail = "\0" * pad
    parts = [t.as_py() + tail for t in texts]
    lengths = np.array([len(p) - pad for p in parts], dtype=np.int64)
    return np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32), lengths


def _grams(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the grams of 1 to ``order`` characters that start at each place but the last pad."""
    n = len(codes) - order + 1
    out, h = [], np.full(n, 17, np.uint64)
    for k in range(order):
        h = (h ^ (codes[k:k + n].astype(np.uint64) + np.uint64(1))) * MULTIPLIER
        h ^= h >> np.uint64(29)
        h = h * MIX
        out.append(h ^ np.uint64(k + 1))
    return out


def _starts(lengths: np.ndarray, pad: int) -> np.ndarray:
    """Places where a character of a text stands (not a pad)."""
    ends = np.cumsum(lengths + pad)
    keep = np.ones(int(ends[-1]) if len(ends) else 0, bool)
    for k in range(1, pad + 1):
        keep[ends - k] = False
    return keep


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(where, np.concatenate(counts), len(found)).astype(np.int64)


def block_counts(texts: pa.ChunkedArray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of all orders in a block and how often they start; padded ones included."""
    codes, lengths = _codes(texts, order - 1)
    keep = _starts(lengths, order - 1)
    keys, sums = [np.array([EMPTY], np.uint64)], [np.array([lengths.sum()], np.int64)]
    for a in range(0, max(0, len(codes) - order + 1), RUN_CHARS):
        grams = _grams(codes[a:a + RUN_CHARS + order - 1], order)
        here = keep[a:a + len(grams[-1])]
        _, first, counts = np.unique(grams[-1][here], return_index=True, return_counts=True)
        for g in grams:
            k, n = _merged([g[here][first]], [counts])
            keys.append(k)
            sums.append(n)
    return _merged(keys, sums)


class Lookup:
    """Counts by key: a direct table by the upper bits, sorted search for the few that clash."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]
        self.shift = np.uint64(64 - max(8, int(len(keys)).bit_length() + 2))
        slots = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        slots[self.keys >> self.shift] = np.arange(len(keys))
        self.slots = slots

    def get(self, wanted: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(wanted), np.int64)
        at = self.slots[wanted >> self.shift]
        hit = (at >= 0) & (self.keys[at] == wanted)
        out = np.where(hit, self.counts[at], 0)
        again = np.flatnonzero(~hit & (at >= 0))
        if len(again):
            at = np.minimum(np.searchsorted(self.keys, wanted[again]), len(self.keys) - 1)
            out[again] = np.where(self.keys[at] == wanted[again], self.counts[at], 0)
        return out


def block_scores(texts: pa.ChunkedArray, keys: np.ndarray, counts: np.ndarray, order: int,
                 backoff: float) -> tuple[np.ndarray, np.ndarray]:
    """(characters, sum of log scores) of each text, from the counts of the block's grams."""
    codes, lengths = _codes(texts, order - 1)
    sums = np.zeros(len(lengths))
    if lengths.sum() == 0:
        return lengths, sums
    table = Lookup(keys, counts)
    total = float(table.get(np.array([EMPTY], np.uint64))[0])
    at = np.cumsum(lengths + order - 1) - lengths - (order - 1)
    low = 0
    while low < len(lengths):  # by runs of texts, so that arrays stay small
        high = max(low + 1, int(np.searchsorted(at, at[low] + RUN_CHARS)))
        _score_run(codes, at, lengths, low, high, table, total, order, backoff, sums)
        low = high
    return lengths, sums


def _score_run(codes, at, lengths, low, high, table, total, order, backoff, sums) -> None:
    first, last = int(at[low]), int(at[high - 1] + lengths[high - 1]) + order - 1
    part = codes[first:last]
    grams = _grams(part, order)
    n = len(grams[0])
    counts = [np.full(n, total)] + [table.get(g).astype(np.float64) for g in grams]
    size, starts = lengths[low:high], at[low:high] - first
    place = np.repeat(starts, size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
    inside = place - np.repeat(starts, size)
    score = np.full(len(place), np.log(backoff) * order - np.log(total))
    done = np.zeros(len(place), bool)
    for k in range(order, 0, -1):
        begin = place - (k - 1)
        usable = ~done & (inside >= k - 1)
        whole = counts[k][np.maximum(begin, 0)]
        usable &= whole > 0
        context = counts[k - 1][np.maximum(begin, 0)]
        where = np.flatnonzero(usable)
        score[where] = np.log(whole[where] / context[where]) + np.log(backoff) * (order - k)
        done[where] = True
    sums[low:high] = np.add.reduceat(np.append(score, 0.0), np.minimum(np.cumsum(size) - size, len(score))) * (size > 0)


def score_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text", order: int = 5, least: int = 1,
                    backoff: float = 0.4) -> DataFrame:
    """Returns doc_id, n_chars, log_score (natural logarithm, summed) and mean_log_score.

    Counts are over all rows, the scored one included; repeated rows count and score alike.
    Null and empty texts have no characters and score 0. Rows are dealt into blocks of about
    twelve million characters by a hash of id and text; a longer text is a block of its own.
    """
    rows = docs.select(F.col(doc).alias("doc_id"), whole_text(text).alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).repartition("block")

    def counted(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        keys, counts = block_counts(block["text"], order)
        return pa.table({"block": pa.array(np.full(len(keys), key[0].as_py()), pa.int64()),
                         "gram": pa.array(keys.view(np.int64)), "n": pa.array(counts)})

    grams = dealt.select("block", "text").groupBy("block").applyInArrow(counted, "block long, gram long, n long")
    # a gram has one row per block at most, so its rows can meet in one task
    totals = grams.withColumn("total", F.sum("n").over(Window.partitionBy("gram")))
    kept = totals if least <= 1 else totals.where((F.col("total") >= least) | (F.col("gram") == EMPTY))
    tables = kept.select("block", "gram", "total")

    def scored(block: pa.Table, table: pa.Table) -> pa.Table:
        n, s = block_scores(block["text"], table["gram"].to_numpy().view(np.uint64), table["total"].to_numpy(), order, backoff)
        return pa.table({"doc_id": block["doc_id"], "n_chars": pa.array(n), "log_score": pa.array(s)})

    kind = docs.schema[doc].dataType.simpleString()
    found = dealt.groupBy("block").cogroup(tables.groupBy("block")).applyInArrow(
        scored, f"doc_id {kind}, n_chars long, log_score double")
    return found.withColumn("mean_log_score", F.when(F.col("n_chars") > 0, F.col("log_score") / F.col("n_chars")).otherwise(0.0))
