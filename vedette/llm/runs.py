"""Periodic runs of words, proposed by string synchronising sets.

A run is a stretch of words with a smallest period q and at least ``exponent`` periods long
that no neighbouring word extends. All texts of a batch are laid end to end, longest first,
with a word of its own kind after each, so one pass serves all of them and no run crosses.

* Periods below ``2 * SMALLEST``: every word is compared with the one p places on; stretches of
  equal ones are the highly periodic regions with small periods.
* Larger periods, scale by scale, t = SMALLEST, 2 SMALLEST, 4 SMALLEST, ... for periods from 2t
  to 4t - 1. Position i is in the synchronising set of t if the smallest hash among the windows
  of t words that begin at i .. i + t is the first or the last one; windows with a period of at
  most t / 3 take no part (they lie in regions that smaller periods have already given). So
  membership hangs on the 2t words from i alone. A run of period q in [2t, 4t) has at least q
  beginnings i for which i and i + q see the same 2t words inside it. Were none of them in the
  set, all these windows were highly periodic, and so were the run, with a smaller period. Hence
  pairs of equal context at distance q propose every run, and as windows with large periods
  cannot come close to each other, a position has few partners.
* A proposal is extended both ways by hashes of 2^k words, from large to small, and then held
  against the words themselves; hashes decide nothing alone.

The same stretch may be proposed with a multiple of its period: the smallest one stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import free_name, whole_text

#: Smallest scale of the synchronising sets; periods below twice that are compared directly.
SMALLEST = 8
#: Words that are worked on together, at least one text.
TOGETHER = 250_000
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"
ODD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
FAR = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX
    return h ^ (h >> np.uint64(27))


def _doubled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of windows of twice the width; a window that does not fit has none."""
    return _mixed(h[:len(h) - width] * ODD + h[width:]) if len(h) > width else h[:0]


def _stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches of true values, ``least`` long at least."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= least
    return begin[long], end[long]


def _lowest(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each window of width + 1, width a power of two."""
    step = 1
    while step < width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[:-1], h[1:])


def _extended(levels: list[np.ndarray], at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far words equal those a period on, before and from the given positions, by their hashes."""
    right, left = at.copy(), at.copy()
    for k in range(len(levels) - 1, -1, -1):
        h, step = levels[k], 1 << k
        while True:  # a stretch may take the largest step often
            ok = right + period < len(h)
            ok[ok] = h[right[ok]] == h[right[ok] + period[ok]]
            right[ok] += step
            if k < len(levels) - 1 or not ok.any():
                break
        while True:
            to = left - step
            ok = (to >= 0) & (to + period < len(h))
            ok[ok] = h[to[ok]] == h[to[ok] + period[ok]]
            left[ok] -= step
            if k < len(levels) - 1 or not ok.any():
                break
    return left, right


def _true_stretch(words: np.ndarray, at: int, period: int) -> tuple[int, int]:
    left = right = at
    while right + period < len(words) and words[right] == words[right + period]:
        right += 1
    while left and words[left - 1] == words[left - 1 + period]:
        left -= 1
    return left, right


def _unique(begin: np.ndarray, end: np.ndarray, period: np.ndarray):
    order = np.lexsort((period, end, begin))
    begin, end, period = begin[order], end[order], period[order]
    new = np.ones(len(begin), bool)
    new[1:] = (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])
    return begin[new], end[new], period[new]


def find_runs(words: np.ndarray, upto: list[tuple[int, int]], exponent: int = 3):
    """(begin, end, period) arrays of all runs of at least ``exponent`` (3 or more) periods, by begin.

    ``words``: numbers, equal for equal words; what must not be crossed has a number of its own.
    ``upto``: (length of a text, where it ends with its mark), longest text first.
    """
    found = []
    for p in range(1, 2 * SMALLEST):
        here = next((end for n, end in reversed(upto) if n >= exponent * p), 0)
        if here == 0:
            break
        begin, end = _stretches(words[p:here] == words[:here - p], (exponent - 1) * p)
        found.append((begin, end + p, np.full(len(begin), p, np.int64)))
    begin, end, period = _unique(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else [np.zeros(0, np.int64)] * 3
    levels, scale = [_mixed(words.astype(np.uint64) * ODD + ODD)], SMALLEST
    while True:
        here = next((end_ for n, end_ in reversed(upto) if n >= exponent * 2 * scale), 0)
        if here == 0:
            return begin, end, period
        while len(levels) <= (2 * scale).bit_length() - 1:
            levels.append(_doubled(levels[-1], 1 << (len(levels) - 1)))
        window, context = levels[scale.bit_length() - 1][:here], levels[(2 * scale).bit_length() - 1][:here]
        flat = (3 * period <= scale) & (end - begin >= scale) & (begin < here)
        if flat.any():
            change = np.zeros(len(window) + 1, np.int64)
            np.add.at(change, begin[flat], 1)
            np.add.at(change, np.minimum(end[flat] - scale + 1, len(window)), -1)
            window = np.where(np.cumsum(change[:-1]) > 0, FAR, window)
        low = _lowest(window, scale)
        n = min(len(low), len(context))
        if n > 0:
            low = low[:n]
            chosen = np.flatnonzero(((low == window[:n]) | (low == window[scale:scale + n])) & (low != FAR))
            chosen = chosen[np.argsort(context[chosen], kind="stable")]
            seen, at, apart, k = context[chosen], [], [], 1
            while k < len(chosen):
                near = (seen[k:] == seen[:-k]) & (chosen[k:] - chosen[:-k] < 4 * scale)
                if not near.any():
                    break
                far = near & (chosen[k:] - chosen[:-k] >= 2 * scale)
                at.append(chosen[:-k][far])
                apart.append((chosen[k:] - chosen[:-k])[far])
                k += 1
            if at and len(at := np.concatenate(at)):
                apart = np.concatenate(apart)
                left, right = _extended([h[:here] for h in levels], at, apart)
                long = right - left >= (exponent - 1) * apart
                a, b, p = _unique(left[long], right[long] + apart[long], apart[long])
                for i in range(len(a)):
                    if not np.array_equal(words[a[i]:b[i] - p[i]], words[a[i] + p[i]:b[i]]):  # hashes that clashed
                        lo, hi = _true_stretch(words, int(a[i]), int(p[i]))
                        a[i], b[i] = lo, hi + p[i]
                good = b - a >= exponent * p
                begin, end, period = _unique(*(np.concatenate(x) for x in ((begin, a[good]), (end, b[good]), (period, p[good]))))
        scale *= 2


def _described(texts: list[list[bytes]], least: int, exponent: int) -> list[tuple[list[dict], bytes]]:
    """Runs and collapsed text of each list of words."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    number: dict[bytes, int] = {}
    words = np.empty(sum(map(len, texts)) + len(texts), np.int64)
    first, upto, at = [0] * len(texts), [], 0
    for k, i in enumerate(order):
        n = len(texts[i])
        first[i] = at
        words[at:at + n] = [number.setdefault(w, len(number)) for w in texts[i]]
        words[at + n] = -1 - k
        at += n + 1
        upto.append((n, at))
    begin, end, period = find_runs(words, upto, exponent)
    long = end - begin >= least
    begin, end, period = begin[long], end[long], period[long]
    out = []
    for i, text in enumerate(texts):
        lo, hi = np.searchsorted(begin, [first[i], first[i] + len(text)])
        if lo == hi:
            out.append(([], b" ".join(text)))
            continue
        keep = np.ones(len(text), bool)
        runs = []
        for k in range(lo, hi):
            a, b, p = int(begin[k]) - first[i], int(end[k]) - first[i], int(period[k])
            runs.append({"start": a, "length": b - a, "period": p})
            keep[a + p:b] = False
        runs.sort(key=lambda r: (r["start"], r["period"]))
        out.append((runs, b" ".join(text[k] for k in np.flatnonzero(keep))))
    return out


def periodic_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed",
                  least: int = 24, exponent: int = 3) -> DataFrame:
    """The rows of ``docs`` with all periodic runs of their words, and the text with each run cut to one period.

    Words are what stands between blanks, tabs and line breaks, numbered from 0. ``runs`` holds
    (start, length, period) of every run of ``least`` words and ``exponent`` (at least 3) periods,
    by start, then period; ``collapsed`` the words outside of what runs repeat, joined by one
    blank. Null, empty and blank texts have no runs and collapse to an empty text; texts of any
    length are worked on whole, each in one piece; repeated rows get equal results; columns of
    ``docs`` named like the two new ones are replaced, all others stay.
    """
    if exponent < 3:
        raise ValueError("synchronising sets propose runs of three periods and more")
    both = free_name(docs, "_found")

    @F.arrow_udf(f"struct<runs:{RUN},collapsed:string>")
    def described(column: pa.Array) -> pa.Array:
        out, held, size = [], [], 0
        for value in column.cast(pa.binary()):
            held.append(value.as_py().split())  # of bytes: at ASCII blanks only
            size += len(held[-1])
            if size > TOGETHER:
                out += _described(held, least, exponent)
                held, size = [], 0
        out += _described(held, least, exponent) if held else []
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array([r for r, _ in out], kind),
                                           pa.array([c for _, c in out], pa.binary()).cast(pa.string())], ["runs", "collapsed"])

    found = docs.withColumn(both, described(whole_text(text)))
    return found.withColumns({runs: F.col(f"{both}.runs"), collapsed: F.col(f"{both}.collapsed")}).drop(both)


def with_planted_period(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts whose id has a crc32 divisible by ten get a periodic tail; the others stay as they are.

    With h the crc32 and g = floor(h / 10), the words from g % n on repeat the first
    1 + floor((n - a) / (3 + g % 8)) of them. Null ids and texts without words stay as they are.
    """
    words = F.filter(F.split(whole_text(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    names = {k: free_name(docs, f"_{k}") for k in ("w", "a", "p")}
    w, a, p = (F.col(names[k]) for k in ("w", "a", "p"))
    h = F.crc32(F.col(doc).cast("string").cast("binary"))
    g = F.floor(h / 10)
    asked = docs.withColumn(names["w"], F.when(h % 10 == 0, words))
    n = F.size(w).cast("long")
    asked = asked.withColumn(names["a"], F.when(n > 0, g % n))
    asked = asked.withColumn(names["p"], F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)))
    tail = F.transform(F.sequence(F.lit(0).cast("long"), n - 1),
                       lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
    return asked.withColumn(text, F.when(a.isNotNull(), F.array_join(tail, " ")).otherwise(F.col(text))).drop(*names.values())
