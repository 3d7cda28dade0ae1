"""Periodic runs against a search over every period, and the digest query against plain Python."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from vedette.llm import queries, runs


def every_run(words, least=24, exponent=3):
    """(start, length, period), period by period and word by word."""
    n, out = len(words), {}
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, exponent * p):
                out.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((a, b - a, p) for (a, b), p in out.items())


def collapsed(words, found):
    gone = {k for a, n, p in found for k in range(a + p, a + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def patchwork(r, size):
    words = []
    while len(words) < size:
        if r.random() < 0.4:
            words += [str(r.randint(0, r.choice([1, 3, 500]))) for _ in range(r.randint(1, 60))]
            continue
        unit = [str(r.randint(0, r.choice([1, 2, 300]))) for _ in range(r.randint(1, r.choice([3, 20, 120])))]
        if r.random() < 0.4:  # periodic inside its period
            unit = unit * 3 + [str(r.randint(0, 2))] * r.randint(0, 5)
        part = (unit * 7)[:int(len(unit) * r.uniform(2.5, 6))]
        if part and r.random() < 0.2:
            part[r.randrange(len(part))] = "z"
        words += part
    return words


@pytest.mark.parametrize("least", [1, 24])
def test_all_runs_are_found(least):
    held = 0
    for seed in range(30):
        r = random.Random(seed)
        texts = [patchwork(r, r.randint(0, 900)) for _ in range(r.randint(1, 6))]
        got = runs._described([[w.encode() for w in t] for t in texts], least, 3)
        for words, (found, text) in zip(texts, got, strict=True):
            expected = every_run(words, least)
            held += sum(p >= 2 * runs.SMALLEST for _, _, p in expected)
            assert [(f["start"], f["length"], f["period"]) for f in found] == expected
            assert text.decode() == collapsed(words, expected)
    assert held > 60


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=160), st.integers(1, 60), st.integers(2, 6))
def test_runs_of_two_words(words, length, times):
    words = words + words[:length] * times
    got = runs._described([[w.encode() for w in words]], 24, 3)[0][0]
    assert [(f["start"], f["length"], f["period"]) for f in got] == every_run(words)


def test_hashes_decide_nothing_alone(monkeypatch):
    monkeypatch.setattr(runs, "_mixed", lambda h: h & runs.np.uint64(3))  # clashes everywhere
    r = random.Random(5)
    words = [str(r.randint(0, 9)) for _ in range(200)]
    for a, n, p in [(f["start"], f["length"], f["period"]) for f in runs._described([[w.encode() for w in words]], 1, 3)[0][0]]:
        assert all(words[k] == words[k + p] for k in range(a, a + n - p))


def digest(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = every_run(words)
    best = min(found, key=lambda f: (-Fraction(f[1], f[2]), f[0], f[2]), default=None)
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in ("".join(f"{a},{n},{p}\n" for a, n, p in found), collapsed(words, found))]
    return (len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2], *sha)


def test_query_on_a_fixture(spark, tmp_path):
    r = random.Random(8)
    texts = [" ".join(patchwork(r, r.randint(0, 500))) for _ in range(150)]
    texts += ["", None, " \t\n", "a", "a " * 30, "a\x0bb\x0cc\r" * 12, " a  " * 30, "a b " * 20_000, texts[0], "A a " * 20]
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.union(docs.limit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()
    assert len(rows) == len(texts) + 1
    planted = 0
    for row in rows:
        planted += zlib.crc32(str(row["doc_id"]).encode()) % 10 == 0
        if len(texts[row["doc_id"]] or "") < 20_000:
            assert tuple(row)[1:] == digest(row["doc_id"], texts[row["doc_id"]]), row["doc_id"]
    assert planted > 5


def test_clashing_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b " * 20, 1, 2, 3), (7, None, 1, 2, 3), (7, "x", 1, 2, 3)],
                                 "doc_id long, text string, _found int, runs int, _a int")
    out = runs.periodic_runs(runs.with_planted_period(docs))
    assert out.columns == ["doc_id", "text", "_found", "runs", "_a", "collapsed"]
    got = {(r["doc_id"], r["collapsed"]): [tuple(x) for x in r["runs"]] for r in out.collect()}
    assert got == {(None, "a b"): [(0, 40, 2)], (7, ""): [], (7, "x"): []}
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, exponent=2)
    assert out.where(F.col("_found") == 1).count() == 3
