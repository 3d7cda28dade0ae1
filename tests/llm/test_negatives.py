"""Hard negatives against scores of all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vedette.llm import negatives, queries

KIND = "id long, vector array<long>, label string, asks boolean, rank int, _g int"


def every_score(rows, positives=5, least=5, low=80, high=100):
    """(anchor, positive, rank, negative, positive score, negative score); rows: (id, vector, label, asks)."""
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and None not in r[1]]
    out = []
    for i, v, label in sorted({(i, tuple(v), label) for i, v, label, asks in rows if asks}):
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, m == label) for j, w, m, _ in rows if j != i)
        for p, j, same in [s for s in scored if s[2]][:positives]:
            window = [(s, k) for s, k, same in scored if not same and low * -p <= 100 * -s <= high * -p]
            out += [(i, j, rank + 1, k, -p, -s) for rank, (s, k) in enumerate(window[:least])]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], KIND)
    return sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("asks"), **options).collect())


def clustered(seed, n, width, spread):
    r = np.random.default_rng(seed)
    centre = r.normal(0, 60, (12, width))
    v = np.floor(centre[r.integers(0, 12, n)] + r.normal(0, spread, (n, width))).astype(int)
    return [(i, v[i].tolist(), "abc"[r.integers(0, 3)], i % 9 == 0) for i in range(n)]


def test_equal_to_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(negatives, "PACK", 6_000)  # several packs
    rows = clustered(1, 600, 24, 25)
    expected = every_score(rows)
    assert len(expected) > 500
    assert mined(spark, rows) == expected
    assert mined(spark, rows, positives=3, negatives=7, low=50, high=90) == every_score(rows, 3, 7, 50, 90)


def test_a_third_of_all_rows_alike_and_all_edge_cases(spark):
    r = random.Random(3)
    rows = clustered(2, 240, 10, 10)
    rows += [(1_000 + i, [50, -20] * 5, "ab"[i % 5 == 0], i % 40 == 0) for i in range(130)]  # ties by id
    rows += [(2_000 + i, [-x for x in rows[i][1]], "a", i < 4) for i in range(20)]  # negative scores
    rows += [(3_000, [], "a", True), (3_001, [0] * 10, "b", True), (3_002, [7] * 3, "a", True), (3_003, [5] * 30, "c", True)]
    rows += [(None, [1] * 10, "a", True), (4_000, None, "a", True), (4_001, [1, None], "a", True), (4_002, [9] * 10, None, True)]
    rows += [rows[0], rows[0], rows[9], (0, [40] * 10, "c", True), (5, [40] * 10, "c", False)]  # repeated rows and ids
    rows += [(5_000 + i, [r.choice([-negatives.LARGEST, negatives.LARGEST, 3]) for _ in range(10)], "abc"[i % 3], i == 0) for i in range(9)]
    assert mined(spark, rows) == every_score(rows)


def test_nothing_to_do(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1, 2], "a", False)]) == []
    assert mined(spark, [(1, [1, 2], "a", True)]) == []
    assert mined(spark, [(1, [1, 2], "a", True), (2, [1, 2], "b", None)]) == []
    with pytest.raises(ValueError):
        mined(spark, [], shares=(0.5,))


def test_whole_vectors(spark):
    values = [[0.5, -0.0001], [], None, [None, 1.0], [math.nan], [math.inf], [-math.inf, 1.0], [1e30, -1e30], [0.1]]
    df = spark.createDataFrame([(v,) for v in values], "v array<float>")
    got = [r[0] for r in df.select(negatives.whole_vector(F.col("v"), 256)).collect()]
    most = negatives.LARGEST
    assert got == [[128, -1], [], None, None, None, None, None, [most, -most], [25]]


def test_lists_omit_what_norms_cover():
    r = np.random.default_rng(4)
    numbers = np.floor(r.normal(0, 100, (500, 64)) * np.linspace(1, 0.01, 64)).astype(np.int16)
    index = negatives.Index(numbers, np.arange(500), ["a"] * 500)
    anchors = numbers[:20].astype(np.int64)
    scores = anchors @ numbers.T.astype(np.int64)
    floors = np.sort(scores, axis=1)[:, -5].astype(float)
    pairs = [set(zip(a.tolist(), x.tolist())) for a, x in index.candidates(anchors, floors)]
    assert {(a, x) for a in range(20) for x in np.flatnonzero(scores[a] >= floors[a]).tolist()} <= set().union(*pairs)
    assert sum(map(len, pairs)) < 20 * 500 / 5


def test_query_over_null_and_repeated_rows(spark, tmp_path):
    r = random.Random(7)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(16)], r.randrange(10)) for i in range(420)]
    rows += [(100, None, 1), (200, [math.nan] * 16, 2), (700, [0.1] * 16, None), (None, [0.1] * 16, 3), (421, [0.1, None], 3), rows[5], rows[100]]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], str((m + 1) % 10 if i % 7 == 0 else m), i % 100 == 0)
            for i, v, m in rows if None not in (i, v, m) and None not in v and not any(map(math.isnan, v))]
    got = queries.QUERIES["op12_hard_negatives"](spark, str(tmp_path))
    assert sorted(tuple(x) for x in got.collect()) == every_score(kept)
