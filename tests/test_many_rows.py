"""Steps whose cost by row, or rows by task, are held down."""

import itertools
import math

import numpy as np

from vedette.operators import iforest, sweep

NAMES = ("feature", "threshold", "left", "right", "rows")


def expected_path(tree, x, known, n=0, depth=0):
    if tree["feature"][n] < 0:
        return depth + float(iforest.mean_path(tree["rows"][n]))
    f, children = tree["feature"][n], (tree["left"][n], tree["right"][n])
    if f in known:
        return expected_path(tree, x, known, children[0] if x[f] <= tree["threshold"][n] else children[1], depth + 1)
    return sum(tree["rows"][c] / tree["rows"][n] * expected_path(tree, x, known, c, depth + 1) for c in children)


def test_attribution_is_that_of_all_subsets_in_any_portions():
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(60, 4)), 1)
    trees = [dict(zip(NAMES, iforest.grow(x[r.choice(60, 24, replace=False)], np.random.default_rng(k)), strict=True)) for k in range(3)]
    got = iforest.shapley(x, trees, 4, step=7)
    for row in range(0, 60, 6):
        for f in range(4):
            want = 0.0
            for size in range(4):
                share = math.factorial(size) * math.factorial(3 - size) / math.factorial(4)
                for s in itertools.combinations([g for g in range(4) if g != f], size):
                    want += share * np.mean([expected_path(t, x[row], {*s, f}) - expected_path(t, x[row], set(s)) for t in trees])
            assert abs(got[row, f] - want) < 1e-9


def test_attribution_looks_up_branches_not_leaves():
    r = np.random.default_rng(4)
    x = np.round(r.random((400, 9)), 2)
    x[:, 3] = 0.5
    trees = [dict(zip(NAMES, iforest.grow(x[r.choice(400, 256, replace=False)], np.random.default_rng(k)), strict=True)) for k in range(3)]
    for tree in trees:
        assert 4 * len(iforest._tree_games(tree, 9)[1]) < sum(f < 0 for f in tree["feature"])
    for rows in (x, np.where(r.random(x.shape) < 0.1, np.nan, x)):
        phi, base, whole = iforest.explained(rows, trees, 9, step=64)
        alone = iforest.explained(rows, trees, 9, states=1)  # every leaf by itself
        assert np.allclose(phi, alone[0], atol=1e-12) and abs(base - alone[1]) < 1e-12
        assert np.allclose(whole, np.mean([iforest.path_lengths(rows, t) for t in trees], axis=0))
    assert np.allclose(base + iforest.shapley(x, trees, 9).sum(axis=1), iforest.explained(x, trees, 9)[2])


def test_window_tasks_are_small_and_keep_keys_together(spark):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(4_000).selectExpr("id % 50 AS k", "id % 7 AS _chunk")
    dealt = sweep.dealt(rows, "k")
    assert dealt.rdd.getNumPartitions() == 8 * parts
    places = dealt.selectExpr("k", "_chunk", "spark_partition_id() AS p").distinct()
    assert places.count() == 350 and places.select("p").distinct().count() > parts
