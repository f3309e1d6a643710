import math
import random
from collections import defaultdict

import numpy as np
import pytest

from roadspeed.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, most=5):
    use = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, lab in rows
           if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, lab, v in {(i, lab, tuple(v)) for i, lab, v in use if i % every == 0}:
        score = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in use]
        pos = sorted((s, j) for s, j, other in score if other == lab and j != i)[:most]
        neg = sorted((s, j) for s, j, other in score if other != lab)
        for s, j in pos:
            fits = [(t, k) for t, k in neg if 80 * -s <= 100 * -t <= 100 * -s][:most]
            out += [(i, j, r, k, -s, -t) for r, (t, k) in enumerate(fits, 1)]
    return sorted(out)


def got(spark, rows, every=100, **how):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as q", "2 as leaf", "3 as score", "'x' as anchor_id").repartition(4)
    out = H.hard_negatives(df, every=every, **how)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def rows_of(seed, n, dim, clusters=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    v = centres[rng.integers(0, clusters, n)] + .3 * rng.normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1)[:, None]
    return [(i, x.astype(np.float32).tolist(), int(rng.integers(0, 3))) for i, x in enumerate(v)]


def test_equals_brute_force_with_many_leaves_and_blocks(spark):
    rows = rows_of(1, 900, 6)
    rows += [(2000 + i, rows[17][1], i % 2) for i in range(300)]  # a third of all rows is one vector
    want = brute(rows, every=30)
    assert len(want) > 300
    assert got(spark, rows, every=30, sample=400, fan=4, leaf=20, block=6 * 50) == want


def test_nulls_ties_repeats_and_odd_vectors(spark):
    rows = rows_of(2, 120, 4)
    rows += [(None, rows[0][1], 1), (500, None, 1), (501, [0.1, None, 0.2, 0.3], 1), (502, [float("nan")] * 4, 1), (503, [float("inf")] * 4, 0),
             (504, rows[1][1], None), (10, rows[10][1], rows[10][2]), (20, rows[21][1], 2), (30, rows[30][1], (rows[30][2] + 1) % 3),
             (505, [], 0), (506, [0.5], 1), (600, [0.0] * 4, 1), (610, [-0.9, -0.9, -0.9, -0.9], 2)]
    assert got(spark, rows, every=10) == brute(rows, every=10)
    assert got(spark, rows, every=10, sample=60, fan=3, leaf=8) == brute(rows, every=10)


def test_large_components_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-3000, 3000) for _ in range(5)], i % 2) for i in range(60)]
    assert got(spark, rows, every=10) == brute(rows, every=10)
    with pytest.raises(ValueError):
        got(spark, rows + [(100, [1e9] * 5, 1)])


def test_empty_table_and_single_rows(spark):
    assert got(spark, []) == []
    assert got(spark, [(0, [1.0, 0.0], 1)]) == []
    assert got(spark, [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.1], 0)]) == brute([(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.1], 0)])


def test_tree_drops_leaves_only_when_no_row_of_theirs_is_in_a_window():
    x = np.array([r[1] for r in rows_of(3, 600, 3)])
    x = np.hstack([x, np.zeros((600, 1))])
    nodes, leaves = H.fit(x[:200], 4, 10)
    leaf = H.descend(nodes, x, learn=True)
    assert leaves > 10 and len(set(leaf.tolist())) > 10
    inner, outer = np.full((50, 1), .3), np.full((50, 1), .5)
    seen = H.visited(nodes, leaves, x[:50], inner, outer, 1e-9)
    d = H._distances(x[:50], x)
    hit = defaultdict(set)
    for a, b in zip(*np.nonzero((d >= .3) & (d <= .5))):
        hit[a].add(leaf[b])
    assert all(seen[a, k] for a, own in hit.items() for k in own)
    assert seen.mean() < .8
