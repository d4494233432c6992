import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotelab.llm import gnat

ROWS = "id long, label int, vector array<double>, leaf string, score double, block int"


def brute(rows, anchor=lambda i: i % 5 == 0, k=5, n=3):
    once = {}
    for i, label, x in rows:
        if i is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        new = (label, [max(-(2**62), min(2**62, math.floor(256 * v))) for v in x])
        once[i] = min(once.get(i, new), new)
    out = []
    for a, (label, q) in once.items():
        if not anchor(a):
            continue
        score = {i: sum(x * y for x, y in zip(q, w)) for i, (_, w) in once.items() if i != a}  # noqa: B905
        first = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in first if once[i][0] == label][:k]:
            some = [i for i in first if once[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:n]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(some, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    frame = spark.createDataFrame([(*r, "x", 0.5, 1) for r in rows], ROWS)
    got = gnat.hard_negatives(frame, F.col("id") % 5 == 0, **more)
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(seed, n, width=6, labels=3, clusters=5):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(clusters, width))
    return [(i, int(random.integers(labels)), (centres[random.integers(clusters)] + 0.15 * random.normal(size=width)).tolist()) for i in range(n)]


SMALL = {"sample": 60, "fanout": 3, "leaf": 6, "block": 16}


def test_mining_equals_comparing_all_rows(spark):
    rows = vectors(1, 300)
    rows += [(1000 + i, i % 3, rows[7][2]) for i in range(60)]  # a hot vector
    rows += [(2000, 1, None), (2001, None, rows[0][2]), (2002, 1, [1.0, None]), (2003, 1, [float("nan")] * 6), (2005, 1, [float("inf")] * 6)]
    rows += [rows[5], (5, 2, rows[9][2]), (None, 1, rows[0][2])]  # repeated ids, no id
    want = brute(rows)
    assert len(want) > 300
    assert mined(spark, rows, **SMALL) == want
    assert mined(spark, rows) == want  # one leaf or many: the same rows


def test_large_components_unequal_widths_zero_and_negative_scores(spark):
    rows = [(i, i % 2, [float(3**i % 101) * 1e5, 2.0, -float(i % 4)][: 1 + i % 3]) for i in range(30)]
    rows += [(100, 0, []), (101, 1, [0.0] * 3), (102, 0, [-5.0, -5.0, -5.0]), (105, 0, [-4.0, -5.0, -5.0]), (110, 1, [])]
    assert mined(spark, rows, **SMALL) == brute(rows)
    big = [(i, i % 2, [1e6 * (1 + i % 7), -1e6 * (i % 3)]) for i in range(40)]  # inner products above 2**53
    assert mined(spark, big, **SMALL) == brute(big) != []


def test_no_rows_no_anchors_one_label(spark):
    rows = vectors(3, 12)
    assert mined(spark, []) == []
    assert mined(spark, [(i + 1, label, x) for i, label, x in rows[:4]]) == []
    assert mined(spark, [(i, 1, x) for i, _, x in rows]) == []


def test_objects_where_longs_overflow():
    a = np.array([[2**40, 2**40]])
    assert gnat.inner(a, a).tolist() == [[gnat.HIGHEST]]
    assert gnat.inner(a, np.array([[2**20, -(2**20) + 1]])).tolist() == [[2**40]]


@pytest.mark.parametrize("seed", range(4))
def test_ranges_leave_out_leaves_but_no_row_of_the_window(seed):
    random = np.random.default_rng(seed)
    rows = np.concatenate([c + random.integers(-20, 20, (80, 8)) for c in random.integers(-300, 300, (6, 8))])
    tree = gnat.Tree(rows[::3], 4, 8)
    norms = (rows.astype(float) ** 2).sum(axis=1)

    def see(node, at, away, near):
        for j in np.unique(near):
            mine = near == j
            node.low[:, j], node.high[:, j] = away[mine].min(axis=0), away[mine].max(axis=0)
            node.norm_low[j], node.norm_high[j] = norms[at[mine]].min(), norms[at[mine]].max()

    leaves = tree.visit(rows, see)
    left = []
    for anchor in rows[::17]:
        score = rows @ anchor
        for low, high in ((np.sort(score)[-5], gnat.HIGHEST), (int(0.5 * score.max()), int(0.95 * score.max())), (0, 0)):
            found = tree.survivors(anchor, float(low), float(high))
            assert set(leaves[(score >= low) & (score <= high)]) <= set(found)
            left.append(len(found) / tree.leaves)
    assert np.mean(left) < 0.6  # and it does leave out
