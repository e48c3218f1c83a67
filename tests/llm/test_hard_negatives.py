"""Hard-negative mining against loops over all rows."""

from __future__ import annotations

import math

import numpy as np
import pytest

from marlstone.llm import hard_negatives


def plain(rows, every=100, k=5):
    used = []
    for i, e, label in rows:
        if i is None or label is None or not e or any(x is None or not math.isfinite(x) for x in e):
            continue
        used.append((i, [math.floor(256 * x) for x in e], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a, (i, v, label) in enumerate(used):
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, m) for b, (j, w, m) in enumerate(used) if b != a)  # noqa: B905
        for s, p, _ in [x for x in scored if x[2] == label][:k]:
            fits = [x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(i, p, n, j, -s, -t) for n, (t, j, _) in enumerate(fits, 1)]
    return sorted(out)


def made(n, seed, dims=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    rows = [(int(i), [float(np.float32(x)) for x in (centres[i % 5] + rng.normal(size=dims) * 0.4)], int(rng.integers(0, 10))) for i in range(n)]
    return rows


def test_mine(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "TREE_ROWS", 200)
    monkeypatch.setattr(hard_negatives, "LEAF_ROWS", 8)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 6)  # so that there are several blocks
    rows = made(900, 3)
    rows += [(None, [1.0] * 6, 1), (1001, None, 1), (1002, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (1003, [1.0] * 6, None), (1004, [float("nan")] * 6, 2), (1005, [float("inf")] * 6, 2)]
    rows += [(100, rows[100][1], rows[100][2]), (2000, rows[7][1], rows[7][2]), (2001, rows[7][1], rows[7][2])]  # repeated rows, ties
    rows += [(3000 + i, rows[9][1], 4) for i in range(40)]
    frame = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<float>, label int, rid string, score double").repartition(3)
    got = sorted(tuple(r) for r in hard_negatives.mine(frame).collect())
    assert got == plain(rows) and len(got) > 100


def test_ball_bounds_hold():
    rng = np.random.default_rng(1)
    rows, labels = np.floor(rng.normal(size=(500, 5)) * 100), rng.integers(0, 4, 500)
    order, root = hard_negatives.ball_tree(rows, labels)
    assert sorted(order) == list(range(500))
    seen, stack = 0, [root]
    while stack:
        ball = stack.pop()
        own = rows[order[ball.begin : ball.end]]
        assert (((own - ball.centre) ** 2).sum(axis=1) <= ball.radius**2 + 1e-6).all()
        assert all(hard_negatives._bit(labels[order[ball.begin : ball.end]]) & ball.bits)
        if ball.parts:
            stack += ball.parts
        else:
            seen += ball.end - ball.begin
    assert seen == 500


def test_prunes(spark):
    """Far clusters are not scored: fewer leaves are visited than there are."""
    rng = np.random.default_rng(2)
    rows = np.floor(np.concatenate([rng.normal(size=(400, 4)) + 1000 * np.eye(4)[i] for i in range(4)]) * 10)
    n = len(rows)
    block = hard_negatives.Anchors(np.array([0]), np.array([1]), rows[:1], np.array([[-(1 << 60)]]), np.array([[1 << 60]]), True)
    best = hard_negatives.Best.empty(1, 5)
    visited = []
    original = hard_negatives.Best.add
    hard_negatives.Best.add = lambda self, *a: (visited.append(1), original(self, *a))
    try:
        block.search(np.arange(n), np.arange(n), np.ones(n, np.int64), rows, best)
    finally:
        hard_negatives.Best.add = original
    score = rows @ rows[0]
    score[0] = -1e18
    assert list(best.vec_id[0]) == sorted(range(n), key=lambda i: (-score[i], i))[:5] and len(visited) <= 6


def test_empty_and_other_lengths(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert hard_negatives.mine(spark.createDataFrame([], kind)).collect() == []
    assert hard_negatives.mine(spark.createDataFrame([(0, [], 1), (1, [], 1)], kind)).collect() == []
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.0], 2), (3, [0.9], 2), (8, [1.0, 0.0], 3)]
    assert sorted(tuple(r) for r in hard_negatives.mine(spark.createDataFrame(rows, kind)).collect()) == plain([r for r in rows if len(r[1]) == 2])
    with pytest.raises(Exception, match="inner products may reach"):
        hard_negatives.mine(spark.createDataFrame([(0, [1e9, 0.0], 1), (1, [1e9, 0.0], 1)], kind)).collect()
