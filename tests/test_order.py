"""Numbers, ranks and running totals over a whole table, against plain loops."""

from __future__ import annotations

import random

import pytest

from marlstone.operators import order


@pytest.mark.parametrize("parts", ["3", "7"])
def test_numbered(spark, parts):
    rng = random.Random(int(parts))
    # one value that most rows share, so that it goes on over several partitions
    rows = [(i, rng.choice([5, 5, 5, 5, 5, None, *range(10)]), rng.choice([None, *range(4)])) for i in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        frame = spark.createDataFrame(rows, "i int, k int, v int").repartition(4)
        got = {r.i: r for r in order.numbered(frame, ["k DESC"], {"total": frame["v"]}, "n", "r", "d").collect()}
        exact = {r.i: r for r in order.numbered(frame, ["k", "i DESC"], {"total": frame["v"]}, "n").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    key = lambda k: (k is None, -(k or 0))  # noqa: E731  descending, nulls last
    for i, k, _ in rows:
        less = [q for _, q, _ in rows if key(q) < key(k)]
        assert got[i].r == len(less) + 1 and got[i].d == len(set(less)) + 1 and got[i].k == k
    assert sorted(r.n for r in got.values()) == list(range(1, 401))
    assert [r.k for r in sorted(got.values(), key=lambda r: r.n)] == sorted((k for _, k, _ in rows), key=key)
    running = 0
    for r in sorted(got.values(), key=lambda r: r.n):
        running += r.v or 0
        assert r.total == running
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, -r[0]))
    total = 0
    for n, (i, _, v) in enumerate(want, 1):
        total += v or 0
        assert (exact[i].n, exact[i].total) == (n, total)


def test_empty_and_clashing_names(spark):
    assert order.numbered(spark.createDataFrame([], "k int, v int"), ["k"]).collect() == []
    frame = spark.createDataFrame([(2, 9, "x", 1), (1, 8, "y", 1)], "k int, part int, tie string, row_number int")
    assert sorted(tuple(r) for r in order.numbered(frame, ["k"]).collect()) == [(1, 8, "y", 1), (2, 9, "x", 2)]
