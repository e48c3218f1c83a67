"""Joins against loops over all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import joins, spans


def frames(spark):
    rng = random.Random(4)
    left = [(i, rng.choice([1, 2, 3, None]), rng.choice([None, *range(30)])) for i in range(80)]
    right = [(i, rng.choice([1, 2, None]), rng.choice([None, *range(30)])) for i in range(60)]
    return left, right, spark.createDataFrame(left, "i int, k int, t int"), spark.createDataFrame(right, "j int, k int, t int")


def test_as_of(spark):
    left, right, a, b = frames(spark)
    got = {r.i: r.j for r in joins.as_of(a, b, ["k"], "t", ["j"]).collect()}
    want = {}
    for i, k, t in left:
        fits = [(u, j) for j, q, u in right if k is not None and t is not None and q == k and u is not None and u <= t]
        want[i] = max(fits)[1] if fits else None
    assert got == want


def test_interval(spark):
    left, right, a, b = frames(spark)
    got = sorted((r.i, r.j) for r in joins.interval(a, b.withColumnRenamed("t", "s"), ["k"], "t", "s", 7).collect())
    assert got == sorted((i, j) for i, k, t in left for j, q, s in right if None not in (k, t, s) and k == q and s <= t < s + 7)


def test_as_of_with_a_burst(spark):
    rng = random.Random(11)
    times = [*(1_000_000 + rng.randrange(400) for _ in range(300)), *rng.sample(range(10**9), 40)]
    left, right = [(i, 1, t) for i, t in enumerate(times)], [(i, 1, t) for i, t in enumerate(rng.sample(times, 150))]
    a, b = spark.createDataFrame(left, "i int, k int, t int").repartition(3), spark.createDataFrame(right, "j int, k int, t int")
    got = {r.i: r.j for r in joins.as_of(a, b, ["k"], "t", ["j"]).collect()}
    assert got == {i: max(((u, j) for j, _, u in right if u <= t), default=(0, None))[1] for i, _, t in left}
    at = b.select(F.col("t").alias("at"))
    spread = joins._in_cells(at, at).groupBy("cell").count().agg(F.max("count")).first()[0]
    assert spread <= 15  # of 150 rows, nearly all in one burst


def test_sessions_of_a_hot_key(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice(["a"] * 8 + ["b", None]), rng.choice([None, rng.randrange(50), 10**6 + rng.randrange(3000), rng.randrange(10**9)])) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, k string, t long").repartition(5)
    want, last, count = {}, {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0)):
        if t is not None and (k not in last or t - last[k] > 9):
            count[k] = count.get(k, 0) + 1
        want[i] = None if t is None else count[k]
        last[k] = t if t is not None else last.get(k)
    assert {r.i: r.session for r in joins.sessions(df, ["k"], "t", 9).collect()} == want
    assert joins.sessions(df.limit(0), ["k"], "t", 9).collect() == []


def test_sessions_and_top(spark):
    df = spark.createDataFrame([("a", 1), ("a", 5), ("a", 20), ("a", 30), ("b", 3)], "k string, t int")
    got = sorted((r.k, r.t, r.session) for r in joins.sessions(df, ["k"], "t", 10).collect())
    assert got == [("a", 1, 1), ("a", 5, 1), ("a", 20, 2), ("a", 30, 2), ("b", 3, 1)]
    assert sorted((r.k, r.t, r["rank"]) for r in joins.top(df, ["k"], [F.desc("t")], 2).collect()) == [("a", 20, 2), ("a", 30, 1), ("b", 3, 1)]


def test_overlaps(spark):
    rng = random.Random(9)
    made = lambda n, name: [(i, rng.choice([1, 1, 1, 2, None]), s, None if rng.random() < 0.02 else s + rng.choice([0, 1, 2, 5, 30, 1000, 100_000, -3])) for i in range(n) for s in [rng.choice([rng.randint(-60, 60), rng.randint(-40_000, 40_000)])]]  # noqa: E731, ARG005
    left, right = made(150, "a"), made(130, "b")
    a = spark.createDataFrame(left, "i int, k int, s long, e long").repartition(3)
    b = spark.createDataFrame(right, "j int, k int, f long, g long")
    got = sorted((r.i, r.j) for r in spans.overlaps(a, b, ["k"], ("s", "e"), ("f", "g")).collect())
    want = sorted((i, j) for i, k, s, e in left for j, q, f, g in right if None not in (k, q, e, g) and k == q and s < e and f < g and s < g and f < e)
    assert got == want and len(want) > 500
    assert spans.overlaps(a.limit(0), b, ["k"], ("s", "e"), ("f", "g")).collect() == []


@pytest.mark.parametrize("key_rows", [0, 30, 2_000])
def test_overlaps_of_keys_with_few_and_many_rows(spark, monkeypatch, key_rows):
    monkeypatch.setattr(spans, "KEY_ROWS", key_rows)
    rng = random.Random(13)
    made = lambda n: [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice([5, None, 7]), s, s + rng.choice([0, 1, 40, 3000])) for i in range(n) for s in [rng.randint(-4000, 4000)]]
    left, right = made(150), made(130)
    a = spark.createDataFrame(left, "i int, k int, l int, s long, e long").repartition(3)
    b = spark.createDataFrame(right, "j int, k int, l int, f long, g long")
    found = spans.overlaps(a, b, ["k", "l"], ("s", "e"), ("f", "g"))
    want = sorted((i, j) for i, k, m, s, e in left for j, q, n, f, g in right if None not in (k, m) and (k, m) == (q, n) and s < e and f < g and s < g and f < e)
    assert sorted((r.i, r.j) for r in found.collect()) == want and len(want) > 150
    assert found.columns == ["k", "l", "i", "s", "e", "j", "f", "g"]
    # only keys with many rows have them repeated, once a cell
    assert ("Generate" in found._jdf.queryExecution().optimizedPlan().toString()) == (key_rows < 2_000)


def test_at_most(spark):
    rng = random.Random(10)
    left = [(i, rng.choice([None, *range(12)])) for i in range(70)]
    right = [(rng.choice([None, *range(12)]), rng.choice([None, 1, 7])) for _ in range(200)]
    a, b = spark.createDataFrame(left, "i int, v int"), spark.createDataFrame(right, "w int, m int")
    got = {r.i: (r.n, r.total) for r in spans.at_most(a, b, "v", "w", {"n": F.lit(1).cast("long"), "total": F.col("m").cast("long")}).collect()}
    below = lambda v: [m for w, m in right if v is not None and w is not None and w <= v]
    assert got == {i: (len(below(v)), sum(m or 0 for m in below(v))) for i, v in left}
