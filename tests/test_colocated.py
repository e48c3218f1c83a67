"""Joins of bucketed tables, Bloom filters and two-phase aggregates, against plain code and by their plans."""

from __future__ import annotations

import random
from collections import defaultdict
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from marlstone.operators import colocated
from marlstone.operators.folds import fold
from marlstone.plans import scale
from marlstone.sources import materialize


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hot", [False, True])
def test_co_located(spark, no_broadcast, hot):
    keys = [7] * 900 + [None] * 900 + list(range(300)) if hot else [k for k in range(300) for _ in range(3)]
    left = materialize(spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "l_id int, l_key int"), "left-rows")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(5, 200)] + [(7, "again"), (None, "none")], "r_key int, r_value string")
    a, b, on = colocated.co_located(left, right, "l_key", "r_key", 8)
    joined = a.join(b, on)
    want = sorted((i, k, v) for i, k in enumerate(keys) for q, v in [(k, f"r{k}"), *([(7, "again")] if k == 7 else [])] if k is not None and 5 <= k < 200)
    assert sorted(tuple(r) for r in joined.select("l_id", "l_key", "r_value").collect()) == want
    assert a.join(b, on, "left").select("l_id").distinct().count() == len(keys)
    assert a.join(b, on, "left_anti").count() == sum(k is None or not 5 <= k < 200 for k in keys)
    assert "Exchange" not in plan(joined)
    assert ("left_salt" in a.columns) == hot
    if hot:
        sizes = [r.n for r in a.where("l_key = 7").groupBy("left_salt").agg(F.count("*").alias("n")).collect()]
        assert len(sizes) == 4 and max(sizes) < 300
    else:
        assert "Exchange" not in plan(joined.groupBy("l_key").count())


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "l_key int"), spark.createDataFrame([(1,)], "r_key int")
    a, b, on = colocated.co_located(none, some, "l_key", "r_key", 4)
    assert a.join(b, on).count() == 0
    assert colocated.may_match(none, some, "l_key", "r_key").count() == 0
    assert colocated.may_match(some, none, "r_key", "l_key").count() == 0


def test_may_match(spark, no_broadcast, monkeypatch):
    large = spark.range(200_000).select(F.when(F.col("id") % 1000 != 1, F.col("id")).alias("k"), F.lit("x").alias("bloom_word"), F.col("id").alias("v"))
    small = spark.range(0, 200_000, 50).select(F.col("id").alias("s"))
    kept = colocated.may_match(large, small, "k", "s")
    assert kept.columns == ["k", "v"]
    assert kept.where("k % 50 = 0").count() == 4000
    assert kept.count() < 4000 + 0.03 * 200_000
    text = plan(kept.join(small, F.col("k") == F.col("s")))
    assert text.index("SortMergeJoin") < text.index("BroadcastHashJoin")  # the filter is below the join's exchange
    with pytest.raises(ValueError):
        colocated.may_match(large, small.select(F.col("s").cast("int")), "k", "s")
    monkeypatch.setattr(colocated, "MOST_WORDS", 64)
    assert colocated.may_match(large, small, "k", "s").count() == 200_000


@pytest.mark.parametrize("parts", ["1", "7"])
def test_fold(spark, parts):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 6 + [None, "a", "é"]), i, rng.randint(-9, 8)) for i in range(4000)] + [("all", -1, 5), ("low", -2, -4)]
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        frame = spark.createDataFrame(rows, "k string, i int, v long").repartition(3)
        state = "n long, total long, best long, head long, tail long, longest long, starts long, ends long"
        got = {r[0]: tuple(r)[1:] for r in fold(frame, ["k"], ["i"], ["v"], state, scale.stretch, scale.join_stretches).collect()}
        assert fold(frame.where("i < -5"), ["k"], ["i"], ["v"], state, scale.stretch, scale.join_stretches).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = defaultdict(list)
    for k, _, v in sorted(rows, key=lambda r: r[1]):
        groups[k].append(v)
    assert set(got) == set(groups)
    for k, v in groups.items():
        best, here = None, 0
        for x in v:  # stretches that end here
            here = max(here, 0) + x
            best = here if best is None else max(best, here)
        stops = [-1, *(i for i, x in enumerate(v) if x <= 0), len(v)]
        runs = [b - a - 1 for a, b in pairwise(stops)]
        heads = [sum(v[:i]) for i in range(1, len(v) + 1)]
        tails = [sum(v[i:]) for i in range(len(v))]
        assert got[k] == (len(v), sum(v), best, max(heads), max(tails), max(runs), runs[0], runs[-1])
