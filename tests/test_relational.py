"""Joins, streams and files beyond what the registered queries compare with SQL."""

from __future__ import annotations

import datetime as dt
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.functions.python import cut_words, gini
from marlstone.operators import joins
from marlstone.plans import relational
from marlstone.sources import read_files, write_files
from marlstone.streaming import followed, sessions, since_last, windowed

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_strategies_are_those_asked_for(spark):
    found = plan(relational.priority_suppliers(spark, DATA))  # all sides but one are small at this scale
    assert found.count("BroadcastHashJoin") == 3 and "SortMergeJoin" not in found and "Exchange hashpartitioning(l_" not in found
    assert "BroadcastNestedLoopJoin" in plan(relational.price_bands(spark, DATA))
    found = plan(relational.large_customers(spark, DATA))
    assert "LeftSemi" in found and "GreaterThanOrEqual(o_totalprice,350000.0)" in found.split("PushedFilters")[2] and "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in found


def test_a_sketch_is_kept_for_each_type_of_event_alone(spark, tmp_path):
    rows = [(kind, user) for kind in ("a", "b", None) for user in [*range(300), None] for _ in range(2)] + [("c", None)]
    spark.createDataFrame(rows, "event_type string, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    found = relational.event_users(spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {("a", 300, True), ("b", 300, True), (None, 300, True), ("c", 0, True)}
    by_pair = re.findall(r"keys=\[event_type#\w+, user_id#\w+\], functions=\[(.*?)\]", plan(found))
    assert by_pair and not any(by_pair)


@pytest.mark.parametrize("kind", relational.FORMATS)
def test_files_keep_nulls_and_odd_strings(spark, tmp_path, kind):
    rows = [(1, None, 1.5, "a"), (2, "", None, "a"), (3, 'quote " comma, é', -0.25, "b"), (None, "x", 2.0, "b"), (4, "null", 0.0, "c")]
    df = spark.createDataFrame(rows, "k long, s string, v double, part string")
    write_files(df, str(tmp_path / kind), kind, ["part"])
    got = read_files(spark, str(tmp_path / kind), kind, df.schema)
    assert got.columns == df.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, rows))
    empty = tmp_path / f"{kind}-empty"
    write_files(df.limit(0), str(empty), kind)
    assert read_files(spark, str(empty), kind, df.schema).collect() == []


def stream(spark, tmp_path, batches, schema):
    """The rows of each of ``batches`` as a micro-batch of its own."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for p in (tmp_path / "in").glob("part-*"):
            p.rename(tmp_path / "in" / f"batch-{i}.parquet")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))


def run(df, tmp_path, name, mode="append"):
    df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    return df.sparkSession.table(name).collect()


def at(hour, minute=0):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=hour, minutes=minute)


def test_late_rows_are_dropped_and_early_windows_closed(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    batches = [[(at(1), "a", 1.0), (at(2), "a", 2.0)], [(at(9), "a", 4.0)], [(at(9, 5), "a", 4.0)], [(at(1, 30), "a", 100.0), (at(8, 30), "a", 8.0)], [(at(20), "a", 16.0)]]
    got = run(windowed(stream(spark, tmp_path, batches, schema), "1 hour", late="1 hour"), tmp_path, "late")
    # rows are judged by the watermark of the batch before: 1:30 comes after it passed its window, 8:30 within the hour; the last window is still open
    assert sorted((r.window_start.hour, r.n, r.total) for r in got) == [(1, 1, 1.0), (2, 1, 2.0), (8, 1, 8.0), (9, 2, 8.0)]


def test_rows_out_of_order_give_the_table_s_answer(spark, tmp_path):
    """Event-time state: rows of later batches may be earlier, as long as the watermark has not passed them; what comes later still is dropped."""
    rng, schema = random.Random(3), "ts timestamp, event_id long, user_id long, event_type string"
    rows = [(at(0, 7 * i), i, rng.choice([1, 2, 3, None]), rng.choice(["error", "purchase", "view"])) for i in range(90)]
    mixed = sorted(rows, key=lambda r: r[1] + rng.randrange(8))  # by less than an hour
    late = [(at(0, 1), 1000, 1, "error"), (at(0, 2), 1001, 1, "purchase")]
    end = [(at(40), 2000, 9, "error")]
    got = run(since_last(stream(spark, tmp_path, [mixed[:30], mixed[30:45], mixed[45:] + late, end], schema), "error", "purchase"), tmp_path, "since")
    want = {}
    for t, i, user, kind in rows:
        if kind == "purchase" and user is not None:
            before = [u for u, j, v, k in rows if k == "error" and v == user and j < i]
            want[i] = int((t - before[-1]).total_seconds()) if before else None
    assert {r.event_id: r.seconds for r in got} == want and len(got) == len(want)


def test_state_expires(spark, tmp_path):
    schema = "ts timestamp, event_id long, user_id long, event_type string"
    batches = [[(at(0), 1, 1, "error"), (at(0), 2, 2, "error")], [(at(10), 3, 1, "purchase")], [(at(60), 4, 9, "error")], [(at(61), 5, 1, "purchase"), (at(61), 6, 2, "purchase")], [(at(90), 7, 9, "error")]]
    got = run(since_last(stream(spark, tmp_path, batches, schema), "error", "purchase", forget_days=2), tmp_path, "forgotten")
    assert {r.event_id: r.seconds for r in got} == {3: 36_000, 5: None, 6: None}


def test_sessions_of_a_stream_are_the_table_s(spark, tmp_path):
    rng, schema = random.Random(6), "ts timestamp, user_id long, value double"
    rows = sorted(((at(0, rng.randrange(3000)), rng.choice([1, 2, None]), float(i)) for i in range(120)), key=lambda r: r[0])
    mixed = [r for _, r in sorted(((r[0].timestamp() + rng.randrange(3000), i), r) for i, r in enumerate(rows))]
    late = [(at(0, 30), 2, 1e6)]
    end = [(at(200), 3, 1.0)]
    got = run(sessions(stream(spark, tmp_path, [mixed[:50], mixed[50:90], mixed[90:] + late, end], schema), "30 minutes", "1 hour"), tmp_path, "sessions")
    want = sessions(spark.createDataFrame(rows, schema), "30 minutes").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 10


def test_two_streams_are_joined_and_the_unmatched_come_out(spark, tmp_path):
    schema = "ts timestamp, event_id long, user_id long"
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    causes = [[(at(1), 1, 1), (at(1), 2, 2), (at(1), 3, None)], [(at(3), 4, 1)], [(at(30), 5, 1)], [(at(1), 6, 1)]]
    effects = [[(at(2), 11, 1), (at(6), 12, 2)], [(at(4), 13, 1)], [(at(30), 14, 7)], [(at(31), 15, 1)]]
    got = run(followed(stream(spark, tmp_path / "a", causes, schema), stream(spark, tmp_path / "b", effects, schema), "2 hours"), tmp_path, "followed")
    # 6 is late; 2 has an effect after more than two hours only; 5 is still open but has found one
    assert sorted(((r.cause_id, r.effect_id) for r in got), key=str) == sorted([(1, 11), (2, None), (4, 13), (5, 15)], key=str)


def test_python_functions():
    assert gini.func(pd.Series([5.0, 5.0, 5.0])) == pytest.approx(0) and gini.func(pd.Series([0.0, 0.0, 9.0])) == pytest.approx(2 / 3)
    assert gini.func(pd.Series([None, 4.0, 0.0])) == pytest.approx(0.5) and gini.func(pd.Series([], dtype=float)) is None and gini.func(pd.Series([0.0])) is None
    assert list(cut_words.func().eval("a b")) == [(1, "a"), (2, "b")] and list(cut_words.func().eval(None)) == []


def test_sessions_and_top_replace_their_columns(spark):
    df = spark.createDataFrame([("a", 1, "old", 7), ("a", 50, "old", 7)], "k string, t int, session string, rank int")
    assert [(r.t, r.session) for r in joins.sessions(df, ["k"], "t", 10).orderBy("t").collect()] == [(1, 1), (50, 2)]
    assert [(r.t, r["rank"]) for r in joins.top(df, ["k"], [F.desc("t")], 1).collect()] == [(50, 1)]
    clash = spark.createDataFrame([(1, 5, 0, 0, 0)], "k int, t int, row int, side int, found int")
    right = spark.createDataFrame([(1, 4, 9)], "k int, t int, j int")
    assert tuple(joins.as_of(clash, right, ["k"], "t", ["j"]).first()) == (1, 5, 0, 0, 0, 9)
    assert joins.as_of(clash.limit(0), right, ["k"], "t", ["j"]).collect() == []
