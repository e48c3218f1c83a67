"""Joins that Spark has no single operator for."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges of time that a key's rows are cut into: as many as shuffle partitions, between these bounds.
CELLS, MOST_CELLS = 64, 4_096


def _in_cells(df: DataFrame, times: DataFrame) -> DataFrame:
    """``df`` with ``cell``, the number of the range that its column ``at`` falls into: each holds about as many rows of ``times``.

    The ends are quantiles of the column ``at`` of ``times``, from one aggregate
    with partial sketches; only they reach the driver. Equal times share a
    range. Nulls have one of their own.
    """
    cells = min(MOST_CELLS, max(CELLS, int(times.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    x = F.col("at").cast("double")
    found = times.agg(F.percentile_approx(x, [i / cells for i in range(1, cells)], 20 * cells).alias("ends")).first()["ends"]
    ends = sorted({e for e in found or [0.0] if math.isfinite(e)} or {0.0})
    cut = Bucketizer(splits=[-math.inf, *ends, math.inf], inputCol="at_double", outputCol="cell", handleInvalid="keep")
    return cut.transform(df.withColumn("at_double", x)).withColumn("cell", F.col("cell").cast("int")).drop("at_double")


def as_of(left: DataFrame, right: DataFrame, key: list[str], at: str, values: list[str]) -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` with its key and a time not after its own.

    Both sides are put in one order by key and time, and each left row takes the
    last right row before it: one sort, no pairs. Times are numbers. Of right
    rows at one time the greatest counts. Rows with a null key or time find
    nothing. ``values`` must not be columns of ``left``, whose own names may
    be any.

    A key with very many rows is spread over cells: ranges of time with about as
    many rows each, so that a burst is cut too. The last right row of each key and cell, found with
    partial maxima, is carried into the cells after it, so that each cell can
    be searched by itself; only these, MOST_CELLS a key at most, meet in one window.
    Rows of one key at one and the same time are in one cell.
    """
    keys = [F.col(k).alias(f"key_{i}") for i, k in enumerate(key)]
    names = [f"key_{i}" for i in range(len(key))]
    found = F.struct(*(F.col(v).alias(f"value_{i}") for i, v in enumerate(values)))
    mine = left.select(F.struct(*(F.col(c).alias(f"left_{i}") for i, c in enumerate(left.columns))).alias("row"), *keys, F.col(at).alias("at"), F.lit(1).alias("side"), F.lit(None).alias("found"))
    theirs = right.select(F.lit(None).alias("row"), *keys, F.col(at).alias("at"), F.lit(0).alias("side"), found.alias("found")).where(F.col("at").isNotNull())
    known = F.col("at").isNotNull()
    for k in names:
        known = known & F.col(k).isNotNull()
    both = _in_cells(mine.unionByName(theirs), left.select(F.col(at).alias("at")).union(right.select(at)))
    # what each cell begins with: the last right row of the cells before it
    top = F.max(F.when(F.col("side") == 0, F.struct("at", "found"))).alias("top")
    tops = both.where(known).groupBy(*names, "cell").agg(top, F.max("side").alias("has_left"))
    before = Window.partitionBy(*names).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.withColumn("top", F.last("top", ignorenulls=True).over(before)).where("has_left = 1 AND top IS NOT NULL")
    both = both.unionByName(carried.select(F.lit(None).alias("row"), *names, F.col("top.at").alias("at"), F.lit(0).alias("side"), F.col("top.found").alias("found"), "cell"))
    order = Window.partitionBy(*names, "cell").orderBy("at", "side", "found").rowsBetween(Window.unboundedPreceding, 0)
    joined = both.withColumn("found", F.when(known, F.last("found", ignorenulls=True).over(order))).where("side = 1")
    return joined.select(*(F.col(f"row.left_{i}").alias(c) for i, c in enumerate(left.columns)), *(F.col(f"found.value_{i}").alias(v) for i, v in enumerate(values)))


def interval(points: DataFrame, spans: DataFrame, key: list[str], at: str, first: str, length: int) -> DataFrame:
    """Pairs of a point and a span with its key that starts at ``first``, lasts ``length`` and holds the point's ``at`` (ends excluded).

    Times are numbers. They are cut into cells of ``length``, so that a span
    touches two at most, and the join is on key and cell. Column names of the
    two sides must differ but for the key.
    """
    cell = lambda c: F.floor(F.col(c) / length)
    mine = points.withColumn("cell", cell(at))
    theirs = spans.withColumn("cell", F.explode(F.array(cell(first), cell(first) + 1)))
    inside = (F.col(at) >= F.col(first)) & (F.col(at) < F.col(first) + length)
    return mine.join(theirs, [*key, "cell"]).where(inside).drop("cell")


def sessions(df: DataFrame, key: list[str], at: str, gap: int) -> DataFrame:
    """Adds ``session``, counted from 1 by key: a row more than ``gap`` after the one before begins a new one.

    Times are numbers. Rows without a time are in no session (null); null keys
    are a key. A column ``session`` of ``df`` is replaced.

    A key with very many rows is spread over ranges of time with about as many
    rows each. Sessions are counted within a range, and a row for each key and
    range, with its ends and its count, says which number it begins with. Only
    these, MOST_CELLS a key at most, meet in one window. ``df`` is read three
    times: for the ranges, for what they begin with (keys and times alone) and
    for its rows. Rows of one key at one and the same time are in one range.
    """
    plain = df.drop("session") if "session" not in {*key, at} else df
    rows = plain.select(F.struct(*(F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(plain.columns))).alias("row"), F.struct(*(F.col(f"`{k}`").alias(f"key_{i}") for i, k in enumerate(key))).alias("key"), F.col(f"`{at}`").alias("at"))
    known = rows.where("at IS NOT NULL")
    within = Window.partitionBy("key", "cell").orderBy("at")
    begins = F.coalesce(F.col("at") - F.lag("at").over(within) > gap, F.lit(False)).cast("long")
    local = _in_cells(known, known).withColumn("begins", begins)
    # each range: whether its first row begins a session, and how many more begin within it
    cells = local.groupBy("key", "cell").agg(F.min("at").alias("head"), F.max("at").alias("tail"), F.sum("begins").alias("more"))
    by_cell = Window.partitionBy("key").orderBy("cell")
    fresh = F.coalesce(F.col("head") - F.lag("tail").over(by_cell) > gap, F.lit(True)).cast("long")
    upto = by_cell.rowsBetween(Window.unboundedPreceding, 0)
    first = (F.sum("fresh").over(upto) + F.sum("more").over(upto) - F.col("more")).alias("first")
    carried = cells.withColumn("fresh", fresh).select("key", "cell", first)
    numbered = local.withColumn("nth", F.sum("begins").over(within)).join(carried, ["key", "cell"]).select("row", (F.col("first") + F.col("nth")).alias("session"))
    found = numbered.unionByName(rows.where("at IS NULL").select("row", F.lit(None).cast("long").alias("session")))
    return found.select(*(F.col(f"row.c_{i}").alias(c) for i, c in enumerate(plain.columns)), "session")


def top(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group, with ``rank``, which replaces a column of that name; ties are broken by ``order``. Spark limits groups before the shuffle too."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
