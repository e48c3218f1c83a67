"""Descriptive statistics: levels, spread, quantiles, histograms and indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.stats import min_max
from marlstone.sources import materialize


#: Ranks that the sketch may be off by, as a share of a group's rows.
SKETCH = 10_000


def quantiles(df: DataFrame, value: Column, by: list[Column], shares: list[float]) -> DataFrame:
    """For each group (columns of ``by``) and each of ``shares``: (..., share, quantile), exact and interpolated; null values are left out.

    A mergeable sketch brackets each quantile. Then rows are counted below the
    bracket, and by value within it, so that of a group's rows only the
    values of a bracket, a few of SKETCH, meet in one window. Rows are read
    twice. The brackets are one row a group; where these are few, adaptive
    execution broadcasts them.
    """
    keys = df.select(*by).columns
    named = df.where(value.isNotNull()).select(*by, value.cast("double").alias("v"))
    marks = [min(max(q + side * 3 / SKETCH, 0.0), 1.0) for q in shares for side in (-1, 1)]
    bracket = named.groupBy(*keys).agg(F.count("*").alias("rows"), F.percentile_approx("v", marks, SKETCH).alias("marks"), F.min("v").alias("least"), F.max("v").alias("most"))
    # the bracket of a small group is all of it
    mark = lambda i, end: F.when(F.col("rows") <= SKETCH, F.col(end)).otherwise(F.get("marks", F.lit(i)))
    asked = F.explode(F.array(*(F.struct(F.lit(q).alias("share"), mark(2 * i, "least").alias("low"), mark(2 * i + 1, "most").alias("high")) for i, q in enumerate(shares))))
    bracket = materialize(bracket.select(*(F.col(k).alias(f"of_{i}") for i, k in enumerate(keys)), "rows", asked.alias("b")).select("*", "b.*").drop("b"), "brackets")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"of_{i}"))
    met = named.join(bracket, same & (F.col("v") <= F.col("high"))) if keys else named.join(F.broadcast(bracket), F.col("v") <= F.col("high"))  # a row for each share
    at = F.when(F.col("v") >= F.col("low"), F.col("v"))
    counts = met.groupBy(*keys, "rows", "share", at.alias("v")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*keys, "share").orderBy(F.asc_nulls_first("v"))
    counts = counts.withColumn("upto", F.sum("n").over(upto))
    rank = (F.col("rows") - 1) * F.col("share")
    holds = lambda r: F.max(F.when((F.col("upto") > r) & (F.col("upto") - F.col("n") <= r), F.col("v")))
    found = counts.groupBy(*keys, "rows", "share").agg(holds(F.floor(rank)).alias("low"), holds(F.ceil(rank)).alias("high"))
    return found.select(*keys, "share", (F.col("low") + (F.col("high") - F.col("low")) * (rank - F.floor(rank))).alias("quantile"))


def summary(df: DataFrame, value: Column, by: list[Column], places: int = 4) -> DataFrame:
    """n, nulls, mean, sd, least, quartiles and most of ``value`` for each group, rounded to ``places``; quartiles are exact (interpolated)."""
    found = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.count_if(value.isNull()).alias("nulls"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most")
    )
    keys = df.select(*by).columns
    named = {0.25: "q1", 0.5: "median", 0.75: "q3"}
    parts = [F.max(F.when(F.col("share") == q, F.col("quantile"))).alias(name) for q, name in named.items()]
    q = quantiles(df, value, by, list(named)).groupBy(*(F.col(k).alias(f"of_{i}") for i, k in enumerate(keys))).agg(*parts)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"of_{i}"))
    both = found.join(q, same, "left")
    return both.select(*keys, "n", "nulls", *(F.round(c, places).alias(c) for c in ("mean", "sd", "least", "q1", "median", "q3", "most")))


def histogram(df: DataFrame, value: Column, least: float, most: float, bins: int, by: list[Column] | None = None) -> DataFrame:
    """Rows in each of ``bins`` equal bins from ``least`` to ``most``; values outside count in bins -1 and ``bins``, and ``most`` in the last."""
    width = (most - least) / bins
    at = F.when(value < least, -1).when(value > most, bins).otherwise(F.least(F.floor((value - least) / width), F.lit(bins - 1))).cast("int")
    return df.where(value.isNotNull()).groupBy(*(by or []), at.alias("bin")).agg(F.count("*").alias("n"))


def trend(panel: DataFrame, value: Column, places: int = 4) -> DataFrame:
    """By period: the mean of ``value``, and its change and growth on the period before."""
    mean = panel.groupBy("period").agg(F.avg(value).alias("mean"))  # one row for each period from here on
    before = F.lag("mean").over(Window.orderBy("period"))
    return mean.select("period", F.round("mean", places).alias("mean"), F.round(F.col("mean") - before, places).alias("change"), F.round(F.col("mean") / F.nullif(before, F.lit(0.0)) - 1, places).alias("growth"))


def index(df: DataFrame, key: list[str], weights: dict[str, float], places: int = 6) -> DataFrame:
    """A weighted sum of indicators, each brought to the scale from 0 (least) to 1 (most) over all rows.

    The ends are one row, joined by broadcast; an indicator that is the same
    in all rows, or null, counts 0.
    """
    ends = df.agg(*(F.min(c).alias(f"least_{c}") for c in weights), *(F.max(c).alias(f"most_{c}") for c in weights))
    both = df.crossJoin(F.broadcast(ends))  # one row
    parts = [F.coalesce(min_max(F.col(c), F.col(f"least_{c}"), F.col(f"most_{c}")), F.lit(0.0)) * w for c, w in weights.items()]
    return both.select(*key, F.round(sum(parts[1:], parts[0]), places).alias("index"))
