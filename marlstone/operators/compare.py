"""Ratio and gap between the mean levels of two groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio_and_gap(df: DataFrame, group: Column, value: Column, high: str, low: str, by: list[Column]) -> DataFrame:
    """Per ``by``: the mean of ``value`` in ``high`` and ``low``, their ratio (4 places) and gap (2 places).

    One conditional aggregate, so partial sums are all that is shuffled. Rows
    of other groups count for neither side; a side without rows gives nulls,
    and so does a ratio over a zero mean.
    """
    mean = lambda name: F.avg(F.when(group == name, value))
    both = df.where(group.isin(high, low)).groupBy(*by).agg(mean(high).alias("high_mean"), mean(low).alias("low_mean"))
    return both.withColumns(
        {
            "ratio": F.round(F.col("high_mean") / F.nullif(F.col("low_mean"), F.lit(0.0)), 4),
            "gap": F.round(F.col("high_mean") - F.col("low_mean"), 2),
            "high_mean": F.round("high_mean", 2),
            "low_mean": F.round("low_mean", 2),
        }
    )
