"""Panels: one row for each entity and period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def build(df: DataFrame, entity: Column, period: Column, **values: Column) -> DataFrame:
    """Aggregates rows to a panel: (entity, period, values...). Rows without entity or period are left out."""
    named = df.where(entity.isNotNull() & period.isNotNull())
    return named.groupBy(entity.alias("entity"), period.alias("period")).agg(*(v.alias(k) for k, v in values.items()))


def duplicate_keys(panel: DataFrame) -> DataFrame:
    """(entity, period, n) of keys that are not unique; empty for a panel."""
    return panel.groupBy("entity", "period").agg(F.count("*").alias("n")).where("n > 1")


def lagged(panel: DataFrame, column: str, periods: int = 1, name: str | None = None) -> DataFrame:
    """Adds the value of ``column`` exactly ``periods`` periods before, null where that period is missing.

    A window by entity: of earlier rows it takes the one at that distance, so a
    gap in the periods is a null and not a value from further back.
    """
    back = Window.partitionBy("entity").orderBy("period").rangeBetween(-periods, -periods)
    return panel.withColumn(name or f"{column}_lag{periods}", F.first(column).over(back))


def balance(panel: DataFrame) -> DataFrame:
    """(n, entities, periods, balanced) of a panel, in one pass."""
    return panel.agg(
        F.count("*").alias("n"), F.count_distinct("entity").alias("entities"), F.count_distinct("period").alias("periods")
    ).withColumn("balanced", F.col("n") == F.col("entities") * F.col("periods"))
