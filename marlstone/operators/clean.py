"""Cleaning: one row for each key, typed, with gaps filled, wide or long."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key: that with the greatest ``order``, and among equals the greatest row. One aggregate, no sort."""
    rest = [c for c in df.columns if c not in {*key, *order}]
    best = F.max(F.struct(*order, *rest)).alias("best")
    return df.groupBy(*key).agg(best).select(*key, *(F.col(f"best.{c}").alias(c) for c in (*order, *rest))).select(*df.columns)


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Casts columns; what can't be cast is null."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS {kind})") for c, kind in kinds.items()})


def filled(df: DataFrame, values: dict[str, float | str]) -> DataFrame:
    """Nulls and NaNs replaced, by column."""
    return df.fillna(values)


def long(df: DataFrame, key: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    """A row for each key and column: (key..., name, value)."""
    return df.unpivot(key, columns, name, value)
