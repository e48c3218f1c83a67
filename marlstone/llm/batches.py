"""Bounds on what a Python worker is handed at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROWS = 500
_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lets Arrow batches have at most ROWS rows, as whole texts can be long; a smaller setting stays."""
    if not 0 < int(spark.conf.get(_KEY)) <= ROWS:
        spark.conf.set(_KEY, ROWS)
