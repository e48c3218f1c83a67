"""The folder that the driver and all executors share.

A cluster names it in ``spark.checkpoint.dir``. Only where that is unset, as
in tests in local mode, a temporary folder of the driver stands in for it.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []
_tables: list[tuple[SparkSession, str]] = []


def _root(spark: SparkSession) -> str:
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset; on a cluster it must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="marlstone-")
    return _own[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it is removed when the driver ends."""
    path = f"{_root(spark)}/marlstone/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes ``path`` through Spark's file systems; a path that is gone is no error."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and returns a reader of it.

    This cuts the lineage: what follows depends on files that outlive any
    executor, and each later use reads them rather than computing ``df`` anew.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """Writes ``df`` once to the shared folder in ``buckets`` by a hash of ``keys``, and returns a reader that knows of them.

    It is one shuffle, so that each bucket is one file. The catalog has it as an external table, until ``clear`` or the driver's end.
    """
    table = f"marlstone_{name}_{uuid.uuid4().hex}"
    path = shared_path(df.sparkSession, name)
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).option("path", path).format("parquet").saveAsTable(table)
    _tables.append((df.sparkSession, table))
    return df.sparkSession.table(table)


def clear(spark: SparkSession) -> None:
    """Removes all that was written to the shared folder for ``spark`` so far. Frames that read it can't be used any more.

    A session that lives on calls this when it is done with a query's result.
    """
    for made in [t for t in _tables if t[0] is spark]:
        spark.sql(f"DROP TABLE IF EXISTS {made[1]}")
        _tables.remove(made)
    for made in [m for m in _made if m[0] is spark]:
        remove(*made)
        _made.remove(made)


@atexit.register
def _clean() -> None:
    for spark, name in _tables:
        with contextlib.suppress(Exception):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    for spark, path in _made:
        with contextlib.suppress(Exception):  # what can't be removed keeps nothing else from being
            remove(spark, path)
