"""Readers for the tables of a data folder, and for and to files of any format that Spark has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: How a format's files are written and read where the defaults don't keep all values.
OPTIONS = {"csv": {"header": "true", "escape": '"', "nullValue": r"\N"}}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of ``sf_dir``, which may be any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def write_files(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Writes ``df`` as files of ``kind`` (parquet, orc, json, csv), in a folder for each value of ``partition_by``.

    Nulls stay nulls and empty strings empty strings in every kind; in csv a null is written as \\N, as which a string must not be.
    """
    df.write.format(kind).options(**OPTIONS.get(kind, {})).mode(mode).partitionBy(*(partition_by or [])).save(path)


def read_files(spark: SparkSession, path: str, kind: str, schema: StructType | str) -> DataFrame:
    """Files of ``kind`` below ``path``. The schema is given, so that no pass over the files has to guess it."""
    return spark.read.format(kind).options(**OPTIONS.get(kind, {})).schema(schema).load(path)
