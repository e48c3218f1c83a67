"""Column expressions for statistics that Spark has no single function for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def min_max(x: Column, least: Column, most: Column) -> Column:
    """x on the scale from least (0) to most (1); null where these are equal."""
    return (x - least) / F.nullif(most - least, F.lit(0.0))


def draw(seed: int, replicate: Column, number: Column, n: Column) -> Column:
    """A draw from 0 to n - 1 that depends on nothing but its arguments: 8 hex digits of an MD5, modulo n.

    The same in any SQL engine with MD5, and however rows are partitioned.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), replicate.cast("string"), number.cast("string")).cast("binary"))
    return F.conv(F.left(digest, F.lit(8)), 16, 10).cast("long") % n
