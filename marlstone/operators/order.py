"""Windows over a whole table without one task that holds it.

``Window.orderBy`` without ``partitionBy`` sorts all rows in one task. Here rows
are range-partitioned in the wanted order and sorted by partition; the totals
of each partition are added up, and what each begins with is carried into it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.sources import materialize


def numbered(df: DataFrame, order: list[Column | str], sums: dict[str, Column] | None = None, row_number: str = "row_number", rank: str | None = None, dense_rank: str | None = None) -> DataFrame:
    """``df`` with a number for each row in ``order`` over the whole table, from 1, and running totals.

    ``sums`` are names of new columns and what they add up: a row's total holds
    its own value and those of all rows before it; nulls add nothing. ``rank``
    and ``dense_rank``, if named, are those of SQL: equal rows by ``order``
    share them. Ties are numbered in some order, the same wherever the result
    is read; to fix it, ``order`` must tell all rows apart. Columns with the
    new names are replaced. Columns of ``order`` sort nulls first unless they
    say otherwise; an empty table stays empty.

    Rows are shuffled by range, written, and then dealt by the number of their
    range, each a window of its own; splitters are sampled by Spark. A value of ``order`` that very many rows
    share is spread too, by a hash of the row, which is the last column to sort
    by. What is added up over partitions is one row for each.
    """
    new = [row_number, *(sums or {}), *(c for c in (rank, dense_rank) if c)]
    kept = [c for c in df.columns if c not in new]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = _directions(df, order)
    names = [f"k{i}" for i in range(len(keys))]
    values = {f"s{i}": F.coalesce(v, F.lit(0)) for i, v in enumerate((sums or {}).values())}
    rows = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), *(k.alias(n) for (k, _), n in zip(keys, names, strict=True)), *(v.alias(n) for n, v in values.items()))
    # rows that are equal in order are spread by a hash of their place in the input, which is written below
    rows = rows.withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    in_order = [_sorted(n, d) for n, (_, d) in zip(names, keys, strict=True)] + [F.col("tie")]
    dealt = rows.repartitionByRange(parts, *in_order).withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "in-order")  # its partitions are fixed from here on

    within = Window.partitionBy("part").orderBy(*in_order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(n) for n in names]
    changed = ~_equal(same, [F.lag(n).over(within) for n in names]) | (F.row_number().over(within) == 1)
    local = dealt.withColumns({"nth": F.row_number().over(within), **{f"upto_{n}": F.sum(n).over(upto) for n in values}, "changed": changed})
    runs = local.withColumn("run", F.sum(F.col("changed").cast("long")).over(upto))
    first_of_run = F.min("nth").over(Window.partitionBy("part", "run"))

    # a row for each partition: how many rows, sums and values it has, and the keys of its ends
    ends = F.struct(*names)
    totals = dealt.groupBy("part").agg(F.count("*").alias("n"), *(F.sum(n).alias(f"all_{n}") for n in values))
    if rank or dense_rank:
        ends_of = runs.groupBy("part").agg(F.max("run").alias("runs"), F.min_by(ends, "nth").alias("head"), F.max_by(ends, "nth").alias("tail"), F.max_by(F.col("run"), "nth").alias("last_run"))
        last = runs.groupBy("part", "run").agg(F.count("*").alias("n_last")).join(ends_of.select("part", F.col("last_run").alias("run")), ["part", "run"]).drop("run")
        totals = totals.join(ends_of.drop("last_run"), "part").join(last, "part")
    one = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    before = totals.select("*", F.coalesce(F.sum("n").over(one), F.lit(0)).alias("n_before"), *(F.coalesce(F.sum(f"all_{n}").over(one), F.lit(0)).alias(f"before_{n}") for n in values))
    if rank or dense_rank:
        by_part = Window.orderBy("part")
        goes_on = F.coalesce(F.col("head").eqNullSafe(F.lag("tail").over(by_part)), F.lit(False))
        before = before.withColumn("goes_on", goes_on)
        # values that begin in a partition, and where the run that a partition begins within has begun
        fresh = F.col("runs") - F.col("goes_on").cast("long")
        whole = (F.col("runs") == 1) & F.col("goes_on")  # nothing but more of the run before
        begun = F.when(whole, F.lit(None)).otherwise(F.col("n_before") + F.col("n") - F.col("n_last"))
        before = before.withColumns({"dense_before": F.coalesce(F.sum(fresh).over(one), F.lit(0)) - F.col("goes_on").cast("long"), "run_begun": F.last(begun, ignorenulls=True).over(one)})
        before = before.withColumn("run_begun", F.when(F.col("goes_on"), F.col("run_begun")))
        carried = ["n_before", "dense_before", "run_begun", *(f"before_{n}" for n in values)]
    else:
        carried = ["n_before", *(f"before_{n}" for n in values)]
    offsets = materialize(before.select("part", *carried), "order-offsets")
    final = (runs.withColumn("first", first_of_run) if rank else runs if dense_rank else local).join(F.broadcast(offsets), "part")  # as many rows as partitions
    out = {row_number: F.col("n_before") + F.col("nth")} | {name: F.col(f"before_{n}") + F.col(f"upto_{n}") for name, n in zip(sums or {}, values, strict=True)}
    if rank:
        out[rank] = F.when((F.col("run") == 1) & F.col("run_begun").isNotNull(), F.col("run_begun") + 1).otherwise(F.col("n_before") + F.col("first"))
    if dense_rank:
        out[dense_rank] = F.col("dense_before") + F.col("run")
    return final.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), *(v.alias(k) for k, v in out.items()))


def _directions(df: DataFrame, order: list[Column | str]) -> list[tuple[Column, str]]:
    """Each of ``order`` as a column and how it is sorted. Names may end in " DESC" or " ASC", with " NULLS FIRST" or " NULLS LAST"."""
    out = []
    for o in order:
        if isinstance(o, Column):
            out.append((o, "ASC NULLS FIRST"))
            continue
        name, _, how = o.partition(" ")
        how = how.upper() or "ASC"
        if "NULLS" not in how:
            how += " NULLS LAST" if how.startswith("DESC") else " NULLS FIRST"
        out.append((F.col(name), how))
    return out


def _sorted(name: str, how: str) -> Column:
    kind = {"ASC NULLS FIRST": F.asc_nulls_first, "ASC NULLS LAST": F.asc_nulls_last, "DESC NULLS FIRST": F.desc_nulls_first, "DESC NULLS LAST": F.desc_nulls_last}[how]
    return kind(name)


def _equal(a: list[Column], b: list[Column]) -> Column:
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & x.eqNullSafe(y)
    return out
