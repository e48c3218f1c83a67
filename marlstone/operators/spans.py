"""Joins on inequalities: of spans that overlap, and of values with all that are not above them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.order import numbered
from marlstone.sources import materialize

#: Keys with no more rows than this, both sides together, are joined whole; only the rows of others are put into cells.
KEY_ROWS = 2_000


def _level(first: str, end: str) -> Column:
    """The least power of two that is not below a span's length, as its exponent."""
    length = F.col(end) - F.col(first)
    return F.when(length <= 1, 0).otherwise(F.length(F.bin(length - 1))).cast("int")


def _cells(first: str, end: str, level: str) -> Column:
    """The one or two cells of 2^level that a span of a level not above touches."""
    return F.explode(F.expr(f"sequence(shiftright({first}, {level}), shiftright({end} - 1, {level}))"))


def overlaps(left: DataFrame, right: DataFrame, key: list[str], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Every pair of a left and a right row with one key whose spans (first, end; whole numbers, end exclusive) have a point in common, once.

    Both sides are written once. Rows of a key that has KEY_ROWS at most are
    joined by the key alone, each held once, as so few are soon compared. Keys
    with more are spread over dyadic cells, as no key may be one task:

    Spans may have any lengths. A span's level is the power of two next to its
    length. It lies in one or two dyadic cells of its own level, and in as many
    of each level above. A pair meets in cells of the longer one's level, and
    counts in that where their common part begins. So a span is held as often
    as twice the levels that the other side has, 64 at most and few in
    practice, and never once for each unit of its length.

    Rows with a null key or end, and empty spans, have no pairs. Keys are
    given once; the two sides' other column names must differ.
    """
    known = F.lit(True)
    for k in key:
        known = known & F.col(k).isNotNull()
    a = materialize(left.where(known & (F.col(left_span[0]) < F.col(left_span[1]))), "spans-left")
    b = materialize(right.where(known & (F.col(right_span[0]) < F.col(right_span[1]))), "spans-right")
    if not key:
        return _in_cells(a, b, key, left_span, right_span)
    met = (F.col(left_span[0]) < F.col(right_span[1])) & (F.col(right_span[0]) < F.col(left_span[1]))
    large = a.select(*key).unionByName(b.select(*key)).groupBy(*key).agg(F.count("*").alias("rows_of_key")).where(F.col("rows_of_key") > KEY_ROWS).select(*key)
    large = materialize(large, "spans-keys")
    if large.isEmpty():
        return a.join(b, key).where(met)
    few = a.join(large, key, "left_anti").join(b.join(large, key, "left_anti"), key).where(met)
    return few.unionByName(_in_cells(a.join(large, key, "left_semi"), b.join(large, key, "left_semi"), key, left_span, right_span))


def _in_cells(left: DataFrame, right: DataFrame, key: list[str], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """The pairs of ``overlaps`` by dyadic cells, whatever a key's number of rows."""
    a, b = left.withColumn("span_level", _level(*left_span)), right.withColumn("span_level", _level(*right_span))
    levels = {side: sorted(r[0] for r in rows.select("span_level").distinct().collect()) for side, rows in (("left", a), ("right", b))}  # 64 numbers at most

    def own(rows: DataFrame, span: tuple[str, str]) -> DataFrame:
        return rows.withColumn("span_cell", _cells(*span, "span_level"))

    def above(rows: DataFrame, span: tuple[str, str], of: list[int], strictly: bool) -> DataFrame:
        test = f"l -> l > span_level" if strictly else "l -> l >= span_level"  # noqa: F541
        each = rows.withColumn("at_level", F.explode(F.expr(f"filter({_numbers(of)}, {test})"))).drop("span_level")
        return each.withColumnRenamed("at_level", "span_level").withColumn("span_cell", _cells(*span, "span_level"))

    met = F.col(left_span[0]) < F.col(right_span[1])
    met = met & (F.col(right_span[0]) < F.col(left_span[1]))
    met = met & (F.col("span_cell") == F.expr(f"shiftright(greatest({left_span[0]}, {right_span[0]}), span_level)"))
    on = [*key, "span_level", "span_cell"]
    longer = own(a, left_span).join(above(b, right_span, levels["left"], strictly=False), on).where(met)
    shorter = above(a, left_span, levels["right"], strictly=True).join(own(b, right_span), on).where(met)
    return longer.unionByName(shorter).drop("span_level", "span_cell")


def _numbers(values: list[int]) -> str:
    return f"array({', '.join(map(str, values))})" if values else "CAST(array() AS ARRAY<INT>)"


def at_most(left: DataFrame, right: DataFrame, left_value: str, right_value: str, sums: dict[str, Column]) -> DataFrame:
    """``left`` with what ``sums`` add up over all rows of ``right`` whose ``right_value`` is not above its ``left_value``.

    The join on an inequality that would pair nearly all rows of two large
    tables, without a pair: both sides are put in one order, range-partitioned,
    and the sums are running totals of the right rows. Nulls on the left find
    0, nulls on the right count for nobody. Columns with the names of ``sums``
    are replaced.
    """
    kept = [c for c in left.columns if c not in sums]
    mine = left.select(*(F.col(f"`{c}`").alias(f"l{i}") for i, c in enumerate(kept)), F.col(left_value).alias("at"), F.lit(1).alias("side"), *(F.lit(None).alias(f"v{i}") for i in range(len(sums))))
    theirs = right.where(F.col(right_value).isNotNull()).select(F.col(right_value).alias("at"), F.lit(0).alias("side"), *(v.alias(f"v{i}") for i, v in enumerate(sums.values())))
    both = mine.unionByName(theirs, allowMissingColumns=True)
    found = numbered(both, ["at", "side"], {f"t{i}": F.col(f"v{i}") for i in range(len(sums))}).where("side = 1")
    return found.select(*(F.col(f"l{i}").alias(c) for i, c in enumerate(kept)), *(F.col(f"t{i}").alias(name) for i, name in enumerate(sums)))
