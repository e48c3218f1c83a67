"""The bootstrap over entities, all replicates at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.stats import draw
from marlstone.operators.order import numbered
from marlstone.operators.regression import demeaned
from marlstone.sources import materialize


def draws(entities: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(replicate, entity, times): each replicate draws as many entities as there are, with replacement.

    Draws come from MD5, so they are the same wherever and however often they
    are made. Entities are numbered by their order over ranges of it, and
    draws are made where the numbers lie: no task or row holds all entities.
    """
    known = materialize(numbered(entities.select("entity").distinct(), ["entity"], row_number="number").withColumn("number", F.col("number") - 1), "entities")
    n = known.count()
    made = known.select(F.col("number").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))).alias("replicate"))
    made = made.select("replicate", draw(seed, F.col("replicate"), F.col("i"), F.lit(max(n, 1))).alias("number"))
    return made.groupBy("replicate", "number").agg(F.count("*").alias("times")).join(known, "number").select("replicate", "entity", "times")


def mediated(panel: DataFrame, y: str, x: str, mediator: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, a, b, indirect): the mediation's product of coefficients, fitted anew to each replicate's entities.

    A replicate is the panel of the drawn entities, each counted as often as it
    was drawn, so entity and period means are its own. All replicates are
    fitted at once, as weighted panels side by side: the rows are the panel's
    times the replicates.
    """
    used = panel.dropna(subset=[y, x, mediator]).select("entity", "period", y, x, mediator)
    size = used.agg(F.count("*").alias("n"), F.count_distinct("entity").alias("e"), F.count_distinct("period").alias("t")).first()
    drawn = draws(used, replicates, seed).join(used, "entity")
    rows = demeaned(drawn, [y, x, mediator], size["n"] == size["e"] * size["t"], weight="times", within=["replicate"])
    pairs = {"xx": (x, x), "xm": (x, mediator), "mm": (mediator, mediator), "xy": (x, y), "my": (mediator, y)}
    weighted = rows.groupBy("replicate").agg(*(F.sum(F.col(a) * F.col(b) * F.col("times")).alias(k) for k, (a, b) in pairs.items()))
    first = F.col("xm") / F.nullif(F.col("xx"), F.lit(0.0))
    det = F.nullif(F.col("xx") * F.col("mm") - F.col("xm") * F.col("xm"), F.lit(0.0))
    second = (F.col("xx") * F.col("my") - F.col("xm") * F.col("xy")) / det
    return weighted.select("replicate", first.alias("a"), second.alias("b"), (first * second).alias("indirect"))


def interval(replicates: DataFrame, column: str, level: float = 0.95) -> DataFrame:
    """The percentile interval of ``column`` over replicates: (n, low, median, high)."""
    tail = (1 - level) / 2
    q = replicates.agg(F.count(column).alias("n"), F.percentile(column, [tail, 0.5, 1 - tail]).alias("q"))
    return q.select("n", *(F.col("q")[i].alias(k) for i, k in enumerate(("low", "median", "high"))))
