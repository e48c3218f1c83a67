"""Queries over operators that spread what would else be one task, or pairs of all rows; and joins, sessions and state on streams."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import panel, regression
from marlstone.operators.colocated import co_located, may_match
from marlstone.operators.folds import fold
from marlstone.operators.order import numbered
from marlstone.operators.spans import at_most, overlaps
from marlstone.sources import materialize, table
from marlstone.streaming import drained, event_stream, followed, sessions

Query = Callable[[SparkSession, str], DataFrame]


def order_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over all orders at once: the place and the running total of each by price, and ranks by day."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("day"))
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    by_price = numbered(orders, ["o_totalprice DESC", "o_orderkey"], {"cents": cents}, "place")
    by_day = numbered(by_price, ["day"], None, "any_place", "day_rank", "day_number")
    return by_day.select("o_orderkey", "place", "cents", "day_rank", "day_number")


ORDER_NUMBERS = """
SELECT o_orderkey, row_number() OVER p AS place, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (ORDER BY o_totalprice DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cents,
       rank() OVER d AS day_rank, dense_rank() OVER d AS day_number
FROM orders WINDOW p AS (ORDER BY o_totalprice DESC, o_orderkey), d AS (ORDER BY CAST(o_orderdate AS DATE))
"""


def shipping_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of any length: from each order to its last shipment (days to months), and of each line's delivery (an hour for each piece), by customer, where they overlap."""
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", seconds("o_orderdate").alias("placed"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", seconds("l_shipdate").alias("shipped"), "l_quantity")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    held = both.groupBy("o_custkey", "o_orderkey", "placed").agg(F.max("shipped").alias("last_shipped")).withColumnRenamed("o_orderkey", "open_order")
    moving = both.select("o_custkey", "l_orderkey", "shipped", (F.col("shipped") + (F.col("l_quantity") * 3600).cast("long")).alias("arrived"))
    pairs = overlaps(held, moving, ["o_custkey"], ("placed", "last_shipped"), ("shipped", "arrived"))
    shared = F.least("last_shipped", "arrived") - F.greatest("placed", "shipped")
    return pairs.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(shared).alias("seconds"), F.count_if(F.col("open_order") == F.col("l_orderkey")).alias("own"))


SHIPPING_OVERLAPS = """
WITH b AS (SELECT o_custkey, o_orderkey, l_quantity, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS placed, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS shipped FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
held AS (SELECT o_custkey, o_orderkey, placed, max(shipped) AS last_shipped FROM b GROUP BY 1, 2, 3),
moving AS (SELECT o_custkey, o_orderkey, shipped, shipped + CAST(l_quantity * 3600 AS BIGINT) AS arrived FROM b)
SELECT h.o_custkey, count(*) AS n, CAST(sum(least(last_shipped, arrived) - greatest(placed, shipped)) AS BIGINT) AS seconds, count(*) FILTER (h.o_orderkey = m.o_orderkey) AS own
FROM held h JOIN moving m ON h.o_custkey = m.o_custkey AND placed < arrived AND shipped < last_shipped WHERE placed < last_shipped AND shipped < arrived GROUP BY 1
"""


def lines_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inequality join of two large tables, aggregated: of each order, the lines that cost no more than it, and their pieces."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    lines = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity")
    return at_most(orders, lines, "o_totalprice", "l_extendedprice", {"n": F.lit(1).cast("long"), "pieces": F.col("l_quantity").cast("long")}).drop("o_totalprice")


LINES_BELOW = """
WITH v AS (SELECT o_totalprice AS price, 1 AS side, o_orderkey, 0 AS n, 0 AS q FROM orders UNION ALL SELECT l_extendedprice, 0, NULL, 1, CAST(l_quantity AS BIGINT) FROM lineitem)
SELECT o_orderkey, CAST(n AS BIGINT) AS n, CAST(q AS BIGINT) AS pieces FROM (SELECT side, o_orderkey, sum(n) OVER w AS n, sum(q) OVER w AS q FROM v WINDOW w AS (ORDER BY price, side)) WHERE side = 1
"""


def closed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users on a stream, read to its end: those that the watermark, an hour behind the latest event, has closed."""
    micros = lambda c: F.unix_micros(c).alias(c)
    return drained(sessions(event_stream(spark, sf_dir), "1 day", "1 hour"), "sessions").select("user_id", micros("session_start"), micros("session_end"), "n", "total")


CLOSED_SESSIONS = """
WITH e AS (SELECT user_id, value, epoch_us(ts) AS us FROM events), g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) < 86400000000 THEN 0 ELSE 1 END AS b FROM e),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY us) AS session FROM g)
SELECT user_id, min(us) AS session_start, max(us) + 86400000000 AS session_end, count(*) AS n, round(sum(value), 2) AS total
FROM s GROUP BY user_id, session HAVING max(us) + 86400000000 <= (SELECT max(us) FROM e) - 3600000000
"""


def errors_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join of two streams: errors, each with its user's purchases within two days, or alone once none can come any more."""
    events = lambda kind: event_stream(spark, sf_dir).where(F.col("event_type") == kind)
    found = drained(followed(events("error"), events("purchase"), "2 days"), "followed")
    return found.select("cause_id", "user_id", "effect_id", (F.unix_micros("effect_at") - F.unix_micros("cause_at")).alias("micros"))


ERRORS_FOLLOWED = """
WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us FROM events), a AS (SELECT * FROM e WHERE event_type = 'error'), b AS (SELECT * FROM e WHERE event_type = 'purchase'),
w AS (SELECT least((SELECT max(us) FROM a), (SELECT max(us) FROM b)) - 3600000000 AS mark)
SELECT a.event_id AS cause_id, a.user_id, b.event_id AS effect_id, b.us - a.us AS micros
FROM a LEFT JOIN b ON a.user_id = b.user_id AND b.us >= a.us AND b.us <= a.us + 172800000000, w WHERE b.event_id IS NOT NULL OR a.us + 172800000000 < mark
"""

#: Customers by order year: not every customer orders every year.
CUSTOMERS = "SELECT o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS period, avg(o_totalprice) AS y, avg(CAST(o_orderpriority = '1-URGENT' AS DOUBLE)) AS x FROM orders GROUP BY 1, 2"


def customer_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-way effects of an unbalanced panel, with errors clustered by customer: what an urgent order costs more, beside customers and years."""
    urgent = F.avg((F.col("o_orderpriority") == "1-URGENT").cast("double"))
    rows = materialize(panel.build(table(spark, sf_dir, "orders"), F.col("o_custkey"), F.year("o_orderdate"), y=F.avg("o_totalprice"), x=urgent), "panel")
    found = regression.two_way(rows, "y", ["x"], clustered=True)
    b, se = found.coefficients["x"], found.errors["x"]
    return spark.createDataFrame([(round(b, 4), round(se, 4), round(b / se, 6), int(found.free), found.n)], "coefficient double, error double, t double, free long, n long")


def _customer_effects() -> str:
    one = "SELECT entity, period, y - avg(y) OVER t AS y, x - avg(x) OVER t AS x FROM (SELECT entity, period, y - avg(y) OVER e AS y, x - avg(x) OVER e AS x FROM {rows} WINDOW e AS (PARTITION BY entity)) WINDOW t AS (PARTITION BY period)"
    steps = [f"r0 AS ({CUSTOMERS})", *(f"r{i} AS MATERIALIZED ({one.format(rows=f'r{i - 1}')})" for i in range(1, 26))]
    return f"""
WITH {', '.join(steps)}, f AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS xx, count(*) AS n FROM r25),
s AS (SELECT sum(x * (y - b * x)) AS u FROM r25, f GROUP BY entity), v AS (SELECT count(*) AS g, sum(u * u) AS uu FROM s)
SELECT round(b, 4) AS coefficient, round(sqrt(uu * g / (g - 1)) / xx, 4) AS error, round(b / (sqrt(uu * g / (g - 1)) / xx), 6) AS t, g - 1 AS free, n FROM f, v
"""


CUSTOMER_EFFECTS = _customer_effects()


def slopes_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether nations differ in how customers' orders go with their balances: one stacked fit, and a Wald test that all slopes are equal."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    found = regression.equal_slopes(orders, F.col("o_totalprice"), F.col("c_acctbal"), F.col("c_nationkey"))
    return spark.createDataFrame([(round(found.common, 6), round(found.f, 6), found.above, found.below, found.groups, found.n)], "common double, f double, above long, below long, groups long, n long")


SLOPES_TEST = """
WITH m AS (SELECT c_nationkey, count(*) AS n, regr_slope(o_totalprice, c_acctbal) AS b, regr_sxx(o_totalprice, c_acctbal) AS sxx, regr_syy(o_totalprice, c_acctbal) AS syy FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
s AS (SELECT count(*) AS g, CAST(sum(n) AS BIGINT) AS n, sum(syy - b * b * sxx) AS rest, sum(b * sxx) / sum(sxx) AS common FROM m)
SELECT round(common, 6) AS common, round((SELECT sum((b - common) ** 2 * sxx) FROM m) / (g - 1) / (rest / (n - 2 * g)), 6) AS f, g - 1 AS above, n - 2 * g AS below, g AS groups, n FROM s
"""


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join and a grouping without a shuffle: lines and orders, bucketed by order, and of each order its lines, pieces and late lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", F.to_date("l_shipdate").alias("l_ship"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("o_day"))
    lines, orders, on = co_located(lines, orders, "l_orderkey", "o_orderkey")
    late = F.count_if(F.date_diff("l_ship", "o_day") > 60).alias("late")
    return lines.join(orders, on).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("pieces"), late)


ORDER_LINES = """
SELECT l_orderkey, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS pieces, count(*) FILTER (CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) > 60) AS late
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
"""


def urgent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Bloom filter ahead of an exchange: lines of urgent orders of 300,000 or more, by customer. Most lines are left out before they are shuffled."""
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_totalprice >= 300000").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")
    found = may_match(lines, orders, "l_orderkey", "o_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return found.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


URGENT_LINES = """
SELECT o_custkey, count(*) AS n, round(sum(l_extendedprice), 2) AS total
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND o_totalprice >= 300000 GROUP BY 1
"""

#: A price in cents that best_stretches measures orders against.
FAIR = 15_000_000


def stretch(values: pa.RecordBatch) -> tuple[int, ...]:
    """Of numbers in a row: how many; their sum; the greatest sums of a stretch, of one from the start and of one to the end; the longest runs above 0, likewise."""
    v = values.column(0).to_numpy()
    sums = np.concatenate([[0], np.cumsum(v)])
    best = int((sums[1:] - np.minimum.accumulate(sums[:-1])).max())
    stops = np.flatnonzero(v <= 0)
    gaps = np.diff(np.concatenate([[-1], stops, [len(v)]])) - 1
    return len(v), int(sums[-1]), best, int(sums[1:].max()), int(sums[-1] - sums[:-1].min()), int(gaps.max()), int(gaps[0]), int(gaps[-1])


def join_stretches(a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
    n, total, best, head, tail, run, starts, ends = zip(a, b, strict=True)
    return (
        sum(n), sum(total), max(*best, tail[0] + head[1]), max(head[0], total[0] + head[1]), max(tail[1], total[1] + tail[0]),
        max(*run, ends[0] + starts[1]), starts[0] + starts[1] if starts[0] == n[0] else starts[0], ends[0] + ends[1] if ends[1] == n[1] else ends[1],
    )


def best_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A two-phase aggregate of Python over groups of any size: of each priority's orders in time, the stretch that lies most above FAIR in sum, and the longest run of orders above it."""
    above = (F.round(F.col("o_totalprice") * 100).cast("long") - FAIR).alias("above")
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", F.to_date("o_orderdate").alias("day"), "o_orderkey", above)
    state = "n long, total long, best long, head long, tail long, longest long, starts long, ends long"
    return fold(orders, ["o_orderpriority"], ["day", "o_orderkey"], ["above"], state, stretch, join_stretches).select("o_orderpriority", "n", "total", "best", "longest")


BEST_STRETCHES = f"""
WITH v AS (SELECT o_orderpriority, CAST(round(o_totalprice * 100) AS BIGINT) - {FAIR} AS x, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS i FROM orders),
c AS (SELECT *, sum(x) OVER w AS s, i - max(CASE WHEN x <= 0 THEN i ELSE 0 END) OVER w AS run FROM v WINDOW w AS (PARTITION BY o_orderpriority ORDER BY i)),
b AS (SELECT *, s - least(0, coalesce(min(s) OVER (PARTITION BY o_orderpriority ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS best FROM c)
SELECT o_orderpriority, count(*) AS n, CAST(sum(x) AS BIGINT) AS total, CAST(max(best) AS BIGINT) AS best, CAST(max(run) AS BIGINT) AS longest FROM b GROUP BY 1
"""

QUERIES: dict[str, Query] = {f.__name__: f for f in (order_numbers, shipping_overlaps, lines_below, closed_sessions, errors_followed, customer_effects, slopes_test, order_lines, urgent_lines, best_stretches)}
ORACLES: dict[str, str] = {name: globals()[name.upper()] for name in QUERIES}
