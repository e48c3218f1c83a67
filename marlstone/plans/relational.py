"""Queries over every kind of relational operator, function and source, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.python import cut_words, gini
from marlstone.sources import read_files, shared_path, table, write_files
from marlstone.streaming import drained, event_stream, since_last, windowed

Query = Callable[[SparkSession, str], DataFrame]


def large_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi join: customers with an order of 350,000 or more."""
    large = table(spark, sf_dir, "orders").where("o_totalprice >= 350000")
    return table(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name", "c_nationkey")


LARGE_CUSTOMERS = "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice >= 350000)"


def patient_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti join: customers without an urgent order."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


PATIENT_CUSTOMERS = "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"


def nation_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full join: nations with rich customers, or with indebted suppliers, or both."""
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9900").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("rich_customers"))
    poor = table(spark, sf_dir, "supplier").where("s_acctbal < 0").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("poor_suppliers"))
    return rich.join(poor, "nation", "full")


NATION_EXTREMES = """
WITH r AS (SELECT c_nationkey AS nation, count(*) AS rich_customers FROM customer WHERE c_acctbal > 9900 GROUP BY 1),
p AS (SELECT s_nationkey AS nation, count(*) AS poor_suppliers FROM supplier WHERE s_acctbal < 0 GROUP BY 1)
SELECT nation, rich_customers, poor_suppliers FROM r FULL JOIN p USING (nation)
"""


def pending_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right join: every customer, with the number of orders in status P."""
    n = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "right").select("c_custkey", F.coalesce("n", F.lit(0)).alias("pending"))


PENDING_ORDERS = """
SELECT c_custkey, coalesce(n, 0) AS pending
FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) RIGHT JOIN customer ON o_custkey = c_custkey
"""

#: Name, least and upper bound of each band of prices.
BANDS = [("low", 0.0, 50_000.0), ("middle", 50_000.0, 200_000.0), ("high", 200_000.0, 350_000.0), ("top", 350_000.0, 1e12)]


def price_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theta join: orders by the band that holds their price. The bands are four rows, whatever the orders."""
    bands = F.broadcast(spark.createDataFrame(BANDS, "band string, least double, below double"))
    held = (F.col("o_totalprice") >= F.col("least")) & (F.col("o_totalprice") < F.col("below"))
    return table(spark, sf_dir, "orders").join(bands, held).groupBy("band").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


PRICE_BANDS = f"""
SELECT band, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders JOIN (VALUES {", ".join(map(str, BANDS))}) b(band, least, below) ON o_totalprice >= least AND o_totalprice < below GROUP BY 1
"""


def priority_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of joins, each by the strategy that its sides call for: Spark broadcasts those that it measures to be small, and sorts the large ones."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    named = lines.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))  # 25 rows at every scale
    return named.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


PRIORITY_SUPPLIERS = """
SELECT n_name, o_orderpriority, count(*) AS n, round(sum(l_quantity), 2) AS quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2
"""


def order_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("order_year"), "o_orderpriority", "o_totalprice")
    return rows.rollup("order_year", "o_orderpriority").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


ORDER_ROLLUP = """
SELECT order_year, o_orderpriority, CAST(grouping(order_year, o_orderpriority) AS BIGINT) AS level, count(*) AS n, round(avg(o_totalprice), 4) AS mean
FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS order_year, * FROM orders) GROUP BY ROLLUP (order_year, o_orderpriority)
"""


def order_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    sets = [[F.col("o_orderstatus")], [F.col("o_orderpriority")], []]
    return rows.groupingSets(sets, "o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


ORDER_GROUPING_SETS = """
SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS level, count(*) AS n
FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())
"""


def _buyers(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).select("o_custkey")


def buyer_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersect, except and union, by rows and by sets: how many customers have orders in status F, O, both or one of them."""
    f, o = _buyers(spark, sf_dir, "F"), _buyers(spark, sf_dir, "O")
    sets = {"both": f.intersect(o), "both_all": f.intersectAll(o), "only_f": f.subtract(o), "more_f": f.exceptAll(o), "either": f.union(o).distinct(), "all": f.unionByName(o)}
    counts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum("o_custkey").alias("keys")) for name, df in sets.items()]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


def _buyer_sets() -> str:
    f, o = (f"SELECT o_custkey FROM orders WHERE o_orderstatus = '{s}'" for s in "FO")
    words = {"both": "INTERSECT", "both_all": "INTERSECT ALL", "only_f": "EXCEPT", "more_f": "EXCEPT ALL", "either": "UNION", "all": "UNION ALL"}
    return " UNION ALL ".join(f"SELECT '{k}' AS name, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys FROM (({f}) {w} ({o}))" for k, w in words.items())


BUYER_SETS = _buyer_sets()


def supplier_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking and analytic window functions, by nation."""
    by = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    coarse = Window.partitionBy("s_nationkey").orderBy(F.floor(F.col("s_acctbal") / 1000))
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.rank().over(coarse).alias("rank"),
        F.dense_rank().over(coarse).alias("dense_rank"),
        F.ntile(4).over(by).alias("quarter"),
        F.round(F.percent_rank().over(coarse), 6).alias("percent_rank"),
        F.round(F.cume_dist().over(coarse), 6).alias("cume_dist"),
        F.lead("s_suppkey").over(by).alias("next_key"),
        F.nth_value("s_suppkey", 2).over(whole).alias("second_key"),
        F.round(F.avg("s_acctbal").over(by.rowsBetween(-1, 1)), 4).alias("smooth"),
    )


SUPPLIER_RANKS = """
SELECT s_suppkey, CAST(rank() OVER c AS INTEGER) AS rank, CAST(dense_rank() OVER c AS INTEGER) AS dense_rank, CAST(ntile(4) OVER b AS INTEGER) AS quarter,
       round(percent_rank() OVER c, 6) AS percent_rank, round(cume_dist() OVER c, 6) AS cume_dist, lead(s_suppkey) OVER b AS next_key,
       nth_value(s_suppkey, 2) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_key,
       round(avg(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS smooth
FROM supplier WINDOW b AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey), c AS (PARTITION BY s_nationkey ORDER BY floor(s_acctbal / 1000))
"""


def event_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and approximate distinct counts: the sketch's answer lies within a tenth of the exact one."""
    # each pair once, and then sketches: beside an exact count in one aggregate, each pair would have a sketch of its own
    pairs = table(spark, sf_dir, "events").select("event_type", "user_id").distinct()
    found = pairs.groupBy("event_type").agg(F.count("user_id").alias("users"), F.approx_count_distinct("user_id", 0.02).alias("about"))
    return found.select("event_type", "users", (F.abs(F.col("about") - F.col("users")) <= 0.1 * F.col("users")).alias("near"))


EVENT_USERS = "SELECT event_type, count(DISTINCT user_id) AS users, true AS near FROM events GROUP BY 1"


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON: the field k of each event's properties, by type of event."""
    parsed = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k bigint")["k"])
    fields = parsed.withColumn("fields", F.size(F.json_object_keys("props")))
    return fields.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.max("fields").alias("fields"), F.max(F.get_json_object("props", "$.k")).alias("raw"))


EVENT_PROPS = """
SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, CAST(max(len(json_keys(props))) AS INTEGER) AS fields, max(json_extract_string(props, '$.k')) AS raw
FROM events GROUP BY 1, 2
"""


def user_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map and array functions: each user's counts by type of event, as a map."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return maps.select(
        "user_id",
        F.array_join(F.array_sort(F.map_keys("m")), ",").alias("kinds"),
        F.coalesce(F.try_element_at("m", F.lit("click")), F.lit(0)).alias("clicks"),
        F.aggregate(F.map_values("m"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"),
        F.size(F.map_filter("m", lambda k, v: v > 1)).alias("repeated"),
    )


USER_KINDS = """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS kinds, CAST(coalesce(sum(n) FILTER (event_type = 'click'), 0) AS BIGINT) AS clicks,
       CAST(sum(n) AS BIGINT) AS n, CAST(count(*) FILTER (n > 1) AS INTEGER) AS repeated
FROM c GROUP BY 1
"""


def order_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date functions."""
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").groupBy(F.date_format(F.date_trunc("month", day), "yyyy-MM-dd").alias("month")).agg(
        F.count("*").alias("n"),
        F.max(F.date_diff(F.last_day(day), day)).alias("most_days_left"),
        F.min(F.quarter(day)).alias("quarter"),
        F.count_if(F.weekday(day) >= 5).alias("on_weekends"),
        F.date_format(F.max(F.add_months(day, 1)), "yyyy-MM-dd").alias("due"),
    )


ORDER_CALENDAR = """
SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, count(*) AS n, CAST(max(date_diff('day', CAST(o_orderdate AS DATE), last_day(o_orderdate))) AS INTEGER) AS most_days_left,
       CAST(min(quarter(o_orderdate)) AS INTEGER) AS quarter, count(*) FILTER (isodow(o_orderdate) >= 6) AS on_weekends,
       strftime(max(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH), '%Y-%m-%d') AS due
FROM orders GROUP BY 1
"""


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String functions."""
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.upper(F.substring("p_name", 1, 5)).alias("head"),
        F.lpad(F.regexp_extract("p_brand", r"([0-9]+)", 1), 5, "0").alias("brand_number"),
        F.instr("p_name", " ").alias("first_blank"),
        F.concat_ws("/", F.reverse(F.split("p_name", " "))).alias("backwards"),
        F.translate(F.lower("p_name"), "aeiou", "").alias("consonants"),
        F.length(F.trim("p_name")).alias("chars"),
    )


PART_NAMES = """
SELECT p_partkey, upper(substr(p_name, 1, 5)) AS head, right(lpad(regexp_extract(p_brand, '([0-9]+)', 1), 5, '0'), 5) AS brand_number, CAST(instr(p_name, ' ') AS INTEGER) AS first_blank,
       array_to_string(list_reverse(string_split(p_name, ' ')), '/') AS backwards, regexp_replace(lower(p_name), '[aeiou]', '', 'g') AS consonants, CAST(length(trim(p_name)) AS INTEGER) AS chars
FROM part
"""


def name_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function of Python, in a lateral join: the words of each part's name."""
    spark.udtf.register("cut_words", cut_words)
    return spark.sql("SELECT p_partkey, pos, word FROM {part}, LATERAL cut_words(p_name)", part=table(spark, sf_dir, "part"))


NAME_WORDS = """
SELECT p_partkey, CAST(i AS INTEGER) AS pos, string_split(p_name, ' ')[i] AS word FROM part, generate_series(1, 99) g(i) WHERE i <= len(string_split(p_name, ' '))
"""


def customer_gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate of Python: how unequal each customer's orders are. A group is one customer's orders."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(gini("o_totalprice"), 6).alias("gini"))


CUSTOMER_GINI = """
WITH r AS (SELECT o_custkey, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, round(2 * sum(i * v) / (max(n) * sum(v)) - (max(n) + 1) / max(n), 6) AS gini FROM r GROUP BY 1
"""


def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed(events, "2 days", "1 day").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


SLIDING_WINDOWS = """
SELECT strftime(date_trunc('day', ts) - to_days(CAST(i AS INTEGER)), '%Y-%m-%d') AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total
FROM events, range(2) r(i) GROUP BY 1, 2
"""


def purchase_after_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stateful operator on a stream: seconds from each user's last error to a purchase. The stream is read to its end; purchases of its last hour still wait."""
    return drained(since_last(event_stream(spark, sf_dir), "error", "purchase"), "since-last")


PURCHASE_AFTER_ERROR = """
WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type IN ('error', 'purchase'))
SELECT p.event_id, p.user_id, p.ms // 1000 - max(x.ms) // 1000 AS seconds
FROM (SELECT * FROM e WHERE event_type = 'purchase' AND ms <= (SELECT max(ms) FROM e) - 3600000) p
LEFT JOIN (SELECT * FROM e WHERE event_type = 'error') x ON p.user_id = x.user_id AND (x.ms < p.ms OR (x.ms = p.ms AND x.event_id < p.event_id))
GROUP BY p.event_id, p.user_id, p.ms
"""

FORMATS = ("csv", "json", "orc", "parquet")


def format_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sinks and sources: orders written in each format, partitioned by status, and read back."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    out = None
    for name in FORMATS:
        path = shared_path(spark, f"orders-{name}")
        write_files(orders, path, name, ["o_orderstatus"])
        back = read_files(spark, path, name, orders.schema).withColumn("format", F.lit(name))
        out = back if out is None else out.unionByName(back)
    return out.groupBy("format", "o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderpriority").alias("first_priority"))


FORMAT_ROUND_TRIPS = f"""
SELECT format, o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, round(sum(o_totalprice), 2) AS total, min(o_orderpriority) AS first_priority
FROM orders, (VALUES {", ".join(f"('{x}')" for x in FORMATS)}) f(format) GROUP BY 1, 2
"""


def _in_thousands(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        frame["o_totalprice"] /= 1000
        yield frame


def thousands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of Python over batches of rows."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").mapInPandas(_in_thousands, "o_orderkey bigint, o_totalprice double").select("o_orderkey", F.round("o_totalprice", 3).alias("thousands"))


THOUSANDS = "SELECT o_orderkey, round(o_totalprice / 1000, 3) AS thousands FROM orders"

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        large_customers, patient_customers, nation_extremes, pending_orders, price_bands, priority_suppliers, order_rollup, order_grouping_sets, buyer_sets, supplier_ranks, event_users,
        event_props, user_kinds, order_calendar, part_names, name_words, customer_gini, sliding_windows, purchase_after_error, format_round_trips, thousands,
    )
}
ORACLES: dict[str, str] = {name: globals()[name.upper()] for name in QUERIES}
