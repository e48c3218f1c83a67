"""The library's own queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import bootstrap, clean, describe, joins, panel, regression
from marlstone.operators import robustness as robust
from marlstone.operators.compare import ratio_and_gap
from marlstone.sources import materialize, table
from marlstone.streaming import windowed

Query = Callable[[SparkSession, str], DataFrame]


def segment_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return ratio_and_gap(orders, F.col("c_mktsegment"), F.col("o_totalprice"), "BUILDING", "MACHINERY", [F.year("o_orderdate").alias("order_year")])


SEGMENT_GAP = """
SELECT order_year, round(h, 2) AS high_mean, round(l, 2) AS low_mean, round(h / nullif(l, 0), 4) AS ratio, round(h - l, 2) AS gap
FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS order_year,
             avg(CASE WHEN c_mktsegment = 'BUILDING' THEN o_totalprice END) AS h,
             avg(CASE WHEN c_mktsegment = 'MACHINERY' THEN o_totalprice END) AS l
      FROM orders JOIN customer ON o_custkey = c_custkey
      WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1)
"""

def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by order year: mean order value, customers' mean balance, share of urgent orders, orders."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    urgent = F.avg((F.col("o_orderpriority") == "1-URGENT").cast("double"))
    return panel.build(orders, F.col("c_nationkey"), F.year("o_orderdate"), price=F.avg("o_totalprice"), balance=F.avg("c_acctbal"), urgent=urgent, orders=F.count("*"))


PANEL = """
SELECT c_nationkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS period, avg(o_totalprice) AS price, avg(c_acctbal) AS balance,
       avg(CAST(o_orderpriority = '1-URGENT' AS DOUBLE)) AS urgent, count(*) AS orders
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
"""
#: Columns without entity and period means; right where the panel is balanced, as it is from scale 0.01 on.
DEMEANED = f"""
WITH p AS ({PANEL}), d AS (SELECT entity, period,
  price - avg(price) OVER (PARTITION BY entity) - avg(price) OVER (PARTITION BY period) + avg(price) OVER () AS y,
  balance - avg(balance) OVER (PARTITION BY entity) - avg(balance) OVER (PARTITION BY period) + avg(balance) OVER () AS x,
  urgent - avg(urgent) OVER (PARTITION BY entity) - avg(urgent) OVER (PARTITION BY period) + avg(urgent) OVER () AS m FROM p)
"""


def nation_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(spark, sf_dir).withColumns({c: F.round(c, 4) for c in ("price", "balance", "urgent")})


NATION_PANEL = f"SELECT entity, period, round(price, 4) AS price, round(balance, 4) AS balance, round(urgent, 4) AS urgent, orders FROM ({PANEL})"


def panel_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lag of every row of the panel."""
    found = panel.lagged(_panel(spark, sf_dir), "price")
    return found.select("entity", "period", F.round("price_lag1", 4).alias("price_lag1"))


PANEL_LAG = f"""
WITH p AS ({PANEL})
SELECT a.entity, a.period, round(b.price, 4) AS price_lag1 FROM p a LEFT JOIN p b ON a.entity = b.entity AND a.period = b.period + 1
"""


def panel_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.balance(_panel(spark, sf_dir))


PANEL_BALANCE = f"SELECT count(*) AS n, count(DISTINCT entity) AS entities, count(DISTINCT period) AS periods, count(*) = count(DISTINCT entity) * count(DISTINCT period) AS balanced FROM ({PANEL})"


def price_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.summary(table(spark, sf_dir, "orders"), F.col("o_totalprice"), [F.col("o_orderpriority")], 2)


PRICE_SUMMARY = """
SELECT o_orderpriority, count(o_totalprice) AS n, count(*) - count(o_totalprice) AS nulls, round(avg(o_totalprice), 2) AS mean, round(stddev_samp(o_totalprice), 2) AS sd,
       round(min(o_totalprice), 2) AS least, round(quantile_cont(o_totalprice, 0.25), 2) AS q1, round(quantile_cont(o_totalprice, 0.5), 2) AS median,
       round(quantile_cont(o_totalprice, 0.75), 2) AS q3, round(max(o_totalprice), 2) AS most
FROM orders GROUP BY 1
"""


def price_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.histogram(table(spark, sf_dir, "orders"), F.col("o_totalprice"), 0.0, 400_000.0, 16, [F.col("o_orderstatus")])


PRICE_HISTOGRAM = """
SELECT o_orderstatus, CAST(CASE WHEN o_totalprice < 0 THEN -1 WHEN o_totalprice > 400000 THEN 16 ELSE least(floor(o_totalprice / 25000), 15) END AS INTEGER) AS bin, count(*) AS n
FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1, 2
"""


def price_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.trend(_panel(spark, sf_dir), F.col("price"))


PRICE_TREND = f"""
WITH t AS (SELECT period, avg(price) AS mean FROM ({PANEL}) GROUP BY 1)
SELECT period, round(mean, 4) AS mean, round(mean - lag(mean) OVER (ORDER BY period), 4) AS change, round(mean / nullif(lag(mean) OVER (ORDER BY period), 0) - 1, 4) AS growth FROM t
"""


def nation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_nation = _panel(spark, sf_dir).groupBy("entity").agg(*(F.avg(c).alias(c) for c in ("price", "balance", "urgent")))
    return describe.index(by_nation, ["entity"], {"price": 0.5, "balance": 0.3, "urgent": 0.2}, 5)


NATION_INDEX = f"""
WITH n AS (SELECT entity, avg(price) AS price, avg(balance) AS balance, avg(urgent) AS urgent FROM ({PANEL}) GROUP BY 1),
scale AS (SELECT *, price - min(price) OVER () AS p, max(price) OVER () - min(price) OVER () AS pr, balance - min(balance) OVER () AS b, max(balance) OVER () - min(balance) OVER () AS br,
          urgent - min(urgent) OVER () AS u, max(urgent) OVER () - min(urgent) OVER () AS ur FROM n)
SELECT entity, round(coalesce(p / nullif(pr, 0), 0) * 0.5 + coalesce(b / nullif(br, 0), 0) * 0.3 + coalesce(u / nullif(ur, 0), 0) * 0.2, 5) AS "index" FROM scale
"""


def segment_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return regression.simple(orders, F.col("o_totalprice"), F.col("c_acctbal"), [F.col("c_mktsegment")], 4)


SEGMENT_OLS = """
SELECT c_mktsegment, count(*) AS n, round(regr_slope(o_totalprice, c_acctbal), 4) AS slope, round(regr_intercept(o_totalprice, c_acctbal), 4) AS intercept,
       round(regr_r2(o_totalprice, c_acctbal), 4) AS r2,
       round(sqrt((regr_syy(o_totalprice, c_acctbal) - pow(regr_slope(o_totalprice, c_acctbal), 2) * regr_sxx(o_totalprice, c_acctbal)) / (count(*) - 2) / regr_sxx(o_totalprice, c_acctbal)), 4) AS se
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
"""


def two_way_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = regression.two_way(materialize(_panel(spark, sf_dir), "panel"), "price", ["balance"])
    return spark.createDataFrame([(round(found.coefficients["balance"], 5), round(found.errors["balance"], 5), found.n)], "coefficient double, error double, n long")


TWO_WAY = f"""
{DEMEANED}, f AS (SELECT sum(x * y) / sum(x * x) AS b, count(*) AS n, sum(x * x) AS xx, sum(y * y) AS yy, count(DISTINCT entity) + count(DISTINCT period) - 1 AS k FROM d)
SELECT round(b, 5) AS coefficient, round(sqrt((yy - b * b * xx) / (n - 1 - k) / xx), 5) AS error, n FROM f
"""


def mediation_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = regression.mediation(materialize(_panel(spark, sf_dir), "panel"), "price", "balance", "urgent")
    row = [round(v, 5) for v in (found.a * 1000, found.b / 1000, found.direct, found.total, found.indirect)]
    return spark.createDataFrame([tuple(row)], "a double, b double, direct double, total double, indirect double")


MEDIATION = f"""
{DEMEANED}, s AS (SELECT sum(x * x) AS xx, sum(x * m) AS xm, sum(m * m) AS mm, sum(x * y) AS xy, sum(m * y) AS my FROM d),
f AS (SELECT xm / xx AS a, (xx * my - xm * xy) / (xx * mm - xm * xm) AS b, (mm * xy - xm * my) / (xx * mm - xm * xm) AS direct, xy / xx AS total FROM s)
SELECT round(a * 1000, 5) AS a, round(b / 1000, 5) AS b, round(direct, 5) AS direct, round(total, 5) AS total, round(a * b, 5) AS indirect FROM f
"""


def mediation_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bootstrap.mediated(materialize(_panel(spark, sf_dir), "panel"), "price", "balance", "urgent", replicates=200, seed=7)
    return bootstrap.interval(found, "indirect").select("n", *(F.round(c, 5).alias(c) for c in ("low", "median", "high")))


#: Entity means come off first, and then each replicate's own period means; right where the panel is balanced.
MEDIATION_BOOTSTRAP = f"""
WITH p AS ({PANEL}), o AS (SELECT entity, period, price - avg(price) OVER e AS y, balance - avg(balance) OVER e AS x, urgent - avg(urgent) OVER e AS m FROM p WINDOW e AS (PARTITION BY entity)),
e AS (SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS number FROM (SELECT DISTINCT entity FROM o)),
c AS (SELECT count(*) AS n FROM e),
draws AS (SELECT r.range AS replicate, CAST('0x' || substr(md5('7|' || r.range || '|' || i.range), 1, 8) AS BIGINT) % c.n AS number
          FROM c, range(200) r, range((SELECT n FROM c)) i),
b AS (SELECT replicate, o.* FROM draws JOIN e USING (number) JOIN o USING (entity)),
d AS (SELECT replicate, y - avg(y) OVER t AS y, x - avg(x) OVER t AS x, m - avg(m) OVER t AS m FROM b WINDOW t AS (PARTITION BY replicate, period)),
w AS (SELECT replicate, sum(x * x) AS xx, sum(x * m) AS xm, sum(m * m) AS mm, sum(x * y) AS xy, sum(m * y) AS my FROM d GROUP BY 1),
f AS (SELECT xm / nullif(xx, 0) * (xx * my - xm * xy) / nullif(xx * mm - xm * xm, 0) AS indirect FROM w)
SELECT count(indirect) AS n, round(quantile_cont(indirect, 0.025), 5) AS low, round(quantile_cont(indirect, 0.5), 5) AS median, round(quantile_cont(indirect, 0.975), 5) AS high FROM f
"""


def robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(_panel(spark, sf_dir), "panel")
    busy = rows.where("orders >= 5")
    fits = {
        "ols": lambda: regression.fit(rows, "price", ["balance"]),
        "two controls": lambda: regression.fit(rows, "price", ["balance", "urgent"]),
        "busy cells": lambda: regression.fit(busy, "price", ["balance"]),
        "early years": lambda: regression.fit(rows.where("period < 1999"), "price", ["balance"]),
        "two-way effects": lambda: regression.two_way(rows, "price", ["balance"]),
    }
    return robust.table_of(fits, rows, 4)


def _one_regressor(name: str, rows: str) -> str:
    """SQL for the rows of a plain fit of price on balance."""
    return f"""
SELECT '{name}' AS variant, unnest(['intercept', 'balance']) AS term, unnest([b0, b]) AS coefficient, unnest([sqrt(s2 * (1 / n + mx * mx / xx)), sqrt(s2 / xx)]) AS error, n
FROM (SELECT *, (yy - b * b * xx) / (n - 2) AS s2 FROM (SELECT regr_intercept(price, balance) AS b0, regr_slope(price, balance) AS b, regr_sxx(price, balance) AS xx, regr_syy(price, balance) AS yy, avg(balance) AS mx, count(*) AS n FROM {rows}))"""


ROBUSTNESS = f"""
{DEMEANED},
v AS ({_one_regressor('ols', 'p')} UNION ALL {_one_regressor('busy cells', 'p WHERE orders >= 5')} UNION ALL {_one_regressor('early years', 'p WHERE period < 1999')}
UNION ALL
SELECT 'two controls', unnest(['intercept', 'balance', 'urgent']), unnest([my - bx * mx - bm * mm, bx, bm]),
       unnest([sqrt(s2 * (1 / n + (mx * mx * smm - 2 * mx * mm * sxm + mm * mm * sxx) / det)), sqrt(s2 * smm / det), sqrt(s2 * sxx / det)]), n
FROM (SELECT *, (syy - bx * sxy - bm * smy) / (n - 3) AS s2 FROM (SELECT *, (smm * sxy - sxm * smy) / det AS bx, (sxx * smy - sxm * sxy) / det AS bm FROM (
      SELECT *, sxx * smm - sxm * sxm AS det FROM (SELECT count(*) AS n, avg(price) AS my, avg(balance) AS mx, avg(urgent) AS mm, regr_syy(price, balance) AS syy, regr_sxx(price, balance) AS sxx,
      regr_sxx(price, urgent) AS smm, regr_sxy(urgent, balance) AS sxm, regr_sxy(price, balance) AS sxy, regr_sxy(price, urgent) AS smy FROM p))))
UNION ALL
SELECT 'two-way effects', 'balance', b, sqrt((yy - b * b * xx) / (n - 1 - k) / xx), n
FROM (SELECT sum(x * y) / sum(x * x) AS b, count(*) AS n, sum(x * x) AS xx, sum(y * y) AS yy, count(DISTINCT entity) + count(DISTINCT period) - 1 AS k FROM d))
SELECT variant, term, round(coefficient, 4) AS coefficient, round(error, 4) AS error, n FROM v
"""


def region_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = _panel(spark, sf_dir).join(F.broadcast(nation.select(F.col("n_nationkey").alias("entity"), "r_name")), "entity")  # 25 rows at every scale
    return regression.simple(rows, F.col("price"), F.col("balance"), [F.col("r_name")], 4)


REGION_SLOPES = f"""
SELECT r_name, count(*) AS n, round(regr_slope(price, balance), 4) AS slope, round(regr_intercept(price, balance), 4) AS intercept, round(regr_r2(price, balance), 4) AS r2,
       round(sqrt((regr_syy(price, balance) - pow(regr_slope(price, balance), 2) * regr_sxx(price, balance)) / (count(*) - 2) / regr_sxx(price, balance)), 4) AS se
FROM ({PANEL}) JOIN nation ON entity = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1
"""


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed(events).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


EVENT_WINDOWS = "SELECT strftime(ts, '%Y-%m-%d') AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"


def last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return clean.long(clean.filled(clean.latest(events, ["user_id", "event_type"], ["event_id"]), {"value": 0.0}).withColumn("event_id", F.col("event_id").cast("double")), ["user_id", "event_type"], ["event_id", "value"])


LAST_EVENTS = """
WITH l AS (SELECT user_id, event_type, arg_max(value, event_id) AS v, max(event_id) AS e FROM events GROUP BY 1, 2)
SELECT user_id, event_type, 'value' AS name, coalesce(v, 0) AS value FROM l UNION ALL SELECT user_id, event_type, 'event_id', CAST(e AS DOUBLE) FROM l
"""

def _seconds(events: DataFrame) -> DataFrame:
    return events.select("event_id", "user_id", "event_type", "value", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))


def last_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _seconds(table(spark, sf_dir, "events"))
    views = events.where("event_type = 'view'").select("user_id", "at", F.col("event_id").alias("view_id"))
    return joins.as_of(events.where("event_type = 'purchase'").select("event_id", "user_id", "at"), views, ["user_id"], "at", ["view_id"])


_AT = "SELECT event_id, user_id, event_type, value, CAST(floor(epoch(ts)) AS BIGINT) AS \"at\" FROM events"
LAST_VIEW = f"""
WITH e AS ({_AT}), p AS (SELECT * FROM e WHERE event_type = 'purchase'), v AS (SELECT * FROM e WHERE event_type = 'view')
SELECT p.event_id, p.user_id, p."at", arg_max(v.event_id, (v."at", v.event_id)) AS view_id
FROM p LEFT JOIN v ON p.user_id = v.user_id AND v."at" <= p."at" GROUP BY 1, 2, 3
"""


def after_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _seconds(table(spark, sf_dir, "events"))
    spans = events.where("event_type = 'error'").select("user_id", F.col("at").alias("error_at"), F.col("event_id").alias("error_id"))
    pairs = joins.interval(events.where("event_type <> 'error'"), spans, ["user_id"], "at", "error_at", 86_400 * 3)
    return pairs.groupBy("error_id").agg(F.count("*").alias("n"), F.min(F.col("at") - F.col("error_at")).alias("soonest"))


AFTER_ERRORS = f"""
WITH e AS ({_AT})
SELECT b.event_id AS error_id, count(*) AS n, min(a."at" - b."at") AS soonest FROM e a JOIN e b ON a.user_id = b.user_id AND a."at" >= b."at" AND a."at" < b."at" + 259200
WHERE a.event_type <> 'error' AND b.event_type = 'error' GROUP BY 1
"""


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = joins.sessions(_seconds(table(spark, sf_dir, "events")), ["user_id"], "at", 86_400)
    return found.groupBy("user_id", "session").agg(F.count("*").alias("n"), (F.max("at") - F.min("at")).alias("seconds"))


USER_SESSIONS = f"""
WITH e AS ({_AT}), g AS (SELECT *, CASE WHEN "at" - lag("at") OVER (PARTITION BY user_id ORDER BY "at") <= 86400 THEN 0 ELSE 1 END AS b FROM e),
s AS (SELECT *, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY "at") AS BIGINT) AS session FROM g)
SELECT user_id, session, count(*) AS n, max("at") - min("at") AS seconds FROM s GROUP BY 1, 2
"""


def price_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority")
    return cube.agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


PRICE_CUBE = """
SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS level, count(*) AS n, round(avg(o_totalprice), 4) AS mean
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)
"""


def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joins.top(orders.select("c_mktsegment", "o_orderkey", "o_totalprice"), ["c_mktsegment"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 10)


TOP_ORDERS = """
SELECT * FROM (SELECT c_mktsegment, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank
FROM orders JOIN customer ON o_custkey = c_custkey) WHERE rank <= 10
"""

QUERIES: dict[str, Query] = {
    "segment_gap": segment_gap,
    "nation_panel": nation_panel,
    "panel_lag": panel_lag,
    "panel_balance": panel_balance,
    "price_summary": price_summary,
    "price_histogram": price_histogram,
    "price_trend": price_trend,
    "nation_index": nation_index,
    "segment_ols": segment_ols,
    "region_slopes": region_slopes,
    "two_way_effects": two_way_effects,
    "mediation_effects": mediation_effects,
    "mediation_bootstrap": mediation_bootstrap,
    "robustness": robustness,
    "event_windows": event_windows,
    "last_events": last_events,
    "last_view": last_view,
    "after_errors": after_errors,
    "user_sessions": user_sessions,
    "price_cube": price_cube,
    "top_orders": top_orders,
}
ORACLES: dict[str, str] = {
    "segment_gap": SEGMENT_GAP,
    "nation_panel": NATION_PANEL,
    "panel_lag": PANEL_LAG,
    "panel_balance": PANEL_BALANCE,
    "price_summary": PRICE_SUMMARY,
    "price_histogram": PRICE_HISTOGRAM,
    "price_trend": PRICE_TREND,
    "nation_index": NATION_INDEX,
    "segment_ols": SEGMENT_OLS,
    "region_slopes": REGION_SLOPES,
    "two_way_effects": TWO_WAY,
    "mediation_effects": MEDIATION,
    "mediation_bootstrap": MEDIATION_BOOTSTRAP,
    "robustness": ROBUSTNESS,
    "event_windows": EVENT_WINDOWS,
    "last_events": LAST_EVENTS,
    "last_view": LAST_VIEW,
    "after_errors": AFTER_ERRORS,
    "user_sessions": USER_SESSIONS,
    "price_cube": PRICE_CUBE,
    "top_orders": TOP_ORDERS,
}
