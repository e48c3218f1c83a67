"""Queries of the panel layer beyond its first fits: controls, lags, parts of an index, instruments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import panel, regression
from marlstone.plans import catalog
from marlstone.plans.catalog import PANEL
from marlstone.sources import materialize

Query = Callable[[SparkSession, str], DataFrame]

#: The panel with what each row had one period before, where there is such a period.
LAGGED = f"(SELECT a.*, b.urgent AS urgent_lag1, b.balance AS balance_lag1 FROM ({PANEL}) a JOIN ({PANEL}) b ON a.entity = b.entity AND a.period = b.period + 1)"


def _lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(panel.lagged(panel.lagged(catalog._panel(spark, sf_dir), "urgent"), "balance"), "panel")


def _without_means(rows: str, **columns: str) -> str:
    """SQL of balanced rows whose columns, renamed, have no entity and period means."""
    parts = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY entity) - avg({c}) OVER (PARTITION BY period) + avg({c}) OVER () AS {k}" for k, c in columns.items())
    return f"(SELECT entity, period, {parts} FROM {rows})"


_EFFECTS = "count(*) AS n, count(DISTINCT entity) + count(DISTINCT period) - 1 AS k"


def controlled_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-way effects with a control beside the regressor."""
    found = regression.two_way(materialize(catalog._panel(spark, sf_dir), "panel"), "price", ["balance", "urgent"])
    return spark.createDataFrame([(k, round(b, 5), round(se, 5), found.n) for k, b, se in found.rows()], "term string, coefficient double, error double, n long")


CONTROLLED_EFFECTS = f"""
WITH s AS (SELECT sum(x * x) AS xx, sum(x * m) AS xm, sum(m * m) AS mm, sum(x * y) AS xy, sum(m * y) AS my, sum(y * y) AS yy, {_EFFECTS} FROM {_without_means(f"({PANEL})", y="price", x="balance", m="urgent")}),
f AS (SELECT *, xx * mm - xm * xm AS det, (mm * xy - xm * my) / (xx * mm - xm * xm) AS bx, (xx * my - xm * xy) / (xx * mm - xm * xm) AS bm FROM s),
g AS (SELECT *, (yy - bx * xy - bm * my) / (n - 2 - k) AS s2 FROM f)
SELECT unnest(['balance', 'urgent']) AS term, unnest([round(bx, 5), round(bm, 5)]) AS coefficient, unnest([round(sqrt(s2 * mm / det), 5), round(sqrt(s2 * xx / det), 5)]) AS error, n FROM g
"""


def lagged_mediation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mediation by the mediator's value one period before, against reverse causality."""
    found = regression.mediation(_lagged(spark, sf_dir), "price", "balance", "urgent_lag1")
    row = [round(v, 5) for v in (found.a * 1000, found.b / 1000, found.direct, found.total, found.indirect)]
    return spark.createDataFrame([tuple(row)], "a double, b double, direct double, total double, indirect double")


LAGGED_MEDIATION = f"""
WITH s AS (SELECT sum(x * x) AS xx, sum(x * m) AS xm, sum(m * m) AS mm, sum(x * y) AS xy, sum(m * y) AS my FROM {_without_means(LAGGED, y="price", x="balance", m="urgent_lag1")}),
f AS (SELECT xm / xx AS a, (xx * my - xm * xy) / (xx * mm - xm * xm) AS b, (mm * xy - xm * my) / (xx * mm - xm * xm) AS direct, xy / xx AS total FROM s)
SELECT round(a * 1000, 5) AS a, round(b / 1000, 5) AS b, round(direct, 5) AS direct, round(total, 5) AS total, round(a * b, 5) AS indirect FROM f
"""

PARTS = ("balance", "urgent", "orders")


def index_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index broken down: the two-way effect on price of each of its parts by itself."""
    rows, out = materialize(catalog._panel(spark, sf_dir), "panel"), []
    for part in PARTS:
        found = regression.two_way(rows, "price", [part])
        out += [(part, round(b, 5), round(se, 5), found.n) for _, b, se in found.rows()]
    return spark.createDataFrame(out, "part string, coefficient double, error double, n long")


INDEX_PARTS = " UNION ALL ".join(
    f"""
SELECT '{part}' AS part, round(b, 5) AS coefficient, round(sqrt((yy - b * b * xx) / (n - 1 - k) / xx), 5) AS error, n
FROM (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS xx, sum(y * y) AS yy, {_EFFECTS} FROM {_without_means(f"({PANEL})", y="price", x=part)})"""
    for part in PARTS
)


def instrumented_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The effect of balance on price, with its value one period before as the instrument."""
    found = regression.instrumented(_lagged(spark, sf_dir), "price", "balance", "balance_lag1")
    return spark.createDataFrame([(round(found.coefficients["balance"], 5), round(found.errors["balance"], 5), found.n)], "coefficient double, error double, n long")


INSTRUMENTED_EFFECT = f"""
WITH s AS (SELECT sum(z * y) AS zy, sum(z * x) AS zx, sum(z * z) AS zz, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy, {_EFFECTS} FROM {_without_means(LAGGED, y="price", x="balance", z="balance_lag1")}),
f AS (SELECT *, zy / zx AS b FROM s)
SELECT round(b, 5) AS coefficient, round(sqrt((yy - 2 * b * xy + b * b * xx) / (n - 1 - k) * zz) / abs(zx), 5) AS error, n FROM f
"""


def weighted_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-way effects of a panel whose rows weigh as many orders as they hold."""
    found = regression.two_way(materialize(catalog._panel(spark, sf_dir), "panel"), "price", ["balance"], weight="orders")
    return spark.createDataFrame([(round(found.coefficients["balance"], 5),)], "coefficient double")


#: Weighted means off in turn, as often as it takes them to vanish.
_ROUND = "SELECT entity, period, w, y - sum(w * y) OVER t / sum(w) OVER t AS y, x - sum(w * x) OVER t / sum(w) OVER t AS x FROM (SELECT entity, period, w, y - sum(w * y) OVER e / sum(w) OVER e AS y, x - sum(w * x) OVER e / sum(w) OVER e AS x FROM {rows} WINDOW e AS (PARTITION BY entity)) WINDOW t AS (PARTITION BY period)"


def _weighted() -> str:
    steps = [f"r0 AS (SELECT entity, period, CAST(orders AS DOUBLE) AS w, price AS y, balance AS x FROM ({PANEL}))"]
    steps += [f"r{i} AS MATERIALIZED ({_ROUND.format(rows=f'r{i - 1}')})" for i in range(1, 21)]
    return f"WITH {', '.join(steps)} SELECT round(sum(w * x * y) / sum(w * x * x), 5) AS coefficient FROM r20"


WEIGHTED_EFFECTS = _weighted()

QUERIES: dict[str, Query] = {f.__name__: f for f in (controlled_effects, lagged_mediation, index_parts, instrumented_effect, weighted_effects)}
ORACLES: dict[str, str] = {name: globals()[name.upper()] for name in QUERIES}
