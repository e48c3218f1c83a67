"""The panel layer against plain arithmetic."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import bootstrap, clean, compare, describe, panel, regression, robustness
from marlstone.plans import catalog


def made(n=12, t=9, drop=0.0, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        for p in range(t):
            if rng.random() >= drop:
                x, m = rng.gauss(i, 2), rng.gauss(p, 1)
                rows.append((i, p, x, m + 0.5 * x, 3 + 2 * x - 1.5 * m + 4 * i - p * p + rng.gauss(0, 0.3)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "entity int, period int, x double, m double, y double")


def by_dummies(rows, columns, y):
    ids, times = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    d = [[float(r[c]) for c in columns] + [float(r[0] == i) for i in ids] + [float(r[1] == t) for t in times[1:]] for r in rows]
    a, b = np.array(d), np.array([r[y] for r in rows])
    beta = np.linalg.lstsq(a, b, rcond=None)[0]
    rest = b - a @ beta
    se = np.sqrt(np.diag(np.linalg.inv(a.T @ a)) * (rest @ rest) / (len(b) - a.shape[1]))
    return beta[: len(columns)], se[: len(columns)]


@pytest.mark.parametrize("drop", [0.0, 0.3])
def test_two_way_effects_are_those_of_dummies(spark, drop):
    rows = made(drop=drop)
    got = regression.two_way(frame(spark, [*rows, (99, 1, None, 1.0, 1.0)]), "y", ["x", "m"])
    beta, se = by_dummies(rows, [2, 3], 4)
    assert got.n == len(rows)
    assert list(got.coefficients.values()) == pytest.approx(beta, rel=1e-6)
    assert list(got.errors.values()) == pytest.approx(se, rel=1e-6)


def test_plain_and_weighted_fits(spark):
    rows = made()
    a, y = np.array([[1, r[2], r[3]] for r in rows]), np.array([r[4] for r in rows])
    got = regression.fit(frame(spark, rows), "y", ["x", "m"])
    assert list(got.coefficients.values()) == pytest.approx(np.linalg.lstsq(a, y, rcond=None)[0], rel=1e-8)
    w = np.array([1 + r[0] % 3 for r in rows], float)
    got = regression.fit(frame(spark, rows).withColumn("w", 1 + F.col("entity") % 3), "y", ["x", "m"], weight="w")
    assert list(got.coefficients.values()) == pytest.approx(np.linalg.solve(a.T @ (a * w[:, None]), a.T @ (w * y)), rel=1e-8)
    empty = regression.fit(frame(spark, []), "y", ["x"])
    assert empty.n == 0 and np.isnan(empty.coefficients["x"])


def test_mediation_adds_up(spark):
    got = regression.mediation(frame(spark, made()), "y", "x", "m")
    assert got.total == pytest.approx(got.direct + got.indirect, rel=1e-6)


@pytest.mark.parametrize("drop", [0.0, 0.25])
def test_bootstrap_fits_each_replicate_anew(spark, drop):
    """Against dummy-variable fits of the drawn entities, each as often as it was drawn."""
    made_rows = made(drop=drop)
    rows = frame(spark, made_rows)
    got = {r.replicate: r for r in bootstrap.mediated(rows, "y", "x", "m", 12, 3).collect()}
    times = {}
    for r in bootstrap.draws(rows, 12, 3).collect():
        times.setdefault(r.replicate, {})[r.entity] = r.times
    for k, drawn in times.items():
        assert sum(drawn.values()) == 12
        # a copy of an entity is an entity of its own; its effect is the same, so copies can share one
        copies = [r for r in made_rows for _ in range(drawn.get(r[0], 0))]
        a, _ = by_dummies(copies, [2], 3)
        b, _ = by_dummies(copies, [2, 3], 4)
        assert got[k].a == pytest.approx(a[0], rel=1e-6) and got[k].b == pytest.approx(b[1], rel=1e-6)
    ends = bootstrap.interval(bootstrap.mediated(rows, "y", "x", "m", 12, 3), "indirect").first()
    assert ends.n == 12 and ends.low <= ends.median <= ends.high


@pytest.mark.parametrize("drop", [0.0, 0.3])
def test_weighted_two_way_effects(spark, drop):
    rows = made(drop=drop)
    got = regression.two_way(frame(spark, rows).withColumn("w", 1 + F.col("entity") * F.col("period") % 3), "y", ["x", "m"], weight="w")
    repeated = [r for r in rows for _ in range(1 + r[0] * r[1] % 3)]
    assert list(got.coefficients.values()) == pytest.approx(by_dummies(repeated, [2, 3], 4)[0], rel=1e-6)


def test_an_instrument_undoes_what_moves_both(spark):
    rng, rows = random.Random(5), []
    for i in range(40):
        for p in range(12):
            z, u = rng.gauss(0, 1), rng.gauss(0, 1)
            rows.append((i, p, 2 * z + u + i, z, 3 * (2 * z + u + i) - 4 * u + rng.gauss(0, 0.1)))
    df = frame(spark, rows)
    got = regression.instrumented(df, "y", "x", "m")
    assert got.coefficients["x"] == pytest.approx(3, abs=4 * got.errors["x"]) and got.errors["x"] < 0.2
    assert abs(regression.two_way(df, "y", ["x"]).coefficients["x"] - 3) > 0.5
    assert np.isnan(regression.instrumented(df.limit(0), "y", "x", "m").coefficients["x"])


def test_lag_balance_and_keys(spark):
    p = frame(spark, [(1, 1, 1.0, 0.0, 0.0), (1, 2, 2.0, 0.0, 0.0), (1, 4, 4.0, 0.0, 0.0), (2, 2, 5.0, 0.0, 0.0)])
    got = {(r.entity, r.period): r.x_lag1 for r in panel.lagged(p, "x").collect()}
    assert got == {(1, 1): None, (1, 2): 1.0, (1, 4): None, (2, 2): None}
    assert tuple(panel.balance(p).first()) == (4, 2, 3, False)
    assert panel.duplicate_keys(p).count() == 0 and panel.duplicate_keys(p.union(p)).count() == 4


def test_comparison_and_description(spark):
    df = spark.createDataFrame([("a", 4.0), ("a", 6.0), ("b", 2.0), ("c", 9.0), ("b", None), (None, 1.0)], "g string, v double")
    r = compare.ratio_and_gap(df, F.col("g"), F.col("v"), "a", "b", []).first()
    assert (r.ratio, r.gap) == (2.5, 3.0)
    s = {r.g: r for r in describe.summary(df, F.col("v"), [F.col("g")]).collect()}
    assert s["b"].n == 1 and s["b"].nulls == 1 and s["a"].median == 5.0 and s["c"].sd is None
    bins = {r.bin: r.n for r in describe.histogram(df, F.col("v"), 2.0, 6.0, 2).collect()}
    assert bins == {-1: 1, 0: 1, 1: 2, 2: 1}
    i = describe.index(spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0)], "k int, a double, b double"), ["k"], {"a": 0.6, "b": 0.4})
    assert sorted(map(tuple, i.collect())) == [(1, 0.0), (2, 0.6)]


@pytest.mark.parametrize("by", [["g"], []])
def test_quantiles_are_exact(spark, by):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 5.0, 5.0, rng.gauss(0, 9)])) for _ in range(3000)] + [("one", 7.0), ("none", None)] + [("many", rng.gauss(0, 9)) for _ in range(30_000)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    shares = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = {(r["g"] if by else "all", r.share): r["quantile"] for r in describe.quantiles(df, F.col("v"), [F.col(c) for c in by], shares).collect()}
    values = {}
    for g, v in rows:
        if v is not None:
            values.setdefault(g if by else "all", []).append(v)
    assert got == {(g, q): pytest.approx(np.quantile(v, q)) for g, v in values.items() for q in shares}


def test_cleaning(spark):
    df = spark.createDataFrame([(1, 1, "3"), (1, 2, "x"), (2, 1, None)], "k int, t int, v string")
    assert sorted(map(tuple, clean.latest(df, ["k"], ["t"]).collect())) == [(1, 2, "x"), (2, 1, None)]
    typed = clean.filled(clean.typed(df, {"v": "double"}), {"v": -1.0})
    assert sorted(r.v for r in typed.collect()) == [-1.0, -1.0, 3.0]
    assert clean.long(typed, ["k"], ["v"]).count() == 3


def test_robustness_table(spark):
    df = frame(spark, made())
    got = robustness.table_of({"one": lambda: regression.fit(df, "y", ["x"]), "two": lambda: regression.two_way(df, "y", ["x"])}, df)
    assert [(r.variant, r.term) for r in got.collect()] == [("one", "intercept"), ("one", "x"), ("two", "x")]


def test_the_whole_panel_is_lagged(spark, monkeypatch):
    p = frame(spark, made(n=5, t=6)).withColumnRenamed("x", "price")
    rows = {(r.entity, r.period): r.price for r in p.collect()}
    monkeypatch.setattr(catalog, "_panel", lambda spark, sf_dir: p)
    got = {(r.entity, r.period): r.price_lag1 for r in catalog.QUERIES["panel_lag"](spark, "").collect()}
    assert got.keys() == rows.keys()
    for (entity, period), lag in got.items():
        assert lag == (None if period == 0 else pytest.approx(rows[entity, period - 1], abs=1e-4))


def test_lag_over_gaps(spark):
    rows = [r for r in made(n=5, t=9) if (r[0] + r[1]) % 5]
    values = {(r[0], r[1]): r[2] for r in rows}
    got = {(r.entity, r.period): r.x_lag1 for r in panel.lagged(frame(spark, rows), "x").collect()}
    assert got == {(i, p): values.get((i, p - 1)) for i, p in values}


def dummies(rows):
    """(coefficient, residuals, x beside the dummies) of y on x with a dummy for each entity and period."""
    entities, periods = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    d = np.array([[float(r[0] == e) for e in entities] + [float(r[1] == p) for p in periods] for r in rows])
    y, x = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    off = lambda v: v - d @ np.linalg.lstsq(d, v, rcond=None)[0]
    y, x = off(y), off(x)
    b = (x @ y) / (x @ x)
    return b, y - b * x, x


def test_effects_of_a_chain_converge(spark):
    """Each entity is seen in three periods in a row: means taken off in turn would need hundreds of rounds."""
    rng = np.random.default_rng(2)
    rows = [(e, t, float(2 * (z := rng.normal() + e * t / 9) + e + 3 * t + rng.normal()), float(z)) for e in range(16) for t in (e, e + 1, e + 2)]
    frame = spark.createDataFrame(rows, "entity int, period int, y double, x double")
    got = regression.two_way(frame, "y", ["x"], clustered=True)
    b, left, x = dummies(rows)
    assert abs(got.coefficients["x"] - b) < 1e-8 * abs(b)
    scores = np.array([sum(u * v for (e, *_), u, v in zip(rows, x, left, strict=True) if e == i) for i in range(16)])
    assert abs(got.errors["x"] / (np.sqrt((scores**2).sum() * 16 / 15) / (x @ x)) - 1) < 1e-6 and got.free == 15
    with pytest.raises(RuntimeError, match="not separated within 2 rounds"):
        regression.demeaned(frame, ["x"], False, rounds=2)


def test_tails():
    from marlstone.functions.tails import f_upper, t_two_sided

    for t, free, p in ((12.706, 1, 0.05), (2.228, 10, 0.05), (2.750, 30, 0.01), (1.96, 1e7, 0.05), (0.0, 5, 1.0)):
        assert abs(t_two_sided(t, free) - p) < 2e-4 and t_two_sided(-t, free) == t_two_sided(t, free)
    for f, a, b, p in ((4.965, 1, 10, 0.05), (3.326, 5, 10, 0.05), (2.534, 5, 30, 0.05), (0.0, 2, 2, 1.0)):
        assert abs(f_upper(f, a, b) - p) < 2e-4


def test_equal_slopes(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(x), float(slope * x + rng.normal())) for g, slope in (("a", 1.0), ("b", 1.0), ("c", 1.0)) for x in rng.normal(size=40)]
    same = regression.equal_slopes(spark.createDataFrame(rows, "g string, x double, y double"), F.col("y"), F.col("x"), F.col("g"))
    other = regression.equal_slopes(spark.createDataFrame([*rows, *((("d", float(x), float(5 * x + rng.normal()))) for x in rng.normal(size=40)), (None, 1.0, 1.0), ("e", 1.0, 1.0)], "g string, x double, y double"), F.col("y"), F.col("x"), F.col("g"))
    # the same by two fits on dummies: with one slope, and with a slope for each group
    groups = sorted({r[0] for r in rows})
    y, x, d = np.array([r[2] for r in rows]), np.array([r[1] for r in rows]), np.array([[float(r[0] == g) for g in groups] for r in rows])
    rest = lambda m: float(((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum())
    one, each = rest(np.column_stack([d, x])), rest(np.column_stack([d, d * x[:, None]]))
    assert abs(same.f / ((one - each) / 2 / (each / (120 - 6))) - 1) < 1e-9 and (same.above, same.below) == (2, 114)
    assert same.p > 0.01 and other.p < 1e-6 and other.groups == 4
