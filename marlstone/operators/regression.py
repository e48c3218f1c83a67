"""Least squares: plain, by group, with fixed effects, and what is built from these."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.tails import f_upper, t_two_sided
from marlstone.sources import materialize


def simple(df: DataFrame, y: Column, x: Column, by: list[Column] | None = None, places: int = 6) -> DataFrame:
    """n, slope, intercept, r2 and standard error of the slope of y on x for each group: one aggregate with partial sums."""
    n, sxx, syy, b = F.regr_count(y, x), F.regr_sxx(y, x), F.regr_syy(y, x), F.regr_slope(y, x)
    found = df.groupBy(*(by or [])).agg(n.alias("n"), b.alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), sxx.alias("sxx"), syy.alias("syy"))
    rest = F.greatest(F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx"), F.lit(0.0))
    se = F.when(F.col("n") > 2, F.sqrt(rest / (F.col("n") - 2) / F.nullif(F.col("sxx"), F.lit(0.0))))
    return found.withColumns({"se": F.round(se, places), **{c: F.round(c, places) for c in ("slope", "intercept", "r2")}}).drop("sxx", "syy")


@dataclass
class Fit:
    """Coefficients by name, their standard errors, and the fit's figures."""

    coefficients: dict[str, float]
    errors: dict[str, float]
    n: int
    r2: float
    free: float = float("nan")

    def p(self) -> dict[str, float]:
        """Two-sided p-values, by Student's t with ``free`` degrees of freedom."""
        return {k: t_two_sided(b / self.errors[k] if self.errors[k] else float("nan"), self.free) for k, b in self.coefficients.items()}

    def rows(self) -> list[tuple[str, float, float]]:
        return [(k, v, self.errors[k]) for k, v in self.coefficients.items()]


def fit(df: DataFrame, y: str, x: list[str], intercept: bool = True, absorbed: int = 0, weight: str | None = None, cluster: str | None = None) -> Fit:
    """Least squares of ``y`` on ``x``. Rows with a null among them are left out.

    ``cluster``: a column; errors are then those of coefficients whose
    disturbances may be correlated in any way among rows with one of its
    values. Each cluster's sum of scores is one row of an aggregate, and the
    sandwich's middle is the sum of their products, times g / (g - 1) for g
    clusters, which give g - 1 degrees of freedom.

    The sums of products are one aggregate; the driver solves a system of as
    many equations as there are regressors. ``absorbed`` degrees of freedom
    are taken off for effects removed before. A regressor that the others
    determine gets the coefficient of least norm, of columns brought to one length.
    """
    known = df.dropna(subset=[y, *x] + ([weight] if weight else []))
    columns = ([F.lit(1.0)] if intercept else []) + [F.col(c).cast("double") for c in x] + [F.col(y).cast("double")]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    k = len(columns)
    sums = known.agg(F.sum(w).alias("n"), *(F.sum(w * columns[i] * columns[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i + 1))).first()
    names = (["intercept"] if intercept else []) + x
    if not sums["n"]:
        return Fit(dict.fromkeys(names, float("nan")), dict.fromkeys(names, float("nan")), 0, float("nan"))
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i + 1):
            m[i, j] = m[j, i] = sums[f"s{i}_{j}"]
    unit = 1 / np.sqrt(np.where(np.diag(m) > 0, np.diag(m), 1.0))[:-1]  # columns of like length keep the inverse exact
    inverse = np.linalg.pinv(m[:-1, :-1] * np.outer(unit, unit), hermitian=True) * np.outer(unit, unit)
    b = inverse @ m[:-1, -1]
    n = round(sums["n"])
    rest = max(0.0, m[-1, -1] - b @ m[:-1, -1])
    total = m[-1, -1] - (m[0, -1] ** 2 / sums["n"] if intercept else 0)
    free = n - len(names) - absorbed
    se = np.sqrt(np.clip(np.diag(inverse), 0, None) * rest / free) if free > 0 else np.full(len(names), np.nan)
    if cluster:
        left = columns[-1]
        for c, value in zip(columns[:-1], b, strict=True):
            left = left - c * float(value)
        scores = known.groupBy(cluster).agg(*(F.sum(w * c * left).alias(f"s{i}") for i, c in enumerate(columns[:-1])))
        pairs = scores.agg(F.count("*").alias("g"), *(F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"s{i}_{j}") for i in range(k - 1) for j in range(i + 1))).first()
        middle, groups = np.zeros((k - 1, k - 1)), pairs["g"]
        for i in range(k - 1):
            for j in range(i + 1):
                middle[i, j] = middle[j, i] = pairs[f"s{i}_{j}"]
        free = groups - 1
        se = np.sqrt(np.clip(np.diag(inverse @ middle @ inverse), 0, None) * groups / free) if free > 0 else np.full(len(names), np.nan)
    return Fit(dict(zip(names, map(float, b), strict=True)), dict(zip(names, map(float, se), strict=True)), n, float(1 - rest / total) if total > 0 else float("nan"), float(free))


def demeaned(
    panel: DataFrame, columns: list[str], balanced: bool, rounds: int = 500, tolerance: float = 1e-10, keep: list[str] | None = None, weight: str | None = None, within: list[str] | None = None
) -> DataFrame:
    """``columns`` without entity and period effects, weighted by ``weight``: what is left of them beside a dummy for each of both.

    A balanced panel whose weights are the same in all periods takes one pass.
    In any other, entity means come off, and period effects are found by
    conjugate gradients on what is left: in as many rounds as there are
    periods, but for rounding, and mostly in few. A round's direction is the
    period means of the present rest, without their own entity means, so rows
    stay free of entity effects throughout. It ends when no period mean is
    further from 0 than ``tolerance`` times the column's spread; RuntimeError
    if that takes more than ``rounds`` rounds. Rows are written every round.
    Means are aggregates with partial sums joined back, so an entity of any
    size is spread over tasks. ``within``: columns that part the rows into
    panels of their own, all done at once, each with steps of its own.
    """
    within = within or []
    kept = list(dict.fromkeys([*within, "entity", "period", *(keep or []), *([weight] if weight else [])]))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    mean = lambda c: F.sum(F.col(c) * w) / F.sum(w)

    def without(df: DataFrame, key: str) -> DataFrame:
        means = df.groupBy(*within, key).agg(*(mean(c).alias(f"mean_{c}") for c in columns))
        return df.join(means, [*within, key]).select(*kept, *((F.col(c) - F.col(f"mean_{c}")).alias(c) for c in columns))

    rows = panel.dropna(subset=[*columns, *([weight] if weight else [])]).select(*kept, *(F.col(c).cast("double").alias(c) for c in columns))
    if balanced:
        return without(without(rows, "entity"), "period")
    by = within or ["one_panel"]
    about = rows.select("*", *([] if within else [F.lit(0).alias("one_panel")])).groupBy(*by)
    spread = lambda c: F.sqrt(F.greatest(F.sum(w * F.col(c) * F.col(c)) / F.sum(w) - F.pow(F.sum(w * F.col(c)) / F.sum(w), 2), 1e-24 * F.pow(F.sum(w * F.col(c)) / F.sum(w), 2)))
    # one row where there is one panel, which the driver then holds; else a written table
    settled = lambda df: materialize(df, "demeaned-state") if within else df.sparkSession.createDataFrame(df.collect(), df.schema)
    state = settled(about.agg(*(spread(c).alias(f"spread_{c}") for c in columns)).select(*by, *(f"spread_{c}" for c in columns), *(F.lit(0.0).alias(f"old_{c}") for c in columns)))
    rows = without(rows, "entity").select("*", *(F.lit(0.0).alias(f"way_{c}") for c in columns))
    for _ in range(rounds):
        means = rows.groupBy(*within, "period").agg(*(mean(c).alias(f"mean_{c}") for c in columns))
        met = rows.join(means, [*within, "period"])
        own = met.groupBy(*within, "entity").agg(*(mean(f"mean_{c}").alias(f"of_{c}") for c in columns))
        step = met.join(own, [*within, "entity"]).select(*kept, *([] if within else [F.lit(0).alias("one_panel")]), *columns, *(f"way_{c}" for c in columns), *(f"mean_{c}" for c in columns), *((F.col(f"mean_{c}") - F.col(f"of_{c}")).alias(f"next_{c}") for c in columns))
        step = materialize(step, "demeaned")
        product = lambda a, b: F.sum(w * F.col(a) * F.col(b))
        sums = [x for c in columns for x in (product(c, f"next_{c}").alias(f"new_{c}"), product(f"next_{c}", f"next_{c}").alias(f"nn_{c}"), product(f"next_{c}", f"way_{c}").alias(f"nw_{c}"), product(f"way_{c}", f"way_{c}").alias(f"ww_{c}"), F.max(F.abs(f"mean_{c}")).alias(f"off_{c}"))]
        told = step.groupBy(*by).agg(*sums).join(state, by)
        ended = lambda c: F.col(f"off_{c}") <= tolerance * F.col(f"spread_{c}")
        turn = lambda c: F.coalesce(F.col(f"new_{c}") / F.nullif(F.col(f"old_{c}"), F.lit(0.0)), F.lit(0.0))
        told = told.withColumns({f"turn_{c}": turn(c) for c in columns}).withColumns({f"done_{c}": ended(c) for c in columns})
        length = lambda c: F.col(f"nn_{c}") + 2 * F.col(f"turn_{c}") * F.col(f"nw_{c}") + F.col(f"turn_{c}") * F.col(f"turn_{c}") * F.col(f"ww_{c}")
        size = lambda c: F.when(F.col(f"done_{c}"), 0.0).otherwise(F.coalesce(F.col(f"new_{c}") / F.nullif(length(c), F.lit(0.0)), F.lit(0.0)))
        told = settled(told.select(*by, *(f"spread_{c}" for c in columns), *(F.col(f"new_{c}").alias(f"old_{c}") for c in columns), *(f"turn_{c}" for c in columns), *(size(c).alias(f"size_{c}") for c in columns), *(f"done_{c}" for c in columns)))
        open_ = F.lit(False)
        for c in columns:
            open_ = open_ | ~F.col(f"done_{c}")
        if told.where(open_).isEmpty():
            return step.select(*kept, *columns)
        state = told.select(*by, *(f"spread_{c}" for c in columns), *(f"old_{c}" for c in columns))
        steps = told.select(*by, *(f"turn_{c}" for c in columns), *(f"size_{c}" for c in columns))
        way = lambda c: F.col(f"next_{c}") + F.col(f"turn_{c}") * F.col(f"way_{c}")
        rows = step.join(steps if within else F.broadcast(steps), by).select(*kept, *((F.col(c) - F.col(f"size_{c}") * way(c)).alias(c) for c in columns), *(way(c).alias(f"way_{c}") for c in columns))
    raise RuntimeError(f"entity and period effects were not separated within {rounds} rounds")


def _size(used: DataFrame) -> tuple[int, int, int]:
    found = used.agg(F.count("*"), F.count_distinct("entity"), F.count_distinct("period")).first()
    return found[0], found[1], found[2]


def two_way(panel: DataFrame, y: str, x: list[str], weight: str | None = None, clustered: bool = False) -> Fit:
    """Two-way fixed effects: least squares after entity and period means are taken off, with degrees of freedom for these.

    With a ``weight``, means and sums of products are weighted alike; rows of a null or zero weight are left out.
    ``clustered``: errors that allow for any correlation among an entity's rows.
    """
    used = panel.dropna(subset=[y, *x])
    if weight:
        used = used.where(F.col(weight) > 0)
    n, entities, periods = _size(used)
    rows = demeaned(used, [y, *x], weight is None and n == entities * periods, weight=weight)
    return fit(rows, y, x, intercept=False, absorbed=max(0, entities + periods - 1), weight=weight, cluster="entity" if clustered else None)


def instrumented(panel: DataFrame, y: str, x: str, instrument: str) -> Fit:
    """The effect of ``x`` on ``y`` with two-way effects, where ``x`` moves with the error: ``instrument`` stands in for it.

    The ratio of the instrument's products with y and x, and its standard error.
    """
    used = panel.dropna(subset=[y, x, instrument])
    n, entities, periods = _size(used)
    rows = demeaned(used, list(dict.fromkeys([y, x, instrument])), n == entities * periods)
    pairs = {"zy": (instrument, y), "zx": (instrument, x), "zz": (instrument, instrument), "xx": (x, x), "xy": (x, y), "yy": (y, y)}
    s = rows.agg(*(F.sum(F.col(a) * F.col(b)).alias(k) for k, (a, b) in pairs.items())).first()
    if not n or not s["zx"]:
        return Fit({x: float("nan")}, {x: float("nan")}, n, float("nan"))
    b = s["zy"] / s["zx"]
    rest, free = s["yy"] - 2 * b * s["xy"] + b * b * s["xx"], n - 1 - max(0, entities + periods - 1)
    se = float(np.sqrt(max(0.0, rest) / free * s["zz"]) / abs(s["zx"])) if free > 0 else float("nan")
    return Fit({x: b}, {x: se}, n, float(1 - rest / s["yy"]) if s["yy"] else float("nan"))


@dataclass
class Mediation:
    """x moves the mediator by ``a``; the mediator moves y by ``b`` beside x's ``direct`` effect; ``total`` without it."""

    a: float
    b: float
    direct: float
    total: float

    @property
    def indirect(self) -> float:
        return self.a * self.b


def mediation(panel: DataFrame, y: str, x: str, mediator: str, controls: list[str] | None = None) -> Mediation:
    """The product of coefficients, each from a fit with two-way fixed effects over the same rows."""
    controls = controls or []
    used = panel.dropna(subset=[y, x, mediator, *controls])
    n, entities, periods = _size(used)
    rows = demeaned(used, [y, x, mediator, *controls], n == entities * periods)
    first = fit(rows, mediator, [x, *controls], intercept=False)
    second = fit(rows, y, [x, mediator, *controls], intercept=False)
    whole = fit(rows, y, [x, *controls], intercept=False)
    return Mediation(first.coefficients[x], second.coefficients[mediator], second.coefficients[x], whole.coefficients[x])


@dataclass
class Slopes:
    """One slope for all groups (``common``), and the test that the groups' own are equal: F, its degrees of freedom and p."""

    common: float
    f: float
    above: int
    below: int
    p: float
    groups: int
    n: int


def equal_slopes(df: DataFrame, y: Column, x: Column, by: Column) -> Slopes:
    """Whether groups differ in the slope of y on x: a Wald test within one stacked fit, in which each group has an intercept and a slope.

    The stacked fit falls apart into the groups' own moments, one aggregate, and
    one variance of the disturbances for all of them. Rows with a null group,
    x or y are left out, and groups in which x does not vary tell nothing of a
    slope. Sums over groups are an aggregate too, so there may be very many.
    """
    n, b, sxx, syy = F.regr_count(y, x), F.regr_slope(y, x), F.regr_sxx(y, x), F.regr_syy(y, x)
    moments = df.where(by.isNotNull()).groupBy(by.alias("of")).agg(n.alias("n"), b.alias("b"), sxx.alias("sxx"), syy.alias("syy")).where("sxx > 0")
    rest = F.greatest(F.col("syy") - F.col("b") * F.col("b") * F.col("sxx"), F.lit(0.0))
    s = moments.agg(F.count("*").alias("g"), F.sum("n").alias("n"), F.sum(rest).alias("rest"), F.sum("sxx").alias("sxx"), F.sum(F.col("b") * F.col("sxx")).alias("sb"), F.sum(F.col("b") * F.col("b") * F.col("sxx")).alias("sbb")).first()
    if not s["g"]:
        return Slopes(float("nan"), float("nan"), 0, 0, float("nan"), 0, 0)
    common, above, below = s["sb"] / s["sxx"], s["g"] - 1, s["n"] - 2 * s["g"]
    apart = max(0.0, s["sbb"] - common * s["sb"])
    f = apart / above / (s["rest"] / below) if above > 0 and below > 0 and s["rest"] > 0 else float("nan")
    return Slopes(common, f, above, below, f_upper(f, above, below), s["g"], s["n"])
