"""Quality rules: plain limits, and outliers by robust multivariate distance.

Statistics of each text are turned into vectors. For each language and source
a minimum-covariance-determinant estimate of their centre and spread is found:
from several starts, which outliers do not carry away, concentration steps are
made until no determinant falls any more, and the least is kept. In a step the
(n + p + 1) / 2 of n rows, by p statistics, that are nearest to the present
estimate give the next one, so nearly half the rows of a cell can be junk.
Texts far from the estimate, by Mahalanobis distance, are rejected. All of it
is built-in functions and aggregates, whose sums are exact: the result is the
same however rows are partitioned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.llm.native import let, words
from marlstone.sources import materialize

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
LEAST_WORDS, MOST_REPEATED = 50, 50
WINDOW = 3

#: Vectors, each on a scale on which ordinary texts spread about evenly. Shares of lines and
#: of words are drawn towards 0 in short texts, where one repeated line makes a large share.
FEATURES = {
    "log_words": "ln(n_words)",
    "log_word_chars": "ln(word_chars / n_words)",
    "symbol_share": "sqrt(n_symbols / word_chars)",
    "dup_line_share": "sqrt(n_dup_lines / (n_lines + 10))",
    "repeat_share": "sqrt(n_repeat_words / (n_words + 200))",
}
D = len(FEATURES)
#: Added to each variance: differences below these are not held against a text, and
#: a statistic that is the same in every text of a cell does not make the spread singular.
LEAST_SPREAD = {"log_words": 0.25, "log_word_chars": 0.08, "symbol_share": 0.05, "dup_line_share": 0.1, "repeat_share": 0.1}
#: Concentration steps go on until no determinant falls, by more than rounding can let its logarithm fall. As each takes
#: another half of the rows, with a lesser determinant, that comes by itself; so many steps without it are an error.
ROUNDING, MOST_STEPS = 1e-9, 500
#: Starts, all from medians: statistics taken as independent, and correlated as their hyperbolic tangents or directions are.
STARTS = ("apart", "tanh", "sign")
#: Correlations of a start are drawn towards 0 by this.
SHRINK = 0.95
#: Values are rounded to this grid before they are summed, and for medians to a coarser one, which bounds how many differ.
GRID, COARSE = 1 << 16, 1 << 8
#: Distances are told apart to this part of their logarithm where the nearest rows are cut off.
CUTS = 32
#: Cells (language and source) with fewer rows use the estimate from all rows of their language, and rare languages that from all rows.
CELL_ROWS = 100
#: Upper 1e-6 quantile of chi-squared with 5 degrees of freedom: beyond any ordinary text.
CHI2_CUT = 35.89
#: Shares of a cell's rows that can give an estimate: from half, by thousandths.
SHARES = [k / 1000 for k in range(500, 1001)]


def _consistency(share: float) -> float:
    """By what the covariance of the nearest ``share`` of normal rows is to be multiplied to be that of all."""
    if share >= 1:
        return 1.0
    five = lambda x: math.erf(math.sqrt(x / 2)) - math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)
    low, high = 0.0, 100.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if five(mid) < share else (low, mid)
    seven = five(low) - math.sqrt(2 * low / math.pi) * math.exp(-low / 2) * low * low / 15
    return share / seven


CONSISTENCY = [_consistency(share) for share in SHARES]


def _symbol_count(text: str, symbols: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, symbols, ""))).cast("long")


def repeated_words(w: str) -> str:
    """SQL for how many words of the array ``w`` stand in a window of WINDOW words that occurs twice or more."""
    last = (1 << 24) - 1
    n = f"size({w}) - {WINDOW - 1}"
    gram = "xxhash64(" + ", ".join(f"get({w}, i + {j})" for j in range(WINDOW)) + ")"
    grams = f"sort_array(transform(sequence(0, {n} - 1), i -> named_struct('h', {gram}, 'i', i)))"
    packed = f"sort_array(transform(sequence(0, {n} - 1), i -> (({gram}) & {~last}L) | i))"
    covered = lambda places: f"aggregate({places}, named_struct('upto', -{WINDOW}, 'n', 0), (a, p) -> named_struct('upto', p, 'n', a.n + least({WINDOW}, p - a.upto))).n"
    # 40 bits of a hash find the windows that may repeat, and whole hashes settle which of these do
    same = lambda i, bits: f"coalesce(shiftright(get(s, {i}), {bits}) = shiftright(v, {bits}), false)"
    near = f"(i > 0 AND {same('i - 1', 24)}) OR {same('i + 1', 24)}"
    maybe = f"transform(filter(s, (v, i) -> {near}), v -> CAST(v & {last}L AS INT))"
    whole = f"sort_array(transform(m, i -> named_struct('h', {gram}, 'i', i)))"
    equal = "filter(g, (x, k) -> (k > 0 AND get(g, k - 1).h = x.h) OR coalesce(get(g, k + 1).h = x.h, false))"
    exact = let("g", whole, covered(f"sort_array(transform({equal}, x -> x.i))"))
    short = let("s", packed, let("m", maybe, f"if(size(m) = 0, 0, {exact})"))
    long = let("g", grams, covered(f"sort_array(transform({equal}, x -> x.i))"))
    return f"CASE WHEN {n} < 2 THEN 0 WHEN {n} > {last} THEN {long} ELSE {short} END"


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (with a word); all 0 for a null text."""
    body = "quality_body"
    rows = df.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    lines = rf"filter(split({body}, '\n'), line -> btrim(line, '{SPACES.encode('unicode_escape').decode()}') <> '')"
    lines = lines.replace("\\x0b", "\\u000b").replace("\\x0c", "\\u000c")
    counted = let("w", words(body), f"named_struct('n', size(w), 'r', {repeated_words('w')})")
    by_line = let("l", lines, "named_struct('n', size(l), 'd', size(l) - size(array_distinct(l)))")
    found = rows.withColumns(
        {
            "quality_words": F.expr(counted),
            "quality_lines": F.expr(by_line),
            "word_chars": F.length(F.translate(body, SPACES, "")).cast("long"),
            "n_symbols": _symbol_count(body, SYMBOLS),
        }
    )
    return found.withColumns(
        {
            "n_words": F.col("quality_words.n").cast("long"),
            "n_repeat_words": F.col("quality_words.r").cast("long"),
            "n_lines": F.col("quality_lines.n").cast("long"),
            "n_dup_lines": F.col("quality_lines.d").cast("long"),
        }
    ).drop(body, "quality_words", "quality_lines")


def _distance(x: list[Column], centre: list[Column], spread: dict[tuple[int, int], Column]) -> Column:
    """Squared Mahalanobis distance, given the Cholesky factor of the covariance."""
    z: list[Column] = []
    for i in range(D):
        rest = x[i] - centre[i]
        for j in range(i):
            rest = rest - spread[i, j] * z[j]
        z.append(rest / spread[i, i])
    return sum((v * v for v in z[1:]), z[0] * z[0])


def _with_factor(df: DataFrame, spread: dict[tuple[int, int], Column], floors: list[Column]) -> DataFrame:
    """Adds the Cholesky factor l_ij of a covariance, and ``log_det``, that of its determinant."""
    for i in range(D):
        for j in range(i + 1):
            value = spread[i, j]
            for k in range(j):
                value = value - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}")
            # rounding can take a variance of 0 below it; the floor stays
            value = F.sqrt(F.greatest(value, floors[i] / 2)) if i == j else value / F.col(f"l_{j}{j}")
            df = df.withColumn(f"l_{i}{j}", value)
    return df.withColumn("log_det", sum((2 * F.ln(f"l_{i}{i}") for i in range(1, D)), 2 * F.ln("l_00")))


_PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
_ESTIMATE = [*(f"c_{i}" for i in range(D)), *(f"l_{i}{j}" for i, j in _PAIRS)]


def _exact(value: Column) -> Column:
    """A sum of values on a grid of 1 / GRID^2, the same in any order."""
    return (F.sum(F.round(value * GRID**2).cast("decimal(20,0)")) / GRID**2).cast("double")


def _factored(moments: DataFrame) -> DataFrame:
    """From a cell's n, n_all, sums s_i and sums of products p_ij: its centre c_i, the Cholesky factor l_ij of its covariance, and scale.

    The n nearest of n_all rows spread less than all do; distances are multiplied by ``scale``
    for that. LEAST_SPREAD is divided beforehand by what it will be multiplied with.
    """
    n, out = F.col("n").cast("double"), moments
    place = F.least(F.greatest(F.round(F.col("n") * 1000 / F.col("n_all")).cast("int") - 500, F.lit(0)), F.lit(500))
    out = out.withColumn("scale", 1 / F.get(F.lit(CONSISTENCY), place))
    floors = [F.lit(LEAST_SPREAD[f] ** 2) * F.col("scale") for f in FEATURES]
    out = out.withColumns({f"c_{i}": F.col(f"s_{i}") / n for i in range(D)})
    spread = {(i, j): F.col(f"p_{i}{j}") / n - F.col(f"c_{i}") * F.col(f"c_{j}") + (floors[i] if i == j else F.lit(0.0)) for i, j in _PAIRS}
    out = _with_factor(out, spread, floors).withColumn("log_det", F.col("log_det") - D * F.ln("scale"))
    return out.select("cell", "start", "scale", "log_det", *_ESTIMATE)


def _measured(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """``rows`` with ``d2``, by the estimates of their cell."""
    d2 = _distance([F.col(f) for f in FEATURES], [F.col(f"c_{i}") for i in range(D)], {(i, j): F.col(f"l_{i}{j}") for i, j in _PAIRS})
    return rows.join(estimate, "cell").withColumn("d2", d2)


def _kept(cells: DataFrame, name: str) -> DataFrame:
    """A table of a few rows for each cell, written as one file: Spark then sees its true size, and
    need not deal all rows out by cell, where the largest would land in one task, to join with it."""
    return materialize(cells.repartition(1), name)


def _starts(vectors: DataFrame) -> DataFrame:
    """The estimates to start from: medians, with the spread of median deviations and each of STARTS' correlations."""
    names = list(FEATURES)
    median = lambda value: F.percentile(F.round(value * COARSE) / COARSE, 0.5)
    middle = _kept(vectors.groupBy("cell").agg(*(median(F.col(f)).alias(f"c_{i}") for i, f in enumerate(names))), "mcd-middle")
    away = vectors.join(middle, "cell").groupBy("cell").agg(*(median(F.abs(F.col(f) - F.col(f"c_{i}"))).alias(f"a_{i}") for i, f in enumerate(names)))
    width = {f"w_{i}": F.sqrt(F.pow(F.col(f"a_{i}") * 1.4826, 2) + LEAST_SPREAD[f] ** 2) for i, f in enumerate(names)}
    middle = _kept(middle.join(away, "cell").withColumns(width).drop(*(f"a_{i}" for i in range(D))), "mcd-widths")
    z = [(F.col(f) - F.col(f"c_{i}")) / F.col(f"w_{i}") for i, f in enumerate(names)]
    length = F.sqrt(sum((v * v for v in z[1:]), z[0] * z[0]))
    made = {"tanh": [F.tanh(v) for v in z], "sign": [F.when(length > 0, v / length).otherwise(F.lit(0.0)) for v in z]}
    sums = [_exact(y[i] * y[j]).alias(f"{k}_{i}{j}") for k, y in made.items() for i, j in _PAIRS]
    found = middle.join(vectors.join(middle, "cell").groupBy("cell").agg(*sums), "cell")
    out = []
    for start in STARTS:
        spread = {}
        for i, j in _PAIRS:
            own = F.sqrt(F.col(f"{start}_{i}{i}") * F.col(f"{start}_{j}{j}")) if start in made else None
            like = F.lit(1.0) if i == j else F.lit(0.0) if own is None else SHRINK * F.coalesce(F.try_divide(F.col(f"{start}_{i}{j}"), own), F.lit(0.0))
            spread[i, j] = like * F.col(f"w_{i}") * F.col(f"w_{j}")
        floors = [F.lit(LEAST_SPREAD[f] ** 2) for f in names]
        out.append(_with_factor(found, spread, floors).select("cell", F.lit(start).alias("start"), F.lit(1.0).alias("scale"), "log_det", *_ESTIMATE))
    return _kept(out[0].unionByName(out[1]).unionByName(out[2]), "mcd-start")


def _concentrated(vectors: DataFrame, estimate: DataFrame, step: int) -> DataFrame:
    """The estimates from the rows that are nearest to ``estimate``: half of a cell's, and as many more as are told apart from these by nothing."""
    names = list(FEATURES)
    measured = _measured(vectors, estimate).withColumn("ring", F.floor(F.ln(F.col("d2") + 1e-9) * CUTS).cast("int"))
    of_cell = Window.partitionBy("cell", "start")
    rings = measured.groupBy("cell", "start", "ring").agg(F.count("*").alias("n"))
    rings = rings.withColumns({"upto": F.sum("n").over(of_cell.orderBy("ring")), "n_all": F.sum("n").over(of_cell)})
    within = rings.where(2 * F.col("upto") >= F.least(F.col("n_all") + D + 1, 2 * F.col("n_all"))).groupBy("cell", "start", "n_all").agg(F.min("ring").alias("last_ring"))
    near = measured.join(_kept(within, f"mcd-within-{step}"), ["cell", "start"]).where("ring <= last_ring")
    sums = {f"s_{i}": _exact(F.col(f)) for i, f in enumerate(names)} | {f"p_{i}{j}": _exact(F.col(names[i]) * F.col(names[j])) for i, j in _PAIRS}
    moments = near.groupBy("cell", "start", "n_all").agg(F.count("*").alias("n"), *(v.alias(k) for k, v in sums.items()))
    return _factored(moments)


def robust_estimates(vectors: DataFrame) -> DataFrame:
    """Centre and spread of each cell with the least determinant, and a factor ``scale`` for squared distances.

    ``vectors`` has cell and the FEATURES; it is read twice a step, so it should
    be a written table. Each step is an aggregate for the distance that
    (n + D + 1) / 2 of n rows keep within, and one for the moments of those
    rows, both with partial sums, so that a cell of any size is no burden to
    one task. Estimates are three rows for each cell; the driver asks only
    whether any is left whose determinant fell.
    """
    vectors = vectors.select("cell", *((F.round(F.col(f) * GRID) / GRID).alias(f) for f in FEATURES))
    estimate = _kept(_concentrated(vectors, _starts(vectors), 0), "mcd-first").withColumn("fell", F.lit(True))
    for step in range(1, MOST_STEPS):
        if estimate.where("fell").isEmpty():
            break
        # where the determinant does not fall, the estimate before stays
        after = _concentrated(vectors, estimate.drop("fell"), step)
        both = estimate.alias("a").join(after.alias("b"), ["cell", "start"])
        fell = F.col("b.log_det") < F.col("a.log_det") - ROUNDING
        chosen = [F.when(fell, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in ("scale", "log_det", *_ESTIMATE)]
        estimate = _kept(both.select("cell", "start", *chosen, fell.alias("fell")), f"mcd-chosen-{step}")
    else:
        raise RuntimeError(f"determinants still fall after {MOST_STEPS} concentration steps")
    best = F.min(F.struct("log_det", "start", "scale", *_ESTIMATE)).alias("best")
    return _kept(estimate.groupBy("cell").agg(best).select("cell", "best.scale", *(f"best.{c}" for c in _ESTIMATE)), "mcd-best")


def judge(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (doc_id unless given), the statistics, base_failed, ``d2`` and kept of every row.

    base_failed: fewer than LEAST_WORDS words, or more than MOST_REPEATED
    percent of them in repeated windows. The others are measured in their cell;
    kept is false for base_failed and for a scaled squared distance beyond
    CHI2_CUT. ``d2`` is null for base_failed. Null languages or sources are
    cells of their own. A cell with fewer than CELL_ROWS rows to estimate from
    uses its language's estimate, which is from all rows of the language, and a
    language with fewer uses that from all rows of all languages.
    """
    keep = keep or ["doc_id"]
    base = (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")) | (F.col("n_words") < LEAST_WORDS)
    plain = df.select(*(F.col(k).alias(f"keep_{k}") for k in keep), F.col(lang).alias("cell_lang"), F.col(source).alias("cell_source"), F.col(text).alias("cell_text"))
    counted = statistics(plain, "cell_text").drop("cell_text").withColumn("base_failed", base)
    counted = materialize(counted, "quality-statistics")
    ok = counted.where(~F.col("base_failed"))
    cells = ok.groupBy("cell_lang", "cell_source").agg(F.count("*").alias("n"))
    langs = cells.groupBy(F.col("cell_lang").alias("of_lang")).agg(F.sum("n").alias("n_lang"), F.min("n").alias("n_least"))
    rare = langs.agg(F.min("n_lang").alias("n_least_lang"))
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    by_source, by_lang, by_all = F.to_json(F.array(part("cell_lang"), part("cell_source"))), F.to_json(F.array(part("cell_lang"))), F.lit("[]")
    large, large_lang = F.col("n") >= CELL_ROWS, F.col("n_lang") >= CELL_ROWS
    name = F.when(large, by_source).when(large_lang, by_lang).otherwise(by_all)
    # the estimates that a row counts in: its own cell's, and those of language and all if any cell uses them
    levels = F.array_compact(F.array(F.when(large, by_source), F.when(large_lang & (F.col("n_least") < CELL_ROWS), by_lang), F.when(F.col("n_least_lang") < CELL_ROWS, by_all)))
    named = cells.join(langs, F.col("cell_lang").eqNullSafe(F.col("of_lang"))).crossJoin(rare)
    named = named.select("of_lang", F.col("cell_source").alias("of_source"), name.alias("cell"), levels.alias("levels"))
    named = _kept(named, "quality-cells")
    own = F.col("cell_lang").eqNullSafe(F.col("of_lang")) & F.col("cell_source").eqNullSafe(F.col("of_source"))
    values = [F.expr(sql).alias(f) for f, sql in FEATURES.items()]
    vectors = materialize(ok.join(named, own).select(*(f"keep_{k}" for k in keep), "cell", "levels", *_STATS, *values), "quality-vectors")
    members = vectors.select(F.explode("levels").alias("cell"), *FEATURES)
    measured = _measured(vectors, robust_estimates(members)).withColumn("d2", F.col("d2") * F.col("scale"))
    final = [F.col(f"keep_{k}").alias(k) for k in keep]
    judged = measured.select(*final, *_STATS, F.lit(False).alias("base_failed"), "d2", (F.col("d2") <= CHI2_CUT).alias("kept"))
    failed = counted.where("base_failed").select(*final, *_STATS, "base_failed", F.lit(None).cast("double").alias("d2"), F.lit(False).alias("kept"))
    return judged.unionByName(failed)


_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
