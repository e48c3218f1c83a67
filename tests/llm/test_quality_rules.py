"""Quality rules: statistics against a plain count, and outliers in made-up cells."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from marlstone.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, cell string, n bigint"


def plain(t):
    t = t or ""
    w = WORD.findall(t)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(x) for x in Q.SYMBOLS), len(lines) - len(set(lines)), len(covered), len(lines)


def test_statistics_are_those_of_a_plain_count(spark):
    rng = random.Random(5)
    bits = ["a", "b", "é", "𝒳𝒳", "#", "*$", "|", "<x>", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "\x85", " ", " ", "a b c", "\n\n"]
    texts = [None, "", " \n ", "a", "a b", "a b c", "a a a a", "x y z x y z", "word " * 30_000, "z" * 100_000, *("".join(rng.choices(bits, k=rng.randint(1, 80))) for _ in range(300))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = Q.statistics(df).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) == plain(r.text), repr(r.text)


def test_outliers_go_and_ordinary_texts_stay(spark):
    rng = random.Random(2)
    rows, junk = [], set()
    for i in range(900):
        words = ["".join(rng.choices("abcdefghijkl", k=rng.randint(2, 9))) for _ in range(rng.randint(60, 600))]
        if i % 10 == 3:  # a tenth of each cell: too many for a plain mean and variance
            junk.add(i)
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), rng.choice(["en", None]), rng.choice(["s1", None, "rare"] if i < 30 else ["s1", None]), "old", 1))
    rows += [(1000, None, "en", "s1", "", 0), (1001, "", None, None, None, None), (1002, "too short", "en", "s1", "", 0), (1003, "the same words " * 200, "en", "s1", "", 0), (1004, "x " * 49 + "y", "xx", "yy", "", 0)]
    rows += [(None, rows[0][1], "en", "s1", "", 0)] * 2
    got = Q.judge(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None or r.doc_id < 900:
            assert not r.base_failed and r.kept == (r.doc_id not in junk), r
        else:
            assert r.base_failed and not r.kept and r.d2 is None
    assert Q.judge(spark.createDataFrame([], SCHEMA)).collect() == []


def test_estimates_are_near_those_of_the_clean_rows(spark):
    rng = np.random.default_rng(4)
    clean, centre = rng.normal(size=(4000, Q.D)) * [2, 1, 3, 1, 1], np.array([5.0, 1, 2, 3, 4])
    bad = np.full((400, Q.D), 40.0) + rng.normal(size=(400, Q.D))
    rows = [("a", *map(float, x)) for x in np.vstack([clean + centre, bad])]
    est = Q.robust_estimates(spark.createDataFrame(rows, "cell string, " + ", ".join(f"{f} double" for f in Q.FEATURES))).first()
    got = np.array([est[f"c_{i}"] for i in range(Q.D)])
    assert np.abs(got - centre).max() < 0.25
    spread = np.array([est[f"l_{i}{i}"] for i in range(Q.D)]) / np.sqrt(est.scale)
    assert np.abs(spread / [2, 1, 3, 1, 1] - 1).max() < 0.25


def test_rare_sources_and_languages_are_measured_by_all_rows_of_the_level_above(spark):
    rng = random.Random(9)
    made = lambda: ["".join(rng.choices("abcdefghijkl", k=rng.randint(2, 9))) for _ in range(rng.randint(60, 600))]
    cells = [*[("en", "large", 0)] * 300, ("en", "lone", 1), ("en", "pair", 0), ("en", "pair", 1), ("en", "three", 0), ("en", "three", 0), ("en", "three", 1), ("xx", "lone", 1), (None, "pair", 0), (None, "pair", 1)]
    rows, junk = [], set()
    for i, (lang, source, bad) in enumerate(cells):
        words = made()
        if bad:
            junk.add(i)
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), lang, source, "", 0))
    got = Q.judge(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got if not r.kept} == junk
    assert {r.doc_id for r in Q.judge(spark.createDataFrame(rows[:301], SCHEMA)).collect() if not r.kept} == {300}


def plain_estimates(cells):
    """Each cell's centre, covariance and scale, by the same steps on whole arrays."""
    grid = lambda v, g: np.floor(v * g + 0.5) / g
    least = np.array(list(Q.LEAST_SPREAD.values()))
    distance = lambda x, c, v: np.einsum("ij,jk,ik->i", x - c, np.linalg.inv(v), x - c)

    def step(x, centre, spread):
        ring = np.floor(np.log(distance(x, centre, spread) + 1e-9) * Q.CUTS)
        last = np.sort(ring)[-(-min(len(x) + Q.D + 1, 2 * len(x)) // 2) - 1]
        near = x[ring <= last]
        scale = 1 / Q.CONSISTENCY[min(max(int(len(near) * 1000 / len(x) + 0.5) - 500, 0), 500)]
        centre = near.mean(0)
        spread = near.T @ near / len(near) - np.outer(centre, centre) + np.diag(least**2 * scale)
        return centre, spread, scale, np.linalg.slogdet(spread)[1] - Q.D * np.log(scale)

    now = {}
    for name, x in cells.items():
        x = cells[name] = grid(x, Q.GRID)
        middle = np.percentile(grid(x, Q.COARSE), 50, axis=0)
        width = np.sqrt((np.percentile(grid(np.abs(x - middle), Q.COARSE), 50, axis=0) * 1.4826) ** 2 + least**2)
        z = (x - middle) / width
        length = np.linalg.norm(z, axis=1, keepdims=True)
        for start, y in (("apart", None), ("tanh", np.tanh(z)), ("sign", np.divide(z, length, out=np.zeros_like(z), where=length > 0))):
            like = np.eye(Q.D)
            if y is not None:
                own = np.sqrt(np.diag(y.T @ y))
                like = np.where(np.eye(Q.D) > 0, 1, Q.SHRINK * np.divide(y.T @ y, np.outer(own, own), out=np.zeros((Q.D, Q.D)), where=np.outer(own, own) > 0))
            now[name, start] = step(x, middle, like * np.outer(width, width))
    fell = True
    while fell:
        after = {k: step(cells[k[0]], *v[:2]) for k, v in now.items()}
        better = {k: v for k, v in after.items() if v[3] < now[k][3] - 1e-9}  # a rule of its own
        now, fell = now | better, bool(better)
    best = {}
    for (name, _), v in sorted(now.items(), key=lambda kv: (kv[1][3], kv[0][1])):
        best.setdefault(name, v)
    return {k: (v[0], v[1], v[2], lambda x, v=v: distance(x, v[0], v[1])) for k, v in best.items()}


def test_verdicts_are_those_of_a_plain_version(spark):
    rng, rows = random.Random(12), []
    for i in range(900):
        words = ["".join(rng.choices("abcdefghijkl", k=rng.randint(2, 9))) for _ in range(int(rng.lognormvariate(5.3, 0.5)) + 50)]
        if rng.random() < 0.3:
            words = [w + "#" * (rng.random() < rng.choice([0.05, 0.1, 0.3])) for w in words]
        if rng.random() < 0.2:
            words += words[: rng.randint(1, len(words))] * rng.randint(1, 2)
        line = rng.choice([5, 12, 80])
        rows.append((i, "\n".join(" ".join(words[j : j + line]) for j in range(0, len(words), line)), "en", rng.choice(["s1", "s2", "s2", None]), "", 0))
    got = Q.judge(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    again = Q.judge(spark.createDataFrame(rows[::-1], SCHEMA).repartition(2)).collect()
    key = lambda r: (r.doc_id, r.kept, r.d2)
    assert sorted(map(key, got), key=str) == sorted(map(key, again), key=str)  # to the last bit
    of, vectors = {}, {}
    for r in got:
        if not r.base_failed:
            v = [np.log(r.n_words), np.log(r.word_chars / r.n_words), np.sqrt(r.n_symbols / r.word_chars), np.sqrt(r.n_dup_lines / (r.n_lines + 10)), np.sqrt(r.n_repeat_words / (r.n_words + 200))]
            of[r.doc_id] = np.array(v)
            vectors.setdefault(rows[r.doc_id][3], []).append(v)
    estimates = plain_estimates({k: np.array(v) for k, v in vectors.items()})
    for r in got:
        if not r.base_failed:
            _, _, scale, distance = estimates[rows[r.doc_id][3]]
            d2 = float(distance(of[r.doc_id][None])[0] * scale)
            assert r.d2 == pytest.approx(d2, rel=1e-6) and r.kept == (d2 <= Q.CHI2_CUT)
    assert 5 < sum(not r.kept for r in got if not r.base_failed) < 450


@pytest.mark.parametrize("share", [0.3, 0.4])
def test_junk_in_large_parts_of_a_cell_goes(spark, share):
    rng = random.Random(8)
    rows, junk = [], set()
    for i in range(400):
        words = ["".join(rng.choices("abcdefghijkl", k=rng.randint(2, 9))) for _ in range(rng.randint(60, 600))]
        if i < 400 * share:
            junk.add(i)
            marks = rng.choice("#*$%|")
            words = [w + marks * rng.randint(0, 3) for w in words]
        rows.append((i, " ".join(words), "en", "s1", "", 0))
    got = Q.judge(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {r.doc_id for r in got if not r.kept} == junk


def test_steps_without_end_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(Q, "MOST_STEPS", 1)
    rng = np.random.default_rng(6)
    rows = [("a", *map(float, x)) for x in rng.normal(size=(200, Q.D))]
    with pytest.raises(RuntimeError, match="still fall"):
        Q.robust_estimates(spark.createDataFrame(rows, "cell string, " + ", ".join(f"{f} double" for f in Q.FEATURES)))
