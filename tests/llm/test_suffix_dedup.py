"""Repeated passages against every window's count."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from marlstone.llm import anchors as A
from marlstone.llm import suffix_dedup as S

W = A.WINDOW


def plain(texts):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + W] for r in raws for i in range(len(r) - W + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - W + 1):
            if seen[r[i : i + W]] > 1:
                gone[i : i + W] = True
        out.append((len(r), int(gone.sum()), len(S._runs(gone)), bytes(b for b, g in zip(r, gone, strict=True) if not g)))
    return out


def texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefé𝒳", k=rng.randint(1, 8)))
    some = lambda n: " ".join(word() for _ in range(n))
    base, passage = some(300), some(60)
    made = [None, "", "short", "x" * 199, "y" * 200, "z" * 201, "z" * 5000, "period " * 300, "period " * 40, "abcde" * 90, base, base]
    for _ in range(30):  # near copies
        w = base.split(" ")
        for _ in range(rng.randint(1, 12)):
            w[rng.randrange(len(w))] = word()
        made.append(" ".join(w))
    for _ in range(30):  # a passage that many share, with and without its first and last bytes
        cut = passage[rng.choice([0, 0, 1, 3]) : len(passage) - rng.choice([0, 0, 2])]
        made.append(f"{some(rng.randint(0, 80))} {cut} {some(rng.randint(0, 80))}")
    made += [f"{some(30)} " + f"{word()} " * rng.randint(20, 120) + some(30) for _ in range(25)]  # runs of one word
    made += ["Of " * n + some(10) for n in (66, 67, 68, 70, 80, 100, 101, 102, 110, 150)] + [(some(3) + " ") * 12 for _ in range(6)] + ["q" * n for n in (201, 202, 299, 300, 301, 302, 303, 400, 401)]
    made += [passage.encode()[: W + k].decode("utf-8", "ignore") for k in (-1, 0, 1, 5)]
    made += [some(50) + passage + some(20) + passage, some(40) + "q" * 205 + some(5) + "q" * 200]
    return made


@pytest.mark.parametrize(("hot", "spread"), [(2000, 4), (3, 1), (0, 4), (2000, 300)])
def test_every_window_counts(spark, monkeypatch, hot, spread):
    """Also with so many buckets that anchors and kinds of zones lie in several."""
    monkeypatch.setattr(S, "HOT_ZONES", hot)
    monkeypatch.setattr(S, "SPREAD", spread)
    all_texts = texts()
    rows = [(i if i % 9 else None, t, "x", i) for i, t in enumerate(all_texts)] + [(500, all_texts[20], "x", 0), (500, all_texts[20], "x", 1), (500, all_texts[30], "x", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, zone string, place int").repartition(4)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.remove_repeats(df).collect()]
    want = [(r[0], *p) for r, p in zip(rows, plain([r[1] for r in rows]), strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_zones_do_not_depend_on_chunks(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(0, 4, 5000).astype(np.uint8)
    data[2000:3000] = 7
    whole = A.zones(data)
    monkeypatch.setattr(A, "CHUNK", 301)
    for a, b in zip(whole, A.zones(data), strict=True):
        assert (a == b).all()
    first, n, value, twice = whole
    assert twice.any() and not twice.all()
    h = A.hashes(data, A.GRAM)
    want = [h[i : i + A.REACH].min() for i in range(len(data) - W + 1)]
    assert (np.repeat(value, n) == want).all() and (np.repeat(first, n) <= np.arange(len(want))).all()


@pytest.mark.parametrize("hot", [2000, 0])
def test_texts_of_one_id_with_like_hashes_are_apart(spark, monkeypatch, hot):
    """Pairs under one id whose Spark hashes agree in their last 25 bits: one has a repeated passage, the other none."""
    monkeypatch.setattr(S, "HOT_ZONES", hot)
    made = lambda k: hashlib.sha512(str(k).encode()).hexdigest()
    passage = " ".join(made(("passage", k)) for k in range(3))
    low = lambda t: xxhash.xxh64_intdigest(t.encode(), seed=42) & ((1 << 25) - 1)
    of = {low(t): t for t in (f"{passage} {made(k)[:40]}" for k in range(20_000))}
    pairs = [(of[low(t)], t) for t in (made(("other", k)) + made(("rest", k)) for k in range(20_000)) if low(t) in of][:4]
    assert len(pairs) == 4
    rows = [(None, t) for pair in pairs for t in pair] + [(1, f"{made('x')} {passage} {made('y')}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert df.where("doc_id IS NULL").selectExpr("xxhash64(text) & 33554431 AS h").distinct().count() == 4
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.remove_repeats(df).collect()]
    want = [(r[0], *p) for r, p in zip(rows, plain([r[1] for r in rows]), strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_many_texts_of_one_id(spark):
    """Unique texts under null ids, beside as many duplicated ones: none of the first loses a byte."""
    made = lambda k: " ".join(hashlib.sha512(f"{k} {j}".encode()).hexdigest() for j in range(2))
    rows = [(None, made(("one", k))) for k in range(4000)] + [(None, made(("two", k))) for k in range(2000) for _ in range(2)]
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).groupBy("n_removed").count().collect()
    assert {r.n_removed: r["count"] for r in got} == {0: 4000, len(rows[0][1]): 4000}


def test_texts_over_several_chunks(spark):
    """Texts of several chunks, with one passage early in the one and late in the other, and a chunk's end within it."""
    rng = random.Random(5)
    made = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage = made(700)
    texts = [made(A.CHUNK - 300) + "1" + passage + "2" + made(A.CHUNK), made(2 * A.CHUNK + 99) + "3" + passage + "4" + made(50), made(900)]
    got = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in S.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: ((700, 1, t.replace(passage, "").encode()) if passage in t else (0, 0, t.encode())) for i, t in enumerate(texts)}


def test_very_many_equal_rows(spark):
    """A hundred thousand rows of one text and one id, among others, in linear time."""
    made = lambda k: " ".join(hashlib.sha512(f"{k} {j}".encode()).hexdigest() for j in range(5))
    equal, part = made("equal"), made("part")
    rows = spark.range(100_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", f"'{equal}' AS text")
    rows = rows.unionByName(spark.createDataFrame([(1, made("one")), (2, "x" + part[:300]), (2, "x" + part[:300]), (3, part[100:] + "y")], "doc_id long, text string"))
    got = S.remove_repeats(rows).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().collect()
    n = len(equal)
    assert {tuple(r) for r in got} == {(None, n, n, 1, 100_000), (1, n, 0, 0, 1), (2, 301, 301, 1, 2), (3, n - 99, 200, 1, 1)}


def test_a_text_of_megabytes(spark):
    rng = random.Random(7)
    long = "".join(rng.choices("abcdefgh ", k=3_000_000))
    rows = [(1, long), (2, "start" + long[1_000_000:2_500_000] + "end")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (3_000_000, 1_500_000, 1), 2: (1_500_008, 1_500_000, 1)}
