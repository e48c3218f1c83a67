"""The Jaccard join against every pair."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import ngram_join as N
from marlstone.llm.components import components


def plain(texts):
    """Each text's links and the least index of its class, by comparing all pairs."""
    words = [(t or "").encode().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()) for w in words]
    n, near = len(sets), [[] for _ in sets]
    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                near[i].append(j)
                near[j].append(i)
    root = list(range(n))
    for i in range(n):  # depth first
        if root[i] == i:
            ahead, seen = [i], {i}
            while ahead:
                for j in near[ahead.pop()]:
                    if j not in seen:
                        seen.add(j)
                        ahead.append(j)
            for j in seen:
                root[j] = min(root[j], i)
    return [len(x) for x in near], root


def texts():
    rng = random.Random(6)
    some = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    made = [None, "", " \n", "one", "one", "two words", "two  words", "a b c d", "a b c d e", " ".join(some(30_000))]
    made.append(made[-1] + " end")
    passage = some(60)
    for _ in range(40):
        made.append(" ".join(some(rng.randint(20, 200)) + passage + some(rng.randint(20, 200))))
    for size, group in ((100, 30), (300, 120), (60, 25)):
        base = some(size)
        for _ in range(group):
            w = list(base)
            for _ in range(rng.randint(0, max(2, size // 25))):
                w[rng.randrange(size)] = f"x{rng.randint(0, 9)}"
            made.append(" ".join(w))
    chain = some(100)  # links that reach further than the threshold
    for _ in range(12):
        chain = chain[3:] + some(3)
        made.append("\n".join(chain))
    return made + [made[60]] * 5


@pytest.mark.parametrize("block", [1024, 20])
def test_every_pair(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK_TEXTS", block)
    rows = [(i, t, "x", "y", 1) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, key string, row_key int").repartition(5)
    got = {r.doc_id: r for r in N.near_duplicates(df).collect()}
    n_links, root = plain([r[1] for r in rows])
    assert len(got) == len(rows)
    assert [got[i].n_links for i in range(len(rows))] == n_links
    assert [got[i].class_id for i in range(len(rows))] == root
    assert [got[i].first for i in range(len(rows))] == [root[i] == i for i in range(len(rows))]
    kept = N.keep_first(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(root))


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "another text with the same id"), (None, "a b c d e f g"), (None, "only null ids here today"), (None, "only null ids here today"), (None, ""), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.copies, r.n_links) for r in N.near_duplicates(df).collect()), key=str)
    want = [(1, 1, 3, 2)] * 2 + [(1, 1, 1, 0), (2, 2, 1, 0), (None, 1, 3, 2), (None, None, 1, 0), (None, None, 2, 1), (None, None, 2, 1)]
    assert got == sorted(want, key=str)
    kept = sorted(((r.doc_id, r.text) for r in N.keep_first(df).collect()), key=str)
    assert kept == sorted([(None, "a b c d e f g"), (1, "another text with the same id"), (None, "only null ids here today"), (None, ""), (2, None)], key=str)
    assert N.near_duplicates(df.limit(0)).collect() == [] and N.keep_first(df.limit(0)).collect() == []


def test_prefixes_are_shortened_until_pairs_at_the_threshold_are_found(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(50, 400))),) for _ in range(300)] + [(None,), ("one",)], "text string").repartition(3)
    depth = N.prefix_depth(df)
    assert 1 < depth < N.prefix_depth(df, 0.95) <= N.DEPTH and N.prefix_depth(df, recall=0.9) > depth
    assert 1 < N.prefix_depth(df.limit(0)) <= depth + 1
    short = spark.createDataFrame([(" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 12))),) for _ in range(300)], "text string")
    assert N.prefix_depth(short) <= depth and N.prefix_depth(df.select("text").unionByName(short)) <= depth
    rng, missed = np.random.default_rng(3), 0
    for _ in range(2000):
        both, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (160, 20, 20))  # 160 of 200
        one, two = (N.packed(N.labels(N.minhashes(np.concatenate([both, x]))), depth)[0] for x in (a, b))
        missed += not (one == two).any()
    assert missed <= 1


def test_the_prefix_is_measured_on_every_set(spark):
    rng = random.Random(14)
    made = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(94)) for _ in range(4000)]  # 90 windows, so that copies are at the threshold itself
    df = spark.createDataFrame([(t,) for t in [*made, *made[:500], None, "one"]], "text string").repartition(3)
    reach = [N.tried(N.shingles(t.encode()), N.THRESHOLD)[1] for t in made]
    share = [sum(r >= depth for r in reach) / len(made) for depth in range(1, N.DEPTH + 1)]
    for depth in (12, 13, 14, 15, 16):
        for recall in (share[depth - 1], share[depth - 1] + 1e-6):  # what all sets reach, and more than that
            longest = max(d for d in range(1, depth + 1) if share[d - 1] >= recall)
            law = max(d for d in range(1, N.DEPTH + 1) if 1 - (1 - 0.8**d) ** N.TREES >= recall)
            assert N.prefix_depth(df, recall=recall) == min(law, longest)


def test_shorter_prefixes_are_those_of_packed_labels(spark):
    label = np.random.default_rng(15).integers(0, 256, (40, N.DEPTH), dtype=np.uint8)
    df = spark.createDataFrame(zip(*(x.tolist() for x in N.packed(label, 16)), strict=True), "high long, low long").coalesce(1)
    for depth in range(1, 17):
        got = df.select(N._cut(F.col("high"), depth), N._cut(F.col("low"), depth - 8)).collect()
        high, low = N.packed(label, depth)
        assert [r[0] for r in got] == high.tolist() and [r[1] for r in got] == (low.tolist() if depth > 8 else [0] * 40)


def test_labels_sort_as_their_values():
    rng = np.random.default_rng(1)
    label = rng.integers(0, 256, (500, 16)).astype(np.uint8)
    for depth in (3, 8, 11, 16):
        high, low = N.packed(label, depth)
        assert [tuple(x) for x in label[np.lexsort((low, high))][:, :depth]] == sorted(tuple(x) for x in label[:, :depth])


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_prefixes_hold_together_across_partitions(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.randint(0, 2), rng.choice([5, 5, 5, rng.randint(-99, 99)]), rng.randint(0, 1), rng.randint(0, 300)) for _ in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = N.chains(spark.createDataFrame(rows, "tree int, high long, low long, node long")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

    def classes(pairs):
        parent = {}
        find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
        for a, b in pairs:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        return {x: find(x) for x in range(301)}

    first = {}
    want = [(first.setdefault(r[:3], r[3]), r[3]) for r in rows]
    assert classes(want) == classes([(r.a, r.b) for r in got])


def test_sets_that_can_be_alike_meet_in_blocks(spark, monkeypatch):
    """Every pair of sizes within the threshold is of ranks that are compared, and each block is as small as it should be."""
    monkeypatch.setattr(N, "BLOCK_TEXTS", 10)
    rng = random.Random(3)
    rows = [(c, i, rng.choice([1, 4, 5, 16, 20, 25, rng.randint(1, 4000)])) for c, n in ((1, 300), (2, 10), (3, 11)) for i in range(n)]
    df = spark.createDataFrame(rows, "comp long, node long, size long").withColumn("rank", N._size_rank(0.8))
    got = df.join(N._blocks(df, 0.8), ["comp", "rank"]).collect()
    assert len(got) == len(rows) and {(r.blocks, r.begin, r.low, r.high) for r in got if r.comp == 2} == {(1, 0, 0, 1)}
    for r in got:
        assert r.low <= r.begin < r.begin + r.blocks <= r.high or r.comp == 2
        for o in got:
            if o.comp == r.comp and min(r["size"], o["size"]) >= 0.8 * max(r["size"], o["size"]):
                assert r.low <= o.begin and o.begin + o.blocks <= r.high
    large = {(r.begin, r.blocks): sum(o.begin == r.begin for o in got if o.comp == 1) for r in got if r.comp == 1}
    assert all(n <= 10 * blocks for (_, blocks), n in large.items())
    assert sum(r.high - r.low for r in got if r.comp == 1) < 300 * max(r.high for r in got if r.comp == 1) / 2


def test_overlaps_are_exact():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 300, n, dtype=np.uint64)) for n in (1, 5, 80, 200, 200, 0)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    got = N.overlaps(sets)
    assert (got[~np.eye(6, dtype=bool)] == want[~np.eye(6, dtype=bool)]).all()
    assert (N.overlaps(sets[:2], sets[2:]) == want[:2, 2:]).all()


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randint(3000, 3400), rng.randint(3000, 3400)) for _ in range(150)] + [(7, 7), (5000, 5001), (5001, 5000), (-4, -9)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


@pytest.mark.parametrize("block", [1024, 8])
def test_repeated_rows_beside_near_copies(spark, monkeypatch, block):
    """Whole rows, null ids among them, many times over, each beside texts that are near it."""
    monkeypatch.setattr(N, "BLOCK_TEXTS", block)
    rng, rows = random.Random(8), []
    for group in range(12):
        words = [f"g{group}w{i}" for i in range(60)]
        for k in range(rng.randint(1, 12)):
            text = " ".join(words[: 60 - k])
            rows += [(rng.choice([None, group * 20 + k]), text)] * rng.choice([1, 1, 2, 30])
    n_links, root = plain([t for _, t in rows])
    classes = {}
    for (i, _), r in zip(rows, root, strict=True):
        classes[r] = min((x for x in (classes.get(r), i) if x is not None), default=None)
    want = sorted(((i, t, classes[r], n) for (i, t), r, n in zip(rows, root, n_links, strict=True)), key=str)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hashed = {r.h: r.text for r in df.selectExpr("xxhash64(text) AS h", "text").collect()}
    got = sorted(((r.doc_id, hashed[r.text_hash], r.class_id, r.n_links) for r in N.near_duplicates(df).collect()), key=str)
    assert got == want
    kept = N.keep_first(df).collect()
    assert len(kept) == len(set(root)) and {r.text for r in kept} <= set(hashed.values())


@pytest.mark.parametrize("mixed", [False, True])
def test_short_texts_at_the_threshold_are_found(spark, mixed):
    """Pairs of 4 to 20 shingles at a similarity of 0.8 exactly, alone and beside long texts."""
    rng = random.Random(4)
    some = lambda n: [f"w{rng.randint(0, 10**7)}" for _ in range(n)]
    rows = []
    for pair in range(1500):
        shingles = rng.choice([5, 10, 15, 20])  # the one set has these, the other four fifths of them
        words = some(shingles + 4)
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(words[: len(words) - shingles // 5]))]
    long = [(10_000 + i, " ".join(some(rng.randint(300, 600)))) for i in range(600 if mixed else 0)]
    got = {r.doc_id: r.n_links for r in N.near_duplicates(spark.createDataFrame(rows + long, "doc_id long, text string").repartition(4)).collect()}
    assert sum(got[2 * pair] for pair in range(1500)) >= 0.999 * 1500 and sum(got[i] for i, _ in long) == 0


def test_a_text_of_megabytes(spark):
    rng = random.Random(5)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(400_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-20_000])), (3, " ".join(words[:300_000]))]
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]
