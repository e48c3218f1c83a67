"""Order MinHash: fingerprints and likeness against plain versions, and the edits."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash

from marlstone.llm import order_minhash as O

SCHEMA = "doc_id long, text string, next_id string, order_key string"
#: Characters of scripts without blanks, each a unit, and words of others.
ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
WORD = re.compile(rf"[{ALONE}]|[^\x20\x09-\x0D{ALONE}]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", None) for i, t in rows], SCHEMA).repartition(3)


def spark_hash(*values):
    """Spark's xxhash64: strings and numbers one after another, each seeded with the hash before."""
    h = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else (v % 2**64).to_bytes(8, "little") if abs(v) >= 2**31 else None
        h = xxhash.xxh64_intdigest(raw if raw is not None else (v % 2**32).to_bytes(4, "little"), seed=h)
    return h


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def plain_print(text):
    """Each function's two first k-mers on the ring, by trying all, in the text's order."""
    w = WORD.findall(text or "")
    if not w:
        return O.EMPTY * O.POINTS
    kmers = ["\0".join(w)] if len(w) < O.K else [tuple(w[i : i + O.K]) for i in range(len(w) - O.K + 1)]
    seen, m = Counter(), []
    for x in kmers:
        h = xxhash.xxh64_intdigest(x.encode(), seed=42) if isinstance(x, str) else spark_hash(*x)
        m.append(xxhash.xxh64_intdigest((seen[x] % 2**32).to_bytes(4, "little"), seed=xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed=42)))
        seen[x] += 1
    out = []
    for j in range(O.POINTS):
        start = j * 2**64 // O.POINTS
        ring = lambda i: ((((m[i] + 2**63) % 2**64 >> O.PLACE_BITS << O.PLACE_BITS) - start) % 2**64, i)  # noqa: B023, E731
        chosen = sorted(range(len(m)), key=ring)[:2]
        chosen = sorted(chosen if len(chosen) == 2 else chosen * 2)
        h = 42
        for i in chosen:
            h = xxhash.xxh64_intdigest(m[i].to_bytes(8, "little"), seed=h)
        out.append(f"{h % 16**O.HEX:0{O.HEX}x}")
    return "".join(out)


def plain_likeness(a, b):
    cut = lambda p: [p[i : i + O.HEX] for i in range(0, len(p), O.HEX)]
    return 1.0 if a == b else (sum(x == y for x, y in zip(cut(a), cut(b), strict=True)) / O.POINTS) ** 0.5


def plain(rows):
    """All result rows: documents by id, descending, null last, ties by the hash of their text as a signed number."""
    key = lambda r: (r[0] is None, -(r[0] or 0), signed(xxhash.xxh64_intdigest((r[1] or "").encode(), seed=42)))
    listed = sorted(rows, key=key)
    out = []
    for (i, t), (_, u) in zip(listed, listed[1:] + listed[:1], strict=True):
        t, u = t or "", u or ""
        h = len(t) // 2
        e = t[: len(t) - h] + u[:h]
        a, b, c = plain_print(t), plain_print(e), plain_print(u)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, f"{plain_likeness(a, b):.9f}", f"{plain_likeness(a, c):.9f}"))
    return sorted(out, key=str)


def found(spark, rows):
    got = O.edit_and_compare(docs(spark, rows)).collect()
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, f"{r.near_edited:.9f}", f"{r.near_next:.9f}") for r in got), key=str)


@pytest.mark.parametrize("bucket", [2_000, 7, 2])
def test_rows_are_those_of_a_plain_version(spark, monkeypatch, bucket):
    monkeypatch.setattr(O, "BUCKET_ROWS", bucket)
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdeé𝒳", k=rng.randint(1, 6)))
    rows = [(i * 7 % 1000, rng.choice([" ", "\n", "  "]).join(word() for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(2000, None), (-5, ""), (None, "null id"), (None, "a second null id"), (None, None), (7, "again"), (7, "again"), (7, "other text"), (3000, "x" * 50_000), (3001, "of the " * 3_000)]
    rows += [(500, "one hot text under one id")] * 25 + [(-(1 << 63), "the least id"), ((1 << 63) - 1, "the greatest")]
    assert found(spark, rows) == plain(rows)


def test_few_rows(spark):
    one = [(5, "one document only, which follows itself")]
    assert found(spark, one) == plain(one)
    assert found(spark, []) == []


def test_places_beyond_the_packed_ones(spark, monkeypatch):
    texts = ["a b c d e f g", "a b a b a b a b a b", "x", "one two"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = [plain_print(t) for t in texts]
    assert [r.p for r in df.select(O.fingerprint("text").alias("p")).collect()] == want
    monkeypatch.setattr(O, "_fits", lambda n: "false")
    assert [r.p for r in df.select(O.fingerprint("text").alias("p")).collect()] == want


def like(spark, a, b):
    df = spark.createDataFrame(list(zip(map(" ".join, a), map(" ".join, b), strict=True)), "a string, b string")
    df = df.select(O.fingerprint("a").alias("a"), O.fingerprint("b").alias("b"))
    return [r.x for r in df.select(O.likeness("a", "b").alias("x")).collect()]


@pytest.mark.parametrize("n", [30, 60, 400])
def test_moves_count_for_more_than_an_edit(spark, n):
    """Half swaps keep nearly all k-mers, and one changed word fewer; but the order is another."""
    rng = random.Random(n)
    texts = [[f"w{rng.randint(0, 10**6)}" for _ in range(n)] for _ in range(30)]
    swapped = like(spark, texts, [t[n // 2 :] + t[: n // 2] for t in texts])
    edited = like(spark, texts, [[*t[: n // 3], "changed", *t[n // 3 + 1 :]] for t in texts])
    assert sum(swapped) / 30 < sum(edited) / 30 - 0.05 and max(swapped) < 0.95
    assert max(like(spark, texts[:15], texts[15:])) < 0.3


def test_no_cliff_between_lengths(spark):
    rng = random.Random(1)
    texts = [[f"w{rng.randint(0, 10**6)}" for _ in range(14)] for _ in range(60)]
    mean = lambda n: sum(like(spark, [t[:n] for t in texts], [t[: n - 1] for t in texts])) / 60
    steps = [mean(n) for n in range(12, 6, -1)]
    assert all(x > 0.45 for x in steps), steps
    assert max(abs(x - y) for x, y in zip(steps, steps[1:])) < 0.15  # noqa: B905


def test_empty_texts(spark):
    got = spark.createDataFrame([("",), (None,), ("   ",), ("a",), ("ab",)], "text string").select("text", O.fingerprint("text").alias("p")).collect()
    assert got[0].p == got[1].p == got[2].p == O.EMPTY * O.POINTS and got[3].p != got[0].p and got[3].p != got[4].p


def test_scripts_without_blanks(spark):
    """One changed character of many costs about what one changed word does; unlike texts stay unlike; units are those of plain code."""
    rng = random.Random(8)
    for low, high in ((0x4E00, 0x9FFF), (0x0E01, 0x0E2E), (0x20000, 0x2A6D0)):
        texts = ["".join(chr(rng.randint(low, high)) for _ in range(400)) for _ in range(12)]
        edited = [t[:150] + "\u3042" + t[151:] for t in texts]
        assert sum(like(spark, [[t] for t in texts], [[t] for t in edited])) / 12 > 0.9
        assert max(like(spark, [[t] for t in texts[:6]], [[t] for t in texts[6:]])) < 0.3
    mixed = ["\u6f22\u5b57 and words\u3068\u304b", "\uff76\uff77\U0002a6d0x\u0e01\u0e31y", "\ud55c\uad6d\uc5b4 \ub744\uc5b4\uc4f0\uae30", "\u6f22"]
    got = spark.createDataFrame([(t,) for t in mixed], "text string").select(O.fingerprint("text").alias("p")).collect()
    assert [r.p for r in got] == [plain_print(t) for t in mixed]


def test_a_text_of_a_megabyte(spark):
    rng = random.Random(2)
    text = " ".join(f"{rng.randint(0, 10**14):015d}" for _ in range(70_000))
    assert len(text) > 10**6
    assert spark.createDataFrame([(text,)], "text string").select(O.fingerprint("text").alias("p")).first().p == plain_print(text)
