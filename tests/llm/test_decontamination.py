"""Benchmark decontamination against loops over all windows."""

from __future__ import annotations

import random
import re

import pytest

from marlstone.llm import decontamination

WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ANY_CASE = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def cut(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items, window=10):
    words, hit, found = cut(text), set(), set()
    for item, body in items:
        w = cut(body)
        size = min(window, len(w))
        grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        at = [i for i in range(len(words) - size + 1) if tuple(words[i : i + size]) in grams]
        hit |= {i + k for i in at for k in range(size)}
        if at and item is not None:
            found.add(str(item))
    return len(words), hit, sorted(found)


def without(text, hit):
    """The text without its hit words and what stands between neighbouring ones."""
    spans = [m.span() for m in ANY_CASE.finditer(text)]
    out, upto = "", 0
    for i in sorted(hit):
        a, z = spans[i]
        out += "" if i - 1 in hit else text[upto:a]
        upto = z
    return out + text[upto:]


def made(seed=5):
    rng = random.Random(seed)
    vocabulary = ["the", "Of", "naïve", "Über", "ÉTÉ", "日本語", "x1", "42", "and", "sea"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", "\x00 "]) for _ in range(n))
    items = [(i, text(rng.choice([12, 15, 30]))) for i in range(12)] + [(12, "Only Three words"), (12, text(14)), (None, text(11)), (13, None), (14, " .,- "), (15, "ß")]
    docs = [(i, text(rng.randrange(60))) for i in range(60)]
    for i in range(60, 110):
        body = rng.choice(items[:12])[1]
        docs.append((i, text(rng.randrange(20)) + body.upper().replace("Ï", "ï") + ". " + text(5) + rng.choice(items[:12])[1][: rng.randrange(60)]))
    docs += [(200, None), (201, ""), (202, "...only THREE/words!"), (203, "only three"), (60, docs[60][1]), (None, items[3][1]), (None, items[3][1]), (204, "ß")]
    return docs, items


@pytest.mark.parametrize("block", [decontamination.BLOCK_HASHES, 40])
def test_scan_and_remove(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_HASHES", block)  # one block, or several
    if block == 40:
        monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    docs, items = made()
    frame = spark.createDataFrame(docs, "doc_id int, text string").repartition(5)
    scanned = decontamination.scan(frame, spark.createDataFrame(items, "item_id int, text string"))
    want = sorted((str(i), *(lambda n, h, f: (n, len(h), f, bool(h)))(*plain(t, items))) for i, t in docs)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in scanned.collect()) == want
    cleaned = sorted((str(r.doc_id), str(r.text)) for r in decontamination.remove(scanned).collect())
    assert cleaned == sorted((str(i), "None" if t is None else without(t, plain(t, items)[1])) for i, t in docs)
    kept = decontamination.remove(scanned, whole=True)
    assert kept.columns == ["doc_id", "text"] and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t in docs if not plain(t, items)[1])


def test_empty_tables_clashing_columns_and_long_texts(spark):
    item = "one two three four five six seven eight nine ten eleven"
    items = spark.createDataFrame([("a", item)], "item_id string, text string")
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert decontamination.scan(empty, items).collect() == []
    rows = [(1, "k", item, 5, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, key string, text string, n_words int, gram string")
    assert [(r.doc_id, r.key, r.gram, r.n_words, r.n_hit) for r in decontamination.scan(docs, items).collect()] == [(1, "k", "w", 11, 11)]
    assert [(r.n_words, r.n_hit, r.contaminated) for r in decontamination.scan(docs, empty.selectExpr("doc_id AS item_id", "text")).collect()] == [(11, 0, False)]
    # a text of megabytes, and one that is nothing but hits
    long = "filler word " * 300_000 + item + " more" * 100_000
    found = {r.doc_id: (r.n_words, r.n_hit) for r in decontamination.scan(spark.createDataFrame([(1, long), (2, (item + " ") * 5_000)], "doc_id long, text string"), items).collect()}
    assert found == {1: (700_011, 11), 2: (55_000, 55_000)}


def test_many_rows_of_one_contaminated_text(spark):
    item = " ".join(f"w{i}" for i in range(40))
    docs = spark.range(20_000).selectExpr("id AS doc_id", f"'start {item} end' AS text")
    scanned = decontamination.scan(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert scanned.where("n_hit = 40 AND n_words = 42").count() == 20_000
