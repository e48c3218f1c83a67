"""Toxicity: held-out accuracy, calibration, and tables that leave nothing to learn."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import boosting, toxicity

DOCS, LABELS = "doc_id long, text string, lang string, score string, predicted long", "doc_id long, quality int, toxic int"


def corpus(n=700, seed=3):
    rng = random.Random(seed)
    clean = ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 9))) for _ in range(600)]
    stem = ["grukk" + "".join(rng.choices("aeiou", k=3)) for _ in range(40)]
    docs, labels = [], []
    for i in range(n):
        words, bad = rng.choices(clean, k=rng.randint(20, 200)), i % 6 == 0
        if bad:
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["Zorgle", "blammo,", *stem]))
        docs.append((i, " ".join(words), "en", "old", None))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_held_out_texts(spark):
    docs, labels = corpus()
    odd = [(9000, None, None, None, None), (9001, "", "en", "", 0), (None, "zorgle blammo zorgle blammo", "en", "", 0), (9002, "x" * 200_000, "en", "", 0), (9003, "you grukkaei idiot " * 20_000, "en", "", 0), (9004, "again", "", "", 0), (9004, "again", "", "", 0)]
    df = spark.createDataFrame(docs + odd, DOCS).repartition(4)
    known = spark.createDataFrame(labels + [(None, 1, 1), (5, None, None), (6, 1, 1), (88_888, 0, 1)], LABELS)
    got = toxicity.score(df, toxicity.learn(df, known))
    assert got.columns == ["doc_id", "score", "predicted"]
    rows = got.select("*", toxicity.held_out().alias("held_out")).collect()
    assert len(rows) == len(docs) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    right = [r.predicted == int(r.doc_id % 6 == 0) for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 9000]
    assert len(right) > 100 and np.mean(right) > 0.97
    by_id = {r.doc_id: r for r in rows}
    assert by_id[9000].score == by_id[9001].score < 0.5 and by_id[9003].predicted == 1
    # dealt otherwise: the same scores
    again = {r.doc_id: r.score for r in toxicity.score(df.repartition(2), toxicity.learn(df.repartition(2), known)).collect()}
    assert again == {r.doc_id: r.score for r in rows}


def test_no_labels_of_one_kind(spark):
    df = spark.createDataFrame([(1, "some text", "en", "", 0), (2, "other text", "en", "", 0)], DOCS)
    for rows in ([], [(1, 1, 0), (2, 1, 0)], [(1, 1, 1)], [(1, 1, None)]):
        model = toxicity.learn(df, spark.createDataFrame(rows, LABELS))
        assert {r.score for r in toxicity.score(df, model).collect()} == {model.rate}
    assert toxicity.score(df.limit(0), model).collect() == []


def test_the_features_say_what_their_names_do():
    d = toxicity.Describer(toxicity.Lexicon({"zork": 5.0, "zork*": 4.0, "grab": 2.0}))
    f = lambda t: dict(zip(toxicity.FEATURES, d(t), strict=True))
    near, far = f("you zork! a b c d e f g h i j"), f("you a b c d e f g h i j zork!")
    assert near["nearness"] > far["nearness"] > 0 and near["strong_word_density"] == far["strong_word_density"] == 1 / 12
    assert f("z0rk here")["disguised_hits"] == 0.5 and f("zorking it")["strong_stem_density"] == 0.5
    assert f("LOUD text")["capitals"] == 0.5 and f("a!!")["exclamations"] == pytest.approx(2 / 3)
    assert f("") == dict.fromkeys(toxicity.FEATURES, 0.0)
    assert f("you are (you) and Your, friend")["second_person"] == 0.5 and f("w" * 200 + " zork")["strong_word_density"] == 0.5


def test_terms_of_any_number_and_length_are_learned():
    counts = {f"term{i}": (5, 0) for i in range(9000)} | {"l" * 300: (4, 0), "common": (9, 500)}
    found = toxicity.weigh(counts, 100, 1000).weights
    assert set(counts) - set(found) == {"common"}
    batch = pa.RecordBatch.from_pydict({"text": ["x " + "l" * 300], "fold": pa.array([1], pa.int32())})
    assert "l" * 300 in next(toxicity._places(iter([batch]))).column(0).to_pylist()


def test_isotonic_regression_and_trees():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 4))
    y = (rng.random(2000) < boosting.sigmoid(2 * x[:, 0] * (x[:, 1] > 0))).astype(float)
    raw = boosting.fit(x, y).raw(x)
    assert raw[y == 1].mean() > raw[y == 0].mean() + 0.5
    at, p = boosting.isotonic(raw, y)
    assert (np.diff(at) > 0).all() and (np.diff(p) > 0).all() and p.min() >= 0 and p.max() <= 1
    # the least squares fit among rising ones: no pool can be moved to gain
    s = np.array([1.0, 2, 3, 4, 5, 6])
    assert boosting.isotonic(s, np.array([0.0, 1, 0, 1, 1, 0]))[1] == pytest.approx([0, 0.5, 2 / 3])


def test_labelled_rows_are_bounded_where_ids_repeat(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_LABELLED", 40)
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    docs = [(ids[0], "the same text")] * 50 + [(ids[1], f"text {i}") for i in range(60)] + [(i, f"of {i}") for i in ids[2:10]]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in ids[:10]], "doc_id long, toxic int")
    got = [sorted(tuple(r) for r in toxicity._labelled(frame(d).repartition(n), labels).collect()) for d, n in ((docs, 3), (docs[::-1], 5))]
    assert got[0] == got[1] and len(got[0]) == 40 and sum(r[0] == "the same text" for r in got[0]) <= 1
    few = toxicity._labelled(frame(docs[:50] + docs[-8:]), labels).collect()
    assert sorted(r.text for r in few) == sorted(["the same text", *(t for _, t in docs[-8:])])
