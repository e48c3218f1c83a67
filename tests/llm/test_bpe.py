"""BPE against the tokenizers library, and exact round trips."""

from __future__ import annotations

import hashlib
import random
import tracemalloc

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marlstone.llm import bpe as B

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()
ENCODER = B.Encoder(B.Vocabulary(PATH))


def same(text):
    ids = ENCODER.encode(text)
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids, text[:200]
    one = B.Decoder(ENCODER.v)
    assert "".join([*map(one.push, ids), one.finish()]) == LIBRARY.decode(ids, skip_special_tokens=False)
    runs = list(ENCODER.runs(text))
    assert b"".join(r[2] for r in runs)[1:].decode() == LIBRARY.decode(ids, skip_special_tokens=False) and sum(r[0] for r in runs) == len(ids)
    return ids


CASES = ["", " ", "Hello world's don't I'LL 'S", "café <|endoftext|>x<|startoftext|> <|endoftext", "İ ſ ẞ ΑΣ ΣΑΣ Å é é ́", "a\x1cb\x1f c \x1c", "᠎ ﻿​\x85 ", "12½²Ⅻ٣", "𝒳𝒴 \U0001f600\U0001f469‍\U0001f680", "\x00\x01\x7f", "Ᲊ Ɤ ࢗ", "x" * 20_000, "ab" * 15_000 + "!", "!" * 9000, "é" * 9000, "가나다" * 3000, "--==++" * 5000]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    same(text)


def test_every_code_point():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(0)
    rng.shuffle(points)
    for at in range(0, len(points), 2000):
        same("".join(c + rng.choice(["", " ", "a", "1"]) for c in points[at : at + 2000]))


def test_long_pieces_come_out_before_they_end():
    """Pieces of words run together, several times the lookahead: the same ids, in bounded memory."""
    v, rng = ENCODER.v, random.Random(4)
    words = [t.removesuffix("</w>") for t in v.ids if t.isascii() and t.removesuffix("</w>").isalpha() and t.islower()]
    for _ in range(8):
        piece = "".join(rng.choices(words, k=4000))
        stream, out, most = B.Transducer(v), [], 0
        for at in range(0, len(piece), 501):
            out += stream.feed(piece[at : at + 501])
            most = max(most, stream.size)
        assert out and most <= 2 * v.lookahead
        assert [*out, *stream.finish()] == LIBRARY.encode(piece, add_special_tokens=False).ids
    letters = "".join(rng.choices("aeinrst", k=30_000))
    stream = B.Transducer(v)
    assert [*stream.feed(letters), *stream.finish()] == LIBRARY.encode(letters, add_special_tokens=False).ids


def test_bytes_come_back():
    for text in ("hello wörld 𝒳 don't", "á", "x" * 7000):
        d = B.Decoder(ENCODER.v, restore=True)
        got = "".join([*map(d.push, ENCODER.encode(text)), d.finish()])
        assert got.replace(" ", "") == LIBRARY.normalizer.normalize_str(text).replace(" ", "")


def test_rows(spark):
    texts = [None, *CASES[:-6], "long words " * 20_000, "again", "again"]
    rows = [(i, t, 9, "old") for i, t in enumerate(texts)] + [(None, "null id", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, ids string").repartition(3)
    got = B.encode(df, PATH, digests=True).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = LIBRARY.encode(texts[r.doc_id] or "" if r.doc_id is not None else "null id", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    for r in B.encode(df, PATH).collect():
        assert r.decoded == LIBRARY.decode(r.ids, skip_special_tokens=False) and len(r.ids) == r.n_tokens
    assert B.encode(df.limit(0), PATH).collect() == []


def test_every_piece_and_token_passes_through_the_machines(monkeypatch):
    fed, pushed, feed, push = [], [], B.Transducer.feed, B.Decoder.push
    monkeypatch.setattr(B.Transducer, "feed", lambda self, x: fed.append(x) or feed(self, x))
    monkeypatch.setattr(B.Decoder, "push", lambda self, x: pushed.append(x) or push(self, x))
    encoder = B.Encoder(ENCODER.v)
    ids = encoder.encode("Some words, don't some wörds <|endoftext|> x")
    assert fed == ["some", "words", ",", "don", "'t", "w\u00c3\u00b6rds", "x"]
    once = encoder._said(())  # nothing
    assert once == (0, b"", b"") and set(pushed) == set(ids)


def test_runs_do_not_show(monkeypatch):
    rng = random.Random(2)
    words = ["don't", "WORDS", "é", "<|endoftext|>", "12", "\x1c", "!?", "a" * 90, "Ab1!" * 40, "x<|endoftext|>Y" * 9, "é" * 70]
    for chunk in (1, 7, 64):
        monkeypatch.setattr(B, "CHUNK", chunk)
        for _ in range(60):
            same("".join(rng.choice(words) + rng.choice(["", " ", "\n\t", "\x85"]) for _ in range(rng.randint(1, 12))))


def test_a_long_text_is_encoded_in_bounded_memory():
    """Spaceless and spaced parts, far longer than a run: what is held does not grow with them."""
    most = []
    for k in (1, 4):
        text, encoder = "Spam" * (50_000 * k) + " and " + "eggs " * (400_000 * k), B.Encoder(ENCODER.v)
        tracemalloc.start()
        n = sum(r[0] for r in encoder.runs(text))
        most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert n > 400_000 * k
    assert most[1] < 1.2 * most[0] < 24 << 20
