"""The registered queries, as they stand, over the whole tables: against their SQL, or against plain versions."""

from __future__ import annotations

import hashlib
import os
import zlib
from pathlib import Path

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marlstone.llm import queries as Q
from tests.llm import test_order_minhash, test_quality_rules

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def documents(duck):
    return duck.execute("SELECT doc_id, text FROM documents").fetchall()


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_rows_are_those_of_the_sql(spark, duck, name):
    found = Q.QUERIES[name](spark, str(DATA))
    columns = sorted(found.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({Q.ORACLES[name]})").fetchall()
    value = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(map(value, r)) for r in found.select(*columns).collect()) == sorted(tuple(map(value, r)) for r in want)
    assert len(want) == duck.execute(f"SELECT count(*) FROM {'pages' if name in ('op3_warc', 'op6_url_filters') else 'documents'}").fetchone()[0]


def test_toxicity(spark, duck):
    got = {r.doc_id: r for r in Q.op1_toxicity(spark, str(DATA)).collect()}
    labels = dict(duck.execute("SELECT doc_id, max(toxic) FROM labels GROUP BY 1").fetchall())
    assert len(got) == len(documents(duck))
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    toxic = [r.predicted for i, r in got.items() if r.held_out and labels.get(i) == 1]
    clean = [r.predicted for i, r in got.items() if r.held_out and labels.get(i) == 0]
    assert sum(toxic) >= 0.6 * len(toxic) and sum(clean) <= 0.05 * len(clean)  # of six toxic ones at this scale


def test_order_minhash_query(spark, duck):
    docs = documents(duck)
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, f"{r.near_edited:.9f}", f"{r.near_next:.9f}") for r in Q.op5_order_minhash(spark, str(DATA)).collect()]
    # whole rows of the shorter texts, and the edits of all, by plain code
    listed = sorted(docs, key=lambda r: -r[0])
    after = dict(zip([r[0] for r in listed], [*listed[1:], listed[0]], strict=True))
    by_id = {r[0]: r for r in got}
    assert len(by_id) == len(docs)
    for i, t in docs:
        u = after[i][1]
        h = len(t) // 2
        e = t[: len(t) - h] + u[:h]
        assert by_id[i][1:3] == (len(t), hashlib.sha256(e.encode()).hexdigest())
        if len(t) + len(u) < 1500:
            a, b, c = map(test_order_minhash.plain_print, (t, e, u))
            like = test_order_minhash.plain_likeness
            assert by_id[i][3:] == (a, b, f"{like(a, b):.9f}", f"{like(a, c):.9f}")


def test_bpe(spark, duck):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    got = {r.doc_id: r for r in Q.op7_bpe(spark, str(DATA)).collect()}
    assert len(got) == len(documents(duck))
    for i, t in documents(duck):
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert tuple(got[i])[1:] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_quality_rules_query(spark, duck):
    got = {r.doc_id: r for r in Q.op8_quality_rules(spark, str(DATA)).collect()}
    quality = dict(duck.execute("SELECT doc_id, min(quality) FROM labels GROUP BY 1").fetchall())
    assert len(got) == len(documents(duck))
    for i, t in documents(duck):
        r = got[i]
        *base, _ = test_quality_rules.plain(t)
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == base
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0]) and not (r.base_failed and r.kept)
    good = [r.kept for i, r in got.items() if quality.get(i) == 1 and not r.base_failed]
    bad = [r.kept for i, r in got.items() if quality.get(i) == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)
