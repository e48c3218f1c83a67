"""WARC archives: exact round trips, damage, and the choice of revisits."""

from __future__ import annotations

import base64
import hashlib
import io
import random
import zlib

import pytest

from marlstone.llm import warc as W


class Slow(io.BytesIO):
    """Gives a few bytes at a time."""

    def read(self, n=-1):
        return super().read(min(n, 7) if n > 0 else 7)


def payloads():
    rng = random.Random(9)
    made = [b"", b"x", b"\r\n\r\n", b"WARC/1.1\r\n\r\n", b"a" * 1_000_000, rng.randbytes(70_000), rng.randbytes(3 * W.CHUNK), b"\0" * (W.CHUNK * 9)]
    return made + [rng.randbytes(rng.randint(0, 3000)) for _ in range(60)] + [("é𝒳" * rng.randint(0, 90_000)).encode() for _ in range(6)]


@pytest.mark.parametrize("stream", [io.BytesIO, Slow])
def test_round_trip(stream):
    parts = payloads()[: None if stream is io.BytesIO else 12]
    data = b"".join(W.encode_record(str(i), f"http://x/{i}\r\nWARC-Type: forged é", p) for i, p in enumerate(parts)) + W.encode_record("r", None, b"z" * 5000, "3")
    *got, last = W.read_records(stream(data), keep_payload=True)
    assert [r["payload"] for r in got] == parts
    assert all(r["payload_bytes"] == len(p) and r["payload_digest"] == hashlib.sha1(p).hexdigest() and r["record_type"] == "response" for r, p in zip(got, parts, strict=True))
    assert got[1]["target_uri"] == "http://x/1%0D%0AWARC-Type:%20forged%20é"
    assert (last["record_type"], last["refers_to"], last["payload_bytes"], last["payload"], last["target_uri"]) == ("revisit", "3", 5000, None, None)
    assert last["payload_digest"] == hashlib.sha1(b"z" * 5000).hexdigest()
    # each record is a gzip member of its own
    one = zlib.decompressobj(31)
    assert base64.b32encode(hashlib.sha1(parts[0]).digest()) in one.decompress(data) and one.eof and one.unused_data


def test_headers_of_any_length(spark):
    url = "http://x/" + "é" * 1_500_000
    record, = W.read_records(io.BytesIO(W.encode_record("1", url, b"page")))
    assert record["target_uri"] == url and record["payload_digest"] == hashlib.sha1(b"page").hexdigest()
    rows = [(1, url, "h" * 3_000_000), (2, None, "h" * 3_000_000), (3, "short", None)]
    got = W.round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.target_uri == rows[r.page_id - 1][1]) for r in got) == [(1, 3_000_000, "revisit", True), (2, 3_000_000, "response", True), (3, 0, "response", True)]


def test_revisits_are_checked_against_their_responses(spark):
    schema = "record_type string, record_id string, refers_to string, payload_digest string, payload_bytes long"
    good = [("response", "1", None, "d", 5), ("revisit", "2", "1", "d", 5)]
    assert W.broken_revisits(spark.createDataFrame(good, schema)).isEmpty()
    for bad in (("revisit", "3", "1", "e", 5), ("revisit", "3", "1", "d", 6), ("revisit", "3", "2", "d", 5)):
        assert W.broken_revisits(spark.createDataFrame([*good, bad], schema)).count() == 1


def test_damage_is_found():
    good = W.encode_record("1", "u", b"some payload" * 50)
    plain = zlib.decompress(good, 31)
    pack = lambda x: (c := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(x) + c.flush()
    assert len(list(W.read_records(io.BytesIO(good + pack(plain))))) == 2
    for bad in (good[:-9], good[:40], b"not gzip", pack(plain.replace(b"some", b"sOme", 1)), pack(plain[:-4]), pack(plain + b"x"), pack(plain.replace(b"Content-Length: ", b"Content-Length: 1", 1)), pack(b"no header")):
        with pytest.raises(W.WarcError):
            list(W.read_records(io.BytesIO(good + bad)))
    assert list(W.read_records(io.BytesIO(b""))) == []


def test_pages_round_trip(spark):
    big, edge = "é" * 900, "y" * 1000
    rows = [(1, "http://a/1", big), (7, "http://a/7", big), (3, None, big), (None, "http://n", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (8, "u", ""), (9, "v", edge), (10, "v", edge), (11, "w", edge[1:]), (12, "w", edge[1:]), (20, "w", "twice" * 400), (20, "w", "twice" * 400)]
    rows += [(100 + i, f"http://b/{i}", "hot" * 1000) for i in range(200)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(5)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in W.round_trip(spark, df).collect()), key=str)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        best = max((j for j, _, h in rows if (h or "").encode() == raw and j is not None), default=None)
        revisit = len(raw) >= 1000 and i != best
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", best if revisit else None))
    assert got == sorted(want, key=str)
    assert W.round_trip(spark, df.limit(0)).collect() == []
