"""Removal of repeated passages by sorting suffixes.

A byte goes where a string of WINDOW bytes that covers it starts elsewhere too.
Sorting every suffix of the corpus would move each text WINDOW times, so only
suffixes that can repeat are sorted, and all of these are:

1. Texts that are equal as a whole repeat as a whole, and a task looks at one
   of them only. Each text is cut into zones (see ``anchors``): runs of windows
   that share an anchor. Sampled splitters range-partition zones by anchor,
   hash and text, so that no anchor, and no passage, must lie in one bucket;
   buckets are sorted, and their first and last runs are compared across
   boundaries. Zones whose anchor occurs once hold no repeated window. Copies
   of a zone are repeated as a whole, and one of them stands for all. Of zones
   that share an anchor and differ, one of each kind goes on, with its bytes.
2. Sampled splitters range-partition these by the leading bytes of the suffix
   at their anchor. Each bucket sorts the suffixes of its zones, cut to WINDOW
   bytes, by multikey quicksort, eight bytes a key; equal neighbours repeat.
3. An anchor with very many different zones is not left to one bucket: its
   suffixes are range-partitioned one by one, by their bytes, ties broken by
   their places, so that equal ones may lie in several buckets, which compare
   across their boundaries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.llm import anchors
from marlstone.llm.anchors import REACH, WINDOW
from marlstone.llm.batches import small_batches
from marlstone.sources import materialize

#: An anchor with more different zones is spread over buckets, suffix by suffix.
HOT_ZONES = 2_000
#: Suffixes that a bucket sorts at once, as far as whole anchors allow.
SORTED_AT_ONCE = 200_000
#: Texts that a task remembers having cut.
REMEMBERED = 200_000
#: Zones are emitted in batches of about so many.
ROWS = 20_000
#: Splitters come from about so many texts; zones are dealt to so many buckets for each shuffle partition.
SAMPLED_TEXTS, SPREAD = 8_000, 4
#: Of their zones so many at most, those of the least hashes, go to the driver.
SAMPLED_ZONES = 100_000

# A zone's place in one number: 25 bits of its text's length, the first window, the number of windows. Rows that repeat
# an id are told apart by these bits (of texts over 32 MB the upper ones are dropped) and by the 64-bit hash of the whole
# text, in a column of its own.
WIDE, LENGTH_BITS = 7, 25


def _rows(columns: dict[str, list | np.ndarray], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(columns[k], kinds[k]) for k in kinds}, schema=pa.schema(list(kinds.items())))


_LONG = pa.int64()


def _keys(anchor: np.ndarray, zone: np.ndarray, text_hash: np.ndarray) -> np.ndarray:
    """Strings of bytes in the order of anchor, zone and text_hash."""
    three = np.stack([anchor, zone, text_hash], axis=1).view(np.uint64) ^ np.uint64(1 << 63)
    return three.astype(">u8").view("S24").ravel()


def _dealt(splitters: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Zones, each with the bucket that the splitters give it."""
        cuts = np.array(splitters.value, "S24")
        for batch in _zones(batches):
            anchor, zone, text_hash = (batch.column(k).to_numpy() for k in (0, 1, 4))
            bucket = np.searchsorted(cuts, _keys(anchor, zone, text_hash), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), *batch.columns], names=["bucket", *batch.schema.names])

    return run


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted buckets of zones to those that are repeated as a whole (``whole``) and those that must be compared (with their anchor).

    Of a kind of zone one row is compared. The first and last kinds of a bucket may go on in
    others (``beside``), so one row of each comes again as ``edge``. ``kinds``: of the anchor, in the bucket.
    """
    held: list[pa.RecordBatch] = []

    def finish() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        anchor, zone = rows.column("anchor").to_numpy(), rows.column("zone").to_numpy()
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (zone[1:] != zone[:-1])
        first, kind = np.flatnonzero(new), new.cumsum() - 1  # each kind's first row, each row's kind
        n_kind = np.bincount(kind)
        begins = np.ones(len(first), bool)
        begins[1:] = anchor[first][1:] != anchor[first][:-1]
        of = begins.cumsum() - 1  # each kind's anchor
        kinds, single = np.bincount(of), np.bincount(of, n_kind == 1) > 0
        beside = np.zeros(len(kinds), bool)
        beside[[0, -1]] = single[[0, -1]] = True  # they may go on
        compared = (kinds[of] > 1) & single[of]
        at = np.flatnonzero((n_kind[kind] > 1) | (new & compared[kind]))
        ends = np.unique([0, first[-1]])
        for at, edge in ((at, False), (ends, True)):
            if len(at):
                part = rows.take(pa.array(at))
                mine = kind[at]
                values = pa.array(anchor[at], mask=None if edge else ~(new[at] & compared[mine]))
                columns = [part.column(k).combine_chunks() for k in ("doc_id", "text_hash", "place")]
                count = kinds[of[mine]]
                if edge and len(at) > 1 and of[mine[0]] == of[mine[1]]:
                    count[1] = 0  # one anchor's kinds count once
                flags = [pa.array(n_kind[mine] > 1), pa.array(beside[of[mine]]), pa.array(count), pa.array(np.full(len(at), edge))]
                yield pa.RecordBatch.from_arrays([*columns, values, part.column("zone").combine_chunks(), *flags], names=["doc_id", "text_hash", "place", "anchor", "zone", "whole", "beside", "kinds", "edge"])

    bucket = None
    for batch in batches:
        number = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
        for a, b in zip(cuts, cuts[1:]):  # noqa: B905
            if a == b:
                continue
            if number[a] != bucket:
                if held:
                    yield from finish()
                held, bucket = [], number[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield from finish()


def _zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text and its hash to the zones of texts that the task has not seen;
    a zone in which windows may be equal, in periodic text, comes in pieces, of REACH windows at most, that are compared as zones are."""
    done: set[tuple[int, int]] = set()
    for batch in batches:
        held: dict[str, list] = {k: [] for k in ("anchor", "zone", "doc_id", "place", "text_hash")}
        size = 0
        for doc_id, text, text_hash in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
            raw = text.as_buffer()
            if raw is None or raw.size < WINDOW or (text_hash, raw.size) in done:
                continue
            if len(done) >= REMEMBERED:
                done.clear()
            done.add((text_hash, raw.size))
            first, n, value, twice = anchors.zones(np.frombuffer(raw, np.uint8))
            if twice.any():
                piece = np.where(twice & (n > 1), np.where(n > REACH, REACH, (n + 1) // 2), n)
                pieces = -(-n // piece)
                nth = np.arange(pieces.sum()) - np.repeat(pieces.cumsum() - pieces, pieces)
                n, piece = np.repeat(n, pieces), np.repeat(piece, pieces)
                first, n, value = np.repeat(first, pieces) + nth * piece, np.minimum(n - nth * piece, piece), np.repeat(value, pieces)
            view = memoryview(raw)
            digest = xxhash.xxh3_64_intdigest
            zone = np.fromiter((digest(view[a:b]) for a, b in zip(first.tolist(), (first + n + (WINDOW - 1)).tolist(), strict=True)), np.uint64, len(first))
            held["anchor"].append(value.view(np.int64))
            held["zone"].append(zone.view(np.int64))
            held["doc_id"].append(pa.repeat(doc_id, len(first)))
            held["place"].append((np.int64(raw.size & ((1 << LENGTH_BITS) - 1)) << 38) | (first << WIDE) | n)
            held["text_hash"].append(np.full(len(first), text_hash, np.int64))
            size += len(first)
            if size > ROWS:
                yield _joined(held)
                held, size = {k: [] for k in held}, 0
        if size:
            yield _joined(held)


def _joined(held: dict[str, list]) -> pa.RecordBatch:
    flat = [pa.array(np.concatenate(held["anchor"])), pa.array(np.concatenate(held["zone"])), pa.concat_arrays(held["doc_id"]), pa.array(np.concatenate(held["place"])), pa.array(np.concatenate(held["text_hash"]))]
    return pa.RecordBatch.from_arrays(flat, names=list(held))


def _start(place: int) -> int:
    return (place >> WIDE) & ((1 << 31) - 1)


def _with_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, a list of (place, anchor, hot) and the text's hash to a row for each zone, with the leading bytes of its anchor and its own bytes."""
    names = ("doc_id", "place", "anchor", "hot", "lead", "body", "text_hash")
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text, wanted, text_hash in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            raw = memoryview(text.as_buffer())
            for zone in wanted:
                place, anchor = zone["place"], zone["anchor"]
                body = bytes(raw[_start(place) : _start(place) + (place & 127) + WINDOW - 1])
                at = int(np.argmax(anchors.hashes(np.frombuffer(body, np.uint8), anchors.GRAM).view(np.int64) == anchor))
                rows.append((doc_id.as_py(), place, anchor, zone["hot"], int.from_bytes(body[at : at + 8], "big") - (1 << 63), body, text_hash))
                if len(rows) >= ROWS:
                    yield _listed(rows, names, batch.schema.field(0).type)
                    rows = []
        if rows:
            yield _listed(rows, names, batch.schema.field(0).type)


def _listed(rows: list[tuple], names: tuple[str, ...], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = {"doc_id": id_type, "place": _LONG, "anchor": _LONG, "hot": pa.bool_(), "lead": _LONG, "body": pa.binary(), "text_hash": _LONG}
    return _rows(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), {n: kinds[n] for n in names})


def repeated(buffer: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which of the suffixes starting ``at``, cut to WINDOW bytes, have an equal in their group.

    Multikey quicksort, all parts at once: suffixes are sorted by group and
    first key of eight bytes; those alone in their part are done, and the
    others go on to the next key within theirs.
    """
    words = np.lib.stride_tricks.as_strided(buffer.view(), (len(buffer) - 7, 8), (1, 1))
    left, part = np.arange(len(at)), group
    for key in range(0, WINDOW, 8):
        if not len(left):
            break
        word = np.ascontiguousarray(words[at[left] + key]).view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((word, part))
        left, part, word = left[order], part[order], word[order]
        new = np.ones(len(left), bool)
        new[1:] = (part[1:] != part[:-1]) | (word[1:] != word[:-1])
        alone = new & np.append(new[1:], True)
        part = new.cumsum()
        left, part = left[~alone], part[~alone]
    out = np.zeros(len(at), bool)
    out[left] = True
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and length of each run of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _sorted_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket of zones, sorted by anchor, to the runs of repeated windows in them."""
    held: list[tuple] = []
    windows, last = 0, None

    def finish(id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        bodies = [z[3] for z in held]
        size = np.array([len(b) for b in bodies])
        begin = size.cumsum() - size
        n = size - (WINDOW - 1)
        of = np.repeat(np.arange(len(held)), n)
        at = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n) + begin[of]
        group = np.unique(np.array([z[2] for z in held]), return_inverse=True)[1]
        flags = repeated(np.frombuffer(b"".join(bodies), np.uint8), at, group[of])
        out = []
        for zone, part in zip(held, np.split(flags, n.cumsum()[:-1]), strict=True):
            out += [(zone[0], zone[1], _start(zone[1]) + a, b + WINDOW - 1, zone[4]) for a, b in _runs(part)]
        if out:
            a, b, c, d, e = map(list, zip(*out, strict=True))
            yield _rows({"doc_id": a, "place": b, "first": c, "n": d, "text_hash": e}, {"doc_id": id_type, "place": _LONG, "first": _LONG, "n": _LONG, "text_hash": _LONG})

    id_type = pa.int64()
    for batch in batches:
        id_type = batch.schema.field(0).type
        for zone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if windows > SORTED_AT_ONCE and zone[2] != last:
                yield from finish(id_type)
                held, windows = [], 0
            held.append(zone)
            last = zone[2]
            windows += len(zone[3]) - (WINDOW - 1)
    if held:
        yield from finish(id_type)


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Zones to their suffixes: WINDOW bytes of each, and its place."""
    for batch in batches:
        for doc_id, place, body, text_hash in zip(batch.column(0), *(c.to_pylist() for c in batch.columns[1:]), strict=True):
            n = len(body) - WINDOW + 1
            windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(body, np.uint8), WINDOW)
            suffix = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * WINDOW).tobytes()), pa.py_buffer(windows.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.repeat(doc_id, n), pa.repeat(pa.scalar(place), n), pa.array(np.arange(n) + _start(place)), suffix, pa.repeat(pa.scalar(text_hash, _LONG), n)], names=["doc_id", "place", "first", "suffix", "text_hash"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes to those with an equal neighbour. The bucket's first and last are given too, as ``edge`` and with their bytes, for its neighbours to see."""
    before: pa.RecordBatch | None = None
    mate, part = False, None

    def out(rows: pa.RecordBatch, edge: bool) -> pa.RecordBatch:
        seen = rows.column(3) if edge else pa.nulls(len(rows), pa.binary())
        return pa.RecordBatch.from_arrays([*rows.columns[:3], seen, rows.column(4), pa.array([edge] * len(rows))], names=[*rows.schema.names, "edge"])

    for batch in batches:
        if not len(batch):
            continue
        suffix = batch.column(3).to_pylist()
        same = np.fromiter((x == y for x, y in zip(suffix, suffix[1:])), bool, len(suffix) - 1)  # noqa: B905
        to_next, to_last = np.append(same, False), np.insert(same, 0, False)
        if before is None:
            yield out(batch.slice(0, 1), True)
        elif suffix[0] == part:
            to_last[0] = True
            if not mate:
                yield out(before, False)
        hit = np.flatnonzero(to_next | to_last)
        if len(hit):
            yield out(batch.take(pa.array(hit)), False)
        before, part, mate = batch.slice(len(batch) - 1, 1), suffix[-1], bool(to_last[-1])
    if before is not None:
        yield out(before, True)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text and its spans to the text without them."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    for batch in batches:
        begun, rows, size = 0, [], 0

        def pack(end: int) -> pa.RecordBatch:
            a, b, c, d = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([batch.column(0).slice(begun, end - begun), pa.array(a, _LONG), pa.array(b, _LONG), pa.array(c, _LONG), pa.array(d, pa.binary())], names=names)

        for i, (text, spans) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), strict=True)):
            raw, kept, upto, removed, n = memoryview(text.as_buffer() or b""), [], 0, 0, 0
            for first, end in sorted((s["first"], s["first"] + s["n"]) for s in spans or ()):
                if first > upto or not n:
                    kept.append(raw[upto:first])
                    n, upto = n + 1, first
                if end > upto:
                    removed, upto = removed + end - upto, end
            kept.append(raw[upto:])
            rows.append((len(raw), removed, n, b"".join(kept)))
            size += len(rows[-1][3])
            if size > 1 << 21:
                yield pack(i + 1)
                begun, rows, size = i + 1, [], 0
        if rows:
            yield pack(len(batch))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) of every row of ``docs``.

    Texts are their UTF-8 bytes; null counts as empty. Each byte goes that is
    covered by a string of WINDOW bytes which also starts anywhere else, in
    the same text or in another, overlapping or not. That is judged on the
    texts as given: of two copies both go. n_spans counts maximal removed
    runs. What is kept is the bytes in between, which may end within a
    character. Rows that repeat an id, null or not, are texts of their own.

    Shuffled are: a row of four numbers for each zone, of about fifty windows;
    the text, to the zones that must be compared; their bytes; and the text
    again, to its spans. No group is held by one task: zones are cut into
    buckets by anchor, hash and text, and what one anchor can bring to a bucket
    of suffixes is bounded by HOT_ZONES.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _spans(docs).mapInArrow(_cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def _splitters(texts: DataFrame, zone: str, buckets: int) -> list[bytes]:
    """Cuts of the zones' keys into ``buckets``, from SAMPLED_ZONES at most of those of about SAMPLED_TEXTS texts."""
    sampled = texts.sample(min(1.0, SAMPLED_TEXTS / max(1, texts.count())), 1).mapInArrow(_zones, zone)
    found = sampled.select("anchor", "zone", "text_hash").orderBy(F.xxhash64("zone", "place", "text_hash")).limit(SAMPLED_ZONES).toArrow()
    keys = np.sort(_keys(*(c.to_numpy() for c in found.columns)))
    return np.unique(keys[[len(keys) * i // buckets for i in range(1, buckets)]]).tolist() if len(keys) else []


def _spans(docs: DataFrame) -> DataFrame:
    """doc_id, text and the spans to remove (null where there are none) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("whole_hash", F.xxhash64("text"))
    own_length = F.octet_length("text").cast("long").bitwiseAND((1 << LENGTH_BITS) - 1)

    # texts that are equal as a whole, by 128 bits of hashes and the length; only their ids and hashes are dealt out, and of rows
    # that are repeated as a whole one, as its span is that of all
    lengths = texts.select("doc_id", "whole_hash", F.xxhash64(F.lit(1), "text").alias("more_hash"), F.octet_length("text").cast("long").alias("n")).where(F.col("n") >= WINDOW)
    several = materialize(lengths.groupBy("whole_hash", "more_hash", "n").agg(F.count("*").alias("copies")).where("copies > 1"), "repeat-copies")
    copied = lengths.join(several, ["whole_hash", "more_hash", "n"]).distinct().select("doc_id", F.shiftleft(F.col("n").bitwiseAND((1 << LENGTH_BITS) - 1), 38).alias("place"), F.lit(0).cast("long").alias("first"), "n", F.col("whole_hash").alias("text_hash"))

    zone = f"anchor long, zone long, doc_id {kind}, place long, text_hash long"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    splitters = spark.sparkContext.broadcast(_splitters(texts, zone, SPREAD * buckets))
    dealt = texts.mapInArrow(_dealt(splitters), f"bucket int, {zone}").repartition(buckets, "bucket").sortWithinPartitions("bucket", "anchor", "zone", "text_hash", "doc_id", "place")
    marked = materialize(dealt.mapInArrow(_marked, f"doc_id {kind}, text_hash long, place long, anchor long, zone long, whole boolean, beside boolean, kinds long, edge boolean"), "repeat-zones")
    splitters.unpersist()
    # two rows a bucket, of which those of one anchor meet: whether their kinds of zones go on in other buckets, and beside which others
    of_anchor, of_kind = Window.partitionBy("anchor"), Window.partitionBy("anchor", "zone")
    edges = marked.where("edge").withColumns({"whole": F.col("whole") | (F.count("*").over(of_kind) > 1), "several": F.min("zone").over(of_anchor) < F.max("zone").over(of_anchor)})
    edges = materialize(edges.withColumns({"of": F.col("anchor"), "all_kinds": F.sum("kinds").over(of_anchor)}).withColumn("anchor", F.when(F.col("several"), F.col("anchor"))), "repeat-edges")
    spread = F.broadcast(edges.where(F.col("all_kinds") > HOT_ZONES).select(F.col("of").alias("spread_anchor")).distinct())  # two rows a bucket at most
    alike = marked.where("NOT edge").unionByName(edges.where("whole OR anchor IS NOT NULL").select(*marked.columns))
    alike = alike.join(spread, F.col("beside") & (F.col("anchor") == F.col("spread_anchor")), "left")
    hot = F.when(F.col("beside"), F.col("spread_anchor").isNotNull()).otherwise(F.col("kinds") > HOT_ZONES)
    alike = alike.select("doc_id", "text_hash", "place", "anchor", "whole", hot.alias("hot"))

    of_text = (F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"), F.shiftright("place", 38).alias("of_length"))
    wanted = alike.where("anchor IS NOT NULL").groupBy(*of_text).agg(F.collect_set(F.struct("place", "anchor", "hot")).alias("zones"))
    own = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("whole_hash") == F.col("of_hash")) & (own_length == F.col("of_length"))
    bodies = texts.join(wanted, own).select("doc_id", "text", "zones", "whole_hash").mapInArrow(_with_bytes, f"doc_id {kind}, place long, anchor long, hot boolean, lead long, body binary, text_hash long")
    bodies = materialize(bodies, "repeat-bodies")

    zone = ("doc_id", "place", "anchor", "body", "text_hash")
    in_buckets = bodies.where("NOT hot").repartitionByRange(buckets, "lead", "anchor").sortWithinPartitions("lead", "anchor").select(*zone)
    spans = in_buckets.mapInArrow(_sorted_bucket, f"doc_id {kind}, place long, first long, n long, text_hash long")
    if not bodies.where("hot").isEmpty():
        suffix = f"doc_id {kind}, place long, first long, suffix binary, text_hash long"
        places = bodies.where("hot").select("doc_id", "place", "body", "text_hash").mapInArrow(_one_by_one, suffix)
        in_order = ("suffix", "doc_id", "text_hash", "place", "first")
        found = places.repartitionByRange(buckets, *in_order).sortWithinPartitions(*in_order).mapInArrow(_neighbours, f"{suffix}, edge boolean")
        found = materialize(found, "repeat-neighbours")
        edges = found.where("edge").withColumn("n", F.size(F.collect_set(F.struct("doc_id", "text_hash", "place", "first")).over(Window.partitionBy("suffix")))).where("n > 1")
        where = ("doc_id", "text_hash", "place", "first")
        hits = found.where("NOT edge").select(*where).unionByName(edges.select(*where))
        spans = spans.unionByName(hits.withColumn("n", F.lit(WINDOW).cast("long")))
    whole = alike.where("whole").select("doc_id", "text_hash", "place", F.expr(f"shiftright(place, {WIDE}) & {(1 << 31) - 1}L").alias("first"), F.expr(f"(place & {(1 << WIDE) - 1}L) + {WINDOW - 1}L").alias("n"))
    gathered = whole.unionByName(copied).unionByName(spans).groupBy(*of_text).agg(F.collect_set(F.struct("first", "n")).alias("spans"))
    # written, so that the join has exchanges of its own, and a text that very many rows repeat can be split
    return texts.join(materialize(gathered, "repeat-spans"), own, "left").select("doc_id", "text", "spans")


def digests(docs: DataFrame) -> DataFrame:
    """As remove_repeats, with the SHA-256 of what is kept in place of it."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            shas = [hashlib.sha256(k.as_buffer()).hexdigest() for k in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(shas, pa.string())], names=[*batch.schema.names[:4], "kept_sha256"])

    return _spans(docs).mapInArrow(hashed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
