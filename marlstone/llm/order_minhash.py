"""Order MinHash fingerprints, inside the JVM.

A text's k-mers are runs of K units: words, and single characters of scripts
that are written without blanks between words. Each is numbered by its occurrence, and
hashed with that number. The hashes lie on a ring, and each of POINTS hash
functions is the distance on it from a point of its own: of all k-mers of the
text, it selects the TUPLE = 2 that come first from there. These are put back
into the order of the text and hashed together. Two texts share a function's
value where it selects the same k-mers, in the same order, so the share of
equal values falls with edits and with moves alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.llm.native import let, lower_bound, words

K, POINTS, TUPLE = 3, 64, 2
#: Fixed values, Unicode's blocks of scripts without blanks: Thai and Lao, Myanmar, Khmer, CJK radicals, kana, kana's phonetic extensions, Han extension A, Han, Han for compatibility, halfwidth kana, Han's planes.
UNSPACED = "0E00-0EFF 1000-109F 1780-17FF 2E80-2FDF 3040-30FF 31F0-31FF 3400-4DBF 4E00-9FFF F900-FAFF FF66-FF9F 20000-3FFFF"
#: Hex digits of a function's value: 32 bits.
HEX = 8
EMPTY = "-" * HEX
#: K-mers are ordered by the leading bits of their hashes and then by their places; up to 2^PLACE_BITS of them both fit in one number.
PLACE_BITS = 24
LAST = (1 << PLACE_BITS) - 1
#: Rows are put in order in buckets of about so many; the cuts between them come from a sample of so many rows a bucket.
BUCKET_ROWS, MOST_BUCKETS, SAMPLED = 2_000, 1 << 16, 40


def _units(text: str) -> str:
    """SQL for a text's units in order. A word ends before and after each character of UNSPACED, which is a unit of its own."""
    ranges = "".join("-".join(rf"\\x{{{end}}}" for end in block.split("-")) for block in UNSPACED.split())
    return words(f"regexp_replace({text}, '([{ranges}])', ' $1 ')")


def _selected(ordered: str, place: Callable[[str], str], leading: Callable[[str], str]) -> str:
    """SQL for a fingerprint from the k-mers in the ring's order; SQL of the ``place`` and ``leading`` bits of one of them."""
    point = lambda x: f"CAST(shiftright({leading(x)}, {64 - (POINTS - 1).bit_length()}) + {POINTS // 2} AS INT)"
    here, after = place("get(g, k)"), place("get(g, pmod(k + 1, size(g)))")
    pair = f"xxhash64(get(m, least({here}, {after})), get(m, greatest({here}, {after})))"
    value = f"lpad(lower(hex(pmod({pair}, {16**HEX}L))), {HEX}, '0')"
    first = f"filter(sequence(0, size(g) - 1), k -> k = 0 OR {point('get(g, k)')} <> {point('get(g, k - 1)')})"
    # a selection serves its own point and those before it that lie beyond the selection before
    parts = "array_join(transform(v, (x, j) -> repeat(x, get(p, j) - if(j = 0, -1, get(p, j - 1)))), '')"
    rest = f"repeat(get(v, 0), {POINTS - 1} - get(p, size(p) - 1))"
    upto = f"transform(f, k -> {point('get(g, k)')})"
    return let("g", ordered, let("f", first, let("v", f"transform(f, k -> {value})", let("p", upto, f"concat({parts}, {rest})"))))


def _fits(n: str) -> str:
    """SQL for whether so many k-mers have places that can be packed."""
    return f"{n} <= {LAST}"


def fingerprint(text: str) -> Column:
    """The fingerprint of a text column: POINTS values of HEX hex digits; all EMPTY for a null text or one without words.

    A function of the whole text alone. A text of less than K units is a single k-mer;
    so is one long word of letters of other scripts, which has no places to be cut at.
    """
    kmer = "xxhash64(" + ", ".join(f"get(u, i + {j})" for j in range(K)) + ")"
    hashes = f"if(size(u) < {K}, array(xxhash64(array_join(u, chr(0)))), transform(sequence(0, size(u) - {K}), i -> {kmer}))"
    # occurrences are counted in texts that repeat a k-mer; elsewhere all are the first
    grouped = "sort_array(transform(s, (h, i) -> named_struct('h', h, 'i', i)))"
    earlier = f"if(k > 0 AND get(qh, k - 1) = x.h, k - {lower_bound('qh', 'x.h')}, 0)"
    numbered = f"transform(q, (x, k) -> named_struct('i', x.i, 'm', xxhash64(x.h, {earlier})))"
    counted = let("q", grouped, let("qh", "q.h", f"transform(sort_array({numbered}), x -> x.m)"))
    hashed = f"if(size(array_distinct(s)) = size(s), transform(s, h -> xxhash64(h, 0)), {counted})"
    packed = f"sort_array(transform(m, (h, i) -> ((h & {~LAST}L) | i)))"
    wide = f"sort_array(transform(m, (h, i) -> named_struct('h', shiftright(h, {PLACE_BITS}), 'i', i)))"
    short = _selected(packed, lambda x: f"CAST({x} & {LAST}L AS INT)", lambda x: x)
    long = _selected(wide, lambda x: f"{x}.i", lambda x: f"shiftleft({x}.h, {PLACE_BITS})")
    sql = let("s", hashes, let("m", hashed, f"if({_fits('size(m)')}, {short}, {long})"))
    return F.expr(let("u", _units(f"coalesce(`{text}`, '')"), f"if(size(u) = 0, repeat('-', {POINTS * HEX}), {sql})"))


def likeness(a: str, b: str) -> Column:
    """The likeness of two fingerprints, from 0 to 1.

    It is the root, of degree TUPLE, of the share of equal values, as a value
    is equal with about that power of the resemblance. Two empty texts are
    alike (1); an empty one and another are not (0).
    """
    alike = f"size(filter(sequence(0, {POINTS - 1}), i -> substring({a}, i * {HEX} + 1, {HEX}) = substring({b}, i * {HEX} + 1, {HEX})))"
    return F.expr(f"CASE WHEN {a} = {b} THEN 1D ELSE pow({alike} / {POINTS}D, {1 / TUPLE}D) END")


def _placed(docs: DataFrame) -> tuple[DataFrame, int]:
    """id, text, order_key and bucket of each row, and how many buckets there are: rows of a bucket all come before those of the next.

    The order is by doc_id, descending, null last, and then by the text's hash.
    Buckets are cut at sampled keys, which alone go to the driver. Rows with
    one key may come in any order, as they are the same, so they are spread
    over the buckets between cuts at this key.
    """
    least = "shiftleft(1L, 63)"
    in_order = lambda sql: f"lpad(hex(({sql}) ^ {least}), 16, '0')"
    key = f"concat({in_order(f'~coalesce(id, {least})')}, if(id IS NULL, '1', '0'), {in_order('xxhash64(text)')})"
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("order_key", F.expr(key))
    n = docs.count()
    buckets = min(MOST_BUCKETS, n // BUCKET_ROWS + 1)
    cuts: list[str] = []
    if buckets > 1:
        found = sorted(r.order_key for r in rows.sample(min(1.0, SAMPLED * buckets / n), 1).select("order_key").collect())
        cuts = [found[len(found) * i // buckets] for i in range(1, buckets)] if found else []
    listed = f"split('{','.join(cuts)}', ',')"
    low, high = lower_bound("cuts", "order_key"), lower_bound("cuts", "concat(order_key, '~')")
    if not cuts:
        return rows.withColumn("bucket", F.lit(0)), 1
    rows = rows.withColumn("cuts", F.expr(listed)).withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    spread = "if(high - low > 1, low + 1 + CAST(pmod(salt, high - low - 1) AS INT), high)"
    rows = rows.withColumn("bucket", F.expr(let("low", low, let("high", high, spread))))
    return rows.drop("cuts", "salt"), len(cuts) + 1


def edit_and_compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of an edited form of it, and their likeness.

    The edited text has the last half (rounded down) of its code points
    replaced by the first as many (or all) of the next document in descending
    order of doc_id; the first follows the last. A null text counts as empty.
    Every row is a document: null ids come last, rows that repeat an id follow
    each other by the hash of their text, and an only row follows itself.

    The texts are shuffled once, into buckets of rows that are neighbours; the
    first row of each bucket is put at the end of the one before as well.
    """
    rows, buckets = _placed(docs)
    tops = sorted((r.bucket, r.top) for r in rows.groupBy("bucket").agg(F.min("order_key").alias("top")).collect())
    heads = [(key, tops[i - 1][0]) for i, (_, key) in enumerate(tops)]  # each also after the last row of the bucket before
    listed = docs.sparkSession.createDataFrame(heads, "head_key string, into int")
    found = rows.join(F.broadcast(listed), F.col("order_key") == F.col("head_key"))  # one row for each bucket
    found = found.dropDuplicates(["into"]).select("id", "text", "order_key", F.col("into").alias("bucket"), F.lit(1).alias("is_head"))
    placed = rows.withColumn("is_head", F.lit(0)).unionByName(found).repartition(max(buckets, 1), "bucket").withColumn("own_print", fingerprint("text"))
    order = Window.partitionBy("bucket").orderBy("is_head", "order_key", "text")
    after = placed.withColumns({"next_text": F.lead("text").over(order), "next_print": F.lead("own_print").over(order)}).where("is_head = 0")
    edited = F.expr("concat(left(text, CAST(n_chars - n_chars DIV 2 AS INT)), left(next_text, CAST(n_chars DIV 2 AS INT)))")
    both = after.withColumn("n_chars", F.length("text").cast("long")).select("id", "n_chars", "own_print", "next_print", edited.alias("edited"))
    printed = both.withColumn("edited_print", fingerprint("edited"))
    return printed.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("own_print").alias("fingerprint"),
        F.col("edited_print").alias("edited_fingerprint"),
        likeness("own_print", "edited_print").alias("near_edited"),
        likeness("own_print", "next_print").alias("near_next"),
    )
