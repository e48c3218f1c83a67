"""Benchmark decontamination: windows of test items' words, looked for in every window of the training texts.

The items' windows are hashed, and their hashes are a broadcast set, in blocks
of bounded size where there are very many. Each text's windows are hashed in
the scan, and meet the set without a shuffle. A hit carries its words, which
are compared with the items' own. Everything is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.native import let, running
from marlstone.sources import materialize

#: Words of a window.
WINDOW = 10
#: Hashes that are broadcast at once. More are looked for in as many scans of the texts as there are blocks of so many.
BLOCK_HASHES = 4_000_000
#: Windows of items are broadcast to verify hits if they are so many bytes at most; beyond that hits are shuffled to them.
BROADCAST_BYTES = 32_000_000

#: What is between words: ASCII characters but for digits and letters. All others are in words.
_BETWEEN = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_BETWEEN_ANY_CASE = r"[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_WORD = r"[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> str:
    """SQL of a text's words: A-Z in lower case, cut at ASCII characters that are neither letters nor digits."""
    # where all characters are ASCII, lower() changes no others
    lowered = f"if(octet_length({text}) = char_length({text}), lower({text}), translate({text}, '{_UPPER}', '{_LOWER}'))"
    return f"filter(split({lowered}, '{_BETWEEN}'), word -> word <> '')"


def _grams(benchmark: DataFrame, window: int) -> DataFrame:
    """(size, gram, hash, items) of each different window of the items; those of one window are ``items``."""
    listed = benchmark.select(F.col("item_id").cast("string").alias("item"), F.expr(words("coalesce(text, '')")).alias("w")).where("size(w) > 0")
    sized = listed.withColumn("size", F.least(F.size("w"), F.lit(window)))
    each = sized.withColumn("at", F.explode(F.expr("sequence(0, size(w) - size)"))).select("item", "size", F.expr("transform(sequence(0, size - 1), k -> get(w, at + k))").alias("part"))
    # as xxhash64 of as many numbers: each one's hash is the next one's seed
    hashed = each.select("item", "size", F.array_join("part", " ").alias("gram"), F.expr("xxhash64(transform(part, x -> xxhash64(x)))").alias("hash"))
    return hashed.groupBy("size", "gram", "hash").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _hits(texts: DataFrame, grams: DataFrame, window: int) -> DataFrame:
    """(key, at, size, gram) of the windows of ``texts`` (key, w) whose hash an item's window has: all that are equal, and what few others a hash brings."""
    found = grams.agg(F.count_distinct("hash").alias("n"), F.array_sort(F.collect_set("size")).alias("sizes")).first()
    blocks = -(-found["n"] // BLOCK_HASHES) or 1
    parts = []
    for size in found["sizes"] or [window]:  # but for items of few words, one size
        # get() takes one element, while slice() may copy the whole array each time
        part = lambda array, i: ", ".join(f"get({array}, {i} + {k})" for k in range(size))  # noqa: B023, E731
        at = f"if(size(h) < {size}, CAST(array() AS ARRAY<BIGINT>), transform(sequence(0, size(h) - {size}), i -> xxhash64({part('h', 'i')})))"
        # a generator of a plain column is compiled into one stage with the join, so that rows that don't meet the set are never
        # made; an outer one is not preceded by a filter, which would compute all hashes once more
        hashed = texts.select("key", "w", F.expr(let("h", "transform(w, x -> xxhash64(x))", at)).alias("hashes"))
        windows = hashed.select("key", "w", F.posexplode_outer("hashes").alias("at", "hash"))
        hashes = grams.where(F.col("size") == size).select(F.col("hash").alias("of_item")).distinct()
        for block in range(blocks):
            some = hashes.where(F.pmod("of_item", F.lit(blocks)) == block) if blocks > 1 else hashes
            met = windows.join(F.broadcast(some), F.col("hash") == F.col("of_item"))  # BLOCK_HASHES at most, or about
            parts.append(met.select("key", "at", F.lit(size).alias("size"), F.expr(f"concat_ws(' ', {part('w', 'at')})").alias("gram")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _key(text: str) -> Column:
    """Names a text: equal ones are looked through once each, but counted once."""
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def _found(docs: DataFrame, benchmark: DataFrame, text: str, window: int) -> DataFrame:
    """(key, spans, items) of each different text with a hit: sorted, disjoint spans of words (first, end), and the items' ids."""
    grams = materialize(_grams(benchmark, window), "test-windows")
    texts = docs.select(_key(text).alias("key"), F.expr(words(f"coalesce(`{text}`, '')")).alias("w"))
    size = grams.agg(F.sum(F.octet_length("gram") + F.expr("aggregate(items, 40, (a, x) -> a + octet_length(x) + 8)")).alias("bytes")).first()["bytes"] or 0
    known = F.broadcast(grams.select("gram", "size", "items")) if size <= BROADCAST_BYTES else grams.select("gram", "size", "items")
    verified = _hits(texts, grams, window).join(known, ["gram", "size"])
    # copies of a text give the same hits, which partial sets collapse before they are shuffled
    gathered = verified.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("at", (F.col("at") + F.col("size")).alias("end")))).alias("hits"), F.flatten(F.collect_set("items")).alias("items"))
    # spans that overlap or touch become one: it begins where all before it have ended
    first = "transform(filter(hits, (x, i) -> i = 0 OR x.at > get(upto, i - 1)), x -> x.at)"
    end = "filter(upto, (e, i) -> i = size(hits) - 1 OR get(hits, i + 1).at > e)"
    merged = let("upto", running("transform(hits, x -> x.end)", "greatest({a}, {b})", "array()"), f"zip_with({first}, {end}, (a, b) -> named_struct('first', a, 'end', b))")
    return materialize(gathered.select("key", F.expr(merged).alias("spans"), F.array_sort(F.array_distinct("items")).alias("items")), "test-hits")


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """Adds n_words, n_hit, spans, items and contaminated to every row of ``docs``.

    A window is ``window`` words of an item (item_id, text) in a row, or all
    words of an item of fewer. Words are in lower case as to A-Z, and cut at
    ASCII characters but for letters and digits. ``spans`` are the disjoint
    spans of words (first, end; from 0, end exclusive) that windows cover
    wherever they occur in a text, n_hit their words, ``items`` the sorted ids,
    as strings, of the items with such windows, and ``contaminated`` is whether
    there are any. Null texts and items have no words. Rows that repeat an id
    are texts, or items, of their own; an id counts once in ``items``, and a
    null id is not listed. Columns with the added names are replaced.

    Texts are not shuffled, only hits and a digest for each row, which goes
    with the columns of ``docs``.
    """
    added = ["n_words", "n_hit", "spans", "items", "contaminated"]
    kept = [c for c in docs.columns if c not in added]
    found = _found(docs, benchmark, text, window)
    n_words = F.expr(f"CAST(coalesce({let('w', f'''split(`{text}`, '{_BETWEEN_ANY_CASE}')''', '''size(w) - if(get(w, 0) = '', 1, 0) - if(size(w) > 1 AND get(w, size(w) - 1) = '', 1, 0)''')}, 0) AS BIGINT)")
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), _key(text).alias("row_key"), n_words.alias("n_words"))
    both = rows.join(found, F.col("row_key") == F.col("key"), "left")
    n_hit = F.expr("CAST(coalesce(aggregate(spans, 0, (n, s) -> n + s.end - s.first), 0) AS BIGINT)")
    none = F.expr("CAST(array() AS ARRAY<STRUCT<first: INT, end: INT>>)")
    return both.select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("spans", none).alias("spans"),
        F.coalesce("items", F.expr("CAST(array() AS ARRAY<STRING>)")).alias("items"),
        F.col("key").isNotNull().alias("contaminated"),
    )


def remove(scanned: DataFrame, text: str = "text", whole: bool = False) -> DataFrame:
    """What ``scan`` gave, with the texts' hit spans taken out; ``whole``: without contaminated documents.

    A span goes from its first word's first to its last word's last
    character; what stands around it stays. The columns that ``scan`` added go.
    """
    added = ("n_words", "n_hit", "spans", "items", "contaminated")
    if whole:
        return scanned.where("NOT contaminated").drop(*added)
    body = f"`{text}`"
    # the i-th word follows the i-th piece between words; what stays of words i to z - 1 is each piece and word
    pieces, own = f"split({body}, '{_WORD}')", f"filter(split({body}, '{_BETWEEN_ANY_CASE}'), word -> word <> '')"
    stays = lambda a, z: let("a", a, let("z", z, "if(z <= a, '', array_join(transform(sequence(a, z - 1), k -> concat(get(g, k), get(v, k))), ''))"))
    before = f"concat({stays('if(i = 0, 0, get(spans, i - 1).end)', 's.first')}, get(g, s.first))"
    after = f"concat({stays('get(spans, size(spans) - 1).end', 'size(v)')}, get(g, size(v)))"
    whole_text = let("g", pieces, let("v", own, f"concat(array_join(transform(spans, (s, i) -> {before}), ''), {after})"))
    return scanned.withColumn(text, F.expr(f"CASE WHEN size(spans) > 0 THEN {whole_text} ELSE {body} END")).drop(*added)
