"""Near-duplicate texts: a join on the Jaccard similarity of word shingles.

Candidates come from an LSH forest. Each of TREES trees is a trie of labels, of
DEPTH MinHash values each, kept as a sorted list: texts that share a prefix
stand in a row. How long a prefix must be is fitted: it starts at DEPTH and is
shortened until pairs at the threshold are found with the target recall, by law
and measured on a changed copy of each set. The lists are range-partitioned,
and rows of a shared prefix are followed across boundaries. Texts that share a
prefix form a group, and every pair in it is then compared exactly, by the
shingles themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.llm.anchors import mixed
from marlstone.llm.batches import small_batches
from marlstone.llm.components import components
from marlstone.sources import materialize

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 64, 16, 0.99999
#: MinHash functions. The first 8 values of all trees are of as many functions, so that trees are independent; deeper ones are shared.
FUNCTIONS = 512
#: A group with more texts, or more shingles, is compared in pairs of blocks.
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 2_000_000
#: Distinct texts whose keys a task remembers having put out.
REMEMBERED = 100_000

_RNG = np.random.default_rng(7_919)
_A = _RNG.integers(1, 1 << 32, FUNCTIONS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, FUNCTIONS, dtype=np.uint64).astype(np.uint32)
_ORDER = np.hstack([np.arange(FUNCTIONS).reshape(TREES, -1), np.roll(np.arange(FUNCTIONS).reshape(TREES, -1), 1, axis=0)])[:, :DEPTH]
_PLACE = _RNG.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def shingles(raw: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of each SHINGLE words in a row; of all words where there are fewer; none without words."""
    words = raw.split()  # of bytes: at ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    k = min(SHINGLE, len(h))
    n = len(h) - k + 1
    with np.errstate(over="ignore"):
        total = np.full(n, np.uint64(k))
        for j in range(k):
            total += h[j : j + n] * _PLACE[j]
    return np.unique(mixed(total))


def minhashes(found: np.ndarray) -> np.ndarray:
    """The least value of each function over a set of shingles."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(FUNCTIONS, np.iinfo(np.uint32).max, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), 256):
            least = np.minimum(least, (x[at : at + 256, None] * _A + _B).min(axis=0))
    return least


def labels(signature: np.ndarray) -> np.ndarray:
    """Each tree's label: DEPTH values of a byte each, of which equal MinHash values have equal ones."""
    with np.errstate(over="ignore"):
        return ((signature[_ORDER] * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def packed(label: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``depth`` values of each label in two numbers that sort as they do."""
    cut = np.zeros((len(label), 16), np.uint8)
    cut[:, :depth] = label[:, :depth]
    two = np.ascontiguousarray(cut).view(">u8") ^ np.uint64(1 << 63)
    return two[:, 0].astype(np.uint64).view(np.int64), two[:, 1].astype(np.uint64).view(np.int64)


def tried(found: np.ndarray, threshold: float) -> tuple[np.ndarray, int | None]:
    """A set's labels, and the longest prefix that it shares in any tree with a copy of it that was changed to the threshold or just above.

    No such length (None) for sets so small that a change would take them below
    the threshold: they would only be compared with themselves. The two sets'
    MinHash values are the lesser ones of what both have and what each has alone.
    """
    changed = int(len(found) * (1 - threshold) / (1 + threshold) + 1e-9)
    if not changed:
        return labels(minhashes(found)), None
    rng = np.random.default_rng(int(found[0]))
    dealt = rng.permutation(found)
    both = minhashes(dealt[changed:])
    own, copy = (labels(np.minimum(both, minhashes(alone))) for alone in (dealt[:changed], rng.integers(0, 1 << 63, changed, dtype=np.uint64)))
    return own, int(np.logical_and.accumulate(own == copy, axis=1).any(axis=0).sum())


def longest_prefix(threshold: float, recall: float) -> int:
    """The most values of a label for which a pair whose similarity is the threshold itself is found, by law, with the target recall."""
    return max((depth for depth in range(1, DEPTH + 1) if 1 - (1 - threshold**depth) ** TREES >= recall), default=1)


def fitted(sets: DataFrame, longest: int, recall: float) -> int:
    """``longest``, shortened until, of all ``sets`` with a length ``reach``, the target share reaches it. The driver gets a count for each length."""
    n = {r["reach"]: r["count"] for r in sets.where("reach IS NOT NULL").groupBy("reach").count().collect()}
    return max((depth for depth in range(1, longest + 1) if sum(c for reach, c in n.items() if reach >= depth) >= recall * sum(n.values())), default=1)


def prefix_depth(texts: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """How many values of a label two texts must share: DEPTH, shortened until pairs at the threshold are found with the target recall.

    What the law gives for a pair whose similarity is the threshold itself must
    reach the target, whatever the corpus, so that short texts count as long
    ones do. So must what is measured, on a changed copy of each distinct set.
    """
    longest = longest_prefix(threshold, recall)
    rows = texts.select(F.lit(0).cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.lit(0).cast("long").alias("text_hash"))
    return fitted(signed(rows, threshold, longest).groupBy("node").agg(F.max("reach").alias("reach")), longest, recall)


def _signer(threshold: float, depth: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, text, text_hash to the set's hash (null without words), its size and, once for each set in a task, what its copy shares and its labels."""
        done: set[int] = set()
        for batch in batches:
            nodes, sizes, reach, high, low = [], [], [], [], []
            for text in batch.column(1):
                found = shingles(bytes(text.as_buffer() or b""))
                node = xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63) if len(found) else None
                nodes.append(node)
                sizes.append(len(found))
                if node is None or node in done:
                    reach.append(None)
                    high.append(None)
                    low.append(None)
                    continue
                if len(done) >= REMEMBERED:
                    done.clear()
                done.add(node)
                label, shared = tried(found, threshold)
                a, b = packed(label, depth)
                reach.append(shared)
                high.append(a)
                low.append(b if depth > 8 else None)
            columns = [batch.column(0), batch.column(2), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(reach, pa.int32()), _lists(high), _lists(low)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "node", "size", "reach", "high", "low"])

    return sign


def signed(texts: DataFrame, threshold: float, depth: int) -> DataFrame:
    """Each row of (doc_id, text, text_hash) with its set's hash, size, ``reach`` and labels of ``depth`` values."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_signer(threshold, depth), f"doc_id {kind}, text_hash long, node long, size long, reach int, high array<long>, low array<long>")


def _cut(label: Column, values: int) -> Column:
    """A number of ``packed`` with its first ``values`` values alone."""
    mask = (1 << 64) - (1 << 8 * (8 - min(8, max(0, values))))
    return label.bitwiseAND(F.lit(mask - (1 << 64) if mask else 0).cast("long"))


def _lists(parts: list[np.ndarray | None]) -> pa.Array:
    """A column of lists, empty for None."""
    offsets = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([x for x in parts if x is not None] or [np.zeros(0, np.int64)])))


def _rows_of_a_prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (tree, high, low, node) to (node, first): the first node with its prefix, where that is another.

    The first and last rows of the partition come again, with ``first`` null
    and their prefix, as the nodes with it may go on in other partitions.
    """
    last, head = None, 0
    names = ["tree", "high", "low", "node", "first"]
    for batch in batches:
        if not len(batch):
            continue
        prefix = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)])
        node = batch.column(3).to_numpy()
        new = np.ones(len(node), bool)
        new[1:] = (prefix[:, 1:] != prefix[:, :-1]).any(axis=0)
        if last is None:
            yield _end(batch, names)
        else:
            new[0] = (prefix[:, 0] != last).any()
        begin = np.maximum.accumulate(np.where(new, np.arange(len(node)), -1))
        first = np.where(begin < 0, head, node[np.maximum(begin, 0)])
        hit = np.flatnonzero(first != node)
        if len(hit):
            nothing = pa.nulls(len(hit), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(hit), pa.int32()), nothing, nothing, pa.array(node[hit]), pa.array(first[hit])], names=names)
        last, head, ends = prefix[:, -1], first[-1], batch.slice(len(batch) - 1, 1)
    if last is not None:
        yield _end(ends, names, head)


def _end(batch: pa.RecordBatch, names: list[str], head: int | None = None) -> pa.RecordBatch:
    """The first row of ``batch`` for the partition's neighbours to see; ``head``: the first node with its prefix, to stand for it."""
    one = batch.slice(0, 1)
    node = one.column(3) if head is None else pa.array([head], pa.int64())
    return pa.RecordBatch.from_arrays([one.column(0), one.column(1), one.column(2), node, pa.nulls(1, pa.int64())], names=names)


def chains(leaves: DataFrame) -> DataFrame:
    """(a, b) that hold together all nodes with a common prefix, from (tree, high, low, node).

    A range partitioning by prefix and node cuts the sorted lists, so a prefix
    that very many nodes have is spread over partitions; two rows of each
    partition meet to join what was cut.
    """
    in_order = ("tree", "high", "low", "node")
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = leaves.repartitionByRange(parts, *in_order).sortWithinPartitions(*in_order).mapInArrow(_rows_of_a_prefix, "tree int, high long, low long, node long, first long")
    found = materialize(found, "forest-rows")
    ends = found.where("first IS NULL")
    least = ends.groupBy("tree", "high", "low").agg(F.min("node").alias("first"))
    across = ends.drop("first").join(least, ["tree", "high", "low"])
    return found.where("first IS NOT NULL").unionByName(across.select(*found.columns)).select(F.col("node").alias("a"), F.col("first").alias("b")).where("a <> b")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A node's columns, of which text is the last, with its shingles in place of the text."""
    for batch in batches:
        at = 0
        while at < len(batch):  # slices, as a set is larger than its text can be
            end, held, out = at, 0, []
            while end < len(batch) and held < 1 << 22:
                out.append(shingles(bytes(batch.columns[-1][end].as_buffer())).tobytes())
                held += len(out[-1])
                end += 1
            part = batch.slice(at, end - at)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out, pa.binary())], names=[*batch.schema.names[:-1], "found"])
            at = end


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Numbers of common elements of each pair of sets: exact, by products of their incidence matrices in strips of columns.

    Elements in one set alone add to no pair and are left out first.
    """
    sets = left + (right or [])
    size = np.array([len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(sets)), size), count[column] > 1
    all_of = int((count == len(sets)).sum())
    shared &= count[column] < len(sets)
    row, column = row[shared], column[shared]
    number = np.unique(column, return_inverse=True)[1]
    width = int(number.max()) + 1 if len(number) else 0
    k = len(left)
    total = np.full((k, len(right) if right is not None else k), all_of, np.float64)
    order = np.argsort(number, kind="stable")
    row, number = row[order], number[order]
    strip = max(64, (1 << 22) // len(sets))
    for begin in range(0, width, strip):
        a, b = np.searchsorted(number, [begin, begin + strip])
        dense = np.zeros((len(sets), min(strip, width - begin)), np.float32)
        dense[row[a:b], number[a:b] - begin] = 1
        total += dense[:k] @ (dense[k:] if right is not None else dense).T
    return total


def links(sets: list[np.ndarray], second: np.ndarray | None, threshold: float) -> np.ndarray:
    """A symmetric matrix of which sets are as similar as the threshold. ``second``: compare only pairs across this mark."""
    n, size = len(sets), np.array([len(s) for s in sets])
    if second is None:
        common = overlaps(sets)
    else:
        a, b = np.flatnonzero(~second), np.flatnonzero(second)
        common = np.zeros((n, n))
        if len(a) and len(b):
            across = overlaps([sets[i] for i in a], [sets[i] for i in b])
            common[np.ix_(a, b)], common[np.ix_(b, a)] = across, across.T
    near = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
    near &= common > 0
    np.fill_diagonal(near, False)
    return near


def roots(near: np.ndarray) -> np.ndarray:
    """The least index of each index's component."""
    root = np.full(len(near), -1)
    for i in range(len(near)):
        if root[i] < 0:
            root[i], ahead = i, np.array([i])
            while len(ahead):
                ahead = np.flatnonzero(near[ahead].any(axis=0) & (root < 0))
                root[ahead] = i
    return root


def _comparer(threshold: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (comp, i, j) to each node's linked texts in the group or pair of blocks, and the least node it hangs together with."""
        group: list[tuple] = []
        at = None
        names = ["node", "linked", "root", "several"]

        def finish() -> Iterator[pa.RecordBatch]:
            if len(group) > 1:
                group.sort(key=lambda r: r[4])
                nodes, copies = np.array([r[4] for r in group]), np.array([r[5] for r in group], np.float64)
                second = np.array([r[3] for r in group]) == group[0][2] if group[0][1] != group[0][2] else None
                near = links([np.frombuffer(r[6], np.uint64) for r in group], second, threshold)
                hit = near.any(axis=1)
                if hit.any():
                    linked, root = (near @ copies).round().astype(np.int64), nodes[roots(near)]
                    several = np.array([r[7] for r in group])
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[hit]), pa.array(linked[hit]), pa.array(root[hit]), pa.array(several[hit])], names=names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != at:
                    yield from finish()
                    group, at = [], row[:3]
                group.append(row)
        yield from finish()

    return compare


def _size_rank(threshold: float) -> Column:
    """Sets as similar as ``threshold`` are of one rank of size or of neighbouring ones, as their sizes are as alike as they."""
    return F.floor(F.ln("size") / (math.log(1 / threshold) * 1.0001)).cast("int") if threshold < 1 else F.col("size").cast("int")


def _blocks(candidates: DataFrame, threshold: float) -> DataFrame:
    """For each group and rank of size: its blocks, from ``begin`` on, and those from ``low`` up to ``high`` that they are compared with.

    A group that one block holds is one block. The blocks of a larger one hold one rank each.
    """
    whole = F.ceil(F.greatest(F.count("*") / BLOCK_TEXTS, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    ranks = candidates.groupBy("comp", "rank").agg(whole, F.count("*").alias("n"), F.sum("size").alias("shingles"))
    of_group = Window.partitionBy("comp")  # a few ranks a group
    small = (F.sum("n").over(of_group) <= BLOCK_TEXTS) & (F.sum("shingles").over(of_group) <= BLOCK_SHINGLES)
    ranks = ranks.withColumn("small", small).withColumn("blocks", F.when(F.col("small"), 1).otherwise(F.col("blocks")))
    in_order = of_group.orderBy("rank")
    upto = F.sum("blocks").over(in_order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    ranks = ranks.withColumn("end", upto).withColumn("begin", F.col("end") - F.col("blocks"))
    below = F.when(F.lag("rank").over(in_order) == F.col("rank") - 1, F.lag("begin").over(in_order))
    above = F.when(F.lead("rank").over(in_order) == F.col("rank") + 1, F.lead("end").over(in_order))
    ranks = ranks.withColumns({"low": F.coalesce(below, F.col("begin")), "high": F.coalesce(above, F.col("end"))})
    alone = lambda c, v: F.when(F.col("small"), v).otherwise(F.col(c)).cast("int").alias(c)
    return ranks.select("comp", "rank", "blocks", alone("begin", 0), alone("low", 0), alone("high", 1))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, text_hash, class_id, copies, n_links and first of every row of ``docs``.

    Two texts are linked if the Jaccard similarity of their sets of SHINGLE
    words in a row is ``threshold`` or more; words are cut at ASCII white
    space, and fewer words than SHINGLE make one shingle. A class is what
    links hold together, and class_id the least doc_id in it. n_links counts
    the other rows that are linked with a row, copies included: ``copies`` rows
    have its very set. ``first`` marks one row (or several, if wholly the same)
    of each class, that of the least doc_id. Texts without words are linked
    with none. A null doc_id gives no name to a class; where it has no other,
    its class_id is null. Rows that repeat an id are texts of their own.

    Every pair that shares a tree's prefix is compared, whatever the group's
    size; a large one is compared in pairs of blocks of sets of like sizes, so
    that a task holds 2 * BLOCK_TEXTS sets at most. Sets are named by 64-bit
    hashes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text")).select("doc_id", "text", "text_hash")
    longest = longest_prefix(threshold, recall)
    trees = materialize(signed(texts, threshold, longest), "forest")
    members = trees.select("doc_id", "text_hash", "node", "size")

    of_node = [F.count("*").alias("copies"), F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_hash")).alias("one"), F.first("size").alias("size"), F.max("reach").alias("reach")]
    by_node = materialize(trees.where("node IS NOT NULL").groupBy("node").agg(*of_node), "forest-nodes")
    depth = fitted(by_node, longest, recall)
    by_node = by_node.drop("reach")

    leaves = trees.select("node", "low", F.posexplode("high").alias("tree", "high"))
    low = F.coalesce(F.get("low", "tree"), F.lit(0).cast("long"))
    leaves = leaves.select("tree", _cut(F.col("high"), depth).alias("high"), _cut(low, depth - 8).alias("low"), "node")
    chained = chains(leaves)
    groups = materialize(components(chained, "forest-chains"), "forest-groups")

    candidates = by_node.join(groups.select("node", F.col("root").alias("comp")), "node").withColumn("rank", _size_rank(threshold))
    candidates = candidates.join(materialize(_blocks(candidates, threshold), "forest-blocks"), ["comp", "rank"]).withColumn("mine", F.col("begin") + F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    candidates = candidates.select("comp", "node", "copies", "mine", "low", "high", F.col("one.doc_id").alias("of_id"), F.col("one.text_hash").alias("of_hash"))
    own = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash"))
    # a row that is repeated as a whole brings its set's node once; partial aggregates collapse it before texts are shuffled
    chosen = texts.join(candidates, own).select("comp", "node", "copies", "mine", "low", "high", "text").dropDuplicates(["node"])
    found = chosen.mapInArrow(_sets, "comp long, node long, copies long, mine int, low int, high int, found binary")
    dealt = found.withColumn("other", F.explode(F.expr("sequence(low, high - 1)")))
    dealt = dealt.select("comp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "copies", "found", (F.col("high") - F.col("low") > 1).alias("several"))
    compared = dealt.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(_comparer(threshold), "node long, linked long, root long, several boolean")
    compared = materialize(compared, "forest-links")

    final = compared.where("NOT several").select("node", "root")
    if not compared.where("several").isEmpty():
        final = final.unionByName(components(compared.where("several").select(F.col("node").alias("a"), F.col("root").alias("b")), "forest-classes"))
    counted = compared.groupBy("node").agg(F.sum("linked").alias("linked"))
    known = by_node.join(final, "node", "left").join(counted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # the classes' names come from sets, not rows: copies have been counted before
    named = known.groupBy("root").agg(F.min("least_id").alias("class_id"), F.min("one").alias("first_one"))
    known = known.join(named, "root").select("node", "class_id", "first_one", "copies", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    alone = F.col("node").isNull()
    first = F.col("doc_id").eqNullSafe(F.col("first_one.doc_id")) & (F.col("text_hash") == F.col("first_one.text_hash"))
    return members.join(known, "node", "left").select(
        "doc_id",
        "text_hash",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("copies", F.lit(1)).alias("copies"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        (alone | first).alias("first"),
    )


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class of near duplicates: that of the least doc_id, once. Texts without words all stay.

    Columns of ``docs`` keep their names, whatever these are.
    """
    judged = near_duplicates(docs, threshold)
    kept = judged.where("first").groupBy(F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).alias("key")).agg((F.max("copies") > 1).alias("copied"))
    kept = materialize(kept, "forest-kept")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.struct(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("hash")).alias("row_key"))
    rows = rows.join(kept, F.col("row_key.id").eqNullSafe(F.col("key.id")) & (F.col("row_key.hash") == F.col("key.hash")))
    # of rows that repeat an id and a text one stays, with partial aggregates; all others pass as they are, as many as have one id
    one = rows.where("copied").groupBy("row_key").agg(F.first("row").alias("row")).select("row.*")
    return rows.where("NOT copied").select("row.*").unionByName(one)
