"""Mixing sources to target weights.

Each source's documents are dealt by hash to blocks. From the targets follow
how many whole passes over its blocks a source gives, and which of its blocks,
in permuted order, are drawn once more. A splitting tree then partitions the
drawn blocks among output shards: at each node half of them go left, and how
many of each source these are is a multivariate hypergeometric draw. So every
shard has the composition that a shuffle of all blocks would give it, and what
it draws is a range of each source's permuted blocks, disjoint from all others.
Documents are shuffled only within their shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.llm.native import let, words
from marlstone.operators.order import numbered
from marlstone.sources import materialize

#: Weights of the sources in order, repeating; the mix's size over that of all sources; the most passes over a source.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: A block is about so many words, and so many documents, at most; a shard about so many words.
BLOCK_WORDS, BLOCK_DOCS, SHARD_WORDS = 100_000, 10_000, 50_000_000
SEED = 20_240_101
#: Columns that a row has on its way; those of the input with these names don't pass.
PASSING = ("blocks", "passes", "reached", "shards", "cut_hash", "cut_size", "cut_copies", "cut_taken", "split_copies", "more", "own", "nth", "sets_ahead")
#: The tree is split as far as so many nodes in one task, and each of these in one of its own.
TOP = 256


def count_words(text: str) -> Column:
    """Words of a text: runs of characters other than ASCII white space; 0 for null."""
    return F.expr(f"CAST(coalesce({let('w', words(f'`{text}`'), 'size(w)')}, 0) AS BIGINT)")


def targets(sources: DataFrame) -> DataFrame:
    """Adds weight and target to a table of (source, source_size), one row for each source.

    Sources in the order of their code points, null last, weigh WEIGHTS,
    repeating. They share SHARE of all sizes by weight; a target stops at MOST
    times its source's size, and the excess goes to the others by weight until
    none is above. That leaves one level for all that are not stopped: it is
    found by taking sources in the order in which they reach their stops.
    """
    in_order = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.get(F.array(*(F.lit(float(w)) for w in WEIGHTS)), F.pmod(F.row_number().over(in_order) - 1, F.lit(len(WEIGHTS))))
    weighed = sources.withColumn("weight", weight).withColumn("stop", MOST * F.col("source_size") / F.col("weight"))
    by_stop = Window.orderBy("stop", F.asc_nulls_last("source"))
    before, rest = by_stop.rowsBetween(Window.unboundedPreceding, -1), by_stop.rowsBetween(0, Window.unboundedFollowing)
    every = by_stop.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = SHARE * F.sum("source_size").over(every) - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = (left / F.sum("weight").over(rest)).alias("level")
    found = weighed.select("*", level)
    final = F.max(F.when(F.col("level") <= F.col("stop"), F.col("level"))).over(every)
    return found.withColumn("target", F.least(MOST * F.col("source_size").cast("double"), F.coalesce(final, F.lit(0.0)) * F.col("weight"))).drop("stop", "level")


def split(counts: np.ndarray, shards: int, seed: int, node: int = 1) -> Iterator[np.ndarray]:
    """How many blocks of each source each of ``shards`` (a power of two) below ``node`` gets; sums are exact.

    Only the counts on the way to the present leaf are held. Each node draws
    from a generator seeded with its own number, so subtrees can be split apart.
    """
    stack = [(counts.astype(np.int64), shards, node)]
    while stack:
        here, leaves, node = stack.pop()
        if leaves == 1:
            yield here
            continue
        rng = np.random.default_rng([seed, node])
        left = np.zeros_like(here)
        want, rest = int(here.sum()) // 2, int(here.sum())
        for i, n in enumerate(here):  # one source after another, each given those before it
            rest -= int(n)
            left[i] = _hypergeometric(rng, int(n), rest, want)
            want -= int(left[i])
        stack += [(here - left, leaves // 2, 2 * node + 1), (left, leaves // 2, 2 * node)]


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """A hypergeometric draw; beyond numpy's bound of 1e9 by inversion of the law, to the precision of doubles."""
    if not good or not sample:
        return 0
    if not bad:
        return sample
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, sample))
    # outwards from the mode, each number's probability follows from its neighbour's
    least, most = max(0, sample - bad), min(good, sample)
    mode = min(max((sample + 1) * (good + 1) // (good + bad + 2), least), most)
    ways = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = math.exp(ways(good, mode) + ways(bad, sample - mode) - ways(good + bad, sample))
    low = high = mode
    p_low = p_high = p
    rest = rng.random() - p
    while rest > 0 and (p_low > 1e-30 or p_high > 1e-30):
        if high < most:
            p_high *= (good - high) / (high + 1) * ((sample - high) / (bad - sample + high + 1))
            high, rest = high + 1, rest - p_high
            if rest <= 0:
                return high
        else:
            p_high = 0.0
        if low > least:
            p_low *= low / (good - low + 1) * ((bad - sample + low) / (sample - low + 1))
            low, rest = low - 1, rest - p_low
            if rest <= 0:
                return low
        else:
            p_low = 0.0
    return mode


def mix(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", with_text: bool = True) -> DataFrame:
    """Every row with size, source_size, target, taken and draws.

    ``size`` is the text's words. ``taken`` is how many of them the mix takes,
    repeats counted: ``size``, or 0 or MOST times that. By source their sum
    is within half a document of the target. ``draws`` lists them: structs of
    shard, the number of shards and a key to sort a shard by. Texts are always taken whole. Rows
    agree from run to run, however they are partitioned. Null sources are one source; a null text has no
    words. Columns of ``docs`` with these names are replaced. Without
    ``with_text`` only id_column is kept of ``docs``, and no text is shuffled.

    Rows that repeat an id, a text and a source are one row with a number of copies to all that plans
    the mix; of the copies at which the quota runs out, as many are taken as fit, those
    with the least hashes of their row. Blocks have bounded words and rows but for copies. They are put in
    order, and their words added up, by ranges of that order, and a row learns from its
    block alone whether it is taken, without a window, so that neither
    a source nor a set of copies of any size is one task's.
    """
    made = ["size", "source_size", "target", "taken", "draws", "mix_key", "mix_hash", "mix_block", *PASSING]
    docs = docs.drop(*made)
    keyed = {"size": count_words(text), "mix_key": F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null")), "mix_hash": _draw(F.concat(F.lit(f"{SEED}|"), F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text), F.lit(""))))}
    skinny = materialize(docs.select(id_column, F.col(source).alias("source"), text).withColumns(keyed).drop(text), "mix-sizes")
    sets = materialize(skinny.groupBy("source", "mix_key", "mix_hash", "size").agg(F.count("*").alias("copies")), "mix-sets")
    sums = sets.groupBy("source", "mix_key").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("n"))
    blocks_of = F.ceil(F.greatest(F.col("source_size") / BLOCK_WORDS, F.col("n") / BLOCK_DOCS)).cast("long").alias("blocks")
    quota = F.least(F.round("target").cast("long"), MOST * F.col("source_size"))
    passes = F.when(F.col("source_size") > 0, F.expr("quota DIV source_size")).otherwise(0)
    sources = targets(sums.select("*", blocks_of)).withColumn("quota", quota).withColumn("passes", passes).withColumn("rest", F.col("quota") - F.col("passes") * F.col("source_size"))
    sources = materialize(sources.drop("source", "n"), "mix-sources")

    block = F.pmod("mix_hash", "blocks").alias("mix_block")
    dealt = sets.join(sources, "mix_key").select("mix_key", block, "mix_hash", "size", "copies", "rest", "passes")
    sized = dealt.groupBy("mix_key", "mix_block").agg(F.sum(F.col("size") * F.col("copies")).alias("words"), F.first("rest").alias("rest"), F.first("passes").alias("passes"))
    permuted = numbered(sized.withColumn("permuted", _draw(F.concat(F.lit(f"{SEED}|"), F.col("mix_block").cast("string")))), ["mix_key", "permuted", "mix_block"], {"upto": F.col("words")}, "number")
    # where each source's blocks begin: one row a source
    starts = permuted.groupBy("mix_key").agg(F.min("number").alias("first"), F.count("*").alias("in_source"), F.min(F.col("upto") - F.col("words")).alias("ahead"))
    before = F.col("upto") - F.col("words") - F.col("ahead")
    extra = F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - before)).cast("long")
    # the blocks that a last pass reaches come first, so that the numbers of drawn blocks have no gaps
    blocks = permuted.join(starts, "mix_key").withColumns({"extra": extra, "reached": before < F.col("rest"), "position": F.col("number") - F.col("first")})
    blocks = materialize(blocks.select("mix_key", "mix_block", "words", "passes", "extra", "reached", "position", "in_source"), "mix-blocks")

    # where the quota runs out within a block, one a source at most: the first set of copies of which not all are taken
    edges = dealt.drop("passes").join(blocks.where("extra > 0 AND extra < words").select("mix_key", "mix_block", "extra"), ["mix_key", "mix_block"])
    within = Window.partitionBy("mix_key", "mix_block").orderBy("mix_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("extra") - F.coalesce(F.sum(F.col("size") * F.col("copies")).over(within), F.lit(0))
    # a document is taken if the quota comes nearer to its end than to its start
    fit = F.when(2 * room >= F.col("size"), F.expr("(2 * room - size) DIV (2 * size) + 1")).otherwise(0)
    edges = edges.where("size > 0").withColumn("room", room).withColumn("cut_taken", F.least("copies", fit)).where("cut_taken < copies")
    first = F.struct("mix_hash", "size", "copies", "cut_taken")
    cuts = edges.groupBy("mix_key", "mix_block").agg(F.min(first).alias("cut"))
    cuts = materialize(cuts.select("mix_key", "mix_block", F.col("cut.mix_hash").alias("cut_hash"), F.col("cut.size").alias("cut_size"), F.col("cut.copies").alias("cut_copies"), F.col("cut.cut_taken").alias("cut_taken")), "mix-cuts")

    # each drawn block has a number among its source's: pass by pass, in permuted order
    drawn = blocks.select("mix_key", "mix_block", "words", F.explode(F.expr("filter(sequence(0, 2), p -> p < passes OR (p = passes AND reached))")).alias("pass"), (F.col("pass") * F.col("in_source") + F.col("position")).cast("long").alias("number"))
    drawn_of = drawn.groupBy("mix_key").agg(F.count("*").alias("drawn"), F.sum(F.col("words")).alias("words"))
    nodes = drawn_of.coalesce(1).mapInPandas(_tops(SHARD_WORDS), "mix_key string, node long, shards long, first long, n long")
    dealt = nodes.repartition(min(TOP, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "node").sortWithinPartitions("node", "mix_key").mapInPandas(_leaves, "mix_key string, shard long, of long, first long, n long")
    ranges = dealt.where("n > 0").select("mix_key", "shard", "of", F.explode(F.expr("sequence(first, first + n - 1)")).alias("number"))
    shards = drawn.join(ranges, ["mix_key", "number"]).groupBy("mix_key", "mix_block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard", "of"))).alias("shards"))
    plan = blocks.select("mix_key", "mix_block", "passes", (F.col("extra") > 0).alias("reached")).join(shards, ["mix_key", "mix_block"], "left").join(cuts, ["mix_key", "mix_block"], "left")

    base = docs.withColumns(keyed) if with_text else skinny.drop("source")
    rows = _planned(base, sources, plan)
    split = cuts.where("cut_taken > 0")
    if not split.isEmpty():  # of a set of copies, one a source at most, some are taken: its rows are numbered
        ours = base.join(split.select("mix_key", F.col("cut_hash").alias("mix_hash")), ["mix_key", "mix_hash"], "left_semi")
        own = F.xxhash64(*(F.col(f"`{c}`") for c in (docs.columns if with_text else [id_column]) if "map<" not in base.schema[c].dataType.simpleString()))
        copies = numbered(_planned(ours, sources, plan).where("split_copies").withColumn("own", own), ["mix_key", "own"], row_number="nth")
        ahead = split.withColumn("sets_ahead", F.coalesce(F.sum("cut_copies").over(Window.orderBy("mix_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a source
        copies = copies.join(ahead.select("mix_key", "sets_ahead"), "mix_key").withColumn("more", F.when(F.col("nth") - F.col("sets_ahead") <= F.col("cut_taken"), F.col("size")).otherwise(0).cast("long"))
        rows = rows.where("NOT split_copies").unionByName(copies.select(*rows.columns))
    one = "named_struct('shard', d.shard, 'of', d.of, 'key', xxhash64(mix_hash, d.pass))"
    draws = F.expr(f"coalesce(transform(filter(shards, d -> size > 0 AND (d.pass < passes OR more > 0)), d -> {one}), array())")
    return rows.withColumns({"taken": F.col("passes") * F.col("size") + F.col("more"), "draws": draws}).select(
        *(docs.columns if with_text else [id_column]), "size", "source_size", "target", "taken", "draws"
    )


def _planned(rows: DataFrame, sources: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with what the plan has for their blocks, and ``more``: the words that a last pass takes; ``split_copies`` marks those of a set of which some are taken."""
    rows = rows.join(sources.select("mix_key", "blocks", "source_size", "target"), "mix_key").withColumn("mix_block", F.pmod("mix_hash", "blocks"))
    rows = rows.join(plan, ["mix_key", "mix_block"])
    at, cut = F.struct("mix_hash", "size"), F.struct(F.col("cut_hash").alias("mix_hash"), F.col("cut_size").alias("size"))
    whole = F.col("reached") & (F.col("cut_hash").isNull() | (at < cut))
    more = F.when(whole, F.col("size")).otherwise(0).cast("long")
    return rows.withColumns({"split_copies": F.coalesce((F.col("cut_taken") > 0) & (at == cut), F.lit(False)), "more": more})


def _tops(shard_words: int):
    """A function for one task, which reads one row a source: how many of each source's drawn blocks go to each of TOP nodes at most."""

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        table = pd.concat(parts).sort_values("mix_key") if parts else pd.DataFrame()
        if not len(table):
            return
        counts, total = table["drawn"].to_numpy(), int(table["words"].sum())
        shards = 1
        while shards * shard_words < total:
            shards *= 2
        first, tops = np.zeros(len(table), np.int64), min(shards, TOP)
        for i, got in enumerate(split(counts, tops, SEED)):
            yield pd.DataFrame({"mix_key": table["mix_key"], "node": np.int64(tops + i), "shards": np.int64(shards // tops), "first": first, "n": got})
            first = first + got

    return deal


def _leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of nodes, sorted by node and source, to each shard's range of each source's drawn blocks."""
    held: list[pd.DataFrame] = []

    def finish() -> Iterator[pd.DataFrame]:
        table = pd.concat(held)
        node, shards, first = int(table["node"].iloc[0]), int(table["shards"].iloc[0]), table["first"].to_numpy()
        tops = 1 << (node.bit_length() - 1)
        begin = (node - tops) * shards
        for i, got in enumerate(split(table["n"].to_numpy(), shards, SEED, node)):
            yield pd.DataFrame({"mix_key": table["mix_key"].to_numpy(), "shard": np.int64(begin + i), "of": np.int64(tops * shards), "first": first, "n": got})
            first = first + got

    for frame in frames:
        for node, part in frame.groupby("node", sort=False):
            if held and int(held[0]["node"].iloc[0]) != node:
                yield from finish()
                held = []
            held.append(part)
    if held:
        yield from finish()


def _draw(key: Column) -> Column:
    """A number from 0 to 2^60 - 1 by MD5, the same in any SQL engine."""
    return F.conv(F.left(F.md5(key.cast("binary")), F.lit(15)), 16, 10).cast("long")


def written_out(mixed: DataFrame) -> DataFrame:
    """A row for each draw, with ``shard``: the mix itself. Every text is whole.

    A shard is sorted by its draws' keys. Partitions hold ranges of shards and
    keys that follow each other: as keys are uniform and shards alike in size,
    they are cut evenly, without sampling.
    """
    parts = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = mixed.withColumn("draw", F.explode("draws"))
    rows = rows.withColumns({"shard": F.col("draw.shard"), "shards": F.col("draw.of"), "shard_key": F.col("draw.key")})
    at = F.expr(f"CAST(least({parts - 1}, floor((shard + shard_key / {2.0**64!r} + 0.5) / shards * {parts})) AS INT)")
    rows = rows.drop("draw", "draws", "size", "source_size", "target", "taken")
    return rows.repartitionById(parts, at).sortWithinPartitions("shard", "shard_key").drop("shard_key", "shards")
