"""Hard-negative mining: ball trees searched by branch and bound.

Rows are held in ball trees of TREE_ROWS rows, which tasks build of what they
read, so no row is shuffled and no tree grows with the corpus. Anchors are
broadcast in blocks of bounded size. A node's inner products with an anchor lie
within its centre's, more or less the anchor's norm times the radius: nodes
outside the window of scores, or strictly beneath the k-th found so far, are
passed over with all below them. What each task has found of an anchor are k
rows at most, and the best of all tasks are ranked by a window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.sources import materialize, shared_path

#: Each component x becomes floor(SCALE * x).
SCALE = 256
#: Rows of a tree, rows of a leaf, anchors of a block.
TREE_ROWS, LEAF_ROWS, BLOCK_ANCHORS = 16_384, 128, 8_192
#: Scores are exact below this bound; rows that could give greater ones are an error.
EXACT = 1 << 53

_NONE = np.iinfo(np.int64).min
FOUND = "anchor long, slot int, score long, vec_id long"


@dataclass
class Ball:
    """A node: its rows' places in the tree, centre, radius, the labels in it as bits, and its label if there is one only."""

    begin: int
    end: int
    centre: np.ndarray
    radius: float
    bits: np.uint64
    only: int | None
    parts: tuple[Ball, Ball] | None


def _bit(label: np.ndarray) -> np.ndarray:
    """Each label's bit of 64: a node without a label's bit has none of its rows."""
    return np.uint64(1) << (label.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58))


def ball_tree(rows: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, Ball]:
    """An order of ``rows`` and the tree over them in that order: a node is cut at the median along the line between two rows far apart."""
    order = np.arange(len(rows))

    def node(begin: int, end: int) -> Ball:
        own = rows[order[begin:end]]
        centre = own.mean(axis=0)
        away = ((own - centre) ** 2).sum(axis=1)
        radius = float(np.sqrt(away.max()))
        of = labels[order[begin:end]]
        only = int(of[0]) if (of == of[0]).all() else None
        parts = None
        if end - begin > LEAF_ROWS and radius > 0:
            one = own[away.argmax()]
            other = own[((own - one) ** 2).sum(axis=1).argmax()]
            along, half = own @ (other - one), (end - begin) // 2
            order[begin:end] = order[begin:end][np.argpartition(along, half)]
            parts = (node(begin, begin + half), node(begin + half, end))
        return Ball(begin, end, centre, radius, np.bitwise_or.reduce(_bit(of)), only, parts)

    root = node(0, len(rows))
    return order, root


@dataclass
class Best:
    """The k best (score, then less vec_id) rows of each slot so far, in order."""

    score: np.ndarray
    vec_id: np.ndarray

    @classmethod
    def empty(cls, slots: int, k: int) -> Best:
        return cls(np.full((slots, k), _NONE), np.full((slots, k), np.iinfo(np.int64).max))

    def add(self, slots: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        """Merges rows of ``score`` (_NONE: no candidate) and ``vec_id`` into those of ``slots``."""
        both = np.hstack([self.score[slots], score]), np.hstack([self.vec_id[slots], vec_id])
        best = np.lexsort((both[1], -both[0].astype(np.float64)), axis=1)[:, : self.score.shape[1]]
        self.score[slots], self.vec_id[slots] = (np.take_along_axis(x, best, axis=1) for x in both)


@dataclass
class Anchors:
    """A block of anchors. ``low`` and ``high`` are the windows of scores of each anchor's slots; same: rows of the anchor's label are sought, else of others."""

    rid: np.ndarray
    label: np.ndarray
    vector: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool

    def search(self, rid: np.ndarray, vec_id: np.ndarray, label: np.ndarray, rows: np.ndarray, best: Best) -> None:
        """Adds to ``best`` (a row for each anchor and slot) what these rows have for the anchors."""
        n, slots = self.low.shape
        by_id = np.argsort(vec_id, kind="stable")  # so that a row's place in a tie follows from its place
        place = np.empty(len(by_id), np.int64)
        place[by_id] = np.arange(len(by_id))
        order, root = ball_tree(rows, label)
        norm = np.sqrt((self.vector**2).sum(axis=1))
        bit = _bit(self.label)
        every = np.arange(n * slots).reshape(n, slots)

        def visit(ball: Ball, active: np.ndarray) -> None:
            """``active``: the anchors' slots for which the ball may have rows; bounds tell which really may."""
            at = np.flatnonzero(active.any(axis=1))
            if self.same:
                at = at[(bit[at] & ball.bits) != 0]
            elif ball.only is not None:
                at = at[self.label[at] != ball.only]
            if not len(at):
                return
            middle, reach = self.vector[at] @ ball.centre, norm[at] * ball.radius
            slack = 1.0 + 1e-9 * (np.abs(middle) + reach)  # more than rounding can take
            upper, lower = (middle + reach + slack)[:, None], (middle - reach - slack)[:, None]
            kth = best.score.reshape(n, slots, -1)[at, :, -1]
            may = active[at] & (upper >= self.low[at]) & (lower <= self.high[at]) & (upper >= kth)
            if not may.any():
                return
            now = np.zeros_like(active)
            now[at] = may
            if ball.parts:
                # the part that on the whole promises more goes first, so that the other meets higher bounds
                promise = [float((self.vector[at] @ p.centre + norm[at] * p.radius).sum()) for p in ball.parts]
                for part in ball.parts if promise[0] >= promise[1] else ball.parts[::-1]:
                    visit(part, now)
                return
            at = np.flatnonzero(now.any(axis=1))
            here = order[ball.begin : ball.end]
            score = (self.vector[at] @ rows[here].T).astype(np.int64)
            fits = (label[here] == self.label[at][:, None]) == self.same
            fits &= rid[here] != self.rid[at][:, None]
            for slot in range(slots):
                mine = now[at, slot]
                beaten = best.score[every[at[mine], slot], -1]  # a row strictly beneath it can't come in
                inside = fits[mine] & (score[mine] >= np.maximum(self.low[at[mine], slot], beaten)[:, None]) & (score[mine] <= self.high[at[mine], slot][:, None])
                some = inside.any(axis=1)
                if some.any():
                    who = at[mine][some]
                    k = min(best.score.shape[1], len(here))
                    sought = np.where(inside[some], score[mine][some], _NONE)
                    # the k first by score and then vec_id: by both at once, as scores alone could cut a tie
                    rank = np.lexsort((np.broadcast_to(place[here], sought.shape), -sought.astype(np.float64)), axis=1)[:, :k]
                    best.add(every[who, slot], np.take_along_axis(sought, rank, axis=1), np.where(np.take_along_axis(sought, rank, axis=1) == _NONE, np.iinfo(np.int64).max, vec_id[here][rank]))

        visit(root, np.ones((n, slots), bool))


def _searcher(anchors: Broadcast, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (rid, vec_id, label, v) to the best k of each anchor's slots among all that the task reads."""
        block: Anchors = anchors.value
        slots = block.low.shape[1]
        best = Best.empty(block.low.size, k)
        held: list[pa.RecordBatch] = []

        def finish() -> None:
            rid, vec_id, label = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3))
            rows = np.concatenate([b.column(3).flatten().to_numpy() for b in held]).astype(np.float64).reshape(len(rid), -1)
            _bounded(rows, block.vector)
            block.search(rid, vec_id, label, rows, best)

        for batch in batches:
            for at in range(0, len(batch), TREE_ROWS):
                if sum(map(len, held)) + min(TREE_ROWS, len(batch) - at) > TREE_ROWS:
                    finish()
                    held.clear()
                held.append(batch.slice(at, TREE_ROWS))
        if sum(map(len, held)):
            finish()
        which, nth = np.nonzero(best.score != _NONE)
        out = [pa.array(block.rid[which // slots]), pa.array((which % slots).astype(np.int32)), pa.array(best.score[which, nth]), pa.array(best.vec_id[which, nth])]
        yield pa.RecordBatch.from_arrays(out, names=["anchor", "slot", "score", "vec_id"])

    return search


def _bounded(rows: np.ndarray, vectors: np.ndarray) -> None:
    if len(rows) and len(vectors):
        most = np.sqrt((rows**2).sum(axis=1).max() * (vectors**2).sum(axis=1).max())
        if most >= EXACT:
            raise ArithmeticError(f"inner products may reach {most:.3g}; they are exact below {EXACT} only")


def prepared(embeddings: DataFrame) -> DataFrame:
    """(rid, vec_id, label, v) of the rows that take part: with an id, a label, and a vector without null or non-finite components.

    v holds floor(SCALE * x) of each component. The label of a row whose
    vec_id is divisible by 7 is (label + 1) % 10. rid names the row; it is
    written, and so the same wherever it is read.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    known = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label").cast("long") + 1, F.lit(10))).otherwise(F.col("label").cast("long"))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    rows = known.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), v.alias("v"))
    return materialize(rows, "mining-rows")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of each anchor's slots over all tasks, with their rank. Spark keeps k of each before they are shuffled, too."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _searched(rows: DataFrame, block: Anchors, k: int) -> DataFrame:
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(block)
    found = materialize(rows.mapInArrow(_searcher(sent, k), FOUND), "mining-found")
    sent.unpersist()
    return materialize(_first(found, k), "mining-first")


def mine(embeddings: DataFrame, every: int = 100, k: int = 5, least: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``embeddings`` (vec_id, embedding, label).

    See ``prepared`` for the rows that take part. A row's score is its inner
    product with the anchor; higher ones come first, ties by smaller vec_id.
    Anchors are the rows whose vec_id is divisible by ``every``. An anchor's
    positives are its first ``k`` other rows of its label; for each, its
    negatives are the first ``k`` rows of other labels whose score is at most
    the positive's and at least ``least`` percent of it, ranked from 1. So a
    positive of a negative score has none.

    Rows that repeat an id are rows of their own: each is an anchor where its
    id is, and the others of its label may be its positives. Vectors are to
    have one length; those of another than most have take no part, and an
    empty one neither. Scores must stay below 2^53, or an error is raised.
    Other columns of ``embeddings`` don't matter, whatever their names.

    Anchors go out in blocks of about BLOCK_ANCHORS, for each of which the
    rows are read twice: a stated query set against all rows.
    """
    spark = embeddings.sparkSession
    rows = prepared(embeddings)
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).where("n > 0").orderBy(F.desc("rows"), F.desc("n")).limit(1).collect()
    dims = lengths[0]["n"] if lengths else 0
    rows = rows.where((F.size("v") == dims) & (F.size("v") > 0))
    anchors = rows.where(F.col("vec_id") % every == 0)
    blocks = -(-anchors.count() // BLOCK_ANCHORS) or 1
    path = shared_path(spark, "mining-negatives")
    for number in range(blocks):
        chosen = anchors.where(F.pmod(F.xxhash64("rid"), F.lit(blocks)) == number)
        block = chosen.select("rid", "vec_id", "label", "v").toArrow()
        vectors = block.column("v").combine_chunks().flatten().to_numpy().reshape(len(block), dims)
        rid, label = block.column("rid").to_numpy(), block.column("label").to_numpy()
        whole = np.full((len(block), 1), np.iinfo(np.int64).max)
        positives = _searched(rows, Anchors(rid, label, vectors, -whole, whole, True), k)
        # the windows of the anchors' positives: k numbers an anchor
        low, high = np.full((len(block), k), np.iinfo(np.int64).max), np.full((len(block), k), _NONE)
        at = {int(r): i for i, r in enumerate(rid)}
        for r in positives.select("anchor", "rank", "score").collect():
            low[at[r.anchor], r["rank"] - 1], high[at[r.anchor], r["rank"] - 1] = -(-least * r.score // 100), r.score
        negatives = _searched(rows, Anchors(rid, label, vectors, low, high, False), k)
        mine = positives.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        found = negatives.select("anchor", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(mine, ["anchor", "slot"])
        named = found.join(chosen.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
        part = named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        part.write.mode("append").parquet(path)
    return spark.read.schema(part.schema).parquet(path)
