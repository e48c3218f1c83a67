"""Whitening of embeddings: leading components by matrix-free block subspace iteration.

The covariance is never formed. A pass over the distinct rows gives Y = XᵀXQ/n
for a block Q of a few columns: tasks centre their rows and add up Xᵀ(XQ), and
sums of partial sums are all that reaches the driver. QR adds what is new of a
block to an orthonormal basis, and Rayleigh-Ritz on the basis gives estimates
and residuals. The next block is what is left over of the leading vectors. It
ends when a pass over the k components themselves certifies each residual. The
basis is thinned to its leading vectors when it is full, and where it spans the
whole space, as it soon does in few dimensions, the estimates are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.sources import materialize

#: Each entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Columns of a block beyond the components; columns of the basis before it is thinned, as a multiple of a block's.
MORE, BASIS = 8, 4
#: A residual is certified if it is at most so much of the largest eigenvalue.
TOLERANCE = 1e-12
MOST_PASSES = 500
#: Components of an eigenvalue below this share of the largest are no directions of the data, only rounding.
LEAST = 1e-12
#: Partial sums of tasks are added up in so many groups before they reach the driver.
GROUPS = 16
_ROWS = "part int, at int, sums array<double>"


@dataclass
class Fit:
    """n distinct vectors, the sums of their entries, and unit components in columns with eigenvalues, of a covariance with this trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    identity_error: float
    passes: int


def entries(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds x, the whole numbers of each vector, to the rows that have one without null or non-finite entries; others are left out.

    An entry of more than a long holds stops at its ends.
    """
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long"))
    return embeddings.where(F.col(vector).isNotNull()).where(finite).withColumn("x", whole)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n, of which the whole part is taken off exactly first."""
    whole = [s // n for s in sums]
    return (x - np.array(whole, np.int64)).astype(np.float64) - np.array([(s - w * n) / n for s, w in zip(sums, whole, strict=True)])


def _totals(dims: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors to their number and the sums of their entries' upper and lower 32 bits, which don't overflow."""
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([high.tolist()], pa.list_(pa.int64())), pa.array([low.tolist()], pa.list_(pa.int64()))], names=["n", "high", "low"])

    return add


def totals(x: DataFrame, dims: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""
    parts = x.mapInArrow(_totals(dims), "n long, high array<long>, low array<long>")
    total = lambda c: F.sum(F.col("v")[c].cast("decimal(38,0)"))
    sums = parts.select("n", F.posexplode(F.arrays_zip("high", "low")).alias("at", "v")).groupBy("at").agg(F.sum("n").alias("n"), total("high").alias("high"), total("low").alias("low"))
    rows = sorted(sums.collect())
    return (rows[0]["n"] if rows else 0), [(int(r["high"]) << 32) + int(r["low"]) for r in rows]


def _product(sent: Broadcast):
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors to Xᵀ(XQ), (XQ)ᵀ(XQ) and the sum of squares, row by row: a task's share of each."""
        from pyspark import TaskContext

        n, sums, q = sent.value
        dims, width = q.shape
        y, gram, squares = np.zeros((dims, width)), np.zeros((width, width)), 0.0
        for batch in batches:
            x = _centred(_matrix(batch.column(0), dims), n, sums)
            p = x @ q
            y, gram, squares = y + x.T @ p, gram + p.T @ p, squares + float((x * x).sum())
        rows = np.vstack([y, gram, np.full((1, width), squares)])
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), task, np.int32)), pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(rows.tolist(), pa.list_(pa.float64()))], names=["part", "at", "sums"])

    return multiply


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by place and task to the sum of each place, in the tasks' order."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, sums in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            row = np.array(sums.values.to_numpy())
            total[at] = total[at] + row if at in total else row
    at = sorted(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(at), np.int32)), pa.array(at, pa.int32()), pa.array([total[a].tolist() for a in at], pa.list_(pa.float64()))], names=["part", "at", "sums"])


def product(x: DataFrame, n: int, sums: list[int], q: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """VQ, QᵀVQ as the covariance of XQ, and V's trace, in one pass over the vectors.

    Places of the result are dealt to GROUPS tasks, each of which adds up all tasks' rows of its places: the driver gets one
    row a place. Sums are in the tasks' order, so reruns over the same files agree.
    """
    sent = x.sparkSession.sparkContext.broadcast((n, sums, q))
    parts = x.mapInArrow(_product(sent), _ROWS).repartition(GROUPS, "at").sortWithinPartitions("at", "part")
    rows = np.array([r["sums"] for r in sorted(parts.mapInArrow(_added, _ROWS).collect(), key=lambda r: r["at"])]) / n
    sent.unpersist()
    dims, width = q.shape
    return rows[:dims], rows[dims : dims + width], float(rows[-1, 0])


def fit(x: DataFrame, dims: int, components: int = COMPONENTS, seed: int = 7) -> Fit:
    """The leading components of the distinct vectors ``x`` (one column, of whole numbers, of ``dims`` each).

    Fewer come back where the vectors span fewer directions. RuntimeError if
    residuals are not certified within MOST_PASSES passes.
    """
    n, sums = totals(x, dims) if dims else (0, [])
    empty = Fit(n, sums, np.zeros((dims, 0)), np.zeros(0), 0.0, 0.0, 0.0, 0)
    if n < 2:
        return empty
    k = min(components, dims)
    width, basis_width = min(dims, k + MORE), min(dims, BASIS * (k + MORE))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, width)))[0]
    basis, image = np.zeros((dims, 0)), np.zeros((dims, 0))
    for passes in range(1, MOST_PASSES + 1):
        y, _, trace = product(x, n, sums, q)
        if trace <= 0:
            return empty
        basis, image = np.hstack([basis, q]), np.hstack([image, y])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, images = basis @ turn, image @ turn
        kept = int((values[:k] > LEAST * values[0]).sum())
        left = images[:, :width] - vectors[:, :width] * values[:width]
        worst = float(np.linalg.norm(left[:, :kept], axis=0).max())
        if worst <= TOLERANCE * values[0] or basis.shape[1] == dims:
            # estimates carry the rounding of all steps: what counts is a pass over the components themselves
            lead, _ = np.linalg.qr(vectors[:, :kept])
            image_of, gram, trace = product(x, n, sums, lead)
            values, turn = np.linalg.eigh((gram + gram.T) / 2)
            values, turn = values[::-1], turn[:, ::-1]
            lead, image_of = lead @ turn, image_of @ turn
            worst = float(np.linalg.norm(image_of - lead * values, axis=0).max())
            if worst <= TOLERANCE * values[0]:
                white = turn.T @ gram @ turn / np.sqrt(np.outer(values, values))
                return Fit(n, sums, lead, values, trace, worst / values[0], float(np.abs(white - np.eye(kept)).max()), passes + 1)
            if basis.shape[1] == dims:  # once more, from what the pass has given
                basis, image, q = np.zeros((dims, 0)), np.zeros((dims, 0)), np.linalg.qr(np.hstack([lead, np.random.default_rng(seed + passes).normal(size=(dims, width - kept))]))[0]
                continue
        if basis.shape[1] + width > basis_width and basis.shape[1] > width and basis_width < dims:
            basis, image = vectors[:, :width], images[:, :width]  # thinned: a restart from the leading vectors
        # what is new in the residuals; twice, so that it is orthogonal to the basis to full precision
        for _ in range(2):
            left = left - basis @ (basis.T @ left)
            left, r = np.linalg.qr(left)
        q = left[:, : dims - basis.shape[1]]
    raise RuntimeError(f"residual {worst / values[0]:.2g} of the largest eigenvalue after {MOST_PASSES} passes")


def _rotated(sent: Broadcast, id_column: str, kind: pa.DataType):
    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """id and x to (id, deviation, whitened entries)."""
        n, sums, turn = sent.value
        dims = len(sums)
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            white = _centred(x, n, sums) @ turn
            deviation = _deviations(x, n, sums)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), pa.array(deviation, pa.int64()), pa.array(white.tolist(), pa.list_(pa.float64()))], names=[id_column, "deviation", "white"])

    return rotate


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums over dimensions of (n*x - S)^2, exact; None where a long does not hold it."""
    far = np.abs(_centred(x, n, sums)).max(initial=0) * n + 1
    if far * far * len(sums) < 2**62 and max(map(abs, sums), default=0) < 2**62 and n * int(np.abs(x).max(initial=0)) < 2**62:
        return ((x * n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    return [d if d < 2**63 else None for d in exact]


def whiten(embeddings: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every row with a vector, for each component.

    A vector's entries become whole numbers (see ``entries``); null vectors and
    those with null or non-finite entries are left out, and so are empty ones
    and those of another length than most. The fit is over the distinct
    vectors, n in number with sums S, and its covariance has the divisor n.
    Components are unit eigenvectors, from 1 by falling eigenvalue, of either
    sign, the same for all rows; ``whitened`` is a row's x - S/n along one, over
    the root of its eigenvalue, ``explained`` the eigenvalue's share of the
    trace, ``deviation`` the exact sum of (n*x - S)^2 over dimensions (null
    where that is beyond a long), and ``identity_error`` the largest entry of
    the whitened covariance minus the identity, measured. Where vectors span
    fewer directions than ``components``, there are rows for those only: none
    for one distinct vector. Rows that repeat an id, null or not, are all
    returned. Of equal eigenvalues the components are any orthonormal ones.
    """
    spark = embeddings.sparkSession
    rows = entries(embeddings.select(F.col(id_column).alias("id"), F.col(vector).alias("embedding")), "embedding").select("id", "x")
    rows = materialize(rows, "white-rows")
    lengths = rows.groupBy(F.size("x").alias("n")).agg(F.count("*").alias("rows")).where("n > 0").orderBy(F.desc("rows"), F.desc("n")).limit(1).collect()
    dims = lengths[0]["n"] if lengths else 0
    rows = rows.where((F.size("x") == dims) & (F.size("x") > 0))
    distinct = materialize(rows.select("x").distinct(), "white-distinct")
    found = fit(distinct, dims, components)
    sent = spark.sparkContext.broadcast((found.n, found.sums, found.components / np.sqrt(found.values)))
    kind = embeddings.schema[id_column].dataType
    id_name = kind.simpleString()
    arrow = pa.string() if id_name == "string" else pa.int32() if id_name == "int" else pa.int64()
    rotated = rows.mapInArrow(_rotated(sent, "id", arrow), f"id {id_name}, deviation long, white array<double>")
    share = F.array(*(F.lit(float(v / found.trace)) for v in found.values)) if len(found.values) else F.expr("CAST(array() AS ARRAY<DOUBLE>)")
    each = rotated.select("id", "deviation", F.posexplode("white").alias("nth", "whitened"))
    return each.select(
        F.col("id").alias(id_column),
        (F.col("nth") + 1).alias("component"),
        F.lit(found.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(share, F.col("nth")).alias("explained"),
        F.lit(found.identity_error).alias("identity_error"),
    )
