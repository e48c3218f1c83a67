"""Aggregates of Python in two phases: states of parts of a group, merged in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.sources import materialize

#: States that are handed on at once.
BATCH = 10_000

State = tuple


def fold(df: DataFrame, key: list[str], order: list[str], values: list[str], state: str, reduce: Callable[[pa.RecordBatch], State], merge: Callable[[State, State], State]) -> DataFrame:
    """A row for each ``key`` with the state of all its rows in ``order``, as columns of the schema ``state``.

    ``reduce`` gives the state of some rows that follow each other, as a batch of ``values``; ``merge`` that of two
    such stretches, the first before the second. It must be associative; it need not be commutative. ``order`` must
    tell the rows of a key apart. Nulls are a key of their own, and nulls of ``values`` reach ``reduce``. An empty
    table gives none. Names of ``state`` must differ from ``key``.

    A group of any size is spread: rows are range-partitioned by key and order, and each task holds one Arrow
    batch and one state. Only groups at the ends of partitions, two a partition at most, have several states,
    and only these are shuffled again.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"key_{i}" for i in range(len(key))]
    sort = [f"order_{i}" for i in range(len(order))]
    rows = df.select(*(F.col(f"`{k}`").alias(n) for k, n in zip(key, names, strict=True)), *(F.col(f"`{o}`").alias(n) for o, n in zip(order, sort, strict=True)), *(F.col(f"`{v}`").alias(f"value_{i}") for i, v in enumerate(values)))
    rows = rows.repartitionByRange(parts, *names, *sort).sortWithinPartitions(*names, *sort).drop(*sort)
    keys = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    empty = df.sparkSession.createDataFrame([], state)
    columns = empty.columns
    n_keys = len(names)

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, first, out = TaskContext.get().partitionId(), None, True, []
        schema = None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = schema or pa.schema([batch.schema.field(i) for i in range(n_keys)])
            begins = np.flatnonzero(_begins(batch, n_keys))
            for i, j in zip(begins, [*begins[1:], batch.num_rows], strict=True):
                at = tuple(batch.column(c)[int(i)].as_py() for c in range(n_keys))
                got = reduce(pa.RecordBatch.from_arrays([c.slice(i, j - i) for c in batch.columns[n_keys:]], names=values))
                if held and held[0] == at:
                    held = (at, merge(held[1], got))
                    continue
                if held:
                    out.append((*held, first))
                    first = False
                held = (at, got)
                if len(out) >= BATCH:
                    yield _rows(out, schema, columns, part)
                    out = []
        if held:  # the last of a partition may go on in the next
            yield _rows([*out, (*held, True)], schema, columns, part)

    held = materialize(rows.mapInArrow(states, f"{keys}, {state}, part int, edge boolean"), "states")
    whole = held.where("NOT edge").select(*names, *columns)
    stretches = F.sort_array(F.collect_list(F.struct("part", F.struct(*columns).alias("state")))).alias("stretches")
    edges = held.where("edge").groupBy(*names).agg(stretches)  # as many stretches as there are partitions at most

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.column(n_keys).to_pylist():
                total = None
                for stretch in row:
                    got = tuple(stretch["state"][c] for c in columns)
                    total = got if total is None else merge(total, got)
                out.append(total)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys], *_columns(out, columns)], names=[*names, *columns])

    both = whole.unionByName(edges.mapInArrow(merged, f"{keys}, {state}"))
    return both.select(*(F.col(n).alias(k) for n, k in zip(names, key, strict=True)), *columns)


def _begins(batch: pa.RecordBatch, n_keys: int) -> np.ndarray:
    """Which rows have another key than the row before; nulls are equal."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for column in batch.columns[:n_keys]:
        codes = column.dictionary_encode("encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return new


def _columns(states: list[State], columns: list[str]) -> list[pa.Array]:
    return [pa.array([s[i] for s in states]) for i in range(len(columns))]


def _rows(found: list[tuple], keys: pa.Schema, columns: list[str], part: int) -> pa.RecordBatch:
    at = [pa.array([k[i] for k, _, _ in found], f.type) for i, f in enumerate(keys)]
    ends = [pa.array([part] * len(found), pa.int32()), pa.array([edge for _, _, edge in found])]
    return pa.RecordBatch.from_arrays([*at, *_columns([s for _, s, _ in found], columns), *ends], names=[*keys.names, *columns, "part", "edge"])
