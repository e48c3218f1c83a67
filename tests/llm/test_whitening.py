"""Whitening against numpy's eigenvectors of the covariance."""

from __future__ import annotations

import math

import numpy as np
import pytest

from marlstone.llm import queries as Q
from marlstone.llm import whitening
from marlstone.sources import table

KIND = "vec_id long, embedding array<float>, label int"


def plain(rows, components=16):
    """{(id, component): (n, deviation, whitened, explained)}, whitened by its size, as signs are free."""
    used = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in e]) for i, e in rows if e and all(c is not None and math.isfinite(c) for c in e)]
    distinct = sorted({tuple(x) for _, x in used})
    n, sums = len(distinct), [sum(d) for d in zip(*distinct, strict=True)]
    centre = lambda x: np.array([(n * v - s) / n for v, s in zip(x, sums, strict=True)])
    x = np.array([centre(d) for d in distinct])
    values, vectors = np.linalg.eigh(x.T @ x / n)
    out = []
    for i, v in used:
        for k in range(min(components, len(values))):
            out.append((i, k + 1, n, sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)), abs(float(centre(v) @ vectors[:, -1 - k])) / math.sqrt(values[-1 - k]), values[-1 - k] / values.sum()))
    return sorted(out)


def agree(got, want):
    got = sorted((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-7, atol=1e-7)


def test_against_numpy(spark):
    rng = np.random.default_rng(4)
    turn = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    rows = [(i, [float(c) for c in np.float32((rng.normal(size=40) * np.geomspace(3, 0.2, 40)) @ turn)]) for i in range(600)]
    rows += [(1000 + i, rows[5][1]) for i in range(300)] + [(5, rows[5][1])]  # a third of all rows is one vector
    bad = [(1, None), (2, [None] * 40), (3, [float("nan")] * 40), (4, [float("inf")] * 40), (6, [1.0] * 3), (7, [])]
    frame = spark.createDataFrame([(i, e, 0) for i, e in rows + bad], KIND).repartition(5)
    got = whitening.whiten(frame).collect()
    agree(got, plain(rows))
    assert all(r.identity_error <= 1e-9 for r in got)


def test_many_dimensions_and_close_eigenvalues(spark):
    """The basis is thinned several times before residuals vanish."""
    rng = np.random.default_rng(5)
    scales = np.concatenate([np.linspace(10, 8, 6), np.linspace(6, 1, 194)])
    rows = [(i, [float(c) for c in np.float32(rng.normal(size=200) * scales)]) for i in range(400)]
    x = spark.createDataFrame([(e,) for _, e in rows], "embedding array<float>")
    distinct = whitening.entries(x).select("x")
    found = whitening.fit(distinct, 200, 4)
    m = np.floor(64 * np.array([e for _, e in rows]))
    values, vectors = np.linalg.eigh(np.cov(m.T, bias=True))
    assert np.allclose(found.values, values[::-1][:4], rtol=1e-10) and found.residual <= whitening.TOLERANCE and found.passes > 3
    assert np.allclose(np.abs(np.sum(found.components * vectors[:, ::-1][:, :4], axis=0)), 1, atol=1e-9)
    assert abs(found.trace / values.sum() - 1) < 1e-12


def test_few_directions_and_empty(spark):
    run = lambda rows: whitening.whiten(spark.createDataFrame(rows, KIND)).collect()
    assert run([]) == [] and run([(1, [], 0), (2, None, 0)]) == [] and run([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)]) == []
    line = [(i, [float(i), 2.0 * i, 5.0], 0) for i in range(5)] + [(None, [1.0, 2.0, 5.0], 0)]
    got = run(line)
    assert {r.component for r in got} == {1} and len(got) == 6 and all(abs(r.explained - 1) < 1e-12 for r in got)
    huge = run([(1, [3e12, 1.0], 0), (2, [-3e12, 2.0], 0), (3, [0.0, 5.0], 0)])
    assert {r.deviation for r in huge if r.vec_id == 1} == {None}
    clash = spark.createDataFrame([(1, [1.0, 0.0], 3, 4, 5), (2, [0.0, 1.0], 3, 4, 5)], "vec_id long, embedding array<float>, x int, n int, component int")
    assert len(whitening.whiten(clash).collect()) == 2


def test_raises_when_not_certified(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MOST_PASSES", 1)
    rng = np.random.default_rng(5)
    frame = spark.createDataFrame([(i, [float(c) for c in rng.normal(size=80)], 0) for i in range(100)], KIND)
    with pytest.raises(RuntimeError, match="after 1 passes"):
        whitening.whiten(frame)


def test_query(spark):
    data = "/root/testdata/sf0.01"
    rows = [(r.vec_id, list(r.embedding)) for r in table(spark, data, "embeddings").collect()]
    agree(Q.op11_whitening(spark, data).collect(), plain(rows))
