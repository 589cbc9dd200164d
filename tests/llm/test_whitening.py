from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from pulsegrid.llm import whitening
from pulsegrid.llm.queries import queries

SMALL = "/root/testdata/sf0.001"


def brute(rows, width, most=16):
    """n, deviations by id, V's eigenvalues, whitened values up to sign."""
    taken = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v] + [1_000_000] * (width - len(v))) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in taken})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    deviation = [(i, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))) for i, x in taken]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums, strict=True)] for x in fit])
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    all_rows = np.array([[(n * c - s) / n for c, s in zip(x, sums, strict=True)] for _, x in taken])
    return n, deviation, e, np.trace(v), all_rows @ u, [i for i, _ in taken]


def held_against(got, rows, width):
    n, deviation, e, trace, projected, ids = brute(rows, width)
    k = min(16, width)
    assert len(got) == len(ids) * k and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, k + 1))
    assert Counter((r.vec_id, r.deviation) for r in got) == Counter({x: k * m for x, m in Counter(deviation).items()})
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error <= 1e-4
    for c in range(1, k + 1):
        own = [r for r in got if r.component == c]
        assert all(abs(r.explained - max(e[c - 1], 0) / trace) <= 1e-4 * max(e[c - 1], 0) / trace + 1e-12 for r in own)
        if e[c - 1] <= 1e-9 * e[0]:
            assert all(r.whitened is None for r in own)
            continue
        want = {}
        for i, x in zip(ids, projected[:, c - 1] / math.sqrt(e[c - 1]), strict=True):
            want.setdefault(i, []).append(x)
        sign = next(s for s in (1, -1) if all(min(abs(r.whitened - s * x) for x in want[r.vec_id]) < 1e-6 for r in own))
        assert sign


def test_query(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    held_against(queries()["op12_whitening"](spark, SMALL).collect(), [(r.vec_id, r.embedding) for r in table.collect()], 64)


@pytest.mark.parametrize("block", [1024, 7])
def test_edges(spark, monkeypatch, block):
    """Several blocks of rows and columns; repeated vectors and ids, null ids, unsound and short vectors, clashing names."""
    monkeypatch.setattr(whitening, "ROWS", block)
    monkeypatch.setattr(whitening, "COLS", block)
    monkeypatch.setattr(whitening, "IN_TASK", 2)
    rng = np.random.default_rng(5)
    rows = [(i % 50, [float(c) for c in rng.normal(size=20) * np.arange(1, 21)]) for i in range(60)] + [(100 + i, rows_v) for i, rows_v in enumerate([[0.5] * 20] * 30)]
    rows += [(200, None), (201, [1.0] * 19 + [None]), (202, [float("nan")] * 20), (203, [float("inf")] + [0.0] * 19), (None, [2.0] * 20), (204, [1.0, 2.0]), (205, [])]
    frame = spark.createDataFrame([(i, v, 3, 1.5, 8) for i, v in rows], "vec_id long, embedding array<double>, idx int, component double, n int")
    held_against(whitening.whiten(frame).collect(), rows, 20)


def test_without_variance(spark):
    shape = "vec_id long, embedding array<float>"
    same = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], shape)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same) == [(i, c, 1, 0, None, 0.0, 0.0) for i in (1, 2) for c in (1, 2)]
    held_against(whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0, 0.0]), (2, [0.5, 2.0, 0.0]), (3, [0.5, 2.0, 3.0])], shape)).collect(), [(1, [0.5, 1.0, 0.0]), (2, [0.5, 2.0, 0.0]), (3, [0.5, 2.0, 3.0])], 3)
    assert whitening.whiten(spark.createDataFrame([], shape)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [])], shape)).count() == 0


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(1 << 40) * i, -float(1 << 41) * (i % 3), 1.0]) for i in range(12)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.deviation) for r in whitening.whiten(frame).collect()}
    assert got == {(i, d if d < 1 << 63 else None) for i, d in brute(rows, 3)[1]}
