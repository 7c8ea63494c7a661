"""Whitening by TSQR against an eigendecomposition in memory."""

from __future__ import annotations

import math
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from conftest import SMALL  # noqa: E402

from lexiweave.llm import whitening as wh  # noqa: E402
from lexiweave.llm.common import table  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, n long, part long, size int, vec string, id string"


def brute(vectors, k=8):
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    d = n * x - s
    y = (d / n).astype(float)
    e, v = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-e)[:k]
    return n, [int((r * r).sum()) for r in d], y @ v[:, order] / np.sqrt(e[order]), e[order] / e.sum()


def check(rows, vectors, k=8):
    """rows of distinct ids 0.. against brute force."""
    n, deviation, white, explained = brute(vectors, k)
    got = np.full(white.shape, np.nan)
    for r in rows:
        assert r.n == n and r.deviation == deviation[r.vec_id] and r.identity_error <= 1e-9
        assert abs(r.explained - explained[r.component - 1]) <= 1e-9 * explained[0]
        got[r.vec_id, r.component - 1] = r.whitened
    sign = np.sign((got * white).sum(axis=0))
    assert np.abs(got * sign - white).max() < 1e-7
    assert np.abs(got.T @ got / n - np.eye(white.shape[1])).max() < 1e-9


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, "v", "i") for i, v in rows], SCHEMA)


def test_table(spark):
    vectors = {r.vec_id: r.embedding for r in table(spark, SMALL, "embeddings").collect()}
    assert sorted(vectors) == list(range(len(vectors)))
    check(wh.op12_whitening(spark, SMALL).collect(), [vectors[i] for i in range(len(vectors))])


@pytest.mark.parametrize("parts", [1, 13])
def test_partitions(spark, parts):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12))).astype(np.float32).tolist()
    vectors[5:200] = [vectors[5]] * 195  # one vector is half of all
    check(wh.whiten(frame(spark, list(enumerate(vectors))).repartition(parts)).collect(), vectors)


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = rng.normal(size=(30, 3)).astype(np.float32).tolist()
    nan, inf = float("nan"), float("inf")
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [nan, 1.0, 1.0]), (104, [1.0, inf, -inf]), (105, [1.0, 2.0]), (106, [3e38, 0.0, 0.0])]
    rows = wh.whiten(frame(spark, [*enumerate(good), *bad])).collect()
    assert len(rows) == 90 and {r.component for r in rows} == {1, 2, 3}
    check(rows, good, 3)
    twice = wh.whiten(frame(spark, [*enumerate(good), (None, good[0]), (0, good[0])])).collect()
    assert len(twice) == 96 and sum(r.vec_id is None for r in twice) == 3 and len({(r.component, r.whitened) for r in twice if r.vec_id in (0, None)}) == 3
    assert wh.whiten(frame(spark, [])).count() == 0
    assert wh.whiten(frame(spark, [(1, [1.0, 2.0])] * 3)).count() == 0  # no direction varies
    flat = wh.whiten(frame(spark, [(i, [v[0], v[1], v[0]]) for i, v in enumerate(good)])).collect()
    assert {r.component for r in flat} == {1, 2} and max(r.identity_error for r in flat) < 1e-9


def test_large_numbers_stay_exact(spark):
    """Products over 64 bits: a decimal in the operator."""
    vectors = [[float(i << 30), float(-i)] for i in range(20)]
    rows = wh.whiten(frame(spark, list(enumerate(vectors)))).collect()
    _, deviation, _, _ = brute(vectors)
    assert max(deviation) > 1 << 63 and all(r.deviation == deviation[r.vec_id] for r in rows)


def test_components_survive_bad_conditioning():
    """Where a covariance in doubles has lost a small direction, R still has it."""
    rng = np.random.default_rng(3)
    y = rng.normal(size=(500, 3)) * [1e9, 1.0, 1.0]
    y -= y.mean(axis=0)
    r = wh._factor(np.vstack([wh._factor(y[:200]), wh._factor(y[200:])]))
    assert np.allclose(np.linalg.svd(r)[1], np.linalg.svd(y)[1], rtol=1e-9)
