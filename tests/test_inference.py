"""Replicates against plain loops, in both ways of making them."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiweave.operators import inference as inf

RNG = np.random.default_rng(1)
ROWS = [(g, s, f"d{d:03d}", float(v)) for g, s in (("a", 3), ("b", 40)) for d in range(30) for v in RNG.normal(0.2 if g == "a" else 0.0, 1, d % 4 + 1)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([*ROWS, ("a", 3, "d001", None), ("b", 40, "new", None)], "name string, stream int, document_id string, diff double")


def keys_of(spark, docs):
    return [r.k for r in spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string").orderBy("i").select(inf.document_key("d").alias("k")).collect()]


def loops(spark, name, stream, draws, b=200, p=96, seed=7):
    docs = sorted({d for g, _, d, _ in ROWS if g == name})
    values = [[v for g, _, x, v in ROWS if g == name and x == d] for d in docs]
    s, n = np.array([sum(v) for v in values]), np.array([len(v) for v in values])
    m, keys = s / n, keys_of(spark, docs)
    macro, ratio = [], []
    for r in range(b):
        if draws:
            at = [int(inf.hashes(seed, stream, np.array([r]), np.array([k]))[0, 0]) % len(docs) for k in range(len(docs))]
            w = np.bincount(at, minlength=len(docs))
        else:
            w = np.array([int(np.searchsorted(inf.POISSON, inf.hashes(seed, stream, np.array([r]), np.array([k], np.uint64))[0, 0], side="right")) for k in keys])
        macro.append((w @ m) / w.sum())
        ratio.append((w @ s) / (w @ n))
    extreme = 0
    for i in range(p):
        words = inf.hashes(seed ^ 0x5F5F5F5F, stream, np.array([i // 32]), np.array(keys, np.uint64))[0]
        signs = [1 - 2 * (int(x) >> (i % 32) & 1) for x in words]
        extreme += abs(np.dot(signs, m) / len(m)) >= abs(m.mean()) - 1e-12
    cut = lambda x: [round(float(np.quantile(x, q)), 6) for q in (0.025, 0.975)]
    return [name, len(docs), int(n.sum()), round(float(m.mean()), 6), *cut(macro), round(float(s.sum() / n.sum()), 6), *cut(ratio), round((extreme + 1) / (p + 1), 6)]


@pytest.mark.parametrize("draws", [inf.DRAWS, 0])
def test_both_ways(spark, rows, draws):
    got = sorted(list(r) for r in inf.paired_inference(rows.repartition(5), ["name"], 200, 96, 7, draws=draws).collect())
    want = [loops(spark, g, s, draws) for g, s in (("a", 3), ("b", 40))]
    for x, y in zip(got, want):
        assert x[0] == y[0] and x[1:] == pytest.approx(y[1:], abs=2e-6)


def test_weights_and_draws_agree(rows):
    a, b = (inf.paired_inference(rows, ["name"], 4000, 3200, 11, draws=d).orderBy("name").toPandas() for d in (inf.DRAWS, 0))
    for c in ("macro_low", "macro_high", "weighted_low", "weighted_high"):
        assert np.allclose(a[c], b[c], atol=0.05)
    assert np.allclose(a.sign_flip_p, b.sign_flip_p)


def test_no_rows(rows):
    assert inf.paired_inference(rows.filter("false"), ["name"], 10, 32).count() == 0
    one = inf.paired_inference(rows.filter("document_id = 'd000' and name = 'a'"), ["name"], 50, 64).first()
    assert one.macro_low == one.macro_high == one.macro_effect and one.sign_flip_p == 1.0


def test_poisson_shares():
    z = inf.hashes(1, 2, np.arange(400), np.arange(500))
    w = np.searchsorted(inf.POISSON, z, side="right")
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02


def test_many_documents_stay_in_small_tasks(spark):
    """A table of one row a document goes through the weights where it is over the bound, with rows bounded by partitions."""
    docs = spark.range(5000).select(F.lit(0).alias("stream"), F.col("id").cast("string").alias("document_id"), (F.pmod(F.hash("id"), F.lit(100)) / 100 - 0.3).alias("diff"))
    got = inf.paired_inference(docs, [], 256, 64, 3, draws=1000).first()
    assert got.documents == 5000 and got.macro_low < got.macro_effect < got.macro_high and got.macro_high - got.macro_low < 0.03
