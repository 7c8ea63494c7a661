"""Global order and bounded samples against plain sorting; no window sees a whole table."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lexiweave.operators import ranking, sampling, statistics


def test_running_sums(spark):
    rng = random.Random(3)
    data = [(rng.randrange(1000), i, rng.randrange(5)) for i in range(3000)]
    rows = spark.createDataFrame(data, "a int, b int, v long").repartition(7)
    got = {(r.a, r.b): r.before for r in ranking.running(rows, ["a", "b"], F.col("v")).collect()}
    total = 0
    for a, b, v in sorted(data):
        assert got[a, b] == total
        total += v
    assert ranking.running(rows.filter("false"), ["a", "b"]).count() == 0
    ranks = sorted(r.before for r in ranking.running(rows, ["a", "b"]).collect())
    assert ranks == list(range(3000))


@pytest.mark.parametrize("m, n", [(40, 9), (40, 1), (5, 9), (1, 3), (0, 3), (12, 12), (13, 7)])
def test_even_ranks(spark, m, n):
    rows = spark.createDataFrame([(i * 7 % 41, f"d{i:02d}") for i in range(m)], "n int, d string")
    order = sorted((i * 7 % 41, f"d{i:02d}") for i in range(m))
    k = min(n, m)
    want = {order[round(i * (m - 1) / max(1, k - 1))] for i in range(k)}
    for row in reversed(order):
        if len(want) < k:
            want.add(row)
    assert {(r.n, r.d) for r in sampling.even_ranks(rows, n, "n", "d").collect()} == want


def test_shortage(spark):
    rows = spark.createDataFrame([("d", i, i % 4 == 0) for i in range(40)], "document_id string, paragraph_id int, has_terms boolean")
    assert ranking.shortages(rows, "has_terms", {True: 11, False: 30}).collect() == [(True, 11, 10)]
    assert sampling.top_by_digest(rows, {True: 10, False: 3}, "has_terms", 1, enough=True).count() == 13
    with pytest.raises(Exception, match="wanted 11 rows of true, there are 10"):
        sampling.top_by_digest(rows, {True: 11, False: 3}, "has_terms", 1, enough=True).collect()
    assert sampling.top_by_digest(rows, {True: 99}, "has_terms", 1).count() == 10


def test_plans_are_bounded(spark):
    rows = spark.range(1000).select(F.lit("d").alias("document_id"), F.col("id").alias("paragraph_id"), (F.col("id") % 3 == 0).alias("risky"), F.when(F.col("id") % 2 == 0, "tie").otherwise("baseline").alias("winner"))

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    for df in (sampling.top_by_digest(rows, {True: 5, False: 3}, "risky", 1), sampling.balanced(rows, 9, 1), sampling.risk_sample(rows, 9, 0.5, 1)):
        assert "WindowGroupLimit" in plan(df)
    assert "SinglePartition" not in plan(ranking.running(rows, ["paragraph_id"])).split("BroadcastExchange")[0]
    assert statistics.wilcoxon(rows.select((F.col("paragraph_id") - 400).alias("diff"))).first().n == 999


def test_wilcoxon_of_millions(spark):
    """The cube of the number of pairs is past a long from 1.7 million on."""
    n = 2_100_000
    rows = spark.range(n).select((F.col("id") % 7 - 3.25).alias("diff"))
    before, w, ties = 0, 0.0, 0
    for d in sorted(abs(i - 3.25) for i in range(7)):
        t = n // 7
        w += (before + (t + 1) / 2) * t * any(i - 3.25 == d for i in range(7))
        before, ties = before + t, ties + t**3 - t
    z = abs(w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    got = statistics.wilcoxon(rows).first()
    assert got.n == n and got.w_plus == w and got.z == pytest.approx(z, abs=1e-5)
