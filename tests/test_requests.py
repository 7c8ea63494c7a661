"""Batches by budget against a plain fold, and what requests hold."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from lexiweave.operators import requests as rq


def test_budget(spark):
    rng = random.Random(8)
    rows = [(f"d{d}", i, rng.choice([None, 0, 5, 40, 99, 300])) for d in range(6) for i in range(rng.randrange(1, 60))]
    df = spark.createDataFrame(rows, "d string, i int, n int").repartition(5)
    got = {(r.d, r.i): r.batch for r in rq.budgeted(df, ["d"], ["i"], F.col("n"), 5, 200).collect()}
    for d in {r[0] for r in rows}:
        batch, items, chars = 0, 0, 0
        for _, i, n in sorted(r for r in rows if r[0] == d):
            n = n or 0
            if items and (items == 5 or chars + n > 200):
                batch, items, chars = batch + 1, 0, 0
            items, chars = items + 1, chars + n
            assert got[d, i] == batch
    assert rq.budgeted(df.filter("false"), ["d"], ["i"], F.col("n"), 5, 200).count() == 0


def test_repairs(spark):
    queue = spark.createDataFrame([("d", f"o{i}", "Person", None, "x" * 50, "UNTRANSLATED") for i in range(5)], "document_id string, occurrence_id string, source_term string, rendering string, target_paragraph string, validation_status string")
    got = [json.loads(r.request) for r in rq.repair_requests(queue, max_items=2).orderBy("batch").collect()]
    assert [[x["occurrence_id"] for x in g["items"]] for g in got] == [["o0", "o1"], ["o2", "o3"], ["o4"]] and got[0]["items"][0]["current_rendering"] is None and got[0]["task"] == "repair_renderings"
