"""Recovery by smaller pieces against a plain loop."""

from __future__ import annotations

import json
import random
import sys

from pyspark import cloudpickle

from lexiweave.functions.python_text import split_source
from lexiweave.operators import recovery
from lexiweave.sources.shared import shared_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test
CAPS = [10_000, 1500, 600, 260, 100]


class Short:
    """Answers pieces of up to a length that the paragraph says."""

    def reply(self, requests, max_tokens):
        return [self.one(json.loads(r)) for r in requests]

    def one(self, r):
        n = CAPS[r["paragraph_id"] % len(CAPS)]
        return (None, "truncated") if len(r["source"]) > n else (r["source"].upper(), None)


def plain(text, cap, limits):
    seen, tries = set(), 0
    for limit in limits:
        pieces = split_source(text, limit)
        shape = tuple(map(len, pieces))
        if shape in seen:
            continue
        seen.add(shape)
        tries += 1
        if all(len(p) <= cap and p.strip() for p in pieces):
            return "\n".join(p.upper() for p in pieces), limit, len(pieces), tries
        last = len(pieces)
    return None, None, last, tries


def test_recovery(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["word ", "end. ", "x" * 30 + " ", "\n"]) for _ in range(rng.choice([3, 60, 400]))) for _ in range(15)] + ["y" * 3000]
    rows = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)] + [("e", 99, None)], "document_id string, paragraph_id int, text string")
    got = {r.paragraph_id: (r.translation, r.limit, r.pieces, r.attempts) for r in recovery.recover(rows, Short(), shared_folder(spark, "recovery"), 9000).collect()}
    assert got == {i: plain(t, CAPS[i % len(CAPS)], [9000, 6000, 4000, 2500, 1500, 900, 500, 250]) for i, t in enumerate(texts)}
    assert any(v[0] is None for v in got.values()) and max(v[3] for v in got.values()) > 3
    assert recovery.recover(rows.filter("false"), Short(), shared_folder(spark, "recovery")).count() == 0


class Small:
    """Fails where it is asked for more than a few megabytes at once."""

    def reply(self, requests, max_tokens):
        assert sum(map(len, requests)) < 6 << 20 and len(requests) <= 200
        return [(json.loads(r)["source"], None) for r in requests]


def test_batches_are_bounded(spark):
    """A task's texts are not in a worker all at once, and no row has the pieces of every cut."""
    folder = shared_folder(spark, "recovery")
    rows = spark.range(0, 600, 1, 1).selectExpr("'d' as document_id", "cast(id as int) as paragraph_id", "repeat('word ', 6000) as text")
    got = recovery.recover(rows, Small(), folder, 9000)
    assert {(r.paragraph_id, r.pieces, r.n) for r in got.selectExpr("paragraph_id", "pieces", "length(replace(translation, '\n', ' ')) as n").collect()} == {(i, 4, 30_000) for i in range(600)}
    assert spark.read.parquet(f"{folder}/try-0").schema["whole"].dataType.simpleString() == "struct<text:string,limits:array<int>>"
