"""Rolled-up validation of uses, and stored results of another source."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexiweave.operators import evaluation
from lexiweave.operators import validation as val

USES = [("a", "HARD", "DEFINIENDUM", "R1", None), ("a", "NONE", "COMMON", "R2", "X"), ("a", "HARD", "DEFINIENDUM", "R1", "X"), ("b", "SOFT", "NESTED", "R3", "Y")]


def test_tree(spark):
    uses = spark.createDataFrame(USES, "document_id string, control_eligibility string, usage_status string, reason string, context_classification string")
    terms = spark.createDataFrame([("a", "T1"), ("a", "T2"), ("b", "T1"), ("c", "T1")], "document_id string, term_id string")
    got = {r.document_id: r for r in val.tree(uses, terms).collect()}
    assert set(got) == {"a", "b", "c", None}
    assert (got["a"].term_count, got["a"].occurrence_count, got["a"].hard_occurrences, got["a"].excluded_occurrences) == (2, 3, 2, 1)
    assert got["a"].validation_reason_counts == {"R1": 2, "R2": 1} and got["a"].context_classification_counts == {"X": 2} and got["c"].usage_status_counts == {} and got["c"].occurrence_count == 0
    assert got[None].term_count == 4 and got[None].soft_occurrences == 1 and got[None].validation_reason_counts == {"R1": 2, "R2": 1, "R3": 1}
    none = val.tree(uses.filter("false"), terms.filter("false")).collect()
    assert len(none) == 1 and none[0].term_count == 0


def test_stale_results_fail(spark):
    p = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y"), ("c", 1, "z")], "document_id string, paragraph_id int, text string")
    t = spark.createDataFrame([("a", "T1", "Person")], "document_id string, term_id string, source_term string")
    now = val.source_signatures(p, t)
    assert now.count() == 3 and {r.source_signature for r in now.collect()} == {r.source_signature for r in val.source_signatures(p.orderBy(F.desc("text")), t).collect()}
    stored = now.filter("document_id <> 'c'")
    assert [r.document_id for r in val.to_validate(p.select("document_id").distinct(), now, stored).collect()] == ["c"]
    other = val.source_signatures(p, t.withColumn("source_term", F.lit("Party")))
    assert {r.document_id: r.state for r in val.freshness(other, stored).collect()} == {"a": "stale", "b": "valid", "c": "new"}
    with pytest.raises(Exception, match="another source: a"):
        val.to_validate(p, other, stored).collect()
    assert val.to_validate(p, other, stored, overwrite=True).count() == 4


def test_a_judgment_is_parsed_once(spark):
    side = lambda value, *fields: "{" + ",".join(f'"{f}":{value}' for f in fields) + "}"

    def answer(score=3, flag="false", winner='"A"', confidence=1, rationale="because"):
        scores, flags = side(score, *evaluation.SCORE_FIELDS.values()), side(flag, *evaluation.ERROR_FIELDS.values())
        return f'{{"scores":{{"A":{scores},"B":{scores}}},"critical_errors":{{"A":{flags},"B":{flags}}},"winner":{winner},"confidence":{confidence},"rationale":"{rationale}"}}'

    cases = [(answer(), None), (None, "not JSON"), ("A wins", "not JSON"), ("{}", "not JSON"), ('{"winner":"A"}', "score"), (answer(score=5.5), "score"), (answer(score="null"), "score"), (answer(flag="null"), "critical error"),
             (answer(winner='"C"'), "winner"), (answer(winner="null"), "winner"), (answer(confidence=1.01), "confidence"), (answer(confidence="null"), "confidence"), (answer(rationale=" "), "rationale")]
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "id int, answer string").select("id", evaluation.validate_judgment(F.col("answer")).alias("problem"))
    assert {r.id: r.problem for r in rows.collect()} == {i: want for i, (_, want) in enumerate(cases)}
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
