"""Files: JSON documents, review CSV, incremental work."""

from __future__ import annotations

import json

import pytest

from lexiweave.operators.providers import EchoProvider, ask
from lexiweave.sources import filings, sinks
from lexiweave.streaming.incremental import run_pending


def test_read_documents(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep/a.json").write_text(json.dumps({"document_id": "a", "paragraphs": [{"paragraph_id": 0, "text": "x"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"document_id": "b", "translations": []}))
    (tmp_path / "dataset_manifest.json").write_text(json.dumps({"document_id": "m", "paragraphs": []}))
    (tmp_path / "broken.json").write_text("{")
    docs = filings.read_documents(spark, str(tmp_path))
    assert [r.document_id for r in docs.collect()] == ["a"]
    with pytest.raises(Exception, match="duplicate document_id"):
        filings.unique_documents(docs.union(docs)).collect()


def test_review_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep/r.json").write_text(json.dumps([{"occurrence_id": "o1", "rendering": "x"}, 5, {"rendering": "y"}]))
    (tmp_path / "other.json").write_text(json.dumps([{"rendering": "z"}]))
    (tmp_path / "object.json").write_text(json.dumps({"occurrence_id": "o2"}))
    (tmp_path / "r.audit.json").write_text(json.dumps([{"occurrence_id": "o3"}]))
    (tmp_path / "broken.json").write_text('[{"occurrence_id": ')
    assert sorted((r.occurrence_id or "", r.rendering) for r in filings.read_review_files(spark, str(tmp_path)).collect()) == [("", "y"), ("o1", "x")]


def test_evaluation_files(spark, tmp_path):
    row = {"paragraph_id": 3, "has_benchmark_terms": True, "judgment": {"winner": "tie", "scores": {"baseline": {"fluency": 4}}}}
    (tmp_path / "a.translation-evaluation.json").write_text(json.dumps({"document_id": "d", "evaluations": [row, {"judgment": None}], "errors": [{"paragraph_id": 9, "error": "late"}]}))
    (tmp_path / "b.translation-evaluation.json").write_text(json.dumps({"evaluations": [row]}))
    (tmp_path / "c.translation-evaluation.json").write_text("[]")
    rows, errors = filings.read_evaluations(spark, str(tmp_path))
    assert sorted((r.document_id, r.paragraph_id, r.judgment.scores.baseline.fluency) for r in rows.collect()) == [("b.translation-evaluation", "3", 4.0), ("d", "3", 4.0)]
    assert [(r.document_id, r.paragraph_id, r.error) for r in errors.collect()] == [("d", "9", "late")]
    (tmp_path / "e.translation-evaluation.json").write_text(json.dumps({"document_id": "d", "evaluations": [row]}))
    with pytest.raises(Exception, match="duplicate evaluation row"):
        filings.read_evaluations(spark, str(tmp_path))[0].collect()


def test_review_csv(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("﻿" + ",".join(filings.REVIEW_COLUMNS) + "\n" + ",".join(f"v{i}" for i in range(14)) + "\n", encoding="utf-8")
    r = filings.read_review_csv(spark, str(path)).first()
    assert (r.document_id, r.reviewer_notes) == ("v0", "v13")


def test_csv_union_of_columns(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "i int, a string"), spark.createDataFrame([(2, "y")], "i int, b string")
    sinks.write_csv([a, b], str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["i", "a", "b"]


def test_incremental_is_idempotent(spark, tmp_path):
    src, done, state = (str(tmp_path / x) for x in ("src", "done", "state"))
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string").write.parquet(src)
    args = (spark, src, "id int, x string", done, state, lambda d: d, ["id"])
    run_pending(*args)
    run_pending(*args)
    spark.createDataFrame([(2, "b"), (3, "c")], "id int, x string").write.mode("append").parquet(src)
    run_pending(*args)
    assert sorted(r.id for r in spark.read.parquet(done).collect()) == [1, 2, 3]


def test_provider(spark):
    rows = spark.createDataFrame([("Translate:\nhello",), ("q",)], "prompt string")
    assert [r.answer for r in ask(rows, EchoProvider({"q": "A"})).collect()] == ["hello", "A"]
