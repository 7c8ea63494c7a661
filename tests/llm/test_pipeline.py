"""The pipeline: each stage's contract, on the smallest tables and on odd ones."""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from conftest import SMALL  # noqa: E402

import pytest  # noqa: E402

import corpus_pipeline  # noqa: E402
from lexiweave.llm.common import table  # noqa: E402
from test_operators import ODD, SCHEMA  # noqa: E402


def test_stages(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    kept = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / str(i)))
            docs = spark.read.parquet(str(tmp_path / str(i)))
            kept.append(docs.select("doc_id").distinct().count())
        else:
            assert out.select("doc_id").distinct().count() == kept[-1]
    assert kept[0] >= kept[1] > kept[2] >= kept[3] == kept[4]


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_stages_on_odd_rows(spark, rows):
    """Nulls in any column, empty texts, ties, repeated rows, clashing column names, and an empty table, through every stage in turn."""
    docs = spark.createDataFrame([(*r, "k", 1, 2, 3, 4, 5, 6, 0.5, 1, 2) for r in rows], SCHEMA)
    sizes = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
        sizes.append(out.count())
    texts = {"".join((t or "").split()) for _, t, _ in rows}
    assert sizes[:2] == [len(rows), len(texts)] and sizes[2] <= min(sizes[1], sizes[3]) and (sizes[4] > 0) == bool(rows)


def test_queries_have_the_names():
    import __spark_entry__ as e

    names = list(e.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
