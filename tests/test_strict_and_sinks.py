"""Strict review files, sinks that are written again after a failure, configuration files."""

from __future__ import annotations

import csv
import json

import pytest
from pyspark.sql import functions as F

from lexiweave.sources import experiments as ex
from lexiweave.sources import sinks
from lexiweave.sources import strict as st
from lexiweave.sources.filings import REVIEW_COLUMNS


def review_file(path, rows, columns=REVIEW_COLUMNS):
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.DictWriter(f, columns, restval="")
        out.writeheader()
        out.writerows(rows)
    return str(path)


GOOD = {"document_id": "d", "term_type": "legal_concept", "criticality": "critical", "include_in_benchmark": "yes"}
ROWS = [
    GOOD | {"term_id": "T1", "source_term": 'a "quoted"\nterm, of two lines'}, GOOD | {"term_id": "T2", "source_term": "b", "criticality": "EXCLUDED"}, GOOD | {"term_id": " T1 ", "source_term": "again"},
    GOOD | {"term_id": "T3", "source_term": "c", "include_in_benchmark": "perhaps"}, GOOD | {"term_id": "T4", "source_term": "d", "term_type": "", "suggested_term_type": "party_name"},
]


def test_lines_of_a_file(spark, tmp_path):
    lines = st.read_lines(spark, review_file(tmp_path / "r.csv", ROWS))
    assert [r.line for r in lines.orderBy("line").collect()] == [2, 3, 4, 5, 6]
    judged = st.judged_lines(lines)
    got = {r.term_id: r for r in st.accepted(judged).collect()}
    assert set(got) == {"T1", "T2", "T4"} and got["T1"].source_term == ROWS[0]["source_term"] and not got["T2"].include and got["T4"].used_suggestion and got["T4"].term_type == "PARTY_NAME"
    assert sorted((r.line, r.term_id, r.reason, r.value) for r in st.quarantine(judged).collect()) == [(4, "T1", "duplicate", "d/T1"), (5, "T3", "include_in_benchmark", "perhaps")]
    with pytest.raises(Exception, match="review line 4: duplicate"):
        st.strict(judged).collect()
    assert st.strict(judged.filter("line < 4")).count() == 2
    assert {r.reason for r in st.quarantine(st.judged_lines(lines, accept_suggestions=False)).collect()} == {"duplicate", "include_in_benchmark", "term_type"}
    with pytest.raises(ValueError, match="criticality"):
        st.read_lines(spark, review_file(tmp_path / "short.csv", [], [c for c in REVIEW_COLUMNS if c != "criticality"]))
    assert st.accepted(st.judged_lines(st.read_lines(spark, review_file(tmp_path / "none.csv", [])))).count() == 0


def test_strict_application(spark, tmp_path):
    review = st.accepted(st.judged_lines(st.read_lines(spark, review_file(tmp_path / "r.csv", ROWS[1:2]))))
    terms = lambda *t: spark.createDataFrame([("d", i, s) for i, s in t], "document_id string, term_id string, source_term string")
    assert st.apply_strict(terms(("T2", " B ")), review).first().criticality == "EXCLUDED"
    for wrong, what in (((("T2", "b"), ("T9", "x")), "T9: missing"), ((("T2", "other"),), "T2: source term differs"), ((), "T2: stale")):
        with pytest.raises(Exception, match=what):
            st.apply_strict(terms(*wrong), review).collect()


def tree(path):
    return {str(p.relative_to(path)): p.read_bytes() for p in sorted(path.rglob("*")) if p.is_file() and not p.name.startswith((".", "_"))}


def test_exhibits_are_the_same_after_a_failed_run(spark, tmp_path):
    rows = spark.range(40).select(F.format_string("0001-%02d", F.col("id") % 4).alias("accession"), F.format_string("../x/f%d.htm", "id").alias("filename"), F.col("id").cast("string").alias("content"), F.when(F.col("id") > 3, F.lit("EX-10")).alias("exhibit_type"), F.col("id")).repartition(4)
    fails = rows.withColumn("content", F.when(F.col("id") == 39, F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    out = tmp_path / "out"
    with pytest.raises(Exception, match="lost"):
        sinks.save_exhibits(fails.drop("id"), str(out))
    assert not (out / "_SUCCESS").exists()
    sinks.save_exhibits(rows.drop("id"), str(out))
    first = tree(out)
    assert len(first) == 80 and first["000101/f1.htm"] == b"1" and not any(".part" in n for n in first) and json.loads((out / "_SUCCESS").read_text()) == {"files": 80}
    assert json.loads(first["000101/f1.htm.metadata.json"]) == {"accession": "0001-01", "filename": "../x/f1.htm", "exhibit_type": None}
    sinks.save_exhibits(rows.drop("id"), str(out))
    assert tree(out) == first


def test_csv_parts(spark, tmp_path):
    a = spark.createDataFrame([(1, 'x "y"', None), (2, "line\nbreak, and comma", "é")], "n int, t string, u string").coalesce(1)
    b = spark.createDataFrame([("only", 3)], "v string, n int").coalesce(1)
    sinks.write_csv([a, b], f"file://{tmp_path}/out")
    parts = [p for p in sorted((tmp_path / "out").glob("part-*.csv"))]
    rows = []
    for p in parts:
        assert p.read_bytes().startswith(b"\xef\xbb\xbf")
        with open(p, encoding="utf-8-sig", newline="") as f:
            rows += list(csv.DictReader(f))
    assert [list(r) for r in rows] == [["n", "t", "u", "v"]] * 3
    assert sorted((r["n"], r["t"], r["u"], r["v"]) for r in rows) == [("1", 'x "y"', "", ""), ("2", "line\nbreak, and comma", "é", ""), ("3", "", "", "only")]
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/out/part-*.csv")
    assert back.count() == 3 and back.columns == ["n", "t", "u", "v"]
    for name, frames in (("none", []), ("empty", [a.filter("false")])):
        sinks.write_csv(frames, str(tmp_path / name), spark)
        assert tree(tmp_path / name) == {"part-00000.csv": b"\xef\xbb\xbf"}
    bad = a.withColumn("t", F.when(F.col("n") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("t")))
    with pytest.raises(Exception, match="lost"):
        sinks.write_csv([bad], str(tmp_path / "bad"))
    assert not (tmp_path / "bad" / "_SUCCESS").exists() and tree(tmp_path / "bad").keys() <= {"part-00000.csv.part"} | {n for n in tree(tmp_path / "bad") if ".part" in n}


def test_configuration_files(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"defaults": {"model": "m", "workers": 4}, "experiments": [{"name": "a", "workers": 2, "enabled": "no"}, {"name": "b", "enabled": False}, {"name": "c", "model": None}]}))
    got = ex.experiment_matrix(ex.read_configs(spark, str(path)), "file").orderBy("position").collect()
    assert [(r.position, r.name, r.workers, r.max_tokens) for r in got] == [(0, "a", 2, 4096), (2, "c", 4, 4096)]
    for text, what in (('{"experiments": []}', "list of experiments"), ('{"defaults": {}}', "list of experiments"), ('{"experiments": [{"model": "x"}]}', "needs a name")):
        with pytest.raises(Exception, match=what):
            ex.experiment_matrix(spark.createDataFrame([(text,)], "value string")).collect()


def test_registry_leaves_out_what_is_missing(spark):
    models = spark.createDataFrame([("k", "m", "named", ["x", "y"]), ("n", "m", None, None)], "model_key string, model string, baseline_experiment string, baseline_candidates array<string>")
    existing = spark.createDataFrame([("baseline", "y"), ("controlled", "k-placeholder-final"), ("controlled", "x")], "kind string, name string")
    assert sorted((r.experiment_id, r.source_experiment) for r in ex.registry(models, existing, include_missing=False).collect()) == [("k__baseline", "y"), ("k__placeholder", "k-placeholder-final")]
    assert ex.registry(models, existing).count() == 6
