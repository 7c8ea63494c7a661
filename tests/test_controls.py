"""Literal cases: wording beside tokens, restoration with spans, counts of a run, a judge's answers."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexiweave.operators import judging, restoring

ITEM = "placeholder string, term_id string, canonical string, renderings array<struct<rendering:string,kind:string>>"
DDL = f"id int, text string, constraints array<struct<{ITEM.replace(' string', ':string').replace(' array', ':array')}>>"
KNOWN = [("主体", "canonical"), ("  ", "allowed"), ("人", "risky")]


def rows(spark, texts, canonical="主体"):
    return spark.createDataFrame([(i, x, [("【术语0001】", "T0001", canonical, KNOWN)]) for i, x in enumerate(texts)], DDL)


def issues(spark, texts, canonical="主体"):
    got = rows(spark, texts, canonical).select("id", F.posexplode_outer(restoring.context_issues(F.col("text"), F.col("constraints"))).alias("k", "i"))
    return [(r.id, r.i and (r.i.issue_type.split("_")[0], r.i.rendering, r.i.side)) for r in got.orderBy("id", "k").collect()]


def test_wording_beside_a_token(spark):
    texts = ["任何主体（【术语0001】）可", "任何【术语0001】，人可", "任何【术语0001】可", "主体【术语0001】人【术语0001】", "", "主体没有", "主体人【术语0001】"]
    found = issues(spark, texts)
    assert found == [(0, ("PLACEHOLDER", "主体", "LEFT")), (1, ("PLACEHOLDER", "人", "RIGHT")), (2, None), (3, None), (4, None), (5, None), (6, ("PLACEHOLDER", "人", "LEFT"))]


def test_wording_out_of_the_window_does_not_count(spark):
    assert issues(spark, ["主体" + "。" * 26 + "【术语0001】", "主体" + "。" * 27 + "【术语0001】"]) == [(0, ("PLACEHOLDER", "主体", "LEFT")), (1, None)]


def test_title_marks_twice(spark):
    assert issues(spark, ["见《 【术语0001】　》"], "《协议》") == [(0, ("REDUNDANT", None, None))]
    assert issues(spark, ["见《【术语0001】》"], "协议") == [(0, None)]


def restored(spark, text, pairs, **more):
    items = [(p, t, c, []) for p, t, c in pairs]
    df = spark.createDataFrame([(0, text, items)], DDL).select(restoring.restore_with_spans(F.col("text"), F.col("constraints"), **more).alias("r"))
    r = df.collect()[0].r
    return r.text, [(s.term_id, s.start, s.end) for s in r.spans], r.problem


def test_restoration_gives_spans(spark):
    text, spans, problem = restored(spark, "甲【术语0001】、【术语0002_01】和【术语0001】", [("【术语0001】", "T1", "主体"), ("【术语0002_01】", "T2", "生效日期")])
    assert (text, problem) == ("甲主体、生效日期和主体", None)
    assert [(t, text[s:e]) for t, s, e in spans] == [("T1", "主体"), ("T2", "生效日期"), ("T1", "主体")]


def test_restoration_tells_what_is_wrong(spark):
    assert restored(spark, "甲【术语0009】", [("【术语0001】", "T1", "主体")]) == ("甲【术语0009】", [], "LEFTOVER")
    assert restored(spark, "甲【术语0001】", [("【术语0001】", "T1", "主体"), ("【术语0001】", "T1", "人")])[2] == "CONFLICT"
    assert restored(spark, "甲", [("【术语0001】", "T1", "主体"), ("【术语0001】", "T1", "主体")]) == ("甲", [], None)
    assert restored(spark, "", []) == ("", [], None)
    with pytest.raises(PySparkException, match="LEFTOVER"):
        restored(spark, "甲【术语0009】", [], strict=True)


def test_counts_of_a_run_without_rows_or_columns(spark):
    p = spark.createDataFrame([("d", 1), ("d", 2), ("e", 1)], "document_id string, paragraph_id int")
    done = spark.createDataFrame([("d", 1, True)], "document_id string, paragraph_id int, placeholder_fallback_used boolean")
    got = {r.document_id: r for r in restoring.control_statistics(p, done, p.filter("document_id = 'e'"), ["document_id"]).collect()}
    assert len(got["d"]) == 40  # 39 counts and the key
    assert (got["d"].remaining_paragraphs, got["d"].placeholder_fallback_noncompliance_paragraphs, got["d"].failed_paragraphs) == (1, 1, 0)
    assert (got["e"].translated_paragraphs, got["e"].remaining_paragraphs, got["e"].failed_paragraphs, got["e"].generation_retries) == (0, 1, 1, 0)


def test_answers_that_cannot_be_used(spark):
    v = spark.createDataFrame([("d", t, f"V{i:03}", "x", 9 - i) for t, n in (("A", 3), ("B", 2), ("C", 3), ("D", 1)) for i in range(n)], "document_id string, term_id string, variant_id string, variant string, n long")
    said = [("A", "V001", "ACCEPTABLE_VARIANT", 0.9), ("A", "V002", "LEGAL_INCONSISTENCY", 0.7), ("B", "V001", "ACCEPTABLE_VARIANT", 0.5), ("B", "V001", "UNRESOLVED", 0.4), ("C", "V001", "ACCEPTABLE_VARIANT", 2.0)]
    a = spark.createDataFrame([("d", *x) for x in said], "document_id string, term_id string, variant_id string, label string, confidence double")
    got = {r.term_id: (r.group_label, r.fallbacks, r.confidence) for r in judging.merge_variant_answers(v, a).collect()}
    assert got == {"A": ("LEGAL_INCONSISTENCY", 0, 0.7), "B": ("ACCEPTABLE_VARIATION", 0, 0.5), "C": ("UNRESOLVED", 2, 0.0)}


SPAN = "array<struct<placeholder:string,term_id:string,canonical:string,start:int,end:int>>"


def faults(spark, text, marked, canonical="主体", risky=()):
    """The text with its spans marked by ^ before each."""
    places, at = [], 0
    for i, part in enumerate(text.split("^")):
        at += len(part)
        places += [(f"【术语000{i + 1}】", "T1", canonical, at, at + len(canonical))]
    df = spark.createDataFrame([(text.replace("^", ""), places[:-1], [("T1", r, "risky") for r in risky])], f"text string, spans {SPAN}, known array<struct<term_id:string,rendering:string,kind:string>>")
    r = df.select(restoring.restored_issues(F.col("text"), F.col("spans"), F.col("known")).alias("i"), restoring.definition_repetitions(F.col("text"), F.col("spans")).alias("d")).collect()[0]
    assert [i.issue_type.split("_")[0] for i in r.i] == marked
    return r


def test_faults_of_a_restored_text(spark):
    assert faults(spark, "任何^主体主体可", ["DUPLICATED"]).i[0].local_context == "任何主体主体可"
    faults(spark, "任何主体 ^主体可", ["DUPLICATED"])
    faults(spark, "主体和^主体可", [])
    assert faults(spark, "^主体 ^主体", ["ADJACENT", "ADJACENT"]).i[1].placeholder == "【术语0002】"
    faults(spark, "见《^《协议》", ["NESTED"], "《协议》")
    faults(spark, "见^《协议》 》", ["NESTED"], "《协议》")
    faults(spark, "见^《协议》", [], "《协议》")
    assert faults(spark, "人，^主体", ["RISKY"], risky=("实体", "人")).i[0].rendering == "人"
    faults(spark, "^主体", [], risky=("主体", "，"))
    got = faults(spark, "在^宽限期期间", ["POSSIBLE"], "宽限期").i[0]
    assert got.severity == "WARNING"
    faults(spark, "^主体【术语0009】", ["UNRESTORED"])
    faults(spark, "", [])


def test_repetitions_that_a_definition_explains(spark):
    assert len(faults(spark, "^主体。“^主体”应遵守", []).d) == 1
    assert len(faults(spark, "“^主体”是指任何^主体", []).d) == 1
    assert len(faults(spark, "^主体可以通知^主体", []).d) == 0
    assert len(faults(spark, "^主体是指" + "甲" * 200 + "^主体", []).d) == 0


def collapsed(spark, text, *items):
    ddl = "text string, c array<struct<placeholder:string,term_id:string,usage:string,renderings:array<struct<rendering:string,kind:string>>>>"
    r = spark.createDataFrame([(text, [(f"【{p}】", t, u, [(x, k) for x, k in known]) for p, t, u, known in items])], ddl).select(restoring.collapse_aliases(F.col("text"), F.col("c")).alias("r")).collect()[0].r
    return r.text, [(e.placeholder[1:-1], e.pattern) for e in r.events]


def test_tokens_that_repeat_a_rendering(spark):
    law = [("联邦存款保险法", "canonical"), ("存保法", "allowed"), ("保险", "risky")]
    one, two = ("术语0019", "T19", "DEFINIENDUM", law), ("术语0019_02", "T19", "USE", law)
    assert collapsed(spark, "见《联邦存款保险法》（“【术语0019】”）规定", one) == ("见《联邦存款保险法》规定", [("术语0019", "CANONICAL_THEN_ALIAS")])
    assert collapsed(spark, "【术语0019】（以下简称“存保法”）规定", one) == ("存保法规定", [("术语0019", "ALIAS_THEN_ALLOWED_VARIANT")])
    assert collapsed(spark, "保险（【术语0019】）", one) == ("保险（【术语0019】）", [])
    assert collapsed(spark, "存保法（【术语0019】）", ("术语0019", "T19", "USE", law)) == ("存保法（【术语0019】）", [])
    text, events = collapsed(spark, "存保法（【术语0019】）是指【术语0019_02】 联邦存款保险法", one, two)
    assert (text, events) == ("存保法是指联邦存款保险法", [("术语0019", "ALLOWED_VARIANT_THEN_ALIAS"), ("术语0019_02", "SIBLING_ALIAS_BEFORE_CANONICAL")])
    assert collapsed(spark, "甲【术语0019_02】联邦存款保险法", two) == ("甲【术语0019_02】联邦存款保险法", [])
    code = ("术语0006_01", "T6", "USE", [("《国内税收法典》", "canonical")])
    assert collapsed(spark, "《国内税收法典》【术语0006_01】第280G条", code) == ("《国内税收法典》第280G条", [("术语0006_01", "TITLE_MARKED_CANONICAL_BEFORE_PLACEHOLDER")])
    assert collapsed(spark, "《【术语0006_01】》", code)[1] == [] and collapsed(spark, "", code) == ("", [])


def test_renderings_with_pattern_characters(spark):
    """A rendering is taken as it is, whatever a pattern would make of it."""
    odd = "a\\E(b)*[c]$"
    items = f"array(named_struct('placeholder', '【术语0001】', 'term_id', 'T1', 'canonical', x, 'usage', 'DEFINIENDUM', 'renderings', array(named_struct('rendering', x, 'kind', 'canonical'))))"
    rows = spark.createDataFrame([(odd, f"{odd}（【术语0001】）起")], "x string, text string").withColumn("c", F.expr(items))
    got = rows.select(restoring.collapse_aliases(F.col("text"), F.col("c")).alias("r"), F.size(restoring.pieces(F.concat(F.col("x"), F.lit("-"), F.col("x")), F.col("x"))).alias("n")).first()
    assert got.r.text == f"{odd}起" and [e.pattern for e in got.r.events] == ["CANONICAL_THEN_ALIAS"] and got.n == 3
