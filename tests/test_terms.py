"""Literal cases: definitions, linking, and the rules for a use of a term."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from lexiweave.functions import python_text as pt
from lexiweave.functions import text as t
from lexiweave.operators import annotations as a
from lexiweave.operators import consistency as c
from lexiweave.operators import controls as ctl
from lexiweave.operators import coverage, statistics, terms


def test_one_term_four_occurrences(spark):
    rows = [("d", i, x) for i, x in enumerate(["“Purchaser” means Alpha Holdings Ltd.", "The Purchaser pays.", "purchaser or Purchaser", "nothing"])]
    found, links = terms.extract(spark.createDataFrame(rows, "document_id string, paragraph_id int, text string"))
    assert [(r.source_term, r.occurrences, r.term_id) for r in found.collect()] == [("Purchaser", 4, "T0001")]
    assert {(r.paragraph_id, r.char_start, r.surface) for r in links.collect()} == {(0, 1, "Purchaser"), (1, 4, "Purchaser"), (2, 0, "purchaser"), (2, 13, "Purchaser")}


def test_longest_first_leaves_nested_out(spark):
    rows = [("d", 0, "“Natural Person” means x. “Person” means y. A Natural Person and a Person.")]
    p = spark.createDataFrame(rows, "document_id string, paragraph_id int, text string")
    links = terms.longest_first(terms.candidate_occurrences(p, terms.canonical_terms(terms.definitions(p))))
    assert sorted((r.char_start, r.source_term) for r in links.collect()) == [(1, "Natural Person"), (27, "Person"), (46, "Natural Person"), (67, "Person")]


CASES = [
    ("This is cause for it", "Cause", ["NONE CASE_MISMATCH_WITH_DEFINED_TERM"]),
    ("(d) Code. “Code” shall mean the Internal Revenue Code of 1986", "Code", ["HARD EXACT_CASE_STANDALONE_MATCH", "HARD EXPLICIT_DEFINIENDUM", "NONE COMPONENT_OF_DIFFERENT_LEGAL_NAME"]),
    ("Benefits. Gilead will provide coverage.", "Gilead", ["HARD EXACT_CASE_STANDALONE_MATCH"]),
    ("The Executive’s Base Salary is", "Base Salary", ["HARD POSSESSIVE_MODIFIER_OUTSIDE_TERM"]),
    ("Your Sign-On Bonus is", "Sign-On Bonus", ["HARD DETERMINER_OR_POSSESSIVE_MODIFIER"]),
    ("The Annual LTIP and", "LTIP", ["HARD SAFE_EXTERNAL_MODIFIER"]),
    ("The Chief Executive Officer and", "Executive", ["NONE COMPONENT_OF_JOB_TITLE"]),
    ("The Defend Trade Secrets Act applies.", "Trade Secrets", ["NONE COMPONENT_OF_LEGAL_INSTRUMENT_NAME"]),
    ("Gilead Sciences pays", "Gilead", ["NONE COMPONENT_OF_ENTITY_FULL_NAME"]),
    ("Gilead Leadership pays", "Gilead", ["HARD ENTITY_ALIAS_AS_RELATION_MODIFIER"]),
    ("U.S. Century Bank pays", "Bank", ["NONE COMPONENT_OF_ENTITY_FULL_NAME"]),
    ("The Savings Plan is", "Plan", ["NONE COMPONENT_OF_NAMED_EXPRESSION"]),
    ("Any Sanctioned Person may be blocked.", "Person", ["SOFT ADJACENT_CAPITALISED_MODIFIER"]),
    ("POLICY\nTanger employees", "Tanger", ["HARD ALL_CAPS_HEADING_BOUNDARY"]),
]


def test_rules_of_use(spark):
    rows = [(i, p, term, m.start(), m.end(), True) for i, (p, term, _) in enumerate(CASES) for m in re.finditer(re.escape(term), p, re.I)]
    got = terms.classify_uses(spark.createDataFrame(rows, "i int, text string, source_term string, char_start int, char_end int, is_definition boolean"))
    seen: dict[int, list] = {}
    for r in got.orderBy("i", "char_start").collect():
        seen.setdefault(r.i, []).append(f"{r.control_eligibility} {r.reason}")
    assert [seen[i] for i in range(len(CASES))] == [want for _, _, want in CASES]


def test_invalid_spans(spark):
    rows = [("abc", "abc", None, 3, False), ("abc", "abc", 0, 9, False), ("abc", "abd", 0, 3, False), (None, "x", 0, 1, False)]
    got = terms.classify_uses(spark.createDataFrame(rows, "text string, source_term string, char_start int, char_end int, is_definition boolean"))
    assert [r.usage_status for r in got.collect()] == ["INVALID_SPAN", "INVALID_SPAN", "SURFACE_MISMATCH", "INVALID_SPAN"]


def test_formal_metrics(spark):
    rows = spark.createDataFrame([("d", "t", x) for x in ("买方", "买方", "买受人")], "document_id string, term_id string, rendering string")
    r = c.formal_metrics(c.variants(rows)).first()
    assert (r.dominant_translation_ratio, r.variant_count, r.translation_variation_rate) == (0.666667, 2, 0.5)


@pytest.mark.parametrize("raw, clean", [("```text\n你好\n```", "你好"), ("译文：你好", "你好"), ("<think>x</think>附件10.1", "附件10.1"), ("reasoning</think>\n附件10.1", "附件10.1"), ("<think>a</think>b</think>最终译文", "最终译文")])
def test_clean_translation(spark, raw, clean):
    assert spark.createDataFrame([(raw,)], "x string").select(t.clean_translation(F.col("x"))).first()[0] == clean


def test_small_functions(spark):
    one = spark.range(1)
    assert one.select(t.latin_residues(F.lit("借款人 Borrower 与 SEC borrower"))).first()[0] == ["Borrower", "SEC"]
    assert one.select(t.normalize_variant(F.lit(" “生效日期” "))).first()[0] == "生效日期"
    assert one.select(a.suggest(F.lit("SEC"))).first()[0]["term_type"] == "PARTY_NAME"
    assert pt.recover_substring("生 效日期", "于生效 日期起") == "生效 日期"
    assert pt.html_paragraphs("<div><p>First block here</p><p>First block here</p><script>var x = 1;</script><li>Second block</div>") == ["First block here", "Second block"]
    assert pt.html_paragraphs("no blocks in here<br>second line of it") == ["no blocks in here", "second line of it"]
    assert pt.split_source("One sentence. Two sentence. Three", 20) == ["One sentence.", "Two sentence. Three"]
    assert pt.json_object('talk ```json\n{"b": 1, "a": "x"}``` more') == '{"a":"x","b":1}'


def test_inject_and_restore(spark):
    p = spark.createDataFrame([("d", 0, "Person may notify another Person.")], "document_id string, paragraph_id int, text string")
    s = spark.createDataFrame([("d", 0, "T0002", x, x + 6, "主体") for x in (0, 26)], "document_id string, paragraph_id int, term_id string, char_start int, char_end int, canonical string")
    done = ctl.inject(p, ctl.number_placeholders(s))
    r = done.select("protected", ctl.restore(F.col("protected"), F.col("constraints")).alias("back")).first()
    assert (r.protected, r.back) == ("【术语0002_01】 may notify another 【术语0002_02】.", "主体 may notify another 主体.")


def test_inventory(spark):
    rows = spark.createDataFrame([(1, ["【术语0001_01】", "【术语0001_02】"], "【术语0001_01】【术语0001_01】【术语9999】")], "id int, expected array<string>, output string")
    r = coverage.placeholder_difference(rows).first()
    assert (r.missing, r.duplicates, r.unknown, r.score) == (1, 1, 1, 3)


def test_sign_test(spark):
    got = spark.range(1).select(statistics.sign_test(F.lit(8).cast("long"), F.lit(2).cast("long")), statistics.sign_test(F.lit(0).cast("long"), F.lit(0).cast("long"))).first()
    assert round(got[0], 6) == 0.109375 and got[1] == 1.0


def test_empty_tables(spark):
    p = spark.createDataFrame([], "document_id string, paragraph_id int, text string")
    assert terms.extract(p)[0].count() == 0
    r = spark.createDataFrame([], "document_id string, term_id string, rendering string")
    assert c.formal_metrics(c.variants(r)).count() == 0


def test_composed_forms(spark):
    """Full-width letters, half-width kana and ligatures are one variant with their plain forms."""
    rows = spark.createDataFrame([("ＡＢＣ　公司", "ABC 公司"), ("ｶﾞｽ", "ガス"), ("ofﬁce", "office"), ("“协议”", "协议"), ("plain", "plain")], "a string, b string")
    got = rows.select(t.normalize_variant(F.col("a")).alias("x"), t.normalize_variant(F.col("b")).alias("y"), t.surface(F.col("a")).alias("s"), t.same_lexical(F.col("a"), F.upper("b")).alias("same")).collect()
    assert all(r.x == r.y for r in got) and got[0].s == "ABC 公司" and [r.same for r in got] == [True, False, True, False, True]


def test_sign_test_of_many_pairs(spark):
    from math import comb

    from lexiweave.operators.statistics import sign_test

    cases = [(0, 0), (3, 1), (600, 500), (1200, 400), (50_000, 50_400), (70_000, 70_000)]
    got = spark.createDataFrame(cases, "a long, b long").select(sign_test(F.col("a"), F.col("b")).alias("p")).collect()
    for (a, b), r in zip(cases[:4], got):
        want = min(1.0, 2 * sum(comb(a + b, i) for i in range(min(a, b) + 1)) / 2 ** (a + b)) if a + b else 1.0
        assert abs(r.p - want) < 1e-9
    assert abs(got[4].p - 0.2075) < 0.001 and got[5].p == 1.0  # normal approximation with continuity correction


def test_overlaps_and_refill(spark):
    from lexiweave.operators import controls, sampling

    spans = spark.createDataFrame([("d", 1, "T2", 4, 15), ("d", 1, "T1", 9, 15), ("d", 1, "T1", 20, 26), ("d", 2, "T1", 0, 6)], "document_id string, paragraph_id int, term_id string, char_start int, char_end int")
    got = {(r.paragraph_id, r.char_start): r.placeholder for r in controls.number_placeholders(spans).collect()}
    assert got == {(1, 4): "【术语0002】", (1, 20): "【术语0001】", (2, 0): "【术语0001】"}
    rows = spark.createDataFrame([("d", i, i < 5) for i in range(100)], "document_id string, paragraph_id int, risky boolean")
    some = sampling.risk_sample(rows, 50, 0.5, 7).collect()
    assert len(some) == 50 and sum(r.risky for r in some) == 5


def test_pieces_and_recovery():
    text = "A first one. " * 3 + "x" * 50 + "\n\nEnd here;  and there"
    for limit in (5, 12, 20, 33, 200):
        pieces = pt.split_source(text, limit)
        assert all(len(p) <= limit for p in pieces) and "".join("".join(pieces).split()) == "".join(text.split())
    assert pt.split_source("", 5) == [""] and pt.split_source("      ab", 3) == ["   ", "ab"]
    assert pt.recover_substring("office", "an ofﬁ ce here") == "ofﬁ ce" and pt.recover_substring("x", "abc") is None


def test_shared_terms(spark):
    """Terms of all documents: every place, any characters, terms without letters; repeated paragraphs stay apart from other documents'."""
    p = spark.createDataFrame([("a", 1, "A (Plan), a plan; planned C++ and §§ by U.S. Person"), ("b", 1, "Person\\E"), ("b", 2, "")], "document_id string, paragraph_id int, text string")
    names = ["Plan", "(Plan)", "C++", "§§", "U.S. Person", "Person", "Person\\E"]
    m = spark.createDataFrame([(n, n.lower()) for n in names], "source_term string, key string")
    got = {(r.document_id, r.source_term, r.char_start, r.surface) for r in terms.candidate_occurrences(p, m).collect()}
    assert got == {("a", "Plan", 3, "Plan"), ("a", "(Plan)", 2, "(Plan)"), ("a", "Plan", 12, "plan"), ("a", "C++", 26, "C++"), ("a", "§§", 34, "§§"), ("a", "U.S. Person", 40, "U.S. Person"), ("a", "Person", 45, "Person"), ("b", "Person", 0, "Person"), ("b", "Person\\E", 0, "Person\\E")}


def test_semantic_verdict(spark):
    from lexiweave.operators import controls

    good = '{"adequacy": "Pass", "term_semantics": "PASS", "unsupported_addition": false, "meaning_omission": 0, "unnatural_attachment": null, "broken_legal_logic": ""'
    rows = [(0, good + "}"), (1, good.replace("0", "0.0") + ', "problematic_terms": ["a"]}'), (2, good.replace("null", '"false"') + "}"), (3, '{"adequacy": "PASS", "term_semantics": "PASS"}'), (4, "{}"), (5, "no"), (6, "[1]"), (7, None)]
    d = spark.createDataFrame(rows, "i int, answer string")
    got = {r.i: r.v for r in d.select("i", controls.semantic_verdict(F.col("answer")).alias("v")).collect()}
    assert [got[i].passed for i in range(5)] == [True, True, False, False, False]
    assert got[1].problematic_terms == ["a"] and got[4].adequacy == "FAIL" and got[4].meaning_omission
    assert got[5] is None and got[6] is None and got[7] is None
