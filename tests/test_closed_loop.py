"""The closed loop against the rules written out for one paragraph at a time, and runs that are broken off or repeated."""

from __future__ import annotations

import json
import re
import sys

import pytest
from conftest import SMALL
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lexiweave.operators import closed_loop as loop
from lexiweave.operators import controls as c
from lexiweave.operators import restoring as rs
from lexiweave.operators.providers import answered
from lexiweave.plans.loop_queries import FAIL, PASS, Script, work
from lexiweave.sources.shared import shared_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test
TOKEN = re.compile("【术语[0-9]+(?:_[0-9]+)?】")
SCHEMA = f"document_id string, paragraph_id int, text string, protected string, constraints array<{loop.CONSTRAINT}>, soft array<string>"


def rule(token, term, source, canonical, *approved):
    return (token, term, source, canonical, [canonical, *approved], "USE", [(canonical, "canonical")])


def paragraphs():
    one, two = rule("【术语0001】", "T1", "Person", "主体", "人士"), rule("【术语0002】", "T2", "Plan", "计划")
    rows = []
    for i in range(24):
        many = [[one], [one, two], []][i % 3]
        text = "Any " + " of ".join(r[2] for r in many) + f" shall comply {i}."
        masked = text
        for r in many:
            masked = masked.replace(r[2], r[0])
        rows.append(("d" + str(i % 2), i, text, masked, many, ["hint"] if i % 4 == 0 else []))
    return rows


def one_by_one(row, provider, p: loop.Policy):
    """The same paragraph as a plain loop."""
    _, number, text, masked, rules, soft = row
    want = [r[0] for r in rules]
    limit, requests, calls, regenerated, repaired, grown, early, seen, stages, best = p.max_tokens, 0, 0, 0, 0, 0, False, {}, [], ("", 10**9)

    def ask(task, a, **more):
        (answer, error), = provider.reply([json.dumps({"paragraph_id": number, "task": task, "attempt": a, "source": masked if task in ("placeholder", "repair") else text, "terms": [{"placeholder": r[0], "source_term": r[2], "canonical": r[3]} for r in rules], **more})], [limit])
        return answer, error

    def grow(error):
        nonlocal limit, grown
        more = min(max(2 * limit, limit + 1024), 8192)
        if error == "truncated" and more > limit:
            limit, grown = more, grown + 1
            return True
        return False

    def facts(output, strategy, status):
        return output, strategy, status, requests, calls, regenerated, repaired, grown, early, stages, limit

    def complies(output):
        return all(any(v in output for v in r[4]) for r in rules)

    def free(task, strategy):
        nonlocal requests
        kept = None
        for a in range(p.retries):
            requests += 1
            output, error = ask(task, a)
            if error:
                grow(error)
                if a + 1 == p.retries:
                    return facts(kept, strategy, "noncompliant") if task == "glossary" and kept is not None else facts(None, None, "failed")
                continue
            kept = output
            ok = task == "plain" or complies(output)
            if ok or a + 1 == p.retries:
                good, bad = ("glossary_fallback_verified", "glossary_fallback_noncompliant") if task == "fallback" else ("verified", "noncompliant")
                return facts(output, strategy, good if ok else bad)
        return None

    if not rules:
        return free("plain", "conditional_glossary" if soft else "uncontrolled")
    if p.mode == "glossary":
        return free("glossary", "glossary")
    for a in range(p.retries):
        mend = a > 0 and p.repair == "llm_repair" and best[0]
        repaired, regenerated = repaired + bool(mend), regenerated + (a > 0 and not mend)
        requests += 1
        output, error = ask("repair" if mend else "placeholder", a, faulty=best[0])
        what, big = None, False
        if error:
            what, big = ("request_or_processing", error), grow(error)
        else:
            found = TOKEN.findall(output)
            wrong = sorted(w for w in want if w not in found), sorted((w, found.count(w)) for w in want if found.count(w) > 1), sorted((f, found.count(f)) for f in set(found) - set(want))
            score = len(wrong[0]) + sum(n - 1 for _, n in wrong[1]) + sum(n for _, n in wrong[2])
            best = min(best, (output, score), key=lambda b: b[1])
            if score:
                what = ("inventory", str(wrong))
            elif p.quality_gate and any(r[3] + r[0] in output for r in rules):
                what = ("context", str([r[1] for r in rules if r[3] + r[0] in output]))
            elif p.verifier == "all" or p.verifier == "retry" and a:
                requests, calls = requests + 1, calls + 1
                verdict = next((v for v in (ask("verify", a)[0] for _ in range(p.verifier_retries)) if v and v.startswith("{")), None)
                what = ("request_or_processing", "no verdict") if verdict is None else ("semantic", "") if verdict == FAIL else None
        if what is None:
            for r in rules:
                output = output.replace(r[0], r[3])
            return facts(output, "placeholder_exact" if not a else "placeholder_repaired" if p.repair == "llm_repair" else "placeholder_retry_exact", "verified")
        stages.append(what[0])
        seen[what] = seen.get(what, 0) + 1
        if p.repeat_limit and seen[what] >= p.repeat_limit:
            early = True
            if not big:
                break
    return free("fallback", "glossary_fallback")


POLICIES = {
    "retry": loop.Policy(retries=4, max_tokens=1024), "repair": loop.Policy(retries=3, max_tokens=1024, repair="llm_repair"), "no_early": loop.Policy(retries=3, max_tokens=1024, repeat_limit=0, verifier="all"),
    "bare": loop.Policy(retries=2, max_tokens=1024, quality_gate=False, verifier="never"), "glossary": loop.Policy(mode="glossary", retries=2, max_tokens=1024),
}


class More(Script):
    """As the script, with answers to the tasks that it does not know, and a cut-off answer each time."""

    def one(self, r, limit):
        if r["task"] == "glossary":
            n, a = r["paragraph_id"] % 4, r["attempt"]
            return (None, "down") if n == 0 or (n == 1 and a == 1) else ("Any 人士 主体 计划" if n == 2 else "nothing", None)
        if r["task"] == "repair":
            return (r["source"] if r["paragraph_id"] % 2 else r["faulty"]), None
        if r["paragraph_id"] % 12 == 0 and r["task"] == "placeholder":
            return None, "truncated"
        return super().one(r, limit)


@pytest.mark.parametrize("name", POLICIES)
def test_loop(spark, name):
    rows, policy = paragraphs(), POLICIES[name]
    got = loop.translate(spark.createDataFrame(rows, SCHEMA), More(), shared_folder(spark, "loop"), policy).collect()
    assert len(got) == len(rows)
    by = {r.paragraph_id: (r.translation, r.strategy, r.status, r.requests, r.verifier_calls, r.regenerations, r.repairs, r.escalations, r.early_fallback, [x.stage for x in r.rejections], r.max_tokens) for r in got}
    for row in rows:
        assert by[row[1]] == one_by_one(row, More(), policy), row[1]


class Counting(Script):
    """Fails when asked for more than so many paragraphs; the number is shared through a file, as workers are processes."""

    def __init__(self, path, limit):
        self.path, self.limit = str(path), limit

    def reply(self, requests, max_tokens):
        with open(self.path, "a") as f:
            f.write("x" * len(requests))
        if self.limit is not None and any(json.loads(r)["attempt"] >= self.limit for r in requests):
            raise RuntimeError("broken off")
        return super().reply(requests, max_tokens)


def test_a_broken_run_goes_on_and_done_paragraphs_stay(spark, tmp_path):
    rows, policy, log = spark.createDataFrame(paragraphs(), SCHEMA), POLICIES["bare"], tmp_path / "asked"
    folder = shared_folder(spark, "loop")
    with pytest.raises(Exception, match="broken off"):
        loop.translate(rows, Counting(log, 1), folder, policy)
    first = len(log.read_text())
    done = loop.translate(rows, Counting(log, None), folder, policy)
    assert done.count() == 24 and first >= 24
    assert json.loads(loop.opening(rows, policy).limit(1).select(loop.request(policy).alias("r")).first()["r"])["task"] in ("placeholder", "plain")
    log.write_text("")
    changed = rows.withColumn("text", F.when(F.col("paragraph_id") == 3, "new").otherwise(F.col("text")))
    again = loop.translate(changed, Counting(log, None), shared_folder(spark, "loop"), policy, completed=done)
    assert {r.paragraph_id for r in again.collect()} == {3}
    assert loop.translate(rows.limit(0), Script(), shared_folder(spark, "loop"), policy).count() == 0


def test_two_tokens_of_a_term_side_by_side_fail_after_restoring(spark):
    rules = [rule("【术语0001_01】", "T1", "Person", "主体"), rule("【术语0001_02】", "T1", "Person", "主体")]

    class Close:
        def reply(self, requests, max_tokens):
            return [(PASS if json.loads(r)["task"] == "verify" else "【术语0001_01】 【术语0001_02】" if json.loads(r)["task"] == "placeholder" and json.loads(r)["attempt"] == 0 else json.loads(r)["source"], None) for r in requests]

    rows = spark.createDataFrame([("d", 1, "Person a Person", "【术语0001_01】 a 【术语0001_02】", rules, [])], SCHEMA)
    got = loop.translate(rows, Close(), shared_folder(spark, "loop"), POLICIES["retry"]).first()
    assert [r.stage for r in got.rejections] == ["restored"] and got.strategy == "placeholder_retry_exact" and got.translation == "主体 a 主体"


def test_work_has_every_paragraph(spark):
    rows = work(spark, SMALL)
    assert rows.count() == spark.read.parquet(f"{SMALL}/customer.parquet").count()


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_costly_values_are_computed_once_a_row(spark):
    """What a round looks at a row's answer with: one parse, one cut a token, one search; workers get the request alone; paragraphs are dealt out before their terms are searched."""
    rows = spark.createDataFrame(paragraphs(), SCHEMA).withColumn("answer", F.lit(PASS))
    assert plan(rows.select(c.semantic_verdict(F.col("answer")).alias("v"))).count("parse_json(") == 1
    assert plan(rows.select(rs.context_issues(F.col("protected"), F.col("constraints")).alias("v"))).count("split(") == 1
    assert plan(rows.select(rs.restore_with_spans(F.col("protected"), F.col("constraints")).alias("v"))).count("regexp_extract_all(") == 1
    assert plan(rows.select(loop.inventory(F.col("protected"), F.col("constraints"), F.col("soft")).alias("v"))).count("regexp_extract_all(") == 1
    asked = loop.opening(rows, POLICIES["retry"]).select("*", answered(Script(), loop.request(POLICIES["retry"]), F.col("max_tokens")).alias("got"))
    assert "MapInArrow" not in asked._jdf.queryExecution().executedPlan().toString()
    made = plan(work(spark, SMALL))
    assert "RepartitionByExpression [document_id" in made and "windowspecdefinition(document_id" in made and not re.search(r"windowspecdefinition\(document_id#\d+, term_id", made)


def test_each_request_is_asked_once(spark, tmp_path):
    log = tmp_path / "asked"
    done = loop.translate(spark.createDataFrame(paragraphs(), SCHEMA), Counting(log, None), shared_folder(spark, "loop"), POLICIES["bare"])
    assert done.agg(F.sum("requests")).first()[0] == len(log.read_text())
