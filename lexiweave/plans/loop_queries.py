"""The closed translation loop over every paragraph, with a scripted provider that fails in a way and a number of times that the paragraph's number says."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import closed_loop as loop
from ..operators import controls as c
from ..operators.recovery import recover
from ..sources.shared import shared_folder
from ..sources.tables import table
from .relational_queries import PG, paragraphs
from .review_queries import SPANS, spans

POLICY = loop.Policy(retries=4, max_tokens=1024)
PASS = '{"adequacy": "PASS", "term_semantics": "PASS", "unsupported_addition": false, "meaning_omission": false, "unnatural_attachment": false, "broken_legal_logic": false}'
FAIL = PASS.replace('"meaning_omission": false', '"meaning_omission": true')


class Script:
    """Translates by leaving the words as they are; twelve kinds of failure by paragraph."""

    def reply(self, requests: list[str], max_tokens: list[int]) -> list[tuple[str | None, str | None]]:
        return [self.one(json.loads(r), n) for r, n in zip(requests, max_tokens)]

    def one(self, r: dict, limit: int) -> tuple[str | None, str | None]:
        kind, task, a = r["paragraph_id"] % 12, r["task"], r["attempt"]
        if kind == 8 or (kind == 5 and a == 0 and task in ("placeholder", "plain")) or (kind == 11 and a == 0 and task == "placeholder"):
            return None, "down"
        if kind == 6 and limit < 2048:
            return None, "truncated"
        if task == "verify":
            return ("no object" if kind == 9 and a == 1 else FAIL if kind == 11 or (kind == 7 and a == 1) else PASS), None
        if task == "plain":
            return r["source"], None
        if task == "fallback":
            return (r["source"] if kind == 4 or (kind == 10 and a == 0) else " ".join([r["source"], *[t["canonical"] for t in r["terms"]]])), None
        first, made_up = r["terms"][0]["placeholder"], "【术语9999】"
        lost, doubled = r["source"].replace(first, "", 1), r["source"].replace(first, first + " and " + first, 1)
        tries = {1: [lost], 2: [lost] * 4, 3: [lost, doubled], 4: [r["source"].replace(first, r["terms"][0]["canonical"] + first)] * 4, 7: [lost], 9: [r["source"] + made_up], 10: [lost, doubled, r["source"] + made_up, lost + made_up]}.get(kind, [])
        return (tries[a] if a < len(tries) else r["source"]), None


def work(spark, folder):
    """Paragraphs with their tokens and the rules for these."""
    known = lambda v: F.array(F.struct(v["canonical"].alias("rendering"), F.lit("canonical").alias("kind")))
    item = lambda v: F.struct(*[v[n].alias(n) for n in ("placeholder", "term_id", "source_term", "canonical")], F.array(v["canonical"]).alias("approved"), F.lit("USE").alias("usage"), known(v).alias("renderings"))
    rows = c.inject(paragraphs(spark, folder), spans(spark, folder), ("term_id", "source_term"), ("text",))
    soft = F.when(F.col("paragraph_id") % 2 == 0, F.array(F.lit("hint"))).otherwise(loop.empty("string"))
    return rows.select("document_id", "paragraph_id", "protected", "text", F.transform("constraints", item).alias("constraints"), soft.alias("soft"))


def translated(spark, folder):
    return loop.translate(work(spark, folder), Script(), shared_folder(spark, "loop"), POLICY)


def closed_loop(spark, folder):
    rows = translated(spark, folder)
    return rows.select("document_id", "paragraph_id", "translation", "strategy", "status", "requests", "verifier_calls", "regenerations", "escalations", "early_fallback", F.array_join(F.transform("rejections", lambda r: r["stage"]), ",").alias("rejections"), "max_tokens")


def totals(spark, folder):
    w = work(spark, folder)
    return loop.run_totals(w, loop.translate(w, Script(), shared_folder(spark, "loop"), POLICY))


#: What the script leads to, by kind: strategy, status, requests, verifier calls, regenerations, early fallback, stages.
EXPECTED = {
    0: ("placeholder_exact", "verified", 1, 0, 0, False, ""), 1: ("placeholder_retry_exact", "verified", 3, 1, 1, False, "inventory"),
    2: ("glossary_fallback", "glossary_fallback_verified", 3, 0, 1, True, "inventory,inventory"), 3: ("placeholder_retry_exact", "verified", 4, 1, 2, False, "inventory,inventory"),
    4: ("glossary_fallback", "glossary_fallback_noncompliant", 6, 0, 1, True, "context,context"), 5: ("placeholder_retry_exact", "verified", 3, 1, 1, False, "request_or_processing"),
    6: ("placeholder_retry_exact", "verified", 3, 1, 1, False, "request_or_processing"), 7: ("placeholder_retry_exact", "verified", 5, 2, 2, False, "inventory,semantic"),
    8: (None, "failed", 6, 0, 1, True, "request_or_processing,request_or_processing"), 9: ("placeholder_retry_exact", "verified", 5, 2, 2, False, "inventory,request_or_processing"),
    10: ("glossary_fallback", "glossary_fallback_verified", 6, 0, 3, False, "inventory,inventory,inventory,inventory"), 11: ("glossary_fallback", "glossary_fallback_verified", 6, 2, 2, True, "request_or_processing,semantic,semantic"),
}
_text = lambda v: "CAST(NULL AS VARCHAR)" if v is None else f"'{v}'"
_rows = ", ".join(f"({k}, {_text(a)}, {_text(b)}, {n}, {v}, {g}, {str(e).lower()}, {_text(s)})" for k, (a, b, n, v, g, e, s) in EXPECTED.items())
LOOP = f"""{PG}, {SPANS}, cut AS (SELECT document_id, paragraph_id, list((char_start, char_end, canonical) ORDER BY char_start) AS x, string_agg(canonical, ' ' ORDER BY char_start) AS names FROM spans GROUP BY ALL),
  kinds AS (SELECT * FROM (VALUES {_rows}) AS v(kind, strategy, status, requests, verifier_calls, regenerations, early_fallback, rejections)),
  p AS (SELECT document_id, paragraph_id, text, x, names, paragraph_id % 12 AS kind, CASE WHEN x IS NULL THEN text ELSE list_reduce(list_prepend(text, list_transform(list_reverse(x), lambda q: q[1] || '|' || q[2] || '|' || q[3])), lambda s, q: left(s, CAST(split_part(q, '|', 1) AS INT)) || split_part(q, '|', 3) || substr(s, CAST(split_part(q, '|', 2) AS INT) + 1)) END AS restored FROM paragraphs LEFT JOIN cut USING (document_id, paragraph_id)),
  done AS (SELECT document_id, paragraph_id, CASE WHEN kind = 8 THEN NULL WHEN x IS NULL THEN text WHEN kind = 4 THEN text WHEN strategy = 'glossary_fallback' THEN text || ' ' || names ELSE restored END AS translation,
    CASE WHEN x IS NOT NULL OR kind = 8 THEN strategy WHEN paragraph_id % 2 = 0 THEN 'conditional_glossary' ELSE 'uncontrolled' END AS strategy, CASE WHEN x IS NULL AND kind <> 8 THEN 'verified' ELSE status END AS status,
    CASE WHEN x IS NOT NULL THEN requests WHEN kind = 8 THEN 4 WHEN kind IN (5, 6) THEN 2 ELSE 1 END AS requests, CASE WHEN x IS NULL THEN 0 ELSE verifier_calls END AS verifier_calls, CASE WHEN x IS NULL THEN 0 ELSE regenerations END AS regenerations,
    CASE WHEN kind = 6 THEN 1 ELSE 0 END AS escalations, x IS NOT NULL AND early_fallback AS early_fallback, CASE WHEN x IS NULL THEN '' ELSE rejections END AS rejections, CASE WHEN kind = 6 THEN 2048 ELSE 1024 END AS max_tokens FROM p JOIN kinds USING (kind))"""

class Short:
    """Answers pieces of up to 200 to 3,400 characters, as the paragraph's number says."""

    def reply(self, requests: list[str], max_tokens: list[int]) -> list[tuple[str | None, str | None]]:
        asked = [json.loads(r) for r in requests]
        return [(None, "truncated") if len(r["source"]) > 200 + 800 * (r["paragraph_id"] % 5) else (r["source"], None) for r in asked]


def recovered(spark, folder):
    """Whole documents as paragraphs; what came of each, and how many characters its pieces have."""
    rows = table(spark, folder, "documents").select(F.lit("d").alias("document_id"), F.col("doc_id").alias("paragraph_id"), "text")
    done = recover(rows, Short(), shared_folder(spark, "recovery"), 9000)
    return done.select("paragraph_id", "limit", "pieces", "attempts", F.length("translation").alias("characters"))


QUERIES = {
    "p22_recovered": (recovered, None),
    "c14_closed_loop": (closed_loop, f"{LOOP} SELECT * FROM done"),
    "c14_run_totals": (totals, f"""{LOOP}, d AS (SELECT document_id, count(*) AS n, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status IN ('glossary_fallback_noncompliant', 'noncompliant')) AS unresolved, sum(requests) AS requests FROM done GROUP BY 1),
      t AS (SELECT count(*) AS documents, count(*) FILTER (failed = 0) AS documents_complete, CAST(sum(n) AS BIGINT) AS paragraphs, CAST(sum(failed) AS BIGINT) AS failed_paragraphs, CAST(sum(unresolved) AS BIGINT) AS unresolved_paragraphs, CAST(sum(requests) AS BIGINT) AS requests FROM d)
      SELECT *, CASE WHEN documents_complete < documents THEN 'partial' WHEN unresolved_paragraphs > 0 THEN 'completed_with_unresolved' ELSE 'complete' END AS status FROM t"""),
}
