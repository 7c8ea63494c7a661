"""Requests over all occurrences, terms, and pairs of translations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import coverage as j
from ..operators import judgments as jd
from ..operators import requests as rq
from ..sources.contracts import relation
from .relational_queries import FOUND, PG, occurrences, paragraphs

ITEMS, CHARS, SOURCE, TARGET = 6, 1100, 100, 180


def pairs(spark, folder):
    rows = j.pair(occurrences(spark, folder), relation(spark, folder, "translations")).join(paragraphs(spark, folder), ["document_id", "paragraph_id"])
    return rows.withColumn("source_context", t.context(F.col("text"), F.col("char_start"), F.col("char_start") + F.length("source_term")))


def cut(x: str, n: int) -> str:
    rest = n - len(t.TRUNCATION_MARKER)
    marker = " || ".join(f"'{p}'" if p else "''" for p in ["...[TRUNCATED]..."])
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE left({x}, {rest // 2}) || chr(10) || {marker} || chr(10) || right({x}, {rest - rest // 2}) END"


#: Batch numbers of a list of sizes: a fold with the open batch's number, rows and characters.
FOLD = """list_reduce(list_prepend({{'b': 0, 'n': 0, 'c': CAST(0 AS BIGINT), 'out': CAST([] AS INT[])}}, list_transform({sizes}, lambda s: {{'b': 0, 'n': 0, 'c': CAST(s AS BIGINT), 'out': CAST([] AS INT[])}})),
  lambda a, x: CASE WHEN len(a.out) > 0 AND (a.n >= {items} OR a.c + x.c > {chars}) THEN {{'b': a.b + 1, 'n': 1, 'c': x.c, 'out': list_append(a.out, a.b + 1)}} ELSE {{'b': a.b, 'n': a.n + 1, 'c': a.c + x.c, 'out': list_append(a.out, a.b)}} END).out"""
CONTEXT = "substr(text, greatest(char_start - 140, 0) + 1, least(length(text), char_start + length(source_term) + 140) - greatest(char_start - 140, 0))"
PAIRED = f"""{PG}, {FOUND}, pr AS (SELECT found.document_id, concat_ws('::', found.document_id, found.term_id, occurrence_index, found.paragraph_id, char_start) AS occurrence_id, source_term, {CONTEXT} AS sc, coalesce(translation, '') AS tp FROM found JOIN paragraphs USING (document_id, paragraph_id) LEFT JOIN translations USING (document_id, paragraph_id)),
  ct AS (SELECT document_id, occurrence_id, source_term, {cut('sc', SOURCE)} AS source_context, {cut('tp', TARGET)} AS target_paragraph FROM pr)"""
STATUSES = "|".join(jd.EXTRACTION)
EXTRACT = f"""{PAIRED}, ls AS (SELECT document_id, list({{'occurrence_id': occurrence_id, 'source_term': source_term, 'source_context': source_context, 'target_paragraph': target_paragraph}} ORDER BY occurrence_id) AS xs, list(length(source_context) + length(target_paragraph) ORDER BY occurrence_id) AS sizes FROM ct GROUP BY 1),
  nb AS (SELECT document_id, unnest(xs) AS x, unnest({FOLD.format(sizes='sizes', items=ITEMS, chars=CHARS)}) AS batch FROM ls)
  SELECT document_id, batch, CAST(count(*) AS INT) AS items, CAST(to_json({{'task': 'extract_legal_term_renderings', 'items': list(x ORDER BY x.occurrence_id), 'output_schema': {{'results': [{{'occurrence_id': 'string', 'rendering': 'words of the target or null', 'status': '{STATUSES}', 'confidence': '0 to 1', 'rationale': 'string'}}]}}}}) AS VARCHAR) AS request FROM nb GROUP BY ALL"""


def planned(spark, folder):
    o = occurrences(spark, folder).groupBy("document_id", "term_id", "source_term").agg(F.array_sort(F.collect_set(F.concat(F.lit("paragraph "), F.col("paragraph_id")))).alias("occurrence_contexts"))
    g = relation(spark, folder, "glossary").select("term_id", "term_type", "criticality", "canonical")
    return o.join(g, "term_id").withColumns({"definition_context": F.concat(F.lit("about "), "source_term"), "candidates": F.array("canonical")})


PLAN = f"""{PG}, {FOUND}, o AS (SELECT document_id, f.term_id, f.source_term, list_sort(list(DISTINCT 'paragraph ' || paragraph_id)) AS ctx FROM found f GROUP BY ALL), tm AS (SELECT document_id, term_id, o.source_term, term_type, criticality, 'about ' || o.source_term AS dc, ctx, [canonical] AS cand FROM o JOIN glossary g USING (term_id)),
  ls AS (SELECT document_id, list({{'term_id': term_id, 'source_term': source_term, 'term_type': term_type, 'criticality': criticality, 'definition_context': dc, 'occurrence_contexts': ctx, 'observed_candidate_renderings': cand}} ORDER BY term_id) AS xs, list(length(dc) + length(array_to_string(ctx, '')) ORDER BY term_id) AS sizes FROM tm GROUP BY 1),
  nb AS (SELECT document_id, unnest(xs) AS x, unnest({FOLD.format(sizes='sizes', items=3, chars=400)}) AS batch FROM ls), nn AS (SELECT *, CAST(row_number() OVER (PARTITION BY document_id, batch ORDER BY x.term_id) - 1 AS INT) AS k FROM nb)
  SELECT document_id, batch, CAST(count(*) AS INT) AS items, CAST(to_json({{'task': 'plan_terms', 'allowed_risk_types': ['NARROW', 'WIDE'], 'items': list({{'item_id': k, 'term_id': x.term_id, 'source_term': x.source_term, 'term_type': x.term_type, 'criticality': x.criticality, 'definition_context': x.definition_context, 'occurrence_contexts': x.occurrence_contexts, 'observed_candidate_renderings': x.observed_candidate_renderings}} ORDER BY k)}}) AS VARCHAR) AS request FROM nn GROUP BY ALL"""


def judged_pairs(spark, folder):
    r = relation(spark, folder, "translations").select("document_id", "paragraph_id", "source", F.col("translation").alias("translation_a"), F.reverse("translation").alias("translation_b"))
    g = relation(spark, folder, "glossary").select("term_id", "canonical", F.when(F.col("criticality") != "EXCLUDED", F.col("criticality")).alias("criticality"), F.repeat(F.concat("source_term", F.lit("  scope ")), 9).alias("scope"))
    return rq.blind_judge_requests(r, occurrences(spark, folder).select("document_id", "paragraph_id", "term_id", "source_term").join(g, "term_id"))


JUDGE = f"""{PG}, {FOUND}, tm AS (SELECT DISTINCT document_id, paragraph_id, f.source_term, canonical, CASE WHEN criticality = 'EXCLUDED' THEN '' ELSE criticality END AS criticality, left(trim(regexp_replace(repeat(f.source_term || '  scope ', 9), '\\s+', ' ', 'g')), 120) AS scope FROM found f JOIN glossary USING (term_id)),
  tl AS (SELECT document_id, paragraph_id, list({{'source_term': source_term, 'canonical': canonical, 'criticality': criticality, 'scope': scope}} ORDER BY source_term) AS terms FROM tm GROUP BY ALL)
  SELECT document_id, paragraph_id, CAST(to_json({{'task': 'blind_pairwise_judgment', 'source': source, 'terms': coalesce(terms, []), 'translation_a': translation, 'translation_b': reverse(translation), 'scores_1_to_5': [{', '.join(f"'{f}'" for f in rq.SCORE_FIELDS.values())}], 'critical_errors': [{', '.join(f"'{f}'" for f in rq.ERROR_FIELDS.values())}], 'winner': ['A', 'B', 'TIE']}}) AS VARCHAR) AS request FROM translations LEFT JOIN tl USING (document_id, paragraph_id)"""

QUERIES = {
    "v02_extraction_requests": (lambda s, f: rq.extraction_requests(pairs(s, f), ITEMS, CHARS, SOURCE, TARGET), EXTRACT),
    "v02_planner_requests": (lambda s, f: rq.planner_requests(planned(s, f), ["WIDE", "NARROW"], 3, 400), PLAN),
    "v02_blind_judge_requests": (judged_pairs, JUDGE),
}
