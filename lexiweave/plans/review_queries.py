"""Sources, review, control and validation operators over the derived relations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import python_text as pt
from ..functions import text as t
from ..operators import annotations as a
from ..operators import controls as c
from ..operators import consistency as cons
from ..operators import statistics as k
from ..operators import coverage as j
from ..sources import filings as fl
from ..sources.contracts import relation, with_clause
from ..sources.tables import table
from .consistency_queries import NV
from .relational_queries import FOUND, NUM, P, PG, PT, SIGN_P, numbered, occurrences, paragraphs, places, uses
from .use_sql import USES
from .text_queries import flat

R, G, E = with_clause("reviews"), with_clause("glossary"), with_clause("evaluations")
HAS = lambda words: " OR ".join(f"contains(l, '{w}')" for w in words)
COMPANY = a.COMPANY.replace("\\\\", "\\")


def suggestion_sql(source: str, term: str) -> str:
    return f"""s0 AS (SELECT *, trim({term}) AS v, lower(trim({term})) AS l FROM {source}), s AS (SELECT *, CASE WHEN regexp_matches(v, '(?i){COMPANY}') OR (upper(v) = v AND lower(v) <> v AND length(v) BETWEEN 2 AND 8) THEN 'PARTY_NAME IMPORTANT false' WHEN l IN {a.PARTIES} THEN 'PARTY_NAME CRITICAL true'
    WHEN {HAS(a.CRITICAL)} THEN 'DEFINED_LEGAL_TERM CRITICAL true' WHEN {HAS(a.RIGHTS)} THEN 'RIGHT_OR_OBLIGATION CRITICAL true' WHEN {HAS(a.DOCUMENTS)} THEN 'DOCUMENT_REFERENCE IMPORTANT true' WHEN {HAS(a.COMMERCIAL)} THEN 'COMMERCIAL_TERM IMPORTANT true' WHEN regexp_matches(v, '^\\p{{Lu}}') THEN 'DEFINED_LEGAL_TERM IMPORTANT true' ELSE 'GENERAL_TERM AUXILIARY false' END AS sug FROM s0)"""


#: Names to classify: every customer as one of a dozen kinds of term.
KINDS = ["Customer Inc.", "SEC", "purchaser", "Effective Date", "exclusive rights", "License Agreement", "purchase price", "Widget", "gadget", "Landlord", "Force Majeure Event", "Notice"]


def names(spark, folder):
    kinds = F.array(*[F.lit(x) for x in KINDS])
    return table(spark, folder, "customer").select("c_custkey", F.element_at(kinds, (F.col("c_custkey") % len(KINDS) + 1).cast("int")).alias("term"))


NAMES = f"names AS (SELECT c_custkey, {KINDS}[CAST(c_custkey % {len(KINDS)} AS INT) + 1] AS term FROM customer)"


def to_validate(spark, folder):
    r = relation(spark, folder, "reviews").select("document_id", "occurrence", "term_id", (F.col("occurrence") % 8).alias("k"), "extraction_status")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("k") + 1).cast("int"))
    return r.select("document_id", "occurrence", "extraction_status", pick("any Person", "the U.S. Person", "x Person", "x Software", "x Person", "x Person", "x Person", "x Person").alias("text"), pick(4, 9, 2, 2, 2, 2, 2, 2).alias("char_start"), pick("Person", "Person", "Person", "Software", "Person", "Person", "Person", "Person").alias("source_term"), pick("主体", "主体", " ", "software", "方", "任何实体", "主体 A", "主体").alias("rendering"), F.when(F.col("k") == 0, "U.S. Person").alias("container"))


STATUS = ["NESTED_IN_LONGER_TERM", "POSSIBLY_NESTED_MODIFIER", "MISSING_RENDERING", "UNTRANSLATED", "AMBIGUOUS_ALIGNMENT", "POSSIBLY_OVER_WIDE", "MIXED_LATIN", "VALID"]
VALID = f"x AS (SELECT document_id, occurrence, {STATUS}[CAST(occurrence % 8 AS INT) + 1] AS validation_status, occurrence % 8 > 0 AS include_in_consistency, occurrence % 8 BETWEEN 1 AND 6 AS needs_rendering_repair, CASE WHEN occurrence % 8 = 3 THEN 'TRANSLATION_ERROR' ELSE extraction_status END AS extraction_status FROM reviews)"


def validated(spark, folder):
    return a.validate_renderings(to_validate(spark, folder)).select("document_id", "occurrence", "validation_status", "include_in_consistency", "needs_rendering_repair", "extraction_status")


def reviewed(spark, folder):
    terms = numbered(spark, folder)
    review = a.export_review(terms, paragraphs(spark, folder))
    edited = review.withColumn("criticality", F.when(F.col("term_id") == "T0002", "EXCLUDED").otherwise("")).filter("term_id <> 'T0003'")
    return a.apply_review(terms, edited)


OUTCOMES = list(a.REPAIRS)


def repaired(spark, folder):
    r = relation(spark, folder, "reviews").select(F.concat_ws("-", "document_id", "occurrence").alias("occurrence_id"), "rendering", "extraction_status", F.lit("UNTRANSLATED").alias("validation_status"), F.lit(True).alias("include_in_consistency"), "occurrence")
    answers = r.filter("occurrence % 7 < 6").select("occurrence_id", F.element_at(F.array(*[F.lit(o) for o in OUTCOMES]), (F.col("occurrence") % 7 + 1).cast("int")).alias("outcome"), F.lit("新").alias("repaired")).distinct()
    return a.apply_repairs(r.drop("occurrence"), answers)


def spans(spark, folder):
    """Glossary terms' places with numbered tokens."""
    o = places(spark, folder).join(relation(spark, folder, "glossary").select("term_id", "canonical"), "term_id")
    return c.number_placeholders(o.withColumn("char_end", F.col("char_start") + F.length("source_term")))


SPANS = f"""{FOUND}, named AS (SELECT f.*, canonical, char_start + length(f.source_term) AS char_end, '【术语' || lpad(regexp_replace(f.term_id, '\\D', '', 'g'), 4, '0') AS name, count(*) OVER w AS n, row_number() OVER (w ORDER BY char_start) AS k FROM found f JOIN glossary USING (term_id) WINDOW w AS (PARTITION BY document_id, paragraph_id, f.term_id)),
  spans AS (SELECT *, name || CASE WHEN n > 1 THEN '_' || lpad(CAST(k AS VARCHAR), 2, '0') ELSE '' END || '】' AS placeholder FROM named)"""


def round_trip(spark, folder):
    done = c.inject(paragraphs(spark, folder), spans(spark, folder))
    return done.select("document_id", "paragraph_id", "protected", c.restore(F.col("protected"), F.col("constraints")).alias("restored"))


def variants_of(column):
    item = lambda r, when: F.struct(F.lit(r).alias("rendering"), F.lit(when).alias("condition"))
    return F.array(item("基薪", "informal use"), item(" 基本薪资 ", "always"), item("底薪", "合同"))


def glossary_compliance(spark, folder):
    approved = c.approved_renderings(F.lit("基本薪资"), variants_of(None), F.array(F.lit("薪资")))
    rows = relation(spark, folder, "translations")
    text = F.when(F.col("paragraph_id") % 5 == 0, F.concat("translation", F.lit("底薪"))).otherwise(F.col("translation"))
    return rows.select("document_id", "paragraph_id", c.compliance(text, F.lit("基本薪资"), approved).alias("status"))


def index_text(spark, folder):
    n = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    line = F.when(F.col("o_orderkey") == 3, F.lit(fl.HEADER)).when(F.col("o_orderkey") % 10 == 9, F.lit("bad|line")).otherwise(F.concat_ws("|", (F.col("o_custkey") + 1000).cast("string"), F.concat(F.lit(" Company "), F.col("o_custkey").cast("string")), F.element_at(F.array(*[F.lit(x) for x in ("10-K", "8-K", "4")]), (F.col("o_orderkey") % 3 + 1).cast("int")), F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.lit("edgar/data/"), F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.lit("-24-"), F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0"), F.when(F.col("o_orderkey") % 7 == 0, ".htm").otherwise(".txt"))))
    return n.select(F.col("o_orderkey").alias("line"), line.alias("value"))


INDEX = """idx AS (SELECT CAST(o_custkey + 1000 AS VARCHAR) AS cik, 'Company ' || o_custkey AS company, ['10-K', '8-K', '4'][CAST(o_orderkey % 3 AS INT) + 1] AS form, strftime(o_orderdate, '%Y-%m-%d') AS filed, lpad(CAST(o_custkey AS VARCHAR), 10, '0') || '-24-' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') AS accession FROM orders WHERE o_orderkey > 3 AND o_orderkey % 10 <> 9 AND o_orderkey % 7 <> 0),
  filings AS (SELECT cik, company, form, filed, 'edgar/data/' || accession || '.txt' AS path, accession FROM idx)"""


def ratings(spark, folder):
    """Two reviewers' preferences and the key that says which method is A."""
    e = relation(spark, folder, "evaluations")
    sides = e.select("document_id", "paragraph_id", F.when(F.col("winner") == "tie", "TIE").when(F.col("winner") == "baseline", "A").otherwise("B").alias("one"), (F.col("paragraph_id") % 4 == 1).alias("swapped"), "winner")
    two = F.when(F.col("paragraph_id") % 3 == 0, "TIE").otherwise(F.col("one"))
    role = lambda x: F.when(x == "TIE", "tie").when((x == "A") == ~F.col("swapped"), "baseline").otherwise("controlled")
    both = sides.withColumn("two", two)
    agreed = F.when(role(F.col("one")) == role(F.col("two")), role(F.col("one"))).otherwise("no consensus")
    return both.groupBy(agreed.alias("consensus")).agg(F.count("*").alias("n"), F.count_if(agreed == F.col("winner")).alias("model_agrees"))


def html_blocks(spark, folder):
    return table(spark, folder, "pages").select("page_id", F.posexplode(pt.html_paragraphs_of(F.col("html"))).alias("paragraph_id", "text"))


def exhibit_pages(spark, folder):
    cell = lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>"))
    rows = table(spark, folder, "part").select((F.col("p_partkey") % 50).alias("id"), "p_partkey", F.concat(F.lit("<tr>"), cell(F.col("p_partkey").cast("string")), cell(F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" supply agreement"))).otherwise(F.col("p_name"))), cell(F.concat(F.lit("<a href='/f/"), (F.col("p_partkey") % 700).cast("string"), F.lit("'>doc"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 11 == 0, ".jpg").otherwise(".htm"), F.lit("</a>"))), cell(F.when(F.col("p_partkey") % 5 == 0, "EX-10.1").otherwise("EX-99")), F.lit("</tr>")).alias("row"))
    page = rows.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "row"))), lambda r: r["row"]), "").alias("body"))
    return page.select("id", F.concat(F.lit("<table><tr><th>Seq</th><th>Description</th><th>Document</th><th>Type</th></tr>"), "body", F.lit("</table>")).alias("html"))


REVIEWED = f"{P}, {NUM}, {suggestion_sql('numbered', 'source_term')}, r AS (SELECT document_id, term_id, CASE WHEN term_id <> 'T0003' THEN split_part(sug, ' ', 1) END AS t, CASE term_id WHEN 'T0002' THEN 'EXCLUDED' WHEN 'T0003' THEN NULL ELSE split_part(sug, ' ', 2) END AS c, term_id NOT IN ('T0002', 'T0003') AND split_part(sug, ' ', 3) = 'true' AS i FROM s)"
QUERIES = {
    "s01_parse_index": (lambda s, f: fl.parse_index(index_text(s, f)), f"WITH {INDEX} SELECT * FROM filings"),
    "s02_quarter_url": (lambda s, f: table(s, f, "orders").select("o_orderkey", fl.quarter_index_url(F.year("o_orderdate"), (F.col("o_orderkey") % 6).cast("int")).alias("url")), "SELECT o_orderkey, CASE WHEN o_orderkey % 6 BETWEEN 1 AND 4 THEN 'https://www.sec.gov/Archives/edgar/full-index/' || year(o_orderdate) || '/QTR' || o_orderkey % 6 || '/master.idx' END AS url FROM orders"),
    "s03_filing_url": (lambda s, f: fl.parse_index(index_text(s, f)).select("accession", fl.filing_index_url(F.col("cik"), F.col("accession")).alias("url")), f"WITH {INDEX} SELECT accession, 'https://www.sec.gov/Archives/edgar/data/' || cik || '/' || replace(accession, '-', '') || '/' || accession || '-index.html' AS url FROM filings"),
    "s04_discover_exhibits": (lambda s, f: fl.discover_exhibits(exhibit_pages(s, f)), "WITH x AS (SELECT p_partkey % 50 AS id, '/f/' || p_partkey % 700 AS href, p_partkey, CAST(p_partkey AS VARCHAR) AS sequence, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' supply agreement' ELSE p_name END AS description, 'doc' || p_partkey || '.htm' AS filename, CASE WHEN p_partkey % 5 = 0 THEN 'EX-10.1' ELSE 'EX-99' END AS exhibit_type FROM part WHERE p_partkey % 11 > 0 AND (p_partkey % 5 = 0 OR p_partkey % 3 = 0)) SELECT id, href, arg_max(sequence, p_partkey) AS sequence, arg_max(description, p_partkey) AS description, arg_max(filename, p_partkey) AS filename, arg_max(exhibit_type, p_partkey) AS exhibit_type FROM x GROUP BY id, href"),
    "s04_exhibit_urls": (lambda s, f: fl.discover_exhibits(exhibit_pages(s, f).withColumn("base", F.concat(F.lit("https://example.test/a/"), F.col("id"), F.lit("/index.html"))).withColumn("html", F.expr("replace(replace(html, '/f/1', '../f/1'), '/f/2', '2')"))), "WITH x AS (SELECT p_partkey % 50 AS id, 'https://example.test/' || CASE WHEN starts_with(CAST(p_partkey % 700 AS VARCHAR), '1') THEN 'a/f/' || p_partkey % 700 WHEN starts_with(CAST(p_partkey % 700 AS VARCHAR), '2') THEN 'a/' || p_partkey % 50 || '/' || p_partkey % 700 ELSE 'f/' || p_partkey % 700 END AS url, p_partkey, CAST(p_partkey AS VARCHAR) AS sequence, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' supply agreement' ELSE p_name END AS description, 'doc' || p_partkey || '.htm' AS filename, CASE WHEN p_partkey % 5 = 0 THEN 'EX-10.1' ELSE 'EX-99' END AS exhibit_type FROM part WHERE p_partkey % 11 > 0 AND (p_partkey % 5 = 0 OR p_partkey % 3 = 0)) SELECT id, url, arg_max(sequence, p_partkey) AS sequence, arg_max(description, p_partkey) AS description, arg_max(filename, p_partkey) AS filename, arg_max(exhibit_type, p_partkey) AS exhibit_type FROM x GROUP BY id, url"),
    "s07_sample_filings": (lambda s, f: fl.sample_filings(fl.parse_index(index_text(s, f)), ("10-K", "8-K"), 60, 9).select("path", "form"), f"WITH {INDEX} SELECT path, form FROM (SELECT path, any_value(form) AS form FROM filings WHERE form IN ('10-K', '8-K') GROUP BY path) ORDER BY sha256('9|' || path), path LIMIT 60"),
    "s11_synthesize_ids": (lambda s, f: fl.synthesize_ids(occurrences(s, f).withColumn("occurrence_id", F.when(F.col("paragraph_id") % 2 == 0, "own").otherwise(""))).select("document_id", "term_id", "paragraph_id", "occurrence_id"), f"{PG}, {FOUND} SELECT document_id, term_id, paragraph_id, CASE WHEN paragraph_id % 2 = 0 THEN 'own' ELSE concat_ws('::', document_id, term_id, occurrence_index, paragraph_id) END AS occurrence_id FROM found"),
    "s16_plain_document": (lambda s, f: fl.plain_document(paragraphs(s, f)), f"{P} SELECT document_id, string_agg(text, chr(10) || chr(10) ORDER BY paragraph_id) AS text FROM paragraphs GROUP BY 1"),
    "s17_markdown_rows": (lambda s, f: fl.markdown_rows(relation(s, f, "evaluations").groupBy("document_id").agg(F.count("*").alias("n"), F.avg(F.when(F.col("document_id") != "3", F.col("baseline_quality"))).alias("q"))), f"{E} SELECT '| ' || document_id || ' | ' || count(*) || ' | ' || CASE WHEN document_id = '3' THEN '—' ELSE printf('%.4f', avg(baseline_quality)) END || ' |' AS line FROM evaluations GROUP BY document_id"),
    "s21_document_counts": (lambda s, f: relation(s, f, "reviews").groupBy("experiment").agg(F.count_distinct("document_id").alias("documents")), f"{R} SELECT experiment, count(DISTINCT document_id) AS documents FROM reviews GROUP BY 1"),
    "p03_html_paragraphs": (html_blocks, None),
    "p21_split_source": (lambda s, f: table(s, f, "documents").select("doc_id", F.posexplode(pt.split_source_of(F.col("text"), 900)).alias("chunk", "text")), None),
    "p30_recover_substring": (lambda s, f: table(s, f, "documents").select("doc_id", (pt.recover_substring_of(F.regexp_replace("text", " ", "   "), "text") == F.btrim("text")).alias("same")), "SELECT doc_id, true AS same FROM documents"),
    "p32_json_object": (lambda s, f: relation(s, f, "evaluations").select("paragraph_id", pt.json_object_of(F.concat(F.lit("Sure:\n```json\n{\"winner\": \""), "winner", F.lit("\", \"n\": "), F.col("paragraph_id").cast("string"), F.lit("}\n``` done"))).alias("json")), f"{E} SELECT paragraph_id, '{{\"n\":' || paragraph_id || ',\"winner\":\"' || winner || '\"}}' AS json FROM evaluations"),
    "a01_export_review": (lambda s, f: a.export_review(numbered(s, f), paragraphs(s, f)), f"{P}, {NUM}, ctx AS (SELECT document_id, term_id, string_agg(text, ' || ' ORDER BY paragraph_id) AS c FROM (SELECT document_id, term_id, unnest(definition_paragraph_ids) AS paragraph_id FROM numbered) JOIN paragraphs USING (document_id, paragraph_id) GROUP BY ALL), {suggestion_sql('numbered', 'source_term')} SELECT document_id, term_id, source_term, occurrences AS frequency, extraction_method, array_to_string(definition_paragraph_ids, ';') AS definition_paragraph_ids, CASE WHEN length({flat('c')}) <= 500 THEN {flat('c')} ELSE left({flat('c')}, 499) || '…' END AS definition_context, split_part(sug, ' ', 1) AS suggested_term_type, split_part(sug, ' ', 2) AS suggested_criticality, split_part(sug, ' ', 3) AS suggested_include, '' AS term_type, '' AS criticality, '' AS include_in_benchmark, '' AS reviewer_notes FROM s JOIN ctx USING (document_id, term_id)"),
    "a02_suggest_annotation": (lambda s, f: names(s, f).withColumn("s", a.suggest(F.col("term"))).select("c_custkey", "term", F.concat_ws(" ", "s.term_type", "s.criticality", F.col("s.include").cast("string")).alias("suggestion")), f"WITH {NAMES}, {suggestion_sql('names', 'term')} SELECT c_custkey, term, sug AS suggestion FROM s"),
    "a03_apply_review": (reviewed, f"{P}, {NUM}, {suggestion_sql('numbered', 'source_term')} SELECT document_id, term_id, source_term, CASE WHEN term_id <> 'T0003' THEN split_part(sug, ' ', 1) END AS term_type, CASE term_id WHEN 'T0002' THEN 'EXCLUDED' WHEN 'T0003' THEN NULL ELSE split_part(sug, ' ', 2) END AS criticality, CASE term_id WHEN 'T0002' THEN false WHEN 'T0003' THEN NULL ELSE split_part(sug, ' ', 3) = 'true' END AS include, CASE WHEN term_id = 'T0003' THEN 'missing' END AS problem FROM s"),
    "a04_annotation_statistics": (lambda s, f: a.annotation_statistics(reviewed(s, f)), f"{P}, {NUM}, {suggestion_sql('numbered', 'source_term')}, r AS (SELECT document_id, CASE WHEN term_id <> 'T0003' THEN split_part(sug, ' ', 1) END AS t, CASE term_id WHEN 'T0002' THEN 'EXCLUDED' WHEN 'T0003' THEN NULL ELSE split_part(sug, ' ', 2) END AS c, term_id NOT IN ('T0002', 'T0003') AND split_part(sug, ' ', 3) = 'true' AS i FROM s) SELECT document_id, count(*) AS terms, count(t) AS reviewed, count(*) FILTER (i) AS benchmark_terms, count(*) FILTER (c = 'CRITICAL') AS critical, count(DISTINCT t) AS types FROM r GROUP BY 1"),
    "a04_annotation_counts": (lambda s, f: a.annotation_counts(reviewed(s, f)), f"{REVIEWED} SELECT document_id, 'term_type' AS field, t AS value, count(*) AS terms FROM r WHERE t IS NOT NULL GROUP BY ALL UNION ALL SELECT document_id, 'criticality', c, count(*) FROM r WHERE t IS NOT NULL GROUP BY ALL"),
    "a05_benchmark_terms": (lambda s, f: a.benchmark_terms(reviewed(s, f)).select("document_id", "term_id", "term_type", "criticality"), f"{REVIEWED} SELECT document_id, term_id, t AS term_type, c AS criticality FROM r WHERE i AND c <> 'EXCLUDED'"),
    "a08_merge_saved": (lambda s, f: a.merge_saved(relation(s, f, "reviews").select("occurrence", "rendering", "extraction_status"), relation(s, f, "reviews").filter("occurrence % 4 = 0").select("occurrence", F.lit("旧").alias("rendering"), F.lit(None).cast("string").alias("extraction_status")).distinct(), "occurrence", ["rendering", "extraction_status"]), f"{R} SELECT occurrence, CASE WHEN occurrence % 4 = 0 THEN '旧' ELSE rendering END AS rendering, extraction_status FROM reviews"),
    "a09_low_confidence": (lambda s, f: a.flag_low_confidence(relation(s, f, "reviews").select("occurrence", "extraction_confidence", F.when(F.col("occurrence") % 3 == 0, "Low confidence.").when(F.col("occurrence") % 3 == 1, "see A").alias("notes")), 0.35, "Low confidence."), f"{R}, x AS (SELECT occurrence, extraction_confidence, extraction_confidence < 0.35 AS low_confidence FROM reviews) SELECT *, CASE occurrence % 3 WHEN 0 THEN 'Low confidence.' WHEN 1 THEN CASE WHEN low_confidence THEN 'see A Low confidence.' ELSE 'see A' END ELSE CASE WHEN low_confidence THEN 'Low confidence.' END END AS notes FROM x"),
    "a10_validate_renderings": (validated, f"{R}, {VALID} SELECT * FROM x"),
    "a11_validation_summary": (lambda s, f: a.validation_summary(validated(s, f)), f"{R}, {VALID} SELECT document_id, count(*) AS rows, count(*) FILTER (include_in_consistency) AS included, count(*) FILTER (needs_rendering_repair) AS repairs, count(*) FILTER (validation_status = 'VALID') AS valid FROM x GROUP BY ROLLUP (document_id)"),
    "a12_repair_queue": (lambda s, f: a.repair_queue(validated(s, f).withColumn("repair_status", F.when(F.col("occurrence") % 3 == 0, "FAILED").when(F.col("occurrence") % 3 == 1, "DONE")), retry_failed=True).select("document_id", "occurrence"), f"{R}, {VALID} SELECT document_id, occurrence FROM x WHERE needs_rendering_repair AND occurrence % 3 <> 1"),
    "a13_apply_repairs": (repaired, f"{R} SELECT document_id || '-' || occurrence AS occurrence_id, CASE WHEN occurrence % 7 IN (0, 4, 5) THEN '新' WHEN occurrence % 7 = 6 THEN rendering END AS rendering, ['FOUND', 'OMITTED', 'IMPLICIT', 'AMBIGUOUS', 'TRANSLATION_ERROR', extraction_status, extraction_status][CAST(occurrence % 7 AS INT) + 1] AS extraction_status, ['REPAIRED_MINIMAL', 'REPAIR_OMITTED', 'REPAIR_IMPLICIT', 'REPAIR_AMBIGUOUS', 'REPAIR_UNTRANSLATED', 'REPAIR_FAILED_RETAINED', 'UNTRANSLATED'][CAST(occurrence % 7 AS INT) + 1] AS validation_status, occurrence % 7 <> 5 AS include_in_consistency FROM reviews"),
    "c01_placeholder_names": (lambda s, f: table(s, f, "part").select("p_partkey", c.placeholder(F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).otherwise(F.concat(F.lit("T"), F.col("p_partkey").cast("string")))).alias("token")), "SELECT p_partkey, '【术语' || CASE WHEN p_partkey % 5 = 0 THEN CAST(CAST(('0x' || left(sha256(p_name), 8)) AS BIGINT) AS VARCHAR) ELSE CASE WHEN p_partkey < 1000 THEN lpad(CAST(p_partkey AS VARCHAR), 4, '0') ELSE CAST(p_partkey AS VARCHAR) END END || '】' AS token FROM part"),
    "c02_inject_placeholders": (lambda s, f: round_trip(s, f).select("document_id", "paragraph_id", "protected"), f"{PG}, {SPANS}, three AS (SELECT document_id, paragraph_id, list((char_start, char_end, placeholder) ORDER BY char_start) AS x FROM spans GROUP BY ALL) SELECT document_id, paragraph_id, CASE WHEN x IS NULL THEN text ELSE list_reduce(list_prepend(text, list_transform(list_reverse(x), lambda q: q[1] || '|' || q[2] || '|' || q[3])), lambda s, q: left(s, CAST(split_part(q, '|', 1) AS INT)) || split_part(q, '|', 3) || substr(s, CAST(split_part(q, '|', 2) AS INT) + 1)) END AS protected FROM paragraphs LEFT JOIN three USING (document_id, paragraph_id)"),
    "c03_route_controls": (lambda s, f: c.route(uses(s, f)).groupBy("document_id", "control").agg(F.count("*").alias("n")), f"{USES}, k AS (SELECT * FROM uses WHERE control_eligibility IN ('HARD', 'SOFT')) SELECT document_id, control_eligibility AS control, count(*) AS n FROM k a WHERE control_eligibility = 'HARD' OR NOT EXISTS (SELECT 1 FROM k h WHERE h.document_id = a.document_id AND h.paragraph_id = a.paragraph_id AND h.control_eligibility = 'HARD' AND h.char_start < a.char_end AND a.char_start < h.char_end) GROUP BY ALL"),
    "c07_restore_placeholders": (lambda s, f: round_trip(s, f).select("document_id", "paragraph_id", "restored", c.leftover(F.col("restored")).alias("leftover")), f"{PG}, {SPANS}, x AS (SELECT document_id, paragraph_id, list((char_start, char_end, canonical) ORDER BY char_start) AS x FROM spans GROUP BY ALL) SELECT document_id, paragraph_id, CASE WHEN x IS NULL THEN text ELSE list_reduce(list_prepend(text, list_transform(list_reverse(x), lambda q: q[1] || '|' || q[2] || '|' || q[3])), lambda s, q: left(s, CAST(split_part(q, '|', 1) AS INT)) || split_part(q, '|', 3) || substr(s, CAST(split_part(q, '|', 2) AS INT) + 1)) END AS restored, false AS leftover FROM paragraphs LEFT JOIN x USING (document_id, paragraph_id)"),
    "c09_approved_renderings": (lambda s, f: relation(s, f, "glossary").select("term_id", F.array_join(c.approved_renderings(F.col("canonical"), variants_of(None), F.array(F.lit("薪资"), F.lit(""))), "|").alias("approved")), f"{G} SELECT term_id, CASE WHEN canonical = '基本薪资' THEN '基本薪资|底薪|薪资' ELSE canonical || '|基本薪资|底薪|薪资' END AS approved FROM glossary"),
    "c10_glossary_compliance": (glossary_compliance, f"{PT} SELECT document_id, paragraph_id, CASE WHEN contains(translation, '基本薪资') THEN 'EXACT_CANONICAL' WHEN paragraph_id % 5 = 0 OR contains(translation, '薪资') THEN 'APPROVED_VARIANT' ELSE 'MISSING_REQUIRED_RENDERING' END AS status FROM translations"),
    "c11_all_renderings": (lambda s, f: relation(s, f, "glossary").select("term_id", F.explode(c.all_renderings(F.col("canonical"), variants_of(None), F.array(F.struct(F.lit("人").alias("rendering"))))).alias("r")).select("term_id", "r.*"), f"{G} SELECT term_id, canonical AS rendering, 'canonical' AS kind FROM glossary UNION ALL SELECT term_id, unnest(['基薪', ' 基本薪资 ', '底薪']), 'allowed' FROM glossary UNION ALL SELECT term_id, '人', 'risky' FROM glossary"),
    "c13_resolution": (lambda s, f: relation(s, f, "translations").select("document_id", "paragraph_id", c.resolution(F.col("attempts"), F.col("paragraph_id") % 9 == 0, F.col("translation") == "").alias("resolution")), f"{PT} SELECT document_id, paragraph_id, CASE WHEN translation = '' THEN 'UNRESOLVED' WHEN paragraph_id % 9 = 0 THEN 'GLOSSARY_FALLBACK' WHEN attempts > 1 THEN 'REPAIRED' ELSE 'FIRST_PASS' END AS resolution FROM translations"),
    "g16_control_statistics": (lambda s, f: relation(s, f, "translations").groupBy("document_id").agg(F.count("*").alias("paragraphs"), F.count_if(F.col("attempts") > 1).alias("retried"), F.count_if(F.col("paragraph_id") % 9 == 0).alias("fallbacks"), F.sum(F.col("attempts") - 1).alias("extra_attempts")), f"{PT} SELECT document_id, count(*) AS paragraphs, count(*) FILTER (attempts > 1) AS retried, count(*) FILTER (paragraph_id % 9 = 0) AS fallbacks, CAST(sum(attempts - 1) AS BIGINT) AS extra_attempts FROM translations GROUP BY 1"),
    "g18_document_metrics": (lambda s, f: cons.aggregate(relation(s, f, "reviews")).groupBy("document_id").agg(F.round(F.sum(F.col("dominant_translation_ratio").cast("decimal(18,6)")).cast("double") / F.count("dominant_translation_ratio"), 6).alias("mean_dtr"), cons.ratio(F.sum("omitted"), F.sum("occurrences")).alias("omission_rate")), f"{R}, i AS (SELECT *, {NV} AS v FROM reviews WHERE include_in_consistency IS NULL OR include_in_consistency), d AS (SELECT document_id, term_id, round(max(n) / sum(n), 6) AS dtr FROM (SELECT document_id, term_id, v, count(*) AS n FROM i WHERE v IS NOT NULL GROUP BY ALL) GROUP BY ALL) SELECT document_id, mean_dtr, omission_rate FROM (SELECT document_id, round(CAST(sum(CAST(dtr AS DECIMAL(18,6))) AS DOUBLE) / count(dtr), 6) AS mean_dtr FROM d GROUP BY 1) JOIN (SELECT document_id, round(count(*) FILTER (extraction_status = 'OMITTED') / count(*), 6) AS omission_rate FROM i GROUP BY 1) USING (document_id)"),
    "g19_reliability": (lambda s, f: relation(s, f, "translations").groupBy("document_id").agg(F.count("*").alias("total"), F.count_if(F.col("paragraph_id") % 9 == 0).alias("uncontrolled")).select("document_id", "total", F.greatest(F.lit(0), F.col("total") - F.col("uncontrolled")).alias("controlled"), F.round(F.try_divide("uncontrolled", "total"), 6).alias("uncontrolled_rate")), f"{PT} SELECT document_id, count(*) AS total, count(*) - count(*) FILTER (paragraph_id % 9 = 0) AS controlled, round(count(*) FILTER (paragraph_id % 9 = 0) / count(*), 6) AS uncontrolled_rate FROM translations GROUP BY 1"),
    "g21_variant_evidence": (lambda s, f: relation(s, f, "reviews").withColumn("v", t.normalize_variant(F.col("rendering"))).filter("v is not null").groupBy("term_id", "v").agg(F.count("*").alias("n"), F.count_distinct("experiment").alias("experiments")).withColumn("place", F.row_number().over(Window.partitionBy("term_id").orderBy(F.desc("n"), "v"))).filter("place <= 2"), f"{R}, x AS (SELECT term_id, {NV} AS v, count(*) AS n, count(DISTINCT experiment) AS experiments FROM reviews GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY term_id ORDER BY n DESC, v) AS INT) AS place FROM x WHERE v IS NOT NULL QUALIFY place <= 2"),
    "g23_status_audit": (lambda s, f: relation(s, f, "reviews").groupBy("experiment", "extraction_status").agg(F.count("*").alias("n"), F.round(F.avg("extraction_confidence"), 6).alias("confidence")), f"{R} SELECT experiment, extraction_status, count(*) AS n, round(avg(extraction_confidence), 6) AS confidence FROM reviews GROUP BY ALL"),
    "g25_subset_wins": (lambda s, f: relation(s, f, "evaluations").filter("has_terms").groupBy("winner").agg(F.count("*").alias("n"), F.round(F.avg(F.col("controlled_quality") - F.col("baseline_quality")), 6).alias("delta")), f"{E} SELECT winner, count(*) AS n, round(avg(controlled_quality - baseline_quality), 6) AS delta FROM evaluations WHERE has_terms GROUP BY 1"),
    "j15_paired_documents": (lambda s, f: cons.aggregate(relation(s, f, "reviews"), ["experiment", "term_id"]).groupBy("term_id").pivot("experiment", ["large__placeholder", "small__glossary"]).agg(F.first("dominant_translation_ratio")).dropna(), f"{R}, i AS (SELECT *, {NV} AS v FROM reviews WHERE include_in_consistency IS NULL OR include_in_consistency), d AS (SELECT experiment, term_id, round(max(n) / sum(n), 6) AS dtr FROM (SELECT experiment, term_id, v, count(*) AS n FROM i WHERE v IS NOT NULL GROUP BY ALL) GROUP BY ALL) SELECT a.term_id, a.dtr AS large__placeholder, b.dtr AS small__glossary FROM d a JOIN d b ON a.term_id = b.term_id AND a.experiment LIKE 'large%' AND b.experiment LIKE 'small%'"),
    "k04_sign_test": (lambda s, f: relation(s, f, "evaluations").groupBy("document_id").agg(F.count_if(F.col("controlled_quality") > F.col("baseline_quality")).alias("up"), F.count_if(F.col("controlled_quality") < F.col("baseline_quality")).alias("down")).withColumn("p", F.round(k.sign_test(F.col("up"), F.col("down")), 6)), f"{E}, g AS (SELECT document_id, count(*) FILTER (controlled_quality > baseline_quality) AS up, count(*) FILTER (controlled_quality < baseline_quality) AS down FROM evaluations GROUP BY 1) SELECT *, round({SIGN_P}, 6) AS p FROM g"),
    "k08_consensus": (ratings, f"{E}, x AS (SELECT winner, CASE WHEN winner = 'tie' THEN 'TIE' WHEN winner = 'baseline' THEN 'A' ELSE 'B' END AS one, paragraph_id FROM evaluations), y AS (SELECT *, CASE WHEN paragraph_id % 3 = 0 THEN 'TIE' ELSE one END AS two, paragraph_id % 4 = 1 AS sw FROM x), z AS (SELECT winner, CASE WHEN one <> two THEN 'no consensus' WHEN one = 'TIE' THEN 'tie' WHEN (one = 'A') <> sw THEN 'baseline' ELSE 'controlled' END AS consensus FROM y) SELECT consensus, count(*) AS n, count(*) FILTER (consensus = winner) AS model_agrees FROM z GROUP BY 1"),
}
