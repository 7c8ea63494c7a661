"""Tokens in model output, counts of a controlled run, and requests to a judge over the derived relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import consistency as cons
from ..operators import judging as jg
from ..operators import restoring as rs
from ..sources.contracts import relation, with_clause
from .consistency_queries import NV, R, sql_variants

PT = with_clause("translations")

#: Output texts that differ by paragraph, read by Spark and DuckDB alike: wording and title marks beside tokens, a token
#: used twice, one without a constraint.
BEFORE = "CASE paragraph_id % 5 WHEN 0 THEN '本 生效日期，' WHEN 1 THEN '《' WHEN 2 THEN '自起算日' ELSE '自' END"
AFTER = "CASE paragraph_id % 7 WHEN 0 THEN '（生效日期）起' WHEN 1 THEN '》起' WHEN 2 THEN '【术语0003】' WHEN 3 THEN '及【术语0009】' ELSE '起' END"
OUTPUT = f"SELECT document_id, paragraph_id, concat(left(translation, 40), {BEFORE}, '【术语0003】', {AFTER}, '；【术语0007_01】') AS output FROM translations"
KNOWN = (("生效日期", "canonical"), ("起算日", "allowed"), ("，", "risky"))
TITLED = "《生效日期》"


def output(spark, folder):
    relation(spark, folder, "translations").createOrReplaceTempView("lw_translations")
    return spark.sql(OUTPUT.replace("FROM translations", "FROM lw_translations"))


def constraints():
    renderings = F.array(*[F.struct(F.lit(r).alias("rendering"), F.lit(k).alias("kind")) for r, k in KNOWN])
    one = lambda token, term, text: F.struct(F.lit(token).alias("placeholder"), F.lit(term).alias("term_id"), F.lit(text).alias("canonical"), renderings.alias("renderings"))
    return F.array(one("【术语0003】", "T0003", TITLED), one("【术语0007_01】", "T0007", "基本薪资"))


def diagnosed(spark, folder):
    rows = output(spark, folder).select("document_id", "paragraph_id", F.posexplode(rs.context_issues(F.col("output"), constraints())).alias("place", "i"))
    return rows.select("document_id", "paragraph_id", "place", "i.issue_type", "i.placeholder", "i.rendering", "i.rendering_kind", "i.side", "i.local_context")


COMPACT = lambda x: r"regexp_replace(" + x + r", '[\s\x{00a0}\x{3000}，。；：、,.!?！？（）()\[\]【】《》〈〉“”‘’\x22\x27—–-]+', '', 'g')"
ISSUES = f"""o AS ({OUTPUT}), c AS (SELECT * FROM (VALUES (0, '【术语0003】', '{TITLED}'), (1, '【术语0007_01】', '基本薪资')) AS v(k, token, canonical)),
  cut AS (SELECT o.*, c.*, strpos(output, token) AS spot FROM o CROSS JOIN c WHERE length(output) - length(replace(output, token, '')) = length(token)),
  ctx AS (SELECT *, substr(output, greatest(spot - 28, 1), spot - greatest(spot - 28, 1)) AS l, substr(output, spot + length(token), 28) AS r FROM cut),
  named AS (SELECT * FROM ctx CROSS JOIN (VALUES {", ".join(f"({i}, '{r}', '{k}')" for i, (r, k) in enumerate(KNOWN))}) AS v(j, rendering, kind)),
  beside AS (SELECT *, CASE WHEN {COMPACT('rendering')} = '' THEN NULL WHEN ends_with({COMPACT('l')}, {COMPACT('rendering')}) THEN 'LEFT' WHEN starts_with({COMPACT('r')}, {COMPACT('rendering')}) THEN 'RIGHT' END AS side FROM named),
  issues AS (SELECT document_id, paragraph_id, k, 0 AS m, 'PLACEHOLDER_WRAPPER_CONTAMINATION' AS issue_type, token, rendering, kind, side, l, r FROM beside WHERE side IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id, paragraph_id, k ORDER BY j) = 1
    UNION ALL SELECT document_id, paragraph_id, k, 1, 'REDUNDANT_TITLE_MARK_WRAPPER', token, NULL, NULL, NULL, l, r FROM ctx WHERE canonical LIKE '《%》' AND ends_with(rtrim(l), '《') AND starts_with(ltrim(r), '》'))"""


#: Tokens beside renderings: aliases in brackets on either side, a second token of the term, title marks, and none.
DEFINED = (("【术语0003】", "T0003", "DEFINIENDUM", ("生效日期", "起算日")), ("【术语0003_02】", "T0003", "USE", ("生效日期", "起算日")), ("【术语0009】", "T0009", "USE", ("《激励计划》",)))
FORMS = ("《生效日期》（“【术语0003】”）", "【术语0003】（以下简称“起算日”）", "生效日期(【术语0003】)自【术语0003_02】 起算日", "起算日【术语0003_02】，【术语0003】", "见《激励计划》【术语0009】", "【术语0009】 《激励计划》与《【术语0003】》", "【术语0003】（生效日期）生效日期【术语0003_02】")
ALIASES = f"SELECT document_id, paragraph_id, concat(left(translation, 30), CASE paragraph_id % 8 {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(FORMS))} ELSE '' END, '起。') AS output FROM translations"


def collapsed(spark, folder):
    relation(spark, folder, "translations").createOrReplaceTempView("lw_translations")
    known = lambda names: F.array(*[F.struct(F.lit(x).alias("rendering"), F.lit("allowed" if i else "canonical").alias("kind")) for i, x in enumerate(names)])
    items = F.array(*[F.struct(F.lit(p).alias("placeholder"), F.lit(t_).alias("term_id"), F.lit(u).alias("usage"), known(names).alias("renderings")) for p, t_, u, names in DEFINED])
    rows = spark.sql(ALIASES.replace("FROM translations", "FROM lw_translations")).withColumn("r", rs.collapse_aliases(F.col("output"), items))
    return rows.select("document_id", "paragraph_id", F.col("r.text").alias("text"), F.array_join(F.transform("r.events", lambda e: F.concat(e["placeholder"], F.lit(" "), e["pattern"])), "|").alias("events"))


def aliases_sql() -> str:
    """One step for each rule: tried where its token is still there to take and, for second tokens, the term has lost one."""
    rules, gap = [], r"\s*"
    opened, closed = r"\s*[（(]\s*" + rs.ALIAS_WORD + gap + rs.QUOTES.replace("'", "''") + gap, gap + rs.QUOTES.replace("'", "''") + r"\s*[）)]"
    for which in (1, 2, 3):
        for token, term, _, names in DEFINED:
            for i, x in enumerate(names):
                kind, marked = ("ALLOWED_VARIANT" if i else "CANONICAL"), x.startswith("《")
                full = f"({x})" if marked else f"(《\\s*{x}\\s*》|{x})"
                if which == 1 and term == "T0003":
                    rules += [(token, "true", full + opened + token + closed, f"{kind}_THEN_ALIAS"), (token, "true", token + opened + full + closed, f"ALIAS_THEN_{kind}")]
                elif which == 2:
                    rules += [(token, f"contains(events, '{token[:7]}')", token + gap + full, f"SIBLING_ALIAS_BEFORE_{kind}"), (token, f"contains(events, '{token[:7]}')", full + gap + token, f"SIBLING_ALIAS_AFTER_{kind}")]
                elif which == 3 and marked:
                    rules += [(token, "true", full + gap + token, f"TITLE_MARKED_{kind}_BEFORE_PLACEHOLDER"), (token, "true", token + gap + full, f"PLACEHOLDER_BEFORE_TITLE_MARKED_{kind}")]
    steps = [f"s0 AS (SELECT document_id, paragraph_id, output AS text, '' AS events FROM ({ALIASES}))"]
    for i, (token, when, pattern, label) in enumerate(rules):
        hit = f"(NOT contains(events, '{token} ') AND {when} AND regexp_matches(text, '{pattern}'))"
        steps.append(f"s{i + 1} AS (SELECT document_id, paragraph_id, CASE WHEN {hit} THEN regexp_replace(text, '{pattern}', '\\1') ELSE text END AS text, CASE WHEN {hit} THEN events || CASE WHEN events = '' THEN '' ELSE '|' END || '{token} {label}' ELSE events END AS events FROM s{i})")
    return f"{PT}, {', '.join(steps)} SELECT * FROM s{len(rules)}"


def restored(spark, folder):
    rows = output(spark, folder).withColumn("r", rs.restore_with_spans(F.col("output"), constraints()))
    spans = F.array_join(F.transform("r.spans", lambda s: F.concat_ws(":", s["term_id"], s["start"].cast("string"), s["end"].cast("string"))), "|")
    return rows.select("document_id", "paragraph_id", F.col("r.text").alias("restored"), spans.alias("spans"), F.col("r.problem").alias("problem"))


#: Places of the tokens by their lengths before and after: a text holds 0003 once or twice, then 0007_01 at its end.
RESTORED = f"""o AS ({OUTPUT}), x AS (SELECT *, replace(replace(output, '【术语0003】', '{TITLED}'), '【术语0007_01】', '基本薪资') AS restored, strpos(output, '【术语0003】') - 1 AS a, length('{TITLED}') AS n FROM o)"""

#: The same texts with the canonical or a risky rendering put before the last token.
TAIL = "CASE paragraph_id % 4 WHEN 0 THEN '基本薪资 ' WHEN 1 THEN '薪水，' ELSE '；' END"
FAULTY = f"SELECT document_id, paragraph_id, replace(output, '；【术语0007_01】', concat({TAIL}, '【术语0007_01】')) AS output FROM o"


def faults(spark, folder):
    output(spark, folder).createOrReplaceTempView("lw_output")
    rows = spark.sql(FAULTY.replace("FROM o", "FROM lw_output")).withColumn("r", rs.restore_with_spans(F.col("output"), constraints()))
    known = F.array(F.struct(F.lit("T0007").alias("term_id"), F.lit("薪水").alias("rendering"), F.lit("risky").alias("kind")))
    found = rows.select("document_id", "paragraph_id", F.explode(rs.restored_issues(F.col("r.text"), F.col("r.spans"), known)).alias("i"))
    return found.select("document_id", "paragraph_id", "i.severity", "i.issue_type", "i.term_id", "i.placeholder", "i.rendering", "i.local_context")


FAULTS = f"""o AS ({OUTPUT}), faulty AS ({FAULTY}), y AS (SELECT document_id, paragraph_id, output, replace(replace(output, '【术语0003】', '{TITLED}'), '【术语0007_01】', '基本薪资') AS text, strpos(output, '【术语0003】') - 1 AS a, 6 AS n FROM faulty),
  sp AS (SELECT document_id, paragraph_id, text, 'T0003' AS term_id, '【术语0003】' AS placeholder, '{TITLED}' AS canonical, a AS st, a + n AS en FROM y UNION ALL SELECT document_id, paragraph_id, text, 'T0003', '【术语0003】', '{TITLED}', a + n, a + 2 * n FROM y WHERE paragraph_id % 7 = 2
    UNION ALL SELECT document_id, paragraph_id, text, 'T0007', '【术语0007_01】', '基本薪资', length(text) - 4, length(text) FROM y),
  pl AS (SELECT * FROM (SELECT *, unnest(generate_series(0, length(text) - length(canonical))) AS ps FROM sp) WHERE substr(text, CAST(ps AS INT) + 1, length(canonical)) = canonical),
  ex AS (SELECT *, ps + length(canonical) AS pe FROM pl WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.document_id = pl.document_id AND sp.paragraph_id = pl.paragraph_id AND sp.term_id = pl.term_id AND pl.ps < sp.en AND sp.st < pl.ps + length(pl.canonical))),
  ot AS (SELECT s.*, q.st AS ps, q.en AS pe FROM sp s JOIN sp q ON s.document_id = q.document_id AND s.paragraph_id = q.paragraph_id AND s.term_id = q.term_id AND s.st <> q.st),
  nb AS (SELECT 'DUPLICATED_CANONICAL_RENDERING' AS issue_type, * FROM ex UNION ALL SELECT 'ADJACENT_RESTORED_CANONICAL_DUPLICATION', * FROM ot),
  ad AS (SELECT *, CAST(least(st, ps) AS INT) AS lo, CAST(greatest(en, pe) AS INT) AS hi FROM nb WHERE trim(CASE WHEN pe <= st THEN substr(text, CAST(pe AS INT) + 1, CAST(st - pe AS INT)) ELSE substr(text, CAST(en AS INT) + 1, CAST(ps - en AS INT)) END) = '' QUALIFY row_number() OVER (PARTITION BY document_id, paragraph_id, issue_type, term_id, st ORDER BY ps) = 1),
  cx AS (SELECT *, CAST(greatest(st - 28, 0) AS INT) AS lo, CAST(en + 28 AS INT) AS hi, substr(text, CAST(greatest(st - 28, 0) AS INT) + 1, CAST(st - greatest(st - 28, 0) AS INT)) AS l, substr(text, CAST(en AS INT) + 1, 28) AS r FROM sp),
  all_issues AS (SELECT document_id, paragraph_id, issue_type, term_id, placeholder, canonical AS rendering, substr(text, greatest(lo - 28, 0) + 1, hi + 28 - greatest(lo - 28, 0)) AS local_context FROM ad
    UNION ALL SELECT document_id, paragraph_id, 'NESTED_TITLE_MARKS', term_id, placeholder, NULL, substr(text, lo + 1, hi - lo) FROM cx WHERE term_id = 'T0003' AND (ends_with(rtrim(l), '《') OR starts_with(ltrim(r), '》'))
    UNION ALL SELECT document_id, paragraph_id, 'RISKY_AND_CANONICAL_ADJACENCY', term_id, placeholder, '薪水', substr(text, lo + 1, hi - lo) FROM cx WHERE term_id = 'T0007' AND (ends_with({COMPACT('l')}, '薪水') OR starts_with({COMPACT('r')}, '薪水'))
    UNION ALL SELECT document_id, paragraph_id, 'UNRESTORED_PLACEHOLDER', NULL, NULL, NULL, '【术语0009】' FROM y WHERE contains(text, '【术语0009】'))"""

#: Columns of a run's paragraphs as numbers and names made from the paragraph's number.
RUN_NUMBERS = {c: i for i, c in enumerate(sorted(set(rs.SUMS.values())))}
STRATEGY = "CASE paragraph_id % 6 WHEN 0 THEN 'placeholder_exact' WHEN 1 THEN 'placeholder_retry_exact' WHEN 2 THEN 'placeholder_repaired' WHEN 3 THEN 'conditional_glossary' WHEN 4 THEN 'uncontrolled' END"
STATUS = "CASE paragraph_id % 8 WHEN 0 THEN 'glossary_fallback_verified' WHEN 1 THEN 'glossary_fallback_noncompliant' WHEN 2 THEN 'noncompliant' WHEN 3 THEN 'first_pass' END"
RUN = ", ".join(f"CASE WHEN paragraph_id % {i + 3} = 0 THEN NULL ELSE CAST(paragraph_id % {i + 2} AS INT) END AS {c}" for c, i in RUN_NUMBERS.items())
RUN = f"""SELECT document_id, paragraph_id, {RUN}, {STRATEGY} AS constraint_strategy_used, CASE WHEN paragraph_id % 4 = 0 THEN 'glossary' ELSE 'placeholder' END AS constraint_mode,
  CASE paragraph_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS constraint_compliance, paragraph_id % 7 = 0 AS placeholder_fallback_used, paragraph_id % 9 = 0 AS placeholder_early_fallback, {STATUS} AS resolution_status, paragraph_id % 13 = 0 AS restored FROM translations"""
STAGE_COUNTS = {s: f"(paragraph_id % {i + 2})" for i, s in enumerate(rs.STAGES.values())}


def control_run(spark, folder):
    relation(spark, folder, "translations").createOrReplaceTempView("lw_translations")
    rows = spark.sql(RUN.replace("FROM translations", "FROM lw_translations"))
    stages = [F.array_repeat(F.struct(F.lit(s).alias("stage")), F.expr(n).cast("int")) for s, n in STAGE_COUNTS.items()]
    rows = rows.withColumn("placeholder_quality_gate_rejections", F.when(F.col("paragraph_id") % 5 > 0, F.concat(*stages)))
    errors = relation(spark, folder, "paragraphs").filter("paragraph_id % 11 = 3").select("document_id", "paragraph_id")
    return rs.control_statistics(relation(spark, folder, "paragraphs"), rows, errors.union(errors), ["document_id"])


def run_sql() -> str:
    big = lambda x: f"CAST(coalesce({x}, 0) AS BIGINT)"
    rejected = lambda x: f"sum(CASE WHEN paragraph_id % 5 > 0 THEN {x} ELSE 0 END)"
    columns = {"translated_paragraphs": "count(*)", "restored_paragraphs": "count(*) FILTER (restored)"} | {n: big(f"sum({c})") for n, c in rs.SUMS.items()} | {"placeholder_retries": big("sum(generation_retry_count)")}
    columns |= {n: f"count(*) FILTER ({c} > 0)" for n, c in rs.POSITIVE.items()} | {n: f"count(*) FILTER (constraint_strategy_used = '{s}')" for n, s in rs.STRATEGIES.items()}
    columns |= {"placeholder_quality_gate_rejections": big(rejected(" + ".join(STAGE_COUNTS.values())))} | {n: big(rejected(STAGE_COUNTS[s])) for n, s in rs.STAGES.items()}
    columns |= {
        "placeholder_early_fallback_paragraphs": "count(*) FILTER (placeholder_early_fallback)", "placeholder_fallback_paragraphs": "count(*) FILTER (placeholder_fallback_used)",
        "placeholder_fallback_noncompliance_paragraphs": "count(*) FILTER (placeholder_fallback_used AND constraint_compliance IS DISTINCT FROM true)",
        "placeholder_fallback_verified_paragraphs": "count(*) FILTER (resolution_status = 'glossary_fallback_verified')",
        "glossary_noncompliance_paragraphs": "count(*) FILTER (constraint_mode = 'glossary' AND constraint_compliance IS DISTINCT FROM true)",
        "unresolved_paragraphs": "count(*) FILTER (resolution_status IN ('glossary_fallback_noncompliant', 'noncompliant'))",
    }
    inner = ", ".join(f"{x} AS {n}" for n, x in columns.items())
    outer = ", ".join(f"coalesce({n}, 0) AS {n}" for n in columns)
    return f"""{PT}, run AS ({RUN}), done AS (SELECT document_id, {inner} FROM run GROUP BY 1), every AS (SELECT document_id, count(*) AS total_paragraphs, count(*) FILTER (paragraph_id % 11 = 3) AS failed_paragraphs FROM paragraphs GROUP BY 1)
      SELECT document_id, total_paragraphs, failed_paragraphs, {outer}, greatest(0, total_paragraphs - coalesce(translated_paragraphs, 0)) AS remaining_paragraphs FROM every LEFT JOIN done USING (document_id)"""


#: Answers of a judge by variant: three labels, one unknown, one left out, some with a confidence out of range.
LABEL = "CASE WHEN n % 5 = 0 THEN 'LEGAL_INCONSISTENCY' WHEN n % 5 = 1 THEN 'dunno' WHEN n % 5 = 2 THEN 'UNRESOLVED' ELSE 'ACCEPTABLE_VARIANT' END"
SURE = "CAST(CASE WHEN n % 7 = 0 THEN 1.5 ELSE (n % 9) / 10.0 END AS DOUBLE)"


def reviewed_variants(spark, folder):
    return cons.variants(relation(spark, folder, "reviews"), t.normalize_variant)


def merged(spark, folder):
    v = reviewed_variants(spark, folder)
    return jg.merge_variant_answers(v, v.filter("n % 11 > 0").select("document_id", "term_id", "variant_id", F.expr(LABEL).alias("label"), F.expr(SURE).alias("confidence")))


VAR = f"{R}, var AS ({sql_variants('reviews', NV)})"
QUERIES = {
    "c05_collapsed_aliases": (collapsed, aliases_sql()),
    "c06_context_issues": (diagnosed, f"{PT}, {ISSUES} SELECT document_id, paragraph_id, CAST(row_number() OVER (PARTITION BY document_id, paragraph_id ORDER BY k, m) - 1 AS INT) AS place, issue_type, token AS placeholder, rendering, kind AS rendering_kind, side, l || token || r AS local_context FROM issues"),
    "c07_restored_spans": (restored, f"{PT}, {RESTORED} SELECT document_id, paragraph_id, restored, 'T0003:' || a || ':' || a + n || CASE WHEN paragraph_id % 7 = 2 THEN '|T0003:' || a + n || ':' || a + 2 * n ELSE '' END || '|T0007:' || length(restored) - 4 || ':' || length(restored) AS spans, CASE WHEN paragraph_id % 7 = 3 THEN 'LEFTOVER' END AS problem FROM x"),
    "c08_restored_issues": (faults, f"{PT}, {FAULTS} SELECT DISTINCT document_id, paragraph_id, 'ERROR' AS severity, issue_type, term_id, placeholder, rendering, local_context FROM all_issues"),
    "g16_run_statistics": (control_run, run_sql()),
    "v02_judge_payloads": (lambda s, f: jg.judge_payloads(reviewed_variants(s, f)), f"""{VAR}, g AS (SELECT document_id, term_id, list({{'variant_id': variant_id, 'rendering': variant, 'count': n, 'is_dominant': variant_id = 'V000'}} ORDER BY variant_id) AS v, list(variant_id ORDER BY variant_id) FILTER (variant_id <> 'V000') AS q, max(variant) FILTER (variant_id = 'V000') AS d FROM var GROUP BY ALL HAVING count(*) > 1),
      b AS (SELECT *, CAST((row_number() OVER (PARTITION BY document_id ORDER BY term_id) - 1) // 4 AS INT) AS batch FROM g)
      SELECT document_id, batch, CAST(count(*) AS INT) AS groups, CAST(to_json({{'groups': list({{'group_id': document_id || '::' || term_id, 'dominant_variant_id': 'V000', 'dominant_rendering': d, 'required_non_dominant_variant_ids': q, 'required_variant_judgment_count': len(q), 'variants': v}} ORDER BY term_id)}}) AS VARCHAR) AS payload FROM b GROUP BY ALL"""),
    "v04_merged_answers": (merged, f"""{VAR}, a AS (SELECT *, {LABEL} AS label, {SURE} AS confidence FROM var WHERE variant_id <> 'V000'), u AS (SELECT *, n % 11 > 0 AND label <> 'dunno' AND confidence <= 1 AS ok FROM a), w AS (SELECT *, CASE WHEN ok THEN label ELSE 'UNRESOLVED' END AS l FROM u)
      SELECT document_id, term_id, count(*) AS judged_variants, count(*) FILTER (NOT ok) AS fallbacks, CASE WHEN bool_or(l = 'LEGAL_INCONSISTENCY') THEN 'LEGAL_INCONSISTENCY' WHEN bool_or(l = 'UNRESOLVED') THEN 'UNRESOLVED' ELSE 'ACCEPTABLE_VARIATION' END AS group_label, min(CASE WHEN ok THEN confidence ELSE 0 END) AS confidence FROM w GROUP BY ALL"""),
}
