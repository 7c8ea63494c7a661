"""The rules for uses of terms in DuckDB's SQL, for the queries t18, t19 and c03."""

from __future__ import annotations

from ..operators import terms as tm
from ..sources.contracts import with_clause


def q(x: str) -> str:
    return x.replace("'", "''")


def names(words) -> str:
    return "(" + ", ".join(f"'{q(w)}'" for w in words) + ")"


GAP = r"[\s\-–—/]*"
WORD, QUOTE, VERB, TITLE = q(tm.WORD), q(tm.QUOTE), q(tm.VERB), q(tm.JOB_TITLE)
LETTERS = lambda x: f"regexp_replace(coalesce({x}, ''), '[^A-Za-z]', '', 'g')"
UPPER = lambda x: f"({LETTERS(x)} <> '' AND {LETTERS(x)} = upper({LETTERS(x)}))"
LOW = lambda x: f"lower(coalesce({x}, ''))"
CAPITAL = lambda x: f"({LOW(x)} NOT IN {names(tm.DETERMINERS)} AND {LETTERS(x)} <> '' AND ({UPPER(x)} OR regexp_matches(coalesce({x}, ''), '^[A-Z]')))"
ALIAS = f"(len(words) = 1 AND lower(source_term) NOT IN {names(tm.NO_ALIASES)} AND (regexp_matches(source_term, '^[A-Z]') OR acronym))"
JOIN = lambda left, right: f"concat_ws(' ', CASE WHEN {left} THEN l END, surface, CASE WHEN {right} THEN r END)"
HAS = "l IS NOT NULL"


def rule(when: str, status: str, control: str, reason: str, role: str, sure: float, kind: str = "NULL", phrase: str = "NULL") -> str:
    return f"WHEN {when} THEN {{'usage_status': '{status}', 'control_eligibility': '{control}', 'reason': '{reason}', 'context_classification': CAST({kind} AS VARCHAR), 'compound_context': CAST({phrase} AS VARCHAR), 'definition_role': {role}, 'confidence': CAST({sure} AS DOUBLE)}}"


def named(when: str, reason: str, kind: str, phrase: str, sure: float) -> str:
    return rule(when, "OTHER_NAMED_EXPRESSION_COMPONENT", "NONE", reason, "'OTHER_NAME_COMPONENT'", sure, f"'{kind}'", phrase)


def modified(when: str, reason: str, kind: str, sure: float) -> str:
    return rule(when, "EXTERNAL_MODIFIED_DEFINED_TERM", "HARD", reason, "'OTHER'", sure, f"'{kind}'", JOIN(HAS, "false"))


DEFINIENDUM = f"(regexp_matches(before, '{QUOTE}$') AND regexp_matches(after, '(?i)^{QUOTE}\\s+{VERB}') OR regexp_matches(before, '(?i)\\(\\s*(?:the\\s+)?{QUOTE}$') AND regexp_matches(after, '^{QUOTE}\\s*\\)') OR NOT regexp_matches(before, '[A-Za-z0-9]$') AND regexp_matches(after, '^\\s+{VERB}'))"
RULES = [
    rule("lower(surface) <> lower(source_term)", "SURFACE_MISMATCH", "NONE", "SOURCE_SLICE_DOES_NOT_MATCH_TERM", "'NONE'", 1.0),
    rule("surface <> source_term", "COMMON_WORD_USAGE", "NONE", "CASE_MISMATCH_WITH_DEFINED_TERM", "'NONE'", 0.99),
    rule(DEFINIENDUM, "DEFINIENDUM", "HARD", "EXPLICIT_DEFINIENDUM", "'DEFINIENDUM'", 1.0),
    rule("other IS NOT NULL", "OTHER_LEGAL_NAME_COMPONENT", "NONE", "COMPONENT_OF_DIFFERENT_LEGAL_NAME", "CASE WHEN is_definition THEN 'DEFINIENS_COMPONENT' ELSE 'OTHER_NAME_COMPONENT' END", 0.99, "NULL", "other || surface"),
    named("title IS NOT NULL", "COMPONENT_OF_JOB_TITLE", "JOB_TITLE", "title", 0.99),
    named(f"{LOW('r')} IN {names(tm.INSTRUMENTS)} AND NOT list_contains(list_transform(words, lambda w: lower(w)), {LOW('r')})", "COMPONENT_OF_LEGAL_INSTRUMENT_NAME", "LEGAL_INSTRUMENT_NAME", f"CASE WHEN {HAS} AND {CAPITAL('l')} THEN regexp_extract(right(before, 100), '({WORD}{GAP})$', 1) ELSE '' END || surface || regexp_extract(after, '^({GAP}{WORD})', 1)", 0.99),
    modified("regexp_matches(after, '^[''’]s\\b')", "POSSESSIVE_SUFFIX_OUTSIDE_TERM", "EXTERNAL_POSSESSIVE", 0.99),
    modified("owner", "POSSESSIVE_MODIFIER_OUTSIDE_TERM", "EXTERNAL_POSSESSIVE", 0.99),
    modified(f"{LOW('l')} IN {names(tm.DETERMINERS)}", "DETERMINER_OR_POSSESSIVE_MODIFIER", "EXTERNAL_DETERMINER", 0.99),
    rule(f"length({LETTERS('l')}) >= 3 AND {UPPER('l')} AND {LOW('l')} IN {names(tm.HEADINGS)} AND {ALIAS}", "DEFINED_TERM_USAGE", "HARD", "ALL_CAPS_HEADING_BOUNDARY", "'OTHER'", 0.98, "'HEADING_BOUNDARY'", JOIN(HAS, "false")),
    named(f"{LOW('r')} IN {names(tm.NAME_SUFFIXES)} OR lower(source_term) IN {names(tm.NAME_SUFFIXES)} AND {HAS} AND {CAPITAL('l')} AND NOT owner", "COMPONENT_OF_ENTITY_FULL_NAME", "ENTITY_FULL_NAME", JOIN(f"{HAS} AND {CAPITAL('l')}", f"{LOW('r')} IN {names(tm.NAME_SUFFIXES)}"), 0.98),
    rule(f"{LOW('r')} IN {names(tm.RELATION_NOUNS)} AND {ALIAS}", "ENTITY_RELATION_USAGE", "HARD", "ENTITY_ALIAS_AS_RELATION_MODIFIER", "'OTHER'", 0.97, "'ENTITY_RELATION'", JOIN("false", "true")),
    modified(f"{LOW('l')} IN {names(tm.SAFE_MODIFIERS)} AND (acronym OR len(words) >= 2)", "SAFE_EXTERNAL_MODIFIER", "EXTERNAL_SAFE_MODIFIER", 0.97),
    named(f"lower(source_term) IN {names(tm.NAMED_HEADS)} AND {HAS} AND {CAPITAL('l')} AND NOT owner", "COMPONENT_OF_NAMED_EXPRESSION", "NAMED_EXPRESSION", JOIN("true", CAPITAL("r")), 0.96),
    rule(f"{CAPITAL('l')} OR {CAPITAL('r')}", "POSSIBLY_NESTED_USAGE", "SOFT", "ADJACENT_CAPITALISED_MODIFIER", "'POSSIBLY_NESTED'", 0.72, "'AMBIGUOUS_CAPITALISED_COMPOUND'", JOIN(CAPITAL("l"), CAPITAL("r"))),
    rule("true", "DEFINED_TERM_USAGE", "HARD", "EXACT_CASE_STANDALONE_MATCH", "'OTHER'", 0.98),
]
ACT = "\\b([A-Z][A-Za-z.&''’\\-]*(?:\\s+[A-Z][A-Za-z.&''’\\-]*){1,8}\\s+)$"
#: uses: every use of every glossary term of the derived paragraphs (single spaces, valid spans), with its rule's fields.
USES = f"""{with_clause("paragraphs", "glossary")}, spots AS (SELECT document_id, paragraph_id, text, source_term, unnest(generate_series(0, length(text) - length(source_term))) AS i FROM paragraphs JOIN glossary ON contains(lower(text), lower(source_term))),
  placed AS (SELECT document_id, paragraph_id, text, source_term, CAST(i AS INT) AS char_start, CAST(i + length(source_term) AS INT) AS char_end FROM spots WHERE lower(substr(text, CAST(i AS INT) + 1, length(source_term))) = lower(source_term) AND NOT regexp_matches(substr(text, CAST(i AS INT), CAST(least(i, 1) AS INT)), '[A-Za-z0-9]') AND NOT regexp_matches(substr(text, CAST(i AS INT) + length(source_term) + 1, 1), '[A-Za-z0-9]')),
  cut AS (SELECT *, left(text, char_start) AS before, substr(text, char_end + 1) AS after, substr(text, char_start + 1, char_end - char_start) AS surface, contains(text, '“' || source_term || '”') AS is_definition, regexp_extract_all(source_term, '{WORD}') AS words, length({LETTERS('source_term')}) >= 2 AND {UPPER('source_term')} AS acronym FROM placed),
  sides AS (SELECT *, nullif(regexp_extract(right(before, 100), '({WORD}){GAP}$', 1), '') AS l, nullif(regexp_extract(left(after, 100), '^{GAP}({WORD})', 1), '') AS r, CASE WHEN NOT regexp_matches(after, '^[A-Za-z0-9_]') THEN CASE WHEN lower(source_term) = 'code' THEN nullif(regexp_extract(before, '(?i)\\b((?:{tm.OTHER_CODES})\\s+)$', 1), '') WHEN lower(source_term) = 'act' AND surface = 'Act' THEN nullif(regexp_extract(before, '{ACT}', 1), '') END END AS other,
    list_filter(regexp_extract_all(text, '{TITLE}'), lambda m: len(list_filter(generate_series(0, length(text) - length(m)), lambda p: substr(text, CAST(p AS INT) + 1, length(m)) = m AND p <= char_start AND p + length(m) >= char_end AND length(m) > char_end - char_start)) > 0)[1] AS title FROM cut),
  owned AS (SELECT *, regexp_matches({LOW('l')}, '[''’]s$') AS owner FROM sides),
  ruled AS (SELECT *, CASE {' '.join(RULES)} END AS rule FROM owned),
  uses AS (SELECT document_id, paragraph_id, source_term, char_start, char_end, surface, rule.* FROM ruled)"""
