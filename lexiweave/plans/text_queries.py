"""Text functions applied to whole texts of documents, roughened so that every rule has work to do."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.tables import table

#: The same roughened texts in Spark and in DuckDB.
ROUGH = r"""
rough AS (
  SELECT doc_id, lang, source, text,
    concat('<TEXT> ', replace(replace(replace(text, '. ', concat('.', chr(10), chr(10), chr(10), ' ')), ', ', concat(',', chr(160), chr(9), ' ')), ' the ', ' “the” '), ' </TEXT>') AS rough
  FROM documents
)"""


def rough(spark, folder):
    d = F.col("text")
    r = F.replace(d, F.lit(". "), F.lit(".\n\n\n "))
    r = F.replace(r, F.lit(", "), F.lit(", \t "))
    r = F.concat(F.lit("<TEXT> "), F.replace(r, F.lit(" the "), F.lit(" “the” ")), F.lit(" </TEXT>"))
    return table(spark, folder, "documents").withColumn("rough", r)


WS = r"[\s\x{00a0}\x{000b}\x{0085}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1680}\x{001c}-\x{001f}]"
NORMAL = rf"regexp_replace(regexp_replace(regexp_replace(replace({{}}, chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{{{{3,}}}}', chr(10) || chr(10), 'g'), '^{WS}+|{WS}+$', '', 'g')"
FLAT = rf"trim(regexp_replace({{}}, '{WS}+', ' ', 'g'))"
EDGES = t.RENDERING_EDGES.replace("'", "''")
QUOTES = " ' || chr(9) || chr(13) || chr(10) || '\"''“”‘’"


def _of(normal: str) -> str:
    return normal.replace("{{", "{").replace("}}", "}")


def normal(x: str) -> str:
    return _of(NORMAL.replace("{}", x))


def flat(x: str) -> str:
    return FLAT.replace("{}", x)


#: name: (column of rough(), the same in DuckDB over the CTE)
SCALARS = {
    "p01_normalize_space": (lambda: t.normalize_space(F.col("rough")), normal("rough")),
    "p02_unwrap_text": (lambda: t.unwrap_text_element(F.col("rough")), r"CASE WHEN regexp_matches(rough, '(?is)<TEXT>\s*(.*?)\s*</TEXT>') THEN regexp_extract(rough, '(?is)<TEXT>\s*(.*?)\s*</TEXT>', 1) ELSE rough END"),
    "p07_parser_kind": (lambda: t.parser_kind(F.concat("source", F.when(F.col("doc_id") % 3 == 0, ".HTM").otherwise(".txt")), F.col("rough")), "CASE WHEN regexp_matches(lower(source || CASE WHEN doc_id % 3 = 0 THEN '.HTM' ELSE '.txt' END), '\\.html?$') OR contains(lower(substr(rough, 1, 4000)), '<html') OR contains(lower(substr(rough, 1, 4000)), '<body') THEN 'html' ELSE 'plain' END"),
    "p08_shorten": (lambda: t.shorten(F.col("rough"), 600), f"CASE WHEN length({flat('rough')}) <= 600 THEN {flat('rough')} ELSE left({flat('rough')}, 599) || '…' END"),
    "p09_truncate_middle": (lambda: t.truncate_middle(F.col("text"), 900), "CASE WHEN length(text) <= 900 THEN text ELSE left(text, 440) || chr(10) || '...[TRUNCATED]...' || chr(10) || right(text, 441) END"),
    "p10_normalize_rendering": (lambda: t.normalize_rendering(F.col("rough")), f"nullif(trim(regexp_replace(rough, '{WS}+', '', 'g'), '{EDGES}'), '')"),
    "p11_normalize_variant": (lambda: t.normalize_variant(F.col("rough")), f"nullif(trim({flat('rough')}, '{QUOTES}'), '')"),
    "p12_surface": (lambda: t.surface(F.col("rough")), f"trim(regexp_replace(rough, '{WS}+', ' ', 'g'), '{QUOTES}')"),
    "p13_same_lexical": (lambda: t.same_lexical(F.col("text"), F.upper("rough")), "regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') <> '' AND regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(upper(rough)), '[^a-z0-9]+', '', 'g')"),
    "p14_normalize_term": (lambda: t.normalize_term(F.col("rough")), f"lower({flat('rough')})"),
    "p15_latin_residues": (lambda: F.array_join(t.latin_residues(F.col("text")), "|"), r"(SELECT string_agg(tok, '|' ORDER BY i) FROM (SELECT tok, i FROM (SELECT tok, i, row_number() OVER (PARTITION BY lower(tok) ORDER BY i) AS k FROM (SELECT unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM (SELECT regexp_extract_all(text, '[A-Za-z]+(?:[A-Za-z0-9._:/@+\-]*[A-Za-z0-9])?') AS toks))) WHERE k = 1 ORDER BY i LIMIT 30))"),
    "p16_disallowed_latin": (lambda: t.disallowed_latin(F.col("text")), r"len(list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9.\-/]*'), lambda x: NOT regexp_matches(x, '^(?:[A-Z][A-Z0-9.\-/]{0,15}|[A-Z]{1,6}[0-9]{1,6}[A-Z]?)$'))) > 0"),
    "p17_clean_translation": (
        lambda: t.clean_translation(F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("<think>"), "text", F.lit("</think> \n翻译： "), "source")).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("```text\n"), "text", F.lit("\n```"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("Translation: "), "text")).otherwise(F.concat(F.lit("<think> "), "text"))),
        rf"CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') WHEN 2 THEN regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') ELSE '' END",
    ),
    "p18_compact": (lambda: t.compact(F.col("text")), r"regexp_replace(text, '[\s\x{00a0}\x{3000}，。；：、,.!?！？（）()\[\]【】《》〈〉“”‘’\x22\x27—–-]+', '', 'g')"),
    "p19_plain_spaces": (lambda: t.plain_spaces(F.col("rough")), r"regexp_replace(rough, '\p{Zs}', ' ', 'g')"),
    "p20_separator_only": (lambda: t.separator_only(F.when(F.col("doc_id") % 5 == 0, "__ * \t_").otherwise(F.col("text"))), "CASE WHEN doc_id % 5 = 0 THEN true ELSE regexp_matches(text, '^[\\s_*]+$') AND regexp_matches(text, '[_*]') END"),
    "p23_output_budget": (
        lambda: F.coalesce(t.smaller_output_budget(F.concat(F.lit("This model's maximum context length is 8192 tokens. You requested "), (F.col("n_chars") % 5000).cast("string"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" output tokens and your prompt contains at least "), F.col("n_chars").cast("string"), F.lit(" input tokens"))).when(F.col("doc_id") % 3 == 1, F.lit(" output tokens; the prompt contains 99 characters")).otherwise("")), (F.col("n_chars") % 5000).cast("int")), F.lit(-1)),
        "CASE doc_id % 3 WHEN 0 THEN greatest(256, least(8192 - length(text) - 64, length(text) % 5000 - 1024)) WHEN 1 THEN greatest(256, length(text) % 5000 - 1024) ELSE -1 END",
    ),
    "p25_token_estimate": (lambda: t.token_estimate(F.concat("text", F.lit("术语一致性"))), r"5 + CAST(ceil(length(text) / 4.0) AS BIGINT)"),
    "p26_safe_slug": (lambda: t.safe_slug(F.col("text")), rf"coalesce(nullif(left(trim(regexp_replace(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g'), '[^A-Za-z0-9._-]+', '_', 'g'), '._'), 180), ''), 'experiment')"),
    "p27_text_hash": (lambda: t.text_hash(F.col("rough")), "sha256(rough)"),
    "p28_mark_term": (lambda: t.mark_term(F.col("text"), F.lit(3), F.lit(9)), "left(text, 3) || '<TERM>' || substr(text, 4, 6) || '</TERM>' || substr(text, 10)"),
    "p29_context": (lambda: t.context(F.col("text"), F.lit(150), F.lit(160)), "substr(text, 11, least(length(text), 300) - 10)"),
    "p31_parse_bool": (lambda: t.parse_bool(F.element_at(F.array(*[F.lit(w) for w in (" YES ", "no", "1", "", "maybe", "Exclude", "y")]), (F.col("doc_id") % 7 + 1).cast("int"))), "CASE WHEN doc_id % 7 IN (0, 2, 6) THEN true WHEN doc_id % 7 IN (1, 3, 5) THEN false END"),
    "t11_over_wide": (lambda: t.over_wide(F.when(F.col("doc_id") % 2 == 0, "Any Person").otherwise("Person"), F.concat(F.when(F.col("doc_id") % 3 == 0, "任何").otherwise("买方"), F.col("text"))), "doc_id % 2 = 1 AND doc_id % 3 = 0"),
    "w01_hash_sample": (lambda: t.digest_fraction(F.lit("2026"), F.col("source"), F.col("doc_id").cast("string")) < 0.25, "CAST(('0x' || left(sha256('2026' || chr(0) || source || chr(0) || CAST(doc_id AS VARCHAR)), 16)) AS UBIGINT)::DOUBLE / 18446744073709551616 < 0.25"),
}


def _scalar(make):
    return lambda spark, folder: rough(spark, folder).select("doc_id", make().alias("value"))


def _blocks(function):
    return lambda spark, folder: rough(spark, folder).select("doc_id", F.posexplode(function(F.col("rough"))).alias("paragraph_id", "text"))


def adjacent_dedup(paragraphs, key: str = "doc_id", order: str = "paragraph_id"):
    """Paragraphs that differ from the one before them in their document."""
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy(key).orderBy(order))
    return paragraphs.withColumn("b", before).filter(~F.col("text").eqNullSafe(F.col("b"))).drop("b")


def _adjacent(spark, folder):
    doubled = rough(spark, folder).withColumn("rough", F.replace("text", F.lit("\n"), F.lit("\n----------\n----------\n")))
    return adjacent_dedup(doubled.select("doc_id", F.posexplode(t.line_blocks(F.col("rough"))).alias("paragraph_id", "text")))


LINE = rf"list_filter(list_transform(string_split_regex({{}}, '\r\n|[\n\r\x{{0b}}\x{{0c}}\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: length(x) >= 8)"

QUERIES = {name: (_scalar(make), f"WITH {ROUGH} SELECT doc_id, {sql} AS value FROM rough") for name, (make, sql) in SCALARS.items()}
QUERIES["p04_blank_line_blocks"] = (_blocks(t.blank_line_blocks), f"WITH {ROUGH}, b AS (SELECT doc_id, list_filter(list_transform(string_split_regex(rough, '\\n\\s*\\n'), lambda x: {normal('x')}), lambda x: length(x) >= 8) AS bs FROM rough) SELECT doc_id, generate_subscripts(bs, 1) - 1 AS paragraph_id, unnest(bs) AS text FROM b")
QUERIES["p05_line_blocks"] = (_blocks(t.line_blocks), f"WITH {ROUGH}, b AS (SELECT doc_id, {LINE.replace('{}', 'rough')} AS bs FROM rough) SELECT doc_id, generate_subscripts(bs, 1) - 1 AS paragraph_id, unnest(bs) AS text FROM b")
QUERIES["p06_adjacent_dedup"] = (
    _adjacent,
    f"WITH b AS (SELECT doc_id, {LINE.replace('{}', 'replace(text, chr(10), chr(10) || ' + repr('----------') + ' || chr(10) || ' + repr('----------') + ' || chr(10))')} AS bs FROM documents), x AS (SELECT doc_id, generate_subscripts(bs, 1) - 1 AS paragraph_id, unnest(bs) AS text FROM b), y AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY paragraph_id) AS b FROM x) SELECT doc_id, paragraph_id, text FROM y WHERE b IS DISTINCT FROM text",
)
