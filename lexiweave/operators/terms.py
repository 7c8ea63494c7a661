"""Defined terms: definitions, linking of occurrences to offsets, frequency, ids, and the rules for each use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

# What a defined term and its definition look like, and words that are no term.
QUOTE = "[\"“”]"
BODY = "[A-Z][A-Za-z0-9&'’\\-]*(?:\\s+(?:of|the|and|or|for|to|in|on|by|with|[A-Z][A-Za-z0-9&'’\\-]*)){0,10}"
MEANS = "\\s+(?:means|shall mean|has the meaning)"
PATTERNS = (("means-clause", f"(?i){QUOTE}({BODY}){QUOTE}{MEANS}"), ("means-clause", f"({BODY}){MEANS}\\b"), ("parenthetical-defined-term", f"(?i)\\(\\s*(?:the\\s+)?{QUOTE}({BODY}){QUOTE}\\s*\\)"))
NO_TERMS = ("This", "That", "The", "A", "An", "For", "If", "In", "As", "It")


def definitions(paragraphs: DataFrame) -> DataFrame:
    """document_id, paragraph_id, method, pattern, match, term: valid terms in the order they are defined."""
    found = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(i).alias("pattern"), F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias("terms")) for i, (m, p) in enumerate(PATTERNS)])
    rows = paragraphs.select("document_id", "paragraph_id", F.explode(found).alias("f"))
    rows = rows.select("document_id", "paragraph_id", "f.method", "f.pattern", F.posexplode("f.terms").alias("match", "term"))
    rows = rows.withColumn("term", F.btrim(t.collapse(F.col("term")), F.lit(" .,:;()[]")))
    n = F.length("term")
    return rows.filter((n >= 2) & (n <= 120) & (F.size(F.split("term", " ")) <= 11) & ~F.col("term").isin(*NO_TERMS))


def canonical_terms(found: DataFrame) -> DataFrame:
    """document_id, key, source_term (first spelling), extraction_method, definition_paragraph_ids."""
    return (
        found.withColumn("key", F.lower("term"))
        .groupBy("document_id", "key")
        .agg(F.min_by("term", F.struct("paragraph_id", "pattern", "match")).alias("source_term"), F.array_join(F.array_sort(F.collect_set("method")), "+").alias("extraction_method"), F.array_sort(F.collect_set("paragraph_id")).alias("definition_paragraph_ids"))
    )


def match_spans(text: Column, pattern: Column) -> Column:
    """array<struct<start,end,match>> of a pattern's matches, in code points."""
    both = F.array(F.struct(F.split(text, pattern, F.lit(-1)).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit")))
    size = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + F.length(x))
    start = lambda s, i: size(F.slice(s["gap"], 1, i + 1)) + size(F.slice(s["hit"], 1, i))
    return F.element_at(F.transform(both, lambda s: F.transform(s["hit"], lambda m, i: F.struct(start(s, i).alias("start"), (start(s, i) + F.length(m)).alias("end"), m.alias("match")))), 1)


def candidate_occurrences(paragraphs: DataFrame, terms: DataFrame) -> DataFrame:
    """Every case-insensitive match at word boundaries of a document's terms, or, where terms has no document_id, of all of them.

    Shared terms meet a paragraph through their first word, so there is no cross join, and Spark broadcasts them if they are few.
    """
    quoted = F.regexp_replace("source_term", "([\\\\\\[\\](){}.*+?^$|])", "\\\\$1")
    pattern = F.concat(F.lit("(?i)(?<![A-Za-z0-9])"), quoted, F.lit("(?![A-Za-z0-9])"))
    if "document_id" in terms.columns:
        pairs = paragraphs.join(terms, "document_id")
    else:
        words = F.transform(F.split("text", "[^A-Za-z0-9]+"), F.lower)
        rows = paragraphs.withColumn("_word", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), words))))  # "": terms without letters
        pairs = rows.join(terms.withColumn("_word", F.lower(F.regexp_extract("source_term", "[A-Za-z0-9]+", 0))), "_word")
    pairs = pairs.filter(F.contains(F.lower("text"), F.col("key")))
    return pairs.select("document_id", "paragraph_id", "text", "key", "source_term", F.explode(match_spans(F.col("text"), pattern)).alias("m")).select("document_id", "paragraph_id", "text", "key", "source_term", F.col("m.start").alias("char_start"), F.col("m.end").alias("char_end"), F.col("m.match").alias("surface"))


def longest_first(candidates: DataFrame) -> DataFrame:
    """Occurrences taken longest term first, those that overlap one taken before left out; with their context."""
    item = F.struct((-F.length("source_term")).alias("o"), F.col("key"), F.col("char_start").alias("s"), F.col("char_end").alias("e"), F.col("source_term"), F.col("surface"))
    grouped = candidates.groupBy("document_id", "paragraph_id").agg(F.first("text").alias("text"), F.array_sort(F.collect_list(item)).alias("items"))
    empty = F.slice(F.col("items"), 1, 0)
    taken = F.aggregate("items", empty, lambda acc, x: F.when(F.exists(acc, lambda y: (x["e"] > y["s"]) & (x["s"] < y["e"])), acc).otherwise(F.concat(acc, F.array(x))))
    rows = grouped.select("document_id", "paragraph_id", "text", F.explode(taken).alias("x"))
    return rows.select("document_id", "paragraph_id", "x.key", "x.source_term", F.col("x.s").alias("char_start"), F.col("x.e").alias("char_end"), "x.surface", t.context(F.col("text"), F.col("x.s"), F.col("x.e")).alias("context"))


def number_terms(terms: DataFrame, occurrences: DataFrame, min_occurrences: int = 3) -> DataFrame:
    """Terms with enough occurrences and their ids: most frequent first, then by name."""
    counts = occurrences.groupBy("document_id", "key").agg(F.count("*").alias("occurrences")).filter(F.col("occurrences") >= min_occurrences)
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("occurrences"), "key"))
    return terms.join(counts, ["document_id", "key"]).withColumn("term_id", F.concat(F.lit("T"), F.lpad(rank.cast("string"), 4, "0")))


def extract(paragraphs: DataFrame, min_occurrences: int = 3) -> tuple[DataFrame, DataFrame]:
    """(numbered terms, their occurrences) of each document."""
    terms = canonical_terms(definitions(paragraphs))
    linked = longest_first(candidate_occurrences(paragraphs, terms))
    numbered = number_terms(terms, linked, min_occurrences)
    return numbered, linked.join(numbered.select("document_id", "key", "term_id"), ["document_id", "key"])


def document_statistics(paragraphs: DataFrame, numbered: DataFrame) -> DataFrame:
    """Documents that have terms: paragraphs, characters, terms and occurrences."""
    size = paragraphs.groupBy("document_id").agg(F.count("*").alias("paragraph_count"), F.sum(F.length("text")).alias("character_count"))
    terms = numbered.groupBy("document_id").agg(F.count("*").alias("term_count"), F.sum("occurrences").alias("occurrence_count"))
    return size.join(terms, "document_id")


def containing_longer(occurrences: DataFrame) -> DataFrame:
    """Each occurrence inside a longer one of another term of its paragraph, with the longest of these."""
    a, b = occurrences.alias("a"), occurrences.alias("b")
    size = lambda x: F.col(f"{x}.char_end") - F.col(f"{x}.char_start")
    inside = (F.col("b.char_start") <= F.col("a.char_start")) & (F.col("b.char_end") >= F.col("a.char_end")) & (size("b") > size("a")) & (F.col("a.source_term") != F.col("b.source_term"))
    both = a.join(b, (F.col("a.document_id") == F.col("b.document_id")) & (F.col("a.paragraph_id") == F.col("b.paragraph_id")) & inside)
    keys = [F.col(f"a.{c}").alias(c) for c in ("document_id", "paragraph_id", "source_term", "char_start", "char_end")]
    return both.groupBy(*keys).agg(F.max_by(F.col("b.source_term"), F.struct(size("b"), F.col("b.source_term"))).alias("container"))


# Word lists of the rules for a use of a term.
WORD = "[A-Za-z][A-Za-z0-9]*(?:[.&'’\\-][A-Za-z0-9]+)*"
VERB = "(?:means|shall\\s+mean|has\\s+the\\s+meaning)\\b"
OTHER_CODES = "Internal\\s+Revenue|United\\s+States?|U\\.S\\.|Bankruptcy|Commercial|Penal|Civil|Tax"
DETERMINERS = ("a", "an", "the", "any", "each", "every", "no", "such", "other", "this", "that", "these", "those", "either", "neither", "all", "some", "your", "his", "her", "its", "our", "their", "my")
SAFE_MODIFIERS = ("annual", "existing", "current", "applicable", "respective", "aggregate", "total", "additional", "initial", "subsequent")
HEADINGS = ("policy", "policies", "benefits", "compensation", "bonus", "awards", "section", "article", "schedule", "exhibit", "appendix", "notice", "employment", "severance", "retirement", "confidentiality", "definitions")
NAME_SUFFIXES = ("sciences", "properties", "corporation", "corp", "company", "inc", "incorporated", "limited", "ltd", "llc", "plc", "lp", "partnership", "holdings", "group", "bank", "bancorp", "trust", "association", "foundation", "university", "institute")
RELATION_NOUNS = ("leadership", "team", "board", "employees", "employee", "management", "factory", "office", "facility", "facilities", "site", "sites", "policy", "policies", "plan", "plans", "benefits", "committee", "committees", "stock", "shares")
NAMED_HEADS = ("plan", "policy", "program", "scheme", "bank", "committee", "fund", "award")
INSTRUMENTS = ("act", "code", "regulation", "regulations", "rules", "statute", "order", "policy", "plan", "program", "agreement")
NO_ALIASES = ("person", "party", "board", "plan", "policy", "program", "bank", "code", "act", "executive", "employee", "employer", "company", "committee", "agreement", "bonus", "salary", "payment", "period", "reason", "cause", "retirement", "disability")
TITLE_WORDS = "(?:Chief|Senior|Executive|Vice|Deputy|Assistant|Managing|General|Regional|Group|Corporate)"
JOB_TITLE = f"\\b{TITLE_WORDS}(?:\\s+{TITLE_WORDS})*\\s+(?:Officer|President|Chairman|Chairwoman|Director|Counsel|Secretary|Treasurer)\\b"


def classify_uses(occurrences: DataFrame) -> DataFrame:
    """usage_status, control_eligibility, reason, context_classification, compound_context, definition_role, confidence of each use.

    Needs text (the paragraph), source_term, char_start, char_end and is_definition. Rules apply in order, the first that fits decides.
    """
    c, lit = F.col, F.lit
    spaced = lambda x: F.regexp_replace(x, "(?U)\\s+", " ")
    ok = c("char_start").isNotNull() & c("char_end").isNotNull() & (c("char_start") >= 0) & (c("char_end") > c("char_start")) & (c("char_end") <= F.length("text"))
    r = occurrences.withColumn("_ok", F.coalesce(ok, lit(False)))
    r = r.withColumn("surface", F.when(c("_ok"), F.substring("text", c("char_start") + 1, c("char_end") - c("char_start"))).otherwise(""))
    r = r.withColumn("_before", F.left("text", F.greatest(lit(0), c("char_start")))).withColumn("_after", F.substring("text", c("char_end") + 1, F.length("text")))
    gap = "[\\s\\-–—/]*"
    r = r.withColumn("_l", F.nullif(F.regexp_extract(F.right("_before", lit(100)), f"({WORD}){gap}$", 1), lit("")))
    r = r.withColumn("_r", F.nullif(F.regexp_extract(F.left("_after", lit(100)), f"^{gap}({WORD})", 1), lit("")))
    low = lambda x: F.coalesce(F.lower(x), lit(""))
    letters = lambda x: F.regexp_replace(F.coalesce(x, lit("")), "[^A-Za-z]", "")
    upper = lambda x: (letters(x) != "") & (letters(x) == F.upper(letters(x)))
    capital = lambda x: ~low(x).isin(*DETERMINERS) & (letters(x) != "") & (upper(x) | F.rlike(F.coalesce(x, lit("")), lit("^[A-Z]")))
    owner = F.rlike(low(c("_l")), lit("['’]s$"))
    term, words = c("source_term"), F.regexp_extract_all("source_term", lit(WORD), lit(0))
    acronym = (F.length(letters(term)) >= 2) & upper(term)
    alias = (F.size(words) == 1) & ~low(term).isin(*NO_ALIASES) & (F.rlike(term, lit("^[A-Z]")) | acronym)
    join = lambda left, right: F.concat_ws(" ", F.when(left, c("_l")), c("surface"), F.when(right, c("_r")))
    definiendum = (
        F.rlike("_before", lit(f"{QUOTE}$")) & F.rlike("_after", lit(f"(?i)^{QUOTE}\\s+{VERB}"))
        | F.rlike("_before", lit(f"(?i)\\(\\s*(?:the\\s+)?{QUOTE}$")) & F.rlike("_after", lit(f"^{QUOTE}\\s*\\)"))
        | ~F.rlike("_before", lit("[A-Za-z0-9]$")) & F.rlike("_after", lit(f"^\\s+{VERB}"))
    )
    code = F.nullif(F.regexp_extract("_before", f"(?i)\\b((?:{OTHER_CODES})\\s+)$", 1), lit(""))
    act = F.nullif(F.regexp_extract("_before", "\\b([A-Z][A-Za-z.&'’\\-]*(?:\\s+[A-Z][A-Za-z.&'’\\-]*){1,8}\\s+)$", 1), lit(""))
    other = F.when(~F.rlike("_after", lit("^[A-Za-z0-9_]")), F.when(low(term) == "code", code).when((low(term) == "act") & (c("surface") == "Act"), act))
    r = r.withColumn("_other", F.concat(other, "surface"))
    inside = F.filter(match_spans(c("text"), lit(JOB_TITLE)), lambda m: (m["start"] <= c("char_start")) & (m["end"] >= c("char_end")) & (m["end"] - m["start"] > c("char_end") - c("char_start")))
    r = r.withColumn("_title", F.when(F.rlike("text", lit(JOB_TITLE)), F.get(F.transform(inside, lambda m: m["match"]), lit(0))))
    instrument = low(c("_r")).isin(*INSTRUMENTS) & ~F.array_contains(F.transform(words, F.lower), low(c("_r")))
    suffix = low(c("_r")).isin(*NAME_SUFFIXES)
    full_name = suffix | low(term).isin(*NAME_SUFFIXES) & c("_l").isNotNull() & capital(c("_l")) & ~owner
    heading = (F.length(letters(c("_l"))) >= 3) & upper(c("_l")) & low(c("_l")).isin(*HEADINGS) & alias
    safe = low(c("_l")).isin(*SAFE_MODIFIERS) & (acronym | (F.size(words) >= 2))
    named = low(term).isin(*NAMED_HEADS) & c("_l").isNotNull() & capital(c("_l")) & ~owner
    has = c("_l").isNotNull()
    after_instrument = F.regexp_extract("_after", f"^({gap}{WORD})", 1)
    before_instrument = F.when(has & capital(c("_l")), F.regexp_extract(F.right("_before", lit(100)), f"({WORD}{gap})$", 1)).otherwise("")

    def out(status: str, control: str, reason: str, role: Column | str, sure: float, kind: str | None = None, phrase: Column | None = None) -> Column:
        return F.struct(lit(status).alias("usage_status"), lit(control).alias("control_eligibility"), lit(reason).alias("reason"), lit(kind).cast("string").alias("context_classification"), (lit(None).cast("string") if phrase is None else phrase).alias("compound_context"), (lit(role) if isinstance(role, str) else role).alias("definition_role"), lit(sure).alias("confidence"))

    named_part = lambda reason, kind, phrase, sure: out("OTHER_NAMED_EXPRESSION_COMPONENT", "NONE", reason, "OTHER_NAME_COMPONENT", sure, kind, phrase)
    modified = lambda reason, kind, sure: out("EXTERNAL_MODIFIED_DEFINED_TERM", "HARD", reason, "OTHER", sure, kind, join(has, lit(False)))
    rules = (
        F.when(~c("_ok"), out("INVALID_SPAN", "NONE", "INVALID_SPAN", "NONE", 1.0))
        .when(F.lower(spaced(c("surface"))) != F.lower(spaced(term)), out("SURFACE_MISMATCH", "NONE", "SOURCE_SLICE_DOES_NOT_MATCH_TERM", "NONE", 1.0))
        .when(spaced(c("surface")) != spaced(term), out("COMMON_WORD_USAGE", "NONE", "CASE_MISMATCH_WITH_DEFINED_TERM", "NONE", 0.99))
        .when(definiendum, out("DEFINIENDUM", "HARD", "EXPLICIT_DEFINIENDUM", "DEFINIENDUM", 1.0))
        .when(c("_other").isNotNull(), out("OTHER_LEGAL_NAME_COMPONENT", "NONE", "COMPONENT_OF_DIFFERENT_LEGAL_NAME", F.when(c("is_definition"), "DEFINIENS_COMPONENT").otherwise("OTHER_NAME_COMPONENT"), 0.99, None, c("_other")))
        .when(c("_title").isNotNull(), named_part("COMPONENT_OF_JOB_TITLE", "JOB_TITLE", c("_title"), 0.99))
        .when(instrument, named_part("COMPONENT_OF_LEGAL_INSTRUMENT_NAME", "LEGAL_INSTRUMENT_NAME", F.concat(before_instrument, "surface", after_instrument), 0.99))
        .when(F.rlike("_after", lit("^['’]s\\b")), modified("POSSESSIVE_SUFFIX_OUTSIDE_TERM", "EXTERNAL_POSSESSIVE", 0.99))
        .when(owner, modified("POSSESSIVE_MODIFIER_OUTSIDE_TERM", "EXTERNAL_POSSESSIVE", 0.99))
        .when(low(c("_l")).isin(*DETERMINERS), modified("DETERMINER_OR_POSSESSIVE_MODIFIER", "EXTERNAL_DETERMINER", 0.99))
        .when(heading, out("DEFINED_TERM_USAGE", "HARD", "ALL_CAPS_HEADING_BOUNDARY", "OTHER", 0.98, "HEADING_BOUNDARY", join(has, lit(False))))
        .when(full_name, named_part("COMPONENT_OF_ENTITY_FULL_NAME", "ENTITY_FULL_NAME", join(has & capital(c("_l")), suffix), 0.98))
        .when(low(c("_r")).isin(*RELATION_NOUNS) & alias, out("ENTITY_RELATION_USAGE", "HARD", "ENTITY_ALIAS_AS_RELATION_MODIFIER", "OTHER", 0.97, "ENTITY_RELATION", join(lit(False), lit(True))))
        .when(safe, modified("SAFE_EXTERNAL_MODIFIER", "EXTERNAL_SAFE_MODIFIER", 0.97))
        .when(named, named_part("COMPONENT_OF_NAMED_EXPRESSION", "NAMED_EXPRESSION", join(lit(True), capital(c("_r"))), 0.96))
        .when(capital(c("_l")) | capital(c("_r")), out("POSSIBLY_NESTED_USAGE", "SOFT", "ADJACENT_CAPITALISED_MODIFIER", "POSSIBLY_NESTED", 0.72, "AMBIGUOUS_CAPITALISED_COMPOUND", join(capital(c("_l")), capital(c("_r")))))
        .otherwise(out("DEFINED_TERM_USAGE", "HARD", "EXACT_CASE_STANDALONE_MATCH", "OTHER", 0.98))
    )
    r = r.withColumn("_rule", F.explode(F.array(rules)))  # a generator is not merged into later projections: the rules run once a row
    return r.select(*occurrences.columns, "surface" if "surface" not in occurrences.columns else F.lit(0).alias("_none"), "_rule.*").drop("_none")


def external_modifier(text: Column, start: Column) -> Column:
    """Capitalised words right before a term, up to three, without those that open a sentence or determine; null if none."""
    # Words that close a run of capitals.
    closed = ("The", "This", "That", "Any", "Each", "Every", "Such", "Other", "No", "A", "An", "All", "For", "If", "In", "As", "By")
    phrase = F.regexp_extract(F.right(F.left(text, start), F.lit(80)), "([A-Za-z][A-Za-z.\\-]*(?:\\s+[A-Za-z][A-Za-z.\\-]*){0,2})\\s*$", 1)
    words = F.reverse(F.split(t.collapse(phrase), " "))
    good = lambda w: (F.rlike(w, F.lit("^[A-Z]")) | F.contains(w, F.lit("."))) & ~w.isin(*closed)
    run = F.filter(words, lambda w, i: F.forall(F.slice(words, 1, i + 1), good))
    return F.nullif(F.array_join(F.reverse(run), " "), F.lit(""))
