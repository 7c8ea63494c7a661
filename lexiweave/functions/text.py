"""Text functions as column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Punctuation and quotes that renderings are stripped of, deleted for adjacency, tags, words, ranges.
RENDERING_EDGES = "，。；：、,. ;:()（）[]【】\"'“”"
QUOTE_EDGES = " \t\r\n\"'“”‘’"
ADJACENCY_DELETED = "[\\s\\x{3000}，。；：、,.!?！？（）()\\[\\]【】《》〈〉“”‘’\"'—–-]+"
CJK_RANGES = "[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{2FA1F}]"
LATIN_TOKEN = "[A-Za-z]+(?:[A-Za-z0-9._:/@+\\-]*[A-Za-z0-9])?"
PLANNER_TOKEN, ALLOWED_TOKEN = "[A-Za-z][A-Za-z0-9.\\-/]*", "^(?:[A-Z][A-Z0-9.\\-/]{0,15}|[A-Z]{1,6}[0-9]{1,6}[A-Z]?)$"
TRUNCATION_MARKER = "\n...[TRUNCATED]...\n"
TRANSLATION_PREFIXES = ("翻译：", "译文：", "Translation:")
OVER_WIDE = "^(?:任何|任一|每一|各个|各|该等|该名|该|本次|本|某一|某|其他|其它|上述|前述|有关|相关|相应|其|一名|一个|一位|一方)"
DETERMINERS = ("any", "each", "every", "such", "other", "the", "a", "an", "this", "that")
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes", "y", "include"), ("false", "0", "no", "n", "exclude", "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def strip_of(c: Column, chars: str) -> Column:
    """The text without leading and trailing characters of a set."""
    return F.btrim(c, F.lit(chars))


def collapse(c: Column) -> Column:
    """Every run of white space becomes one space; none at the ends."""
    return F.btrim(F.regexp_replace(c, "(?U)\\s+", " "))


def normalize_space(c: Column) -> Column:
    spaced = F.regexp_replace(F.replace(c, F.lit(" "), F.lit(" ")), "[ \\t]+", " ")
    return strip(F.regexp_replace(spaced, "\\n{3,}", "\n\n"))


def unwrap_text_element(c: Column) -> Column:
    """What stands in the first <TEXT> element; the whole text without one."""
    found = F.rlike(c, F.lit("(?is)<TEXT>\\s*(.*?)\\s*</TEXT>"))
    return F.when(found, F.regexp_extract(c, "(?is)<TEXT>\\s*(.*?)\\s*</TEXT>", 1)).otherwise(c)


def looks_like_html(c: Column) -> Column:
    probe = F.lower(F.substring(c, 1, 4000))
    return F.contains(probe, F.lit("<html")) | F.contains(probe, F.lit("<body"))


def blank_line_blocks(c: Column, shortest: int = 8) -> Column:
    """Blocks between blank lines, spaces normalised, short ones left out."""
    return F.filter(F.transform(F.split(c, "\\n\\s*\\n"), normalize_space), lambda x: F.length(x) >= shortest)


def plain_blocks(c: Column, shortest: int = 8) -> Column:
    """Blocks of a plain text once its HTML entities are resolved; of one that turns out to be HTML, its elements' texts."""
    from .python_text import html_paragraphs_of, unescape

    text = F.when(F.contains(c, F.lit("&")), unescape(c)).otherwise(c)
    return F.when(looks_like_html(text), html_paragraphs_of(F.when(looks_like_html(text), c))).otherwise(blank_line_blocks(text, shortest))


def line_blocks(c: Column, shortest: int = 8) -> Column:
    return F.filter(F.transform(F.split(c, "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\x{2028}\\x{2029}]"), strip), lambda x: F.length(x) >= shortest)


def parser_kind(name: Column, text: Column) -> Column:
    by_name = F.rlike(F.lower(name), F.lit("\\.html?$"))
    return F.when(by_name | looks_like_html(text), "html").otherwise("plain")


def shorten(c: Column, limit: int) -> Column:
    flat = collapse(c)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.left(flat, F.lit(limit - 1)), F.lit("…")))


def truncate_middle(c: Column, limit: int) -> Column:
    rest = limit - len(TRUNCATION_MARKER)
    cut = F.left(c, F.lit(limit)) if limit <= 40 else F.concat(F.left(c, F.lit(rest // 2)), F.lit(TRUNCATION_MARKER), F.right(c, F.lit(rest - rest // 2)))
    return F.when(F.length(c) <= limit, c).otherwise(cut)


def normalize_rendering(c: Column) -> Column:
    return F.nullif(strip_of(F.regexp_replace(c, "(?U)[\\s\\x{3000}]+", ""), RENDERING_EDGES), F.lit(""))


#: Characters that composition (NFKC) never changes and that do not join with others: other texts alone go to Python.
STABLE = "[\\x00-\\x7E\\x{3001}-\\x{3011}\\x{4E00}-\\x{9FFF}\\x{2018}-\\x{201D}]*"


def composed(c: Column) -> Column:
    """A text in its compatibility form (full-width letters, ligatures, half-width kana)."""
    from .python_text import compose

    return F.coalesce(compose(F.when(~F.rlike(c, F.lit(f"^{STABLE}$")), c)), c)


def surface(c: Column) -> Column:
    """Composed, white space collapsed, quotes stripped."""
    return strip_of(F.regexp_replace(F.coalesce(composed(c), F.lit("")), "(?U)\\s+", " "), QUOTE_EDGES)


def normalize_variant(c: Column) -> Column:
    return F.nullif(strip_of(collapse(composed(c)), QUOTE_EDGES), F.lit(""))


def same_lexical(a: Column, b: Column) -> Column:
    key = lambda c: F.regexp_replace(F.lower(composed(c)), "[^a-z0-9]+", "")
    return F.coalesce((key(a) != "") & (key(a) == key(b)), F.lit(False))


def normalize_term(c: Column) -> Column:
    return F.lower(collapse(c))


def latin_residues(c: Column, limit: int = 30) -> Column:
    """Distinct Latin tokens by their lower case, first spelling first."""
    tokens = F.regexp_extract_all(c, F.lit(LATIN_TOKEN), F.lit(0))
    both = F.array(F.struct(tokens.alias("as_is"), F.transform(tokens, F.lower).alias("low")))  # bound once for the lambdas below
    first = lambda s: F.transform(F.slice(F.array_distinct(s["low"]), 1, limit), lambda k: F.element_at(s["as_is"], F.array_position(s["low"], k).cast("int")))
    return F.element_at(F.transform(both, first), 1)


def disallowed_latin(c: Column) -> Column:
    return F.exists(F.regexp_extract_all(c, F.lit(PLANNER_TOKEN), F.lit(0)), lambda t: ~F.rlike(t, F.lit(ALLOWED_TOKEN)))


def clean_translation(c: Column) -> Column:
    """The final translation: reasoning blocks, a code fence and a leading label taken off."""
    t = strip(F.coalesce(c, F.lit("")))
    closed = F.rlike(t, F.lit("(?i)</think\\s*>"))
    t = strip(F.when(closed, F.regexp_replace(t, "(?is)^.*</think\\s*>", "")).otherwise(F.regexp_replace(t, "(?is)^\\s*<think\\b[^>]*>.*$", "")))
    fence = "(?is)^```(?:text|markdown)?\\s*(.*?)\\s*```$"
    t = F.when(F.rlike(t, F.lit(fence)), strip(F.regexp_extract(t, fence, 1))).otherwise(t)
    return F.regexp_replace(t, "^(?:" + "|".join(TRANSLATION_PREFIXES) + ")\\s*", "")


def compact(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)" + ADJACENCY_DELETED, "")


def plain_spaces(c: Column) -> Column:
    return F.regexp_replace(c, "\\p{Zs}", " ")


def separator_only(c: Column) -> Column:
    return F.rlike(c, F.lit("(?U)^[\\s_*]+$")) & F.rlike(c, F.lit("[_*]"))


def chunk_limits(configured: int | None) -> list[int]:
    """Smaller and smaller chunk sizes to try, each once."""
    steps = [configured, 6000, 4000, 2500, 1500, 900, 500, 250]
    return list(dict.fromkeys(s for s in steps if s))


def smaller_output_budget(message: Column, current: Column) -> Column:
    """The next output limit after a context overflow that a server reported in tokens or in characters; null: another error."""
    head = "(?is)maximum\\s*context length is\\s+(\\d+)\\s+tokens.*?requested\\s+(\\d+)\\s+output tokens.*?"
    tokens, characters = head + "contains at least\\s+(\\d+)\\s+input tokens", head + "prompt contains\\s+(\\d+)\\s+characters"
    n = lambda k: F.regexp_extract(message, tokens, k).try_cast("int")
    by_tokens = F.greatest(F.lit(256), F.least(n(1) - n(3) - 64, current - 1024))
    return F.when(F.rlike(message, F.lit(tokens)), by_tokens).when(F.rlike(message, F.lit(characters)), F.greatest(F.lit(256), current - 1024))


def token_estimate(c: Column) -> Column:
    cjk = F.regexp_count(c, F.lit(CJK_RANGES))
    return (cjk + F.ceil((F.length(c) - cjk) / 4)).cast("long")


def safe_slug(c: Column, default: str = "experiment") -> Column:
    slug = F.btrim(F.regexp_replace(strip(c), "[^A-Za-z0-9._-]+", "_"), F.lit("._"))
    return F.coalesce(F.nullif(F.left(slug, F.lit(180)), F.lit("")), F.lit(default))


def text_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def mark_term(text: Column, start: Column, end: Column) -> Column:
    """<TERM> markers around code points start to end."""
    return F.concat(F.left(text, start), F.lit("<TERM>"), F.substring(text, start + 1, end - start), F.lit("</TERM>"), F.substring(text, end + 1, F.length(text)))


def context(text: Column, start: Column, end: Column, width: int = 140) -> Column:
    left = F.greatest(F.lit(0), start - width)
    return F.substring(text, left + 1, F.least(F.length(text), end + width) - left)


def parse_bool(c: Column) -> Column:
    """true, false or, for other words, null."""
    w = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(w.isin(*TRUE_WORDS), True).when(w.isin(*FALSE_WORDS), False)


def over_wide(source: Column, rendering: Column) -> Column:
    first = F.lower(F.regexp_extract(source, "(?U)^\\s*(\\S+)", 1))
    return F.rlike(rendering, F.lit(OVER_WIDE)) & ~first.isin(*DETERMINERS)


def digest_fraction(*parts: Column) -> Column:
    """The first 64 bits of the parts' SHA-256 (joined by NUL) as a fraction of 2^64."""
    digest = F.sha2(F.concat_ws("\x00", *parts), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(1 << 64))
