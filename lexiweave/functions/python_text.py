"""Text functions that no built-in expression gives: Arrow UDFs over batches, made when first applied."""

from __future__ import annotations

import html
import json
import re
import unicodedata
from bisect import bisect_left, bisect_right
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that make a block, those whose text does not count, and where a sentence ends.
BLOCKS = frozenset(("p", "div", "li", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6"))
SILENT = frozenset(("script", "style", "noscript"))
NOT_BLANK, NO_WIDTH = re.compile(r"\S"), re.compile("[\\s\u200b\ufeff]+")
BOUNDARY = re.compile(r"(?<=[.;:!?。；：！？])\s+|\n+")


def squeeze(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text.replace(" ", " "))).strip()


class Leaves(HTMLParser):
    """Texts of the block elements that hold no other block, in the order they open; also all text, by line."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.blocks: list[dict] = []
        self.lines: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs) -> None:
        if tag in SILENT:
            self.silent += 1
        elif tag in BLOCKS:
            if tag in ("p", "li", "td", "th") and self.open and self.open[-1]["tag"] == tag:
                self.open.pop()  # its end tag may be left out
            for b in self.open:
                b["leaf"] = False
            self.open.append({"tag": tag, "leaf": True, "text": []})
            self.blocks.append(self.open[-1])

    def handle_endtag(self, tag) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in BLOCKS and any(b["tag"] == tag for b in self.open):
            while self.open.pop()["tag"] != tag:
                pass

    def handle_data(self, data) -> None:
        if not self.silent and data.strip():
            self.lines.append(data.strip())
            for b in self.open:
                b["text"].append(data.strip())


def html_paragraphs(text: str, shortest: int = 8) -> list[str]:
    """Leaf blocks of a page, spaces normalised, short and repeated neighbours left out; without any, its lines."""
    page = Leaves()
    page.feed(text)
    page.close()
    found = [p for b in page.blocks if b["leaf"] and len(p := squeeze(" ".join(b["text"]))) >= shortest]
    if not found:
        found = [p for data in page.lines for line in data.splitlines() if len(p := squeeze(line).strip()) >= shortest]
    return [p for i, p in enumerate(found) if not i or p != found[i - 1]]


def split_source(text: str, limit: int) -> list[str]:
    """Pieces of at most limit characters, cut after the last sentence if that leaves half a piece, else anywhere."""
    gaps = [m.span() for m in BOUNDARY.finditer(text)]  # found once; each cut is a search among them
    begins = [b for b, _ in gaps]
    out, at = [], 0
    while len(text) - at > limit:
        j, full = bisect_left(begins, at + limit) - 1, at + limit
        cut = min(gaps[j][1], full) if j >= 0 else full
        if cut - at < max(1, limit // 2) or not text[at:cut].strip():
            cut = full
        out.append(text[at:cut].strip() or text[at:cut])
        more = NOT_BLANK.search(text, cut)
        at = more.start() if more else len(text)
    return out + [text[at:]] * (at < len(text) or not out)


def bare(text: str) -> str:
    """Compatibility forms composed, without white space and characters of no width."""
    return NO_WIDTH.sub("", unicodedata.normalize("NFKC", text))


def recover_substring(rendering: str, target: str) -> str | None:
    """The stretch of target that equals rendering but for white space and compatibility forms."""
    forms, want = [bare(c) for c in target], "".join(map(bare, rendering))
    found = "".join(forms).find(want) if want else -1
    if found < 0:
        return None
    ends = list(accumulate(map(len, forms)))  # where each character's form ends in the composed text
    return target[bisect_right(ends, found) : bisect_left(ends, found + len(want)) + 1]


def json_object(answer: str) -> str | None:
    """The first JSON object in an answer, fences and talk around it aside."""
    text = re.sub(r"(?is)^.*</think\s*>", "", answer).strip()
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", text):
        try:
            found, _ = decoder.raw_decode(text, m.start())
        except ValueError:
            continue
        return json.dumps(found, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return None


def _lift(ddl: str, kind: pa.DataType, function):
    def apply(*columns: Column) -> Column:
        @F.arrow_udf(ddl)
        def of(first: pa.Array, *rest: pa.Array) -> pa.Array:
            rows = zip(first.to_pylist(), *[r.to_pylist() for r in rest])
            return pa.array([None if row[0] is None else function(*row) for row in rows], kind)

        return of(*columns)

    return apply


html_paragraphs_of = _lift("array<string>", pa.list_(pa.string()), html_paragraphs)
unescape = _lift("string", pa.string(), html.unescape)
compose = _lift("string", pa.string(), lambda s: unicodedata.normalize("NFKC", s))
recover_substring_of = _lift("string", pa.string(), recover_substring)
json_object_of = _lift("string", pa.string(), json_object)


def split_source_of(column: Column, limit: int) -> Column:
    return _lift("array<string>", pa.list_(pa.string()), lambda s: split_source(s, limit))(column)
