"""Licence notices by conditional compression.

Candidate blocks (sentences of a line, and whole lines, with a word of licensing in them, runs of neighbouring sentences
and lines around one that could be a template's wording, and stretches of words, wherever lines and sentences end, that share
enough pairs of neighbouring words with a template) are compressed alone and with each template as a zstandard raw dictionary. Templates are ranked by the share of the size that the dictionary saves;
the winner is confirmed by the exact differences of its wording: words missing, added, or changed.
"""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Short notices in common use, by SPDX id.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-short": "Released under the MIT License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-short": "Released under the BSD License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0-long": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-4.0-view": "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
    "CC-BY-SA-4.0-view": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved.",
}
CUES = ("licen", "copyright", "permission", "redistribut", "public domain", "unencumbered", "creative commons", "spdx", "cc by", "cc-by", "cc0", "all rights reserved")
#: Words with points and hyphens in them; a line may end after a hyphen.
WORD = re.compile(r"[^\W_]+(?:(?:\.|-(?:[ \t]*\n[\s#*/;%>]*)?)[^\W_]+)*")
HYPHEN = re.compile(r"(?<=\w)-[ \t]*\n[\s#*/;%>]*(?=\w)")
#: A winner must save this share of the block's size, and have at most this share of the longer wording different.
MIN_SAVED, MAX_DIFFERENT = 0.3, 0.25
TRIED = 6  # templates at least, from the best saving on, whose wording is compared
BREAK = re.compile(r"\s*\n[\s#*/;%>-]*")  # a line's end, and what marks the next one as a comment


def words_of(text: str) -> list[str]:
    return [HYPHEN.sub("-", w) if "\n" in w else w for w in WORD.findall(text.lower())]


class Scanner:
    def __init__(self, templates: dict[str, str]):
        import zstandard as z

        self.words = {k: words_of(t) for k, t in templates.items()}
        # A confirmed block lacks at most a third of its template's words, so of any larger part of them it holds one.
        bare = [w for k, w in self.words.items() if not any(c in templates[k].lower() for c in CUES)]
        self.cues = (*CUES, *dict.fromkeys(v for w in bare for v in sorted(w, key=len, reverse=True)[: len(w) // 3 + 1]))
        self.most = max(map(len, self.words.values()), default=0) / (1 - MAX_DIFFERENT)
        self.having: dict[str, list[tuple[str, int]]] = {}
        for k, w in self.words.items():
            for v, n in Counter(w).items():
                self.having.setdefault(v, []).append((k, n))
        self.pairs: dict[tuple[str, str], list[tuple[str, int]]] = {}
        for k, w in self.words.items():
            for t, pair in enumerate(zip(w, w[1:])):
                self.pairs.setdefault(pair, []).append((k, t))
        self.plain = z.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
        self.given = {k: z.ZstdCompressor(level=3, dict_data=z.ZstdCompressionDict(t.lower().encode(), dict_type=z.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for k, t in templates.items()}

    def has_cue(self, text: str) -> bool:
        low = text.lower()
        return any(c in low for c in self.cues)

    def blocks(self, text: str) -> list[tuple[int, int]]:
        """Spans of the candidate blocks: sentences that hold a cue, lines of more than one sentence that do, and runs of sentences around a cue."""
        out, units, at = [], [], 0
        if not self.has_cue(text):
            return out
        for line in text.split("\n"):
            end = at + len(line)
            cuts = [at, *(m.end() + at for m in re.finditer(r"[.;:!?]\s+", line)), end]
            if self.has_cue(line):
                spans = [(s, e) for s, e in zip(cuts, cuts[1:]) if self.has_cue(text[s:e])]
                if len(cuts) > 2 and len(WORD.findall(line)) <= self.most:  # a longer line lacks too much of any template
                    spans.append((at, end))
                out += [(s, e) for s, e in spans if text[s:e].strip()]
            units += [(s, e) for s, e in zip(cuts, cuts[1:]) if text[s:e].strip()]
            at = end + 1
        return list(dict.fromkeys(out + self.runs(text, units) + self.stretches(text)))

    def stretches(self, text: str) -> list[tuple[int, int]]:
        """Stretches of words near a template's wording, cut to it.

        A confirmed stretch differs in at most a quarter of the longer wording, and a difference takes at most two pairs
        of neighbouring words away, so at least half a template's pairs, less one, lie within four thirds of its length.
        """
        spans = [m.span() for m in WORD.finditer(text)]
        words = [HYPHEN.sub("-", text[s:e].lower()) for s, e in spans]
        hits: dict[str, list[tuple[int, int]]] = {}
        for i, pair in enumerate(zip(words, words[1:])):
            for k, t in self.pairs.get(pair, ()):
                hits.setdefault(k, []).append((i, t))
        out = []
        for k, found in hits.items():
            own = self.words[k]
            need, most = max(1, -(-len(own) // 2) - 1), int(len(own) / (1 - MAX_DIFFERENT)) + 1
            b = 0
            for a, (i, t) in enumerate(found):
                b = max(b, a)
                while b + 1 < len(found) and found[b + 1][0] - i < most:
                    b += 1
                if b - a + 1 < need or a and found[a - 1] == (i - 1, t - 1):  # the hit before starts the same stretch
                    continue
                first, last = max(0, i - t), min(len(words), found[b][0] + len(own) - found[b][1])
                last = min(last, first + 2 * most)
                cut = self.trimmed(own, words[first:last])
                if cut:
                    out.append((spans[first + cut[0]][0], spans[first + cut[1] - 1][1]))
        return list(dict.fromkeys(out))

    @staticmethod
    def trimmed(own: list[str], words: list[str]) -> tuple[int, int] | None:
        """The part of words that stands for a template: without words added before its first and after its last."""
        ops = SequenceMatcher(None, own, words, autojunk=False).get_opcodes()
        same = [o for o in ops if o[0] == "equal"]
        if not same:
            return None
        (_, a0, _, b0, _), (_, _, a1, _, b1) = same[0], same[-1]
        return max(0, b0 - a0), min(len(words), b1 + len(own) - a1)

    def runs(self, text: str, units: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Runs of two units or more around one with a cue whose words, in whatever order, are near enough to a template's."""
        out, words = [], {}
        cues = [i for i, (s, e) in enumerate(units) if self.has_cue(text[s:e])]

        def of(i: int) -> list[str]:
            if i not in words:
                words[i] = words_of(text[slice(*units[i])])
            return words[i]

        starts: dict[int, int] = {}  # of a start: the first unit with a cue from there on
        for c in cues:
            i, n = c, len(of(c))
            while i >= 0 and n <= self.most and i not in starts:
                starts[i] = c
                i -= 1
                n += len(of(i)) if i >= 0 else 0
        for i, c in starts.items():
            if not of(i):
                continue
            used, common, n = Counter(), Counter(), 0
            for j in range(i, len(units)):
                n += len(of(j))
                if n > self.most:
                    break
                for w in of(j):
                    used[w] += 1
                    for k, most in self.having.get(w, ()):
                        common[k] += used[w] <= most
                if j > i and j >= c and of(j) and any(n + len(self.words[k]) - 2 * m <= MAX_DIFFERENT * max(n, len(self.words[k])) for k, m in common.items()):
                    out.append((units[i][0], units[j][1]))
        return out

    def match(self, block: str) -> dict:
        """The best template of a block with its saving, the runner-up, and the differences in wording."""
        block = BREAK.sub(" ", HYPHEN.sub("-", block))
        data = block.strip().lower().encode()
        alone = len(self.plain.compress(data))
        words = words_of(block)
        ranked = sorted(((1 - len(c.compress(data)) / alone, -abs(len(self.words[k]) - len(words)), k) for k, c in self.given.items()), reverse=True)
        # Savings of short blocks are a few bytes apart, and a long template may hold a short one's words: exact wording decides.
        close = [r for i, r in enumerate(ranked) if r[0] >= ranked[0][0] - 0.05 or i < TRIED and r[0] >= MIN_SAVED]

        def differences(k: str) -> tuple[int, list[str], list[str]]:
            ops = SequenceMatcher(None, self.words[k], words, autojunk=False).get_opcodes()
            missing = [w for tag, a, b, _, _ in ops if tag in ("delete", "replace") for w in self.words[k][a:b]]
            added = [w for tag, _, _, a, b in ops if tag in ("insert", "replace") for w in words[a:b]]
            return len(missing) + len(added), missing, added

        found = [(differences(k), saved, k) for saved, _, k in close]
        (n, missing, added), saved, name = min(found, key=lambda f: (f[0][0], -f[1], f[2]))  # of equal ones the first by name
        longest = max(len(self.words[name]), len(words), 1)
        other = next((k for _, _, k in ranked if k != name), None)
        return {"license": name, "saved": round(saved, 6), "second": other, "missing": missing, "added": added, "confirmed": saved >= MIN_SAVED and n <= MAX_DIFFERENT * longest}

    def scan(self, text: str) -> list[dict]:
        found = [{"start": s, "end": e, **self.match(text[s:e])} for s, e in self.blocks(text)]
        best: list[dict] = []  # of overlapping blocks the confirmed with most of a template, then the closest in wording
        differ = lambda f: len(f["missing"]) + len(f["added"])
        for f in sorted(found, key=lambda f: (not f["confirmed"], differ(f) - (len(self.words[f["license"]]) - len(f["missing"])) * f["confirmed"], f["start"], -f["end"])):
            if all(f["end"] <= g["start"] or f["start"] >= g["end"] for g in best):
                best.append(f)
        return sorted(best, key=lambda f: f["start"])


FOUND = "array<struct<start:int,end:int,license:string,saved:double,second:string,missing:array<string>,added:array<string>,confirmed:boolean>>"
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("license", pa.string()), ("saved", pa.float64()), ("second", pa.string()), ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string())), ("confirmed", pa.bool_())]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate block: doc_id, block, start, end (code points), license, saved, second, missing, added, confirmed.

    Texts that are null, empty or hold no word of licensing have no rows; repeated rows come out once each; a null doc_id
    stays null; an empty table gives no rows. Whole texts are read; nothing is shuffled.
    """
    templates = templates or TEMPLATES
    state: list[Scanner] = []

    @F.arrow_udf(FOUND)
    def of(texts: pa.Array) -> pa.Array:
        if not state:
            state.append(Scanner(templates))
        return pa.array([state[0].scan(t.as_py() or "") for t in texts], _ARROW)

    rows = docs.select(F.col(id_col).alias("doc_id"), of(F.col(text_col)).alias("f")).select("doc_id", F.posexplode("f").alias("block", "f"))
    return rows.select("doc_id", "block", "f.*")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    return out.withColumns({"missing": F.concat_ws(" ", "missing"), "added": F.concat_ws(" ", "added")})
