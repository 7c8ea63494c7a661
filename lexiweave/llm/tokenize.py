"""Token ids of a lower-casing BPE with word ends, equal to the tokenizers library's, from a cache of words.

The vocabulary file (a tokenizers JSON) is a parameter. Texts of plain Latin script are cut at white space, the
pieces looked up in a bounded cache, and pieces not in it merged by a byte-pair encoder that holds the same merges
as ranks (a word's end is one more byte). All other texts, and texts that may hold a special token, go through the
tokenizers library itself.
"""

from __future__ import annotations

import json
import re
import sys

import numpy as np

#: Latin letters up to U+024F without those that a normaliser may change, digits, signs; white space of ASCII only.
PLAIN = re.compile("[\t-\r -~¡-įĲ-ľŁ-ňŊ-žƀ-ǃǍ-ǰǴ-ɏ]*")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼-¾]+|[0-9²³¹¼-¾]|(?:[^\w\s]|_)+")
WORD_END = b"\xff"


def _byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable ones themselves, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe:
    """encode(text): little-endian unsigned 32-bit ids as bytes."""

    def __init__(self, path: str, cache_bytes: int = 20 << 20):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.path, self.exact = path, None
        self.cache: dict[str, bytes] = {}  # chunks and the words in them alike: a word by itself is a chunk of one
        self.room = cache_bytes
        as_byte = _byte_of_symbol()

        def raw(symbol: str) -> bytes:
            end = symbol.endswith("</w>") and len(symbol) > 4
            return bytes(as_byte[c] for c in (symbol[:-4] if end else symbol)) + WORD_END * end

        vocab = {raw(s): i for s, i in model["vocab"].items() if s not in ("<|startoftext|>", "<|endoftext|>")}
        single = [bytes([b]) for b in range(256)]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        order = [*single, *(b + WORD_END for b in single), *(raw(a) + raw(b) for a, b in merges)]
        ranks = {token: rank for rank, token in reversed(list(enumerate(order)))}
        self.four = [vocab.get(token, 0).to_bytes(4, "little") for token in order]
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def _word(self, word: str) -> bytes:
        four = self.four
        ids = b"".join([four[r] for r in self.merge(word.encode() + WORD_END)])
        if self.room > 0:
            self._keep(word, ids)
        return ids

    def _cold(self, chunk: str) -> bytes:
        if chunk.isalpha():
            return self._word(chunk)
        get, merged = self.cache.get, self._word
        words = PIECES.findall(chunk)
        ids = b"".join([ids if (ids := get(w)) is not None else merged(w) for w in words])
        if self.room > 0 and len(words) > 1:
            self._keep(chunk, ids)
        return ids

    def _keep(self, key: str, ids: bytes) -> None:
        """Frequent words come early, so a full cache stays as it is."""
        size = sys.getsizeof(key) + sys.getsizeof(ids) + 100  # about what a slot of the dictionary takes
        if size <= self.room:
            self.room -= size
            self.cache[key] = ids
        elif size < 1000:
            self.room = 0

    def encode(self, text: str) -> bytes:
        if "<|" in text or not PLAIN.fullmatch(text):
            if self.exact is None:
                from tokenizers import Tokenizer

                self.exact = Tokenizer.from_file(self.path)
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        get, cold = self.cache.get, self._cold
        return b"".join([ids if (ids := get(w)) is not None else cold(w) for w in text.lower().split()])
