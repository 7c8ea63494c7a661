"""Chunk-wise encoding against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import sys
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from conftest import SMALL  # noqa: E402

from lexiweave.llm import chunk_bpe as cb  # noqa: E402
from lexiweave.llm.common import table  # noqa: E402
from lexiweave.llm.packing import vocabulary_path  # noqa: E402

SCHEMA = "doc_id long, text string, uid long, key string, pos int, n_tokens int, middle string"
NAMES = ("n_tokens", "ids_sha256", "decoded_sha256")


@pytest.fixture(scope="module")
def exact():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def want(exact, text):
    ids = exact.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(exact.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_table(spark, exact):
    texts = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    got = cb.op11_bpe_chunks(spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[n] for n in NAMES) == want(exact, texts[r.doc_id]), r.doc_id


def odd_texts():
    rng = random.Random(9)
    shared = " ".join("".join(rng.choices("abcdefg'", k=rng.randrange(1, 9))) for _ in range(700))
    texts = ["", None, " \t\n\x0b\x0c\r", "it's 'tis don't we'll", shared, shared, "x" + shared, shared[3:], "<|endoftext|> " + shared + "<|startoftext|>", shared + "<|endoftext|>" + shared]
    texts += ["a" * 20000, "ab" * 9000, "日本語テスト" * 900, ("é ́x " * 700), "É́" * 3000, "=" * 9000 + " " * 9000, ("x" * 127 + " ") * 60, "'" * 3000 + "re"]
    texts += [shared.replace(" ", "\n\n"), shared.replace(" ", " "), shared.replace(" ", " \x1c \x85 ")]
    return texts


@pytest.mark.parametrize("bits", [cb.FILTER_BITS, cb.BLOCK])
def test_odd_rows(spark, exact, bits):
    texts = odd_texts()
    rows = [(i, t, 1, "k", 2, 3, "m") for i, t in enumerate(texts)] + [(None, "null id", 1, "k", 2, 3, "m")] * 2 + [(4, texts[4], 1, "k", 2, 3, "m")]
    got = cb.encode_documents(spark.createDataFrame(rows, SCHEMA), vocabulary_path(), filter_bits=bits).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[n] for n in NAMES) == want(exact, "null id" if r.doc_id is None else texts[r.doc_id]), r.doc_id
    assert cb.encode_documents(spark.createDataFrame([], SCHEMA), vocabulary_path()).count() == 0


def test_cuts_follow_content():
    rng = random.Random(2)
    text = "".join(rng.choices("abcdefgh é日", k=30000)).encode()
    for data in (text, b"=" * 30000, b"", b"a", ("日" * 9000).encode()):
        ends = cb.cuts(data)
        assert ends == sorted(set(ends)) and ends[-1] == len(data)
        assert all(len(c) <= cb.MAX_CHUNK for c in (data[a:b] for a, b in zip([0, *ends], ends)))
        b"".join(data[a:b].decode().encode() for a, b in zip([0, *ends], ends))  # no character is cut

    def pieces(d):
        ends = cb.cuts(d)
        return {d[a:b] for a, b in zip([0, *ends], ends)}

    assert len(pieces(text) & pieces(b"some other start " + text)) >= len(pieces(text)) - 4


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"ab'sreEÉ1.<|>", " ", "\n", "\x85", "日", "́", "<|endoftext|>"]), max_size=80).map("".join), st.lists(st.integers(0, 80), max_size=6))
def test_joins_of_any_cuts(text, at):
    """Pieces cut anywhere, as shared chunks would be, against the whole text."""
    codec = _codec()
    joiner = cb.Joiner(codec)
    bounds = sorted({0, len(text), *[min(a, len(text)) for a in at]})
    for a, b in zip(bounds, bounds[1:]):
        data = text[a:b].encode()
        piece = cb.piece_of(codec, data)
        joiner.piece(*piece) if piece else joiner.text(data)
    whole = cb.Digest(codec)
    whole.add(codec.encode(text.encode()))
    assert joiner.close() == whole.row()


_CODECS: list[cb.Codec] = []


def _codec() -> cb.Codec:
    if not _CODECS:
        _CODECS.append(cb.Codec(vocabulary_path()))
    return _CODECS[0]
