"""BPE encoding and decoding that reuses content-defined chunks across documents.

A text is cut where a rolling hash of its last 32 bytes hits a mask, so equal passages give equal chunks wherever they
stand. A first pass counts chunk hashes; those met twice set bits in a filter of a fixed size. A second pass encodes
what is met once where it stands; chunks whose bits are set are gathered, one text a chunk, and encoded once each. The
ids of a document's pieces are then streamed in order. A cut may fall inside a word, so at each join the text between
the nearest white space on both sides, with one more word on either side, is encoded again; the outer words must come
out with the ids that the pieces have for them, or the window grows.

The filter has no false negatives, and a false positive only sends a chunk that is met once through the shuffle: on
any input the result is the same, and once the filter is full all chunks take that way.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_folder, table
from .packing import vocabulary_path
from .tokenize import WordBpe

MIN_CHUNK, MEAN_BITS, MAX_CHUNK = 128, 9, 4096  # bytes; the mean is about 2^9 over the least
FILTER_BITS = 1 << 26  # 8 MiB in every Python worker
BLOCK = 1 << 16
_GEAR = np.random.RandomState(7).randint(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
_SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of a random number for each of the last 32 bytes, shifted by its distance; by doubling the window."""
    h = _GEAR[data]
    for w in (1, 2, 4, 8, 16):
        if len(h) > w:
            h[w:] = h[w:] + (h[:-w] << np.uint32(w))
    return h


def cuts(data: bytes, least: int = MIN_CHUNK, bits: int = MEAN_BITS, most: int = MAX_CHUNK) -> list[int]:
    """Ends of the chunks of a UTF-8 text, none inside a character."""
    n = len(data)
    if n <= least:
        return [n]
    x = np.frombuffer(data, np.uint8)
    hit = (rolling(x) >> np.uint32(32 - bits)) == 0
    places = np.flatnonzero(hit[:-1] & ((x[1:] & 0xC0) != 0x80)) + 1
    out, at = [], 0
    while n - at > least:
        i = int(np.searchsorted(places, at + least))
        end = int(places[i]) if i < len(places) else n
        if end > at + most:
            end = at + most
            while end > at and end < n and x[end] & 0xC0 == 0x80:
                end -= 1
        at = end
        out.append(at)
    if at < n:
        out.append(n)
    return out


def _bit(key: bytes, bits: int) -> int:
    return int.from_bytes(key[:8], "little") % bits


def _key(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _bytes(value) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def _count_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = []
        for text in batch.column(0):
            data, at = _bytes(text), 0
            for end in cuts(data):
                keys.append(int.from_bytes(_key(data[at:end])[:8], "little", signed=True))
                at = end
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], ["h"])


def shared_filter(texts: DataFrame, bits: int = FILTER_BITS) -> bytes:
    """A bit for each chunk met more than once in the one binary column of texts: bits / 8 bytes, whatever the input.

    Hashes are counted on the executors; set bits are gathered there into blocks, and only blocks come to the driver.
    """
    hashes = texts.mapInArrow(_count_keys, "h long")
    again = hashes.groupBy("h").count().filter("count > 1")
    bit = F.pmod("h", F.lit(bits))  # bits is a power of two: the same as of the unsigned number

    def block(pdf):
        mask = np.zeros(BLOCK, np.uint8)
        mask[(pdf["bit"] % BLOCK).to_numpy()] = 1
        import pandas as pd
        import zstandard

        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "mask": [zstandard.compress(np.packbits(mask, bitorder="little").tobytes())]})

    rows = again.select(bit.alias("bit")).distinct().withColumn("block", F.floor(F.col("bit") / BLOCK)).groupBy("block").applyInPandas(block, "block long, mask binary")
    import zstandard

    out = bytearray(bits // 8)
    for r in rows.toLocalIterator():
        out[r.block * (BLOCK // 8) : (r.block + 1) * (BLOCK // 8)] = zstandard.decompress(bytes(r.mask))
    return bytes(out)


class Codec:
    """Encodes with the vocabulary, and writes ids as the decimal and the decoded text; made once a worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("decoder") is not None:
            raise ValueError("decoding is the tokens joined by spaces only where the vocabulary names no decoder")
        vocab = {t["content"]: t["id"] for t in spec["added_tokens"]} | spec["model"]["vocab"]
        self.kind = "<u2" if max(vocab.values()) < 1 << 16 else "<u4"
        names = {i: t for t, i in vocab.items()}
        self.token = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.decimal = [b"%d" % i for i in range(len(self.token))]
        self.bpe = WordBpe(path)

    def encode(self, data: bytes) -> np.ndarray:
        return np.frombuffer(self.bpe.encode(data.decode("utf-8", "replace")), "<u4")


class Digest:
    """Count, hash of the decimal ids, and hash of the decoded text, of ids that come in pieces."""

    def __init__(self, codec: Codec):
        self.codec, self.n, self.ids, self.text = codec, 0, hashlib.sha256(), hashlib.sha256()

    def add(self, ids: np.ndarray) -> None:
        if not len(ids):
            return
        lead = b" " if self.n else b""
        listed, decimal, token = ids.tolist(), self.codec.decimal, self.codec.token
        self.ids.update(lead + b" ".join([decimal[i] for i in listed]))
        self.text.update(lead + b" ".join([token[i] for i in listed]))
        self.n += len(listed)

    def row(self) -> tuple[int, str, str]:
        return self.n, self.ids.hexdigest(), self.text.hexdigest()


def piece_of(codec: Codec, data: bytes) -> tuple[bytes, bytes, bytes, bytes, bytes] | None:
    """head, head's guard ids, middle ids, tail's guard ids, tail; None of a text with fewer than three gaps of white space.

    head: the first part, up to the first gap, and the guard word after it; tail likewise from the end. The parts at
    the ends may be cut words; the guard words and the middle are whole, so their ids stand.
    """
    first = _SPACE.search(data)
    second = first and _SPACE.search(data, first.end())
    if not second:
        return None
    stop = len(data)
    bounds: list[int] = []  # starts of the last two gaps
    while len(bounds) < 2 and stop > 0:
        at = max(data.rfind(c, 0, stop) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
        if at < 0:
            break
        end = at + 1
        while at > 0 and data[at - 1] in b" \t\n\x0b\x0c\r":
            at -= 1
        bounds.append(end)
        stop = at
    last_word, guard_start = bounds[0], bounds[1] if len(bounds) == 2 else 0
    if guard_start < second.end():
        return None
    kind = codec.kind
    guard_head, guard_tail = codec.encode(data[first.end() : second.start()]), codec.encode(data[guard_start:last_word])
    middle = codec.encode(data[second.end() : guard_start])
    return data[: second.end()], guard_head.astype(kind).tobytes(), middle.astype(kind).tobytes(), guard_tail.astype(kind).tobytes(), data[guard_start:]


def _agrees(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> bool:
    return len(ids) >= len(left) + len(right) and np.array_equal(ids[: len(left)], left) and np.array_equal(ids[len(ids) - len(right) :], right)


class Joiner:
    """Streams the pieces of one document into its digest."""

    def __init__(self, codec: Codec):
        self.codec, self.digest = codec, Digest(codec)
        self.open: list[bytes] = []  # text whose ids are not out yet: it starts after white space
        self.left = np.empty(0, codec.kind)  # ids of the guard word it starts with

    def text(self, data: bytes) -> None:
        self.open.append(data)

    def piece(self, head: bytes, guard_head: bytes, middle: bytes, guard_tail: bytes, tail: bytes) -> None:
        kind = self.codec.kind
        ids = self.codec.encode(b"".join([*self.open, head]))
        if not _agrees(ids, self.left, np.frombuffer(guard_head, kind)):
            raise RuntimeError("ids of a join differ from those of the chunks beside it: this vocabulary has tokens over white space")
        self.digest.add(ids)
        self.digest.add(np.frombuffer(middle, kind))
        self.open, self.left = [tail], np.frombuffer(guard_tail, kind)

    def close(self) -> tuple[int, str, str]:
        ids = self.codec.encode(b"".join(self.open))
        if not _agrees(ids, self.left, ids[:0]):
            raise RuntimeError("ids of a document's end differ from those of its last chunk")
        self.digest.add(ids)
        return self.digest.row()


PIECE = "head binary, guard_head binary, middle binary, guard_tail binary, tail binary"
_PIECE = [*"head guard_head middle guard_tail tail".split()]


def _split(path: str, shared, bits: int, id_type: pa.DataType):
    """Rows of documents: done in place if no chunk is shared, else a row for each shared chunk and for each run of others."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codec, seen, mask = Codec(path), set(), shared.value
        uid = TaskContext.get().partitionId() << 40
        names = ["uid", "pos", "key", "text", *_PIECE, "n_tokens", "ids_sha256", "decoded_sha256"]
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 7, pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows, ids, size = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                data, at, parts = _bytes(text), 0, []
                for end in cuts(data):
                    key = _key(data[at:end])
                    b = _bit(key, bits)
                    if mask[b >> 3] >> (b & 7) & 1:
                        parts.append((key, at, end))
                    elif parts and parts[-1][0] is None:
                        parts[-1] = (None, parts[-1][1], end)
                    else:
                        parts.append((None, at, end))
                    at = end
                uid += 1
                if len(parts) == 1 and parts[0][0] is None:
                    digest = Digest(codec)
                    digest.add(codec.encode(data))
                    rows.append((uid, 0, None, None, *[None] * 5, *digest.row()))
                    ids.append(doc_id)
                    continue
                for pos, (key, start, end) in enumerate(parts):
                    part = data[start:end]
                    if key is None:
                        piece = piece_of(codec, part)
                        rows.append((uid, pos, None, *((None, *piece) if piece else (part, *[None] * 5)), None, None, None))
                    else:  # the text goes along once a task
                        rows.append((uid, pos, key, None if key in seen else part, *[None] * 5, None, None, None))
                        if len(seen) < 1 << 18:
                            seen.add(key)
                    size += end - start
                    ids.append(doc_id)
                if size > 4 << 20:
                    yield _batch(rows, ids, names, kinds, id_type)
                    rows, ids, size = [], [], 0
            if rows:
                yield _batch(rows, ids, names, kinds, id_type)

    return split


def _batch(rows: list, ids: list, names: list, kinds: list, id_type: pa.DataType) -> pa.RecordBatch:
    columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays([pa.array([i.as_py() for i in ids], id_type), *columns], ["doc_id", *names])


def _encode_chunks(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                data = _bytes(text)
                piece = piece_of(codec, data)
                rows.append((None, *piece) if piece else (data, *[None] * 5))
            columns = [pa.array(c, pa.binary()) for c in zip(*rows)] if rows else [pa.array([], pa.binary())] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "text", *_PIECE])

    return encode


def _assemble(path: str, id_type: pa.DataType):
    """Streams pieces sorted by (uid, pos); one document is open at a time."""

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, joiner, current, doc_id = Codec(path), None, None, None
        for batch in batches:
            rows = []
            uids, text, parts = batch.column("uid").to_pylist(), batch.column("text"), [batch.column(c) for c in _PIECE]
            ids = batch.column("doc_id")
            for i, uid in enumerate(uids):
                if uid != current:
                    if joiner is not None:
                        rows.append((doc_id, *joiner.close()))
                    joiner, current, doc_id = Joiner(codec), uid, ids[i].as_py()
                if text[i].is_valid:
                    joiner.text(_bytes(text[i]))
                else:
                    joiner.piece(*[_bytes(p[i]) for p in parts])
            if rows:
                yield _digests(rows, id_type)
        if joiner is not None:
            yield _digests([(doc_id, *joiner.close())], id_type)

    return assemble


def _digests(rows: list, id_type: pa.DataType) -> pa.RecordBatch:
    kinds = [id_type, pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256 (of the decoded text).

    Ids equal the tokenizers library's without special tokens added. A null or empty text has no ids and the hashes of
    an empty text; repeated rows give a row each; a null doc_id stays null; an empty table gives no rows; other columns
    are not read. A text of any length is streamed by pieces of at most MAX_CHUNK bytes, or of what no other shares.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    id_kind = rows.schema["doc_id"].dataType
    id_type, id_ddl = to_arrow_type(id_kind), id_kind.simpleString()
    mask = spark.sparkContext.broadcast(shared_filter(rows.select("text"), filter_bits))
    folder = f"{checkpoint_folder(spark)}/chunks-{uuid.uuid4().hex}"
    schema = f"doc_id {id_ddl}, uid long, pos int, key binary, text binary, {PIECE}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    rows.mapInArrow(_split(vocabulary, mask, filter_bits, id_type), schema).write.option("compression", "zstd").parquet(folder)
    split = spark.read.schema(schema).parquet(folder)
    done = split.filter("ids_sha256 IS NOT NULL").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    pieces = split.filter("ids_sha256 IS NULL AND key IS NULL").select("uid", "pos", "doc_id", "text", *_PIECE)
    shared = split.filter("key IS NOT NULL")
    texts = shared.filter("text IS NOT NULL").groupBy("key").agg(F.min("text").alias("text"))
    chunks = texts.mapInArrow(_encode_chunks(vocabulary), f"key binary, text binary, {PIECE}")
    joined = shared.select("uid", "pos", "doc_id", "key").join(chunks, "key").select(*pieces.columns)
    # One exchange by document; its rows are put in order inside the partitions and streamed.
    ordered = pieces.union(joined).repartition("uid").sortWithinPartitions("uid", "pos")
    out = ordered.mapInArrow(_assemble(vocabulary, id_type), f"doc_id {id_ddl}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return done.union(out)


def op11_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary_path())
