"""SimHash near-duplicates over an inverted index of positional bytes.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 3 of their 8 bytes, so they share
at least 5 positional bytes. The index lists fingerprints by 4 positional bytes at a time: the 4-subsets of
byte positions whose exclusive-or is zero (14 of them) hold every 3 positions in one subset, whose complement is
again one of the 14, so every such pair meets in a list, and lists are keyed by 32 bits, not 8. In a list the
shared positional bytes of a pair are tallied, pairs with fewer than 5 are dropped, the rest verified bit by bit.
A list gives a spanning forest of its links, never all pairs.

Lists of more than `list_limit` different fingerprints are not compared pairwise: fingerprints of such a list
agree in 32 bits, and any two of them linked agree after 3 of the other 32 bits are cleared. Grouping by each of
these 4,960 cleared values (at most 8 members a group) finds the same links in linear time, over all executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, keep_rows, row_key, table, utf8
from .components import connected_components, forest

POSITIONS = [s for s in combinations(range(8), 4) if s[0] ^ s[1] ^ s[2] ^ s[3] == 0]
MAX_BITS, MIN_SHARED = 3, 5


def simhash(text: bytes, words_each: int = 3, seed: int = 42) -> int:
    words = text.lower().split()  # A-Z only, white space of ASCII only
    if not words:
        return 0
    k = min(words_each, len(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k))))
    n = len(words) - k + 1
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        ones += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _simhash_column(column: Column) -> Column:
    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.fromiter((simhash(x.as_py()) for x in texts), np.uint64, len(texts)).view(np.int64))

    return of(column)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (long, the 64 bits); null and empty texts have fingerprint 0."""
    return docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col)[1].alias("x"), _simhash_column(utf8(text_col)).alias("fp"))


def index_keys(fp: Column) -> Column:
    """The 14 list keys of a fingerprint: 4 of its bytes, and which 4 in the bits above."""
    byte = lambda p: F.shiftrightunsigned(fp, 8 * p).bitwiseAND(255)
    keys = []
    for i, s in enumerate(POSITIONS):
        key = F.lit(i << 32)
        for j, p in enumerate(s):
            key = key.bitwiseOR(F.shiftleft(byte(p), 8 * j))
        keys.append(key)
    return F.array(*keys)


def links_in(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links among different fingerprints: tally shared positional bytes, then verify."""
    fps = fps.view(np.uint64)
    a, b = [], []
    block = max(1, (1 << 21) // max(1, len(fps)))
    for i in range(0, len(fps), block):
        x = fps[i : i + block, None] ^ fps[None, :]
        shared = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=2, dtype=np.uint8)
        p, q = np.nonzero((shared >= MIN_SHARED) & (shared < 8))
        good = (p + i < q) & (np.bitwise_count(x[p, q]) <= MAX_BITS)
        if good.any():
            p, q = forest(p[good] + i, q[good])
            a.append(p)
            b.append(q)
    if not a:
        return fps[:0].view(np.int64), fps[:0].view(np.int64)
    p, q = forest(np.concatenate(a), np.concatenate(b))
    return fps[p].view(np.int64), fps[q].view(np.int64)


def _walk_lists(batches: Iterator[pa.RecordBatch], list_limit: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, fp: the links of each list; fingerprints of lists over the limit pass through (kind 1)."""

    def out(kind: int, u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int32)), pa.array(u), pa.array(v)], ["kind", "u", "v"])

    key, held, long_list = None, np.empty(0, np.int64), False

    def close() -> Iterator[pa.RecordBatch]:
        if long_list:
            yield out(1, held, np.full(len(held), key, np.int64))
        elif len(held) > 1:
            u, v = links_in(held)
            if len(u):
                yield out(0, u, v)

    for batch in batches:
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else [0]
        sizes = np.diff(starts)
        # lists inside the batch with one member need no visit
        for i in np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) == 0) | (np.arange(len(sizes)) == len(sizes) - 1)):
            s, e = starts[i], starts[i + 1]
            if keys[s] != key:
                yield from close()
                key, held, long_list = keys[s], fps[s:e].copy(), False
            else:
                held = np.concatenate([held, fps[s:e]])
            if len(held) > list_limit:
                yield out(1, held, np.full(len(held), key, np.int64))
                long_list, held = True, held[:0]
    yield from close()


def _links_of_long_lists(over: DataFrame) -> DataFrame:
    """Links of lists over the limit (u: fingerprint, v: key), by clearing 3 of the 32 bits outside the key."""
    free = []
    for s in POSITIONS:
        bits = [8 * p + i for p in range(8) if p not in s for i in range(8)]
        free.append(F.array(*[F.lit(~(1 << b) if b < 63 else (1 << 63) - 1) for b in bits]))
    masks = [c for c in combinations(range(32), 3)]
    three = F.array(*[F.lit(a | b << 5 | c << 10) for a, b, c in masks])
    f = over.select("u", F.element_at(F.array(*free), (F.shiftright("v", 32) + 1).cast("int")).alias("free"), F.col("v").alias("key"))
    f = f.select("u", "key", "free", F.explode(three).alias("m"))
    at = lambda shift: F.element_at("free", F.shiftright(F.col("m"), shift).bitwiseAND(31) + 1)
    f = f.select("u", "key", "m", F.col("u").bitwiseAND(at(0)).bitwiseAND(at(5)).bitwiseAND(at(10)).alias("rest"))
    groups = f.groupBy("key", "m", "rest").agg(F.collect_set("u").alias("us")).filter(F.size("us") > 1)  # 8 members at most
    return groups.select(F.explode("us").alias("u"), F.array_min("us").alias("v")).filter("u <> v").distinct()


def near_pairs(fps: DataFrame, list_limit: int = 40_000) -> DataFrame:
    """Links (u, v) that connect all different fingerprints (column fp) as their pairs within 3 bits do."""
    lists = fps.select("fp").distinct().select(F.explode(index_keys(F.col("fp"))).alias("key"), "fp")
    lists = lists.repartition("key").sortWithinPartitions("key")
    found = checkpoint(lists.mapInArrow(lambda it: _walk_lists(it, list_limit), "kind int, u long, v long"))
    links = found.filter("kind = 0").select("u", "v")
    over = found.filter("kind = 1").select("u", "v")
    return links if over.isEmpty() else links.union(_links_of_long_lists(over))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", list_limit: int = 40_000) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id, and x (hash of the row's text).

    component_id is the smallest doc_id reachable over links of at most 3 differing bits, the row's own included.
    Null, empty and blank texts have fingerprint zero, linked like any other; repeated rows come out once each;
    null doc_ids take the smallest id of their component (null if it has none); an empty table gives no rows.
    """
    fp = checkpoint(fingerprints(docs, id_col, text_col))
    own = fp.groupBy("fp").agg(F.min("doc_id").alias("low"))
    parts = checkpoint(connected_components(near_pairs(own, list_limit)))
    named = parts.join(own, parts.node == own.fp).groupBy("root").agg(F.min("low").alias("lowest"))
    label = own.join(parts.join(named, "root").select(F.col("node").alias("fp"), "lowest"), "fp", "left").select(F.col("fp").alias("f"), F.when(F.col("lowest").isNull(), F.col("low")).otherwise(F.col("lowest")).alias("component_id"))
    rows = fp.join(label, fp.fp == label.f)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "x")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: the one with the smallest doc_id."""
    near = near_duplicates(docs, id_col, text_col)
    best = near.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "x")).alias("b"))
    kept = best.select(F.coalesce(F.col("b.doc_id").cast("string"), F.lit("\x00null")).alias("k"), F.col("b.x").alias("x"))
    return keep_rows(docs, kept, id_col, text_col)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("x")
