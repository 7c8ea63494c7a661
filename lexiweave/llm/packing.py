"""Best-fit packing of documents into sequences by the sum-of-squares rule.

Each piece goes where the squared counts of open bins per residual gap become smallest: with N(h) open bins of gap
h, the bin gap (or the new bin) with the least change of sum N(h)^2 is taken, the tighter one on a tie. Full bins are closed.

Pieces are dealt by hash into groups of bounded expected size, packed in parallel, longest first. Sequences that
stay under `refill` full are opened again and their pieces, a small part, packed again with those of other
groups, until one group is left; so the waste does not grow with the number of groups. In the last group sequences with
room are opened again by the same rule in other orders, until there are as few as its tokens need at the least.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_rows, checkpoint, table, utf8
from .tokenize import WordBpe

VOCABULARY = "word_bpe_49k.json"
GROUP_PIECES = 8192
REOPEN = 40  # rounds


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size, in the order given."""
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    bins = 0
    gaps = np.empty(0, np.int64)  # those with open bins, ascending
    for i, s in enumerate(sizes.tolist()):
        rest = capacity - s
        best, change = capacity, (2 * count[rest] + 1 if rest else 0)
        at = int(np.searchsorted(gaps, s))
        if at < len(gaps):
            g = gaps[at:]
            left = g - s
            delta = np.where(left > 0, 2 * count[left] + 1, 0) - 2 * count[g] + 1
            j = int(delta.argmin())
            if delta[j] <= change:
                best = int(g[j])
        if best == capacity:
            b, bins = bins, bins + 1
        else:
            b = open_bins[best].pop()
            count[best] -= 1
            if not count[best]:
                gaps = np.delete(gaps, np.searchsorted(gaps, best))
        where[i], offset[i] = b, capacity - best
        left = best - s
        if left:
            open_bins[left].append(b)
            count[left] += 1
            if count[left] == 1:
                gaps = np.insert(gaps, np.searchsorted(gaps, left), left)
    return where, offset


def _pieces_udf(path: str, capacity: int, end_id: int):
    state: list[WordBpe] = []

    @F.arrow_udf("array<struct<start:bigint,length:bigint,ids_crc32:bigint>>")
    def pieces(texts: pa.Array) -> pa.Array:
        if not state:
            state.append(WordBpe(path))
        end, step, out = end_id.to_bytes(4, "little"), 4 * capacity, []
        for text in texts:
            ids = state[0].encode(text.as_py().decode("utf-8", "replace")) + end
            out.append([{"start": i // 4, "length": (min(len(ids), i + step) - i) // 4, "ids_crc32": zlib.crc32(ids[i : i + step])} for i in range(0, len(ids), step)])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])))

    return pieces


def pieces_of(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and end_id, cut only beyond the capacity."""
    cut = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(_pieces_udf(vocabulary, capacity, end_id)(utf8(text_col))).alias("piece", "p"))
    return cut.select("doc_id", "piece", "p.start", "p.length", "p.ids_crc32")


def reopen(sizes: np.ndarray, where: np.ndarray, capacity: int, rounds: int = REOPEN, refill: float = 0.995) -> np.ndarray:
    """The bin of each size after some bins are emptied and packed again, in orders that mix sizes; never more bins than before."""
    rng, least = np.random.default_rng(len(sizes)), -(-int(sizes.sum()) // capacity)
    for i in range(rounds):
        full = np.bincount(where, sizes)
        if len(full) <= least:
            break
        opened = full < (capacity if i % 2 == 0 else refill * capacity)
        some = np.flatnonzero(opened[where])
        blur = rng.random(len(some))
        some = some[np.argsort(blur if i % 3 == 0 else -sizes[some] * (1 + 0.3 * blur), kind="stable")]
        again, _ = sum_of_squares(sizes[some], capacity)
        if len(some) and again.max() < opened.sum():
            kept = np.cumsum(~opened) - 1
            where = np.where(opened[where], 0, kept[where])
            where[some] = (~opened).sum() + again
    return where


def offsets(sizes: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Places one after another in each bin."""
    order = np.argsort(where, kind="stable")
    upto = np.cumsum(sizes[order]) - sizes[order]
    first = np.r_[True, where[order][1:] != where[order][:-1]]
    out = np.empty(len(sizes), np.int64)
    out[order] = upto - np.maximum.accumulate(np.where(first, upto, 0))
    return out


def _pack_group(capacity: int, refill: float, last: bool):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "uid"], ascending=[False, True], ignore_index=True)
        sizes = pdf["length"].to_numpy()
        where, offset = sum_of_squares(sizes, capacity)
        if last:
            where = reopen(sizes, where, capacity)
            offset = offsets(sizes, where)
        full = np.bincount(where, sizes)
        pdf["bin"], pdf["offset"] = where, offset
        pdf["done"] = last | (full >= refill * capacity)[where]
        return pdf[["uid", "length", "g", "bin", "offset", "done"]]

    return pack


def pack(pieces: DataFrame, capacity: int = 4096, group_pieces: int = GROUP_PIECES, refill: float = 0.995) -> DataFrame:
    """pieces (any columns, with length up to the capacity) with sequence_id and offset."""
    with batch_rows(pieces.sparkSession, 256, "2m"):  # texts of any length go through the encoder here
        rows = checkpoint(pieces.withColumn("uid", F.monotonically_increasing_id()))
    todo, done, level = rows.select("uid", "length").filter(F.col("length") < capacity), None, 0
    placed = rows.filter(F.col("length") >= capacity).select("uid", (2 * F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left, before = todo.count(), None
    while left:
        groups = -(-left // group_pieces)
        last = groups == 1 or level == 15 or before is not None and left > 0.9 * before
        dealt = todo.withColumn("g", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(groups)))
        done = checkpoint(dealt.groupBy("g").applyInPandas(_pack_group(capacity, refill, last), "uid long, length long, g long, bin long, offset long, done boolean"))
        name = 2 * (16 * (4 * group_pieces * F.col("g") + F.col("bin")) + level) + 1  # even numbers are full pieces
        placed = placed.union(done.filter("done").select("uid", name.alias("sequence_id"), "offset"))
        todo, before, level = done.filter("not done").select("uid", "length"), left, level + 1
        left = 0 if last else todo.count()
    return rows.join(placed, "uid").drop("uid")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of one id (the end id); repeated rows are packed once each; a null doc_id
    stays null; an empty table gives no rows; other columns are not read.
    """
    out = pack(pieces_of(docs, vocabulary, capacity, id_col=id_col, text_col=text_col), capacity)
    return out.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")


def vocabulary_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())
