"""Exact duplicates by composable polynomial fingerprints.

A text without its white space is cut into chunks; each chunk is hashed on its own, in parallel, as a polynomial
modulo two primes and shifted by the bytes before it (times base to that power), so a document's fingerprint is the
plain sum of its chunks' and can be put together in any order. The chunks of rows with equal fingerprints are then
compared place by place; a group with chunks that differ (a collision) is told apart by SHA-256 as well.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_function, checkpoint, fresh, keep_rows, row_key, table

PRIMES, BASES = (2147483647, 2147483629), (1103515245, 1664525)
CHUNK = 1 << 18  # code points


def power(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    """base to each exponent modulo a prime below 2^31."""
    out, square, e = np.ones(len(exponents), np.uint64), np.uint64(base % prime), exponents.astype(np.uint64)
    while e.any():
        out = np.where(e & np.uint64(1), out * square % np.uint64(prime), out)
        square, e = square * square % np.uint64(prime), e >> np.uint64(1)
    return out


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    p = _POWERS.get(base, np.ones(1, np.uint64))
    while len(p) < n:
        p = np.concatenate([p, p * power(base, np.array([len(p)]), prime)[0] % np.uint64(prime)])
    _POWERS[base] = p
    return p


def polynomial(data: bytes, base: int, prime: int) -> int:
    """Sum of byte i (plus one) times base^i, modulo the prime."""
    x, p, total = np.frombuffer(data, np.uint8), _powers(base, prime, min(len(data), 1 << 16)), 0
    for i in range(0, len(x), 1 << 16):
        part = x[i : i + (1 << 16)].astype(np.uint64) + np.uint64(1)
        total += int((part * p[: len(part)]).sum() % np.uint64(prime)) * pow(base, i, prime)
    return total % prime


@arrow_function("struct<a:bigint,b:bigint>")
def _shifted(chunks: pa.Array, offsets: pa.Array) -> pa.Array:
    """Both polynomials of each chunk, times base to the power of the bytes before it."""
    at = offsets.to_numpy(zero_copy_only=False)
    out = []
    for base, prime in zip(BASES, PRIMES):
        h = np.fromiter((polynomial(c.as_py(), base, prime) for c in chunks), np.uint64, len(chunks))
        out.append(pa.array((h * power(base, at, prime) % np.uint64(prime)).astype(np.int64)))
    return pa.StructArray.from_arrays(out, ["a", "b"])


def _normal(text_col: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def _chunked(rows: DataFrame, chunk: int, *columns: str) -> DataFrame:
    """columns, then no (chunk number), part (the chunk's text) and before (bytes before it) of column norm, whose text is read once."""
    parts, lens = F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)), fresh("lens")
    parts = F.when(F.length("norm") <= chunk, F.array("norm")).otherwise(parts)
    cut = rows.withColumn(lens, parts).select(*columns, F.transform(lens, F.octet_length).alias(lens), F.posexplode(lens).alias("no", "part"))
    return cut.select(*columns, "no", "part", F.aggregate(F.slice(lens, F.lit(1), F.col("no")), F.lit(0).cast("long"), lambda a, v: a + v).alias("before"))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, chunk: int) -> DataFrame:
    """uid, doc_id, k, x, n, sha, bytes, fa, fb of each row. Texts of more than a chunk are cut, their chunks dealt to all tasks and summed up."""
    k, x = row_key(id_col, text_col)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), k.alias("k"), x.alias("x"), F.coalesce(F.length(text_col), F.lit(0)).alias("n"), _normal(text_col).alias("norm"), F.col(text_col).alias("raw"))
    own = ["uid", "doc_id", "k", "x", "n"]
    facts = [F.sha2("norm", 256).alias("sha"), F.octet_length("norm").alias("bytes")]
    names = ["h.a", "h.b"]
    long = F.coalesce(F.length("raw"), F.lit(0)) > chunk
    small = rows.filter(~long).select(*own, *facts, _shifted(F.col("norm").cast("binary"), F.lit(0).cast("long")).alias("h")).select(*own, "sha", "bytes", *[F.col(n).alias(f"f{n[-1]}") for n in names])
    large = rows.filter(long)
    parts = _chunked(large, chunk, "uid").repartition("uid", "no").withColumn("h", _shifted(F.col("part").cast("binary"), F.col("before")))
    sums = parts.groupBy(F.col("uid").alias("of")).agg(*[F.pmod(F.sum(n), F.lit(p)).alias(f"f{n[-1]}") for n, p in zip(names, PRIMES)])
    return small.union(large.select(*own, *facts).join(sums, F.col("uid") == F.col("of")).select(*small.columns))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, and k, x (the row's key).

    Texts are equal if they are after deleting ASCII white space; of equal ones the row with the most code points in
    the original text stays, then the smallest doc_id (null last), then any one of rows that repeat one another.
    Null counts as empty; empty and blank texts are equal to each other; an empty table gives no rows.
    """
    rows = checkpoint(fingerprints(docs, id_col, text_col, chunk))
    by = ["fa", "fb", "bytes"]
    member = rows.join(rows.groupBy(*by).count().filter("count > 1").drop("count"), by).select(*by, "k", "x").distinct()
    # Chunk by chunk: the chunks of a place in a group are all equal if the least is the greatest; copies meet before the shuffle already.
    k, x = row_key(id_col, text_col)
    texts = docs.select(k.alias("k"), x.alias("x"), _normal(text_col).alias("norm")).join(member, ["k", "x"])
    places = _chunked(texts, chunk, *by).groupBy(*by, "no").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    wrong = checkpoint(places.filter("low <> high").select(*by).distinct().withColumn("wrong", F.lit(True)))
    rows = rows.withColumn("tag", F.lit(""))
    if not wrong.isEmpty():
        rows = rows.drop("tag").join(wrong, by, "left").withColumn("tag", F.when(F.col("wrong"), F.col("sha")).otherwise(""))
    by = [*by, "tag"]
    best = rows.groupBy(*by).agg(F.count("*").alias("group_size"), F.min(F.struct(-F.col("n"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("uid").alias("uid"))).alias("b"))
    out = rows.join(best, by)
    return out.select("doc_id", F.col("b.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("b.uid")).alias("kept"), F.col("sha").alias("text_sha256"), "k", "x")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names; nulls, ties, repeated rows and empty tables as in duplicates()."""
    return keep_rows(docs, duplicates(docs, id_col, text_col).filter("kept"), id_col, text_col)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents")).drop("k", "x")


OP9_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(length(text), 0) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  row_number() OVER w = 1 AS kept, h AS text_sha256
FROM t WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
