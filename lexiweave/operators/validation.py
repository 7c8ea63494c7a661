"""Validated uses of terms rolled up by document and over all documents, and which stored results are stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = {"hard_occurrences": "HARD", "soft_occurrences": "SOFT", "excluded_occurrences": "NONE"}
COUNTED = {"usage_status_counts": "usage_status", "validation_reason_counts": "reason", "context_classification_counts": "context_classification"}


def tree(uses: DataFrame, terms: DataFrame) -> DataFrame:
    """A row a document, and one for all (document_id null): terms, occurrences by control level, and maps from status, reason and context to their counts.

    uses: see terms.classify_uses(). terms: document_id, term_id; documents whose terms never occur are there with zeros.
    The uses are counted once by all three values; every level is summed from those few rows.
    """
    counted = uses.groupBy("document_id", "control_eligibility", *COUNTED.values()).agg(F.count("*").alias("n"))
    each = F.explode(F.array(F.lit(True), F.lit(False))).alias("_all")
    rows = counted.select("*", each).withColumn("document_id", F.when(~F.col("_all"), F.col("document_id")))
    levels = rows.groupBy("_all", "document_id").agg(F.sum("n").alias("occurrence_count"), *[F.sum(F.when(F.col("control_eligibility") == level, F.col("n")).otherwise(0)).alias(name) for name, level in LEVELS.items()])

    def by(field: str, name: str) -> DataFrame:
        one = rows.filter(F.col(field).isNotNull()).groupBy("_all", "document_id", field).agg(F.sum("n").alias("n"))
        return one.groupBy("_all", F.col("document_id").alias("_d")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(field), F.col("n"))))).alias(name)).withColumnRenamed("_all", "_a")

    t = terms.groupBy("document_id").agg(F.count("*").alias("term_count"))
    t = t.select(F.lit(False).alias("_all"), "document_id", "term_count").unionByName(t.agg(F.coalesce(F.sum("term_count"), F.lit(0)).alias("term_count")).select(F.lit(True).alias("_all"), F.lit(None).cast(terms.schema["document_id"].dataType).alias("document_id"), "term_count"))
    out = t.alias("t").join(levels.alias("l"), (F.col("t._all") == F.col("l._all")) & F.col("t.document_id").eqNullSafe(F.col("l.document_id")), "left").select("t.*", "occurrence_count", *LEVELS)
    for name, field in COUNTED.items():
        m = by(field, name)
        out = out.join(m, (out["_all"] == m["_a"]) & out["document_id"].eqNullSafe(m["_d"]), "left").drop("_a", "_d")
        out = out.withColumn(name, F.coalesce(name, F.expr("cast(map() as map<string,bigint>)")))
    return out.fillna(0, ["occurrence_count", *LEVELS]).drop("_all")


def source_signatures(paragraphs: DataFrame, terms: DataFrame) -> DataFrame:
    """document_id, source_signature: a hash of a document's paragraphs, in order, and its terms. terms: document_id, term_id, source_term."""
    digest = lambda *c: F.sha2(F.to_json(F.struct(*c)), 256)
    all_of = lambda order, d: F.transform(F.array_sort(F.collect_list(F.struct(*order, d.alias("h")))), lambda x: x["h"])
    p = paragraphs.groupBy("document_id").agg(all_of(["paragraph_id"], digest("paragraph_id", "text")).alias("p"))
    t = terms.groupBy("document_id").agg(all_of(["term_id"], digest("term_id", "source_term")).alias("t"))
    both = p.join(t, "document_id", "left")
    return both.select("document_id", F.sha2(F.concat(F.array_join("p", ""), F.lit("|"), F.array_join(F.coalesce("t", F.expr("cast(array() as array<string>)")), "")), 256).alias("source_signature"))


def freshness(signatures: DataFrame, stored: DataFrame) -> DataFrame:
    """document_id and state of each document: new without a stored result, valid with one of this source, stale with one of another."""
    s = stored.select("document_id", F.col("source_signature").alias("_stored"))
    state: Column = F.when(F.col("_stored").isNull(), "new").when(F.col("_stored") == F.col("source_signature"), "valid").otherwise("stale")
    return signatures.join(s, "document_id", "left").select("document_id", state.alias("state"))


def to_validate(documents: DataFrame, signatures: DataFrame, stored: DataFrame, overwrite: bool = False) -> DataFrame:
    """documents whose uses have to be validated: all with overwrite, else new ones; a stale one fails the query."""
    if overwrite:
        return documents
    state = freshness(signatures, stored)
    stop = F.raise_error(F.concat(F.lit("stored validation of another source: "), F.col("document_id").cast("string"))).cast("boolean")
    wanted = state.filter(F.when(F.col("state") == "stale", stop).otherwise(F.col("state") == "new"))
    return documents.join(wanted, "document_id", "left_semi")
