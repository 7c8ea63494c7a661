"""Filing indexes and exhibit pages, dataset folders, CSV, text and table sinks."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Where indexes stand, what an index line holds, words of an agreement, files that are no documents.
ROOT = "https://www.sec.gov"
HEADER = "CIK|Company Name|Form Type|Date Filed|Filename"
AGREEMENT = "(?i)\\b(agreement|contract|indenture|lease|license|licence|plan|employment|purchase|merger|confidentiality|non[- ]disclosure|credit|loan|guaranty|guarantee|services|supply|distribution|collaboration|settlement|separation|consulting|compensation)\\b"
NO_DOCUMENTS = "(?i)\\.(jpg|jpeg|png|gif|css|js|xml|xsd)$"
DEFAULT_FORMS = ("10-K", "10-Q", "8-K", "S-1", "S-4", "20-F", "6-K")


def quarter_index_url(year: Column, quarter: Column) -> Column:
    return F.when(quarter.between(1, 4), F.format_string(ROOT + "/Archives/edgar/full-index/%d/QTR%d/master.idx", year, quarter))


def parse_index(text: DataFrame) -> DataFrame:
    """cik, company, form, filed, path, accession of the index lines (column value) after the header (column line counts them)."""
    start = text.filter(F.contains("value", F.lit(HEADER))).agg(F.min("line").alias("start"))
    f = F.transform(F.split("value", "\\|", -1), lambda x: F.btrim(x))
    rows = text.join(F.broadcast(start), F.col("line") > F.col("start")).select(f.alias("f"))  # one row
    rows = rows.filter(F.size("f") == 5).select(*[F.col("f")[i].alias(c) for i, c in enumerate(("cik", "company", "form", "filed", "path"))])
    return rows.withColumn("accession", F.regexp_extract("path", "(\\d{10}-\\d{2}-\\d{6})\\.txt$", 1)).filter("accession <> ''")


def filing_index_url(cik: Column, accession: Column) -> Column:
    return F.concat(F.lit(ROOT + "/Archives/edgar/data/"), cik.cast("long").cast("string"), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), accession, F.lit("-index.html"))


class _Rows(HTMLParser):
    """Tables of a page: header cells, and rows of cells with the first link."""

    def __init__(self) -> None:
        super().__init__()
        self.tables: list[dict] = []
        self.cell: list[str] | None = None
        self.link: list[str] | None = None

    def handle_starttag(self, tag, attrs) -> None:
        if tag == "table":
            self.tables.append({"head": [], "rows": []})
        elif self.tables and tag == "tr":
            self.tables[-1]["rows"].append({"cells": [], "href": None, "name": ""})
        elif self.tables and tag in ("td", "th"):
            self.cell = []
        elif tag == "a" and self.cell is not None and (href := dict(attrs).get("href")) and self.tables[-1]["rows"] and self.tables[-1]["rows"][-1]["href"] is None:
            self.tables[-1]["rows"][-1]["href"], self.link = href, []

    def handle_data(self, data) -> None:
        for part in (self.cell, self.link):
            if part is not None and data.strip():
                part.append(data.strip())

    def handle_endtag(self, tag) -> None:
        if tag in ("td", "th") and self.cell is not None:
            where = self.tables[-1]["head"] if tag == "th" else self.tables[-1]["rows"][-1]["cells"] if self.tables[-1]["rows"] else []
            where.append(" ".join(self.cell))
            self.cell = None
        elif tag == "a" and self.link is not None:
            self.tables[-1]["rows"][-1]["name"], self.link = " ".join(self.link), None


def exhibit_rows(page: str) -> list[dict]:
    found = _Rows()
    found.feed(page)
    out = []
    for table in found.tables:
        head = [h.lower() for h in table["head"]]
        if any("document" in h for h in head) and any("type" in h for h in head):
            for r in table["rows"]:
                if len(r["cells"]) >= 4 and r["name"]:
                    out.append({"sequence": r["cells"][0], "description": r["cells"][1], "filename": r["name"], "exhibit_type": r["cells"][3], "href": r["href"]})
    return out


def absolute(base: Column, link: Column) -> Column:
    """A link as a browser on the page base would follow it."""
    from urllib.parse import urljoin

    @F.arrow_udf("string")
    def joined(bases: pa.Array, links: pa.Array) -> pa.Array:
        return pa.array([None if x is None else urljoin(b or "", x) for b, x in zip(bases.to_pylist(), links.to_pylist())], pa.string())

    return joined(base, link)


def discover_exhibits(pages: DataFrame) -> DataFrame:
    """Contract exhibits of filing pages (id, html): exhibit 10s and descriptions of agreements, each link once, its last row.

    With a column base, the page's address, links are made absolute (url) and told apart by that.
    """
    kind = pa.list_(pa.struct([(c, pa.string()) for c in ("sequence", "description", "filename", "exhibit_type", "href")]))

    @F.arrow_udf("array<struct<sequence:string,description:string,filename:string,exhibit_type:string,href:string>>")
    def rows(html: pa.Array) -> pa.Array:
        return pa.array([exhibit_rows(h or "") for h in html.to_pylist()], kind)

    based = ["base"] if "base" in pages.columns else []
    r = pages.select("id", *based, F.posexplode(rows(F.col("html"))).alias("place", "e")).select("id", *based, "place", "e.*")
    r = r.filter(~F.rlike("filename", F.lit(NO_DOCUMENTS)) & (F.upper("exhibit_type").startswith("EX-10") | F.rlike("description", F.lit(AGREEMENT))))
    if based:
        r = r.withColumn("url", absolute(F.col("base"), F.col("href")))
        last = r.groupBy("id", "url").agg(F.max_by(F.struct("sequence", "description", "filename", "exhibit_type"), "place").alias("e"))
        return last.select("id", "url", "e.*")
    last = r.groupBy("id", "href").agg(F.max_by(F.struct("sequence", "description", "filename", "exhibit_type"), "place").alias("e"))
    return last.select("id", "href", "e.*")


def sample_filings(filings: DataFrame, forms: tuple = DEFAULT_FORMS, n: int = 100, seed: int = 0) -> DataFrame:
    """n filings of some forms in the order of a hash, each path once."""
    some = filings.filter(F.col("form").isin(*forms)).dropDuplicates(["path"])
    return some.orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), "path"), 256), "path").limit(n)


DOCUMENT = "document_id string, schema_version string, paragraphs array<struct<paragraph_id:int,text:string>>, terms array<struct<term_id:string,source_term:string,extraction_method:string,definition_paragraph_ids:array<int>,occurrences:array<struct<paragraph_id:int,char_start:int,char_end:int,surface:string,context:string>>>>"


def read_documents(spark: SparkSession, folder: str, schema: str = DOCUMENT, required: str = "paragraphs") -> DataFrame:
    """One JSON document a file, folders below included; manifests, malformed files and those without the required field left out."""
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    named = rows.withColumn("file_name", F.col("_metadata.file_name"))
    return named.filter(~F.col("file_name").endswith("manifest.json") & F.col(required).isNotNull())


def unique_documents(documents: DataFrame) -> DataFrame:
    """documents, unless two have one id: then the query fails."""
    twice = documents.groupBy("document_id").agg(F.count("*").alias("n"))
    checked = twice.select("document_id", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("duplicate document_id "), "document_id"))).alias("_ok"))
    return documents.join(checked, "document_id").filter("_ok is null").drop("_ok")


def json_files(spark: SparkSession, folder: str, glob: str = "*.json") -> DataFrame:
    """file_name and value (the whole text) of each file, folders below included."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder)
    return rows.select(F.col("_metadata.file_name").alias("file_name"), F.btrim("value", F.lit(" \t\r\n")).alias("value"))


# Endings of files beside reviews that are no reviews.
NO_REVIEWS = ("manifest.json", ".audit.json", ".checkpoint.json", ".metrics.json", ".aggregated.json", ".judgments.json")
REVIEW = "occurrence_id string, document_id string, term_id string, source_term string, paragraph_id int, target_paragraph string, rendering string, extraction_status string, extraction_confidence double, notes string"


def read_review_files(spark: SparkSession, folder: str, schema: str = REVIEW) -> DataFrame:
    """The objects of JSON arrays of which one at least has an occurrence_id; other files and malformed ones are left out."""
    files = json_files(spark, folder).filter(F.startswith("value", F.lit("[")))
    for ending in NO_REVIEWS:
        files = files.filter(~F.col("file_name").endswith(ending))
    items = F.filter(F.from_json("value", "array<string>"), lambda x: F.startswith(x, F.lit("{")))
    files = files.withColumn("rows", F.transform(items, lambda x: F.from_json(x, schema)))
    return files.filter(F.exists("rows", lambda r: r["occurrence_id"].isNotNull())).select("file_name", F.explode("rows").alias("r")).select("file_name", "r.*")


SIDE = "struct<fidelity:double,legal:double,terminology:double,fluency:double,quality:double>"
JUDGED = f"struct<paragraph_id:string,has_benchmark_terms:boolean,judgment:struct<winner:string,confidence:double,scores:struct<baseline:{SIDE},controlled:{SIDE}>>>"


def read_evaluations(spark: SparkSession, folder: str, row: str = JUDGED, error: str = "struct<paragraph_id:string,error:string>") -> tuple[DataFrame, DataFrame]:
    """(evaluations, errors) of the evaluation files, a row each with its document_id (else the file's name).

    Evaluations without a paragraph_id are left out; two of one paragraph make the query fail.
    """
    schema = f"document_id string, evaluations array<{row}>, errors array<{error}>"
    files = json_files(spark, folder, "*.translation-evaluation.json").filter(F.startswith("value", F.lit("{"))).withColumn("d", F.from_json("value", schema))
    name = F.coalesce(F.nullif(F.col("d.document_id"), F.lit("")), F.regexp_replace("file_name", "\\.json$", "")).alias("document_id")
    found = files.select(name, F.explode("d.evaluations").alias("r")).select("document_id", "r.*").filter("paragraph_id is not null")
    n = F.count("*").over(Window.partitionBy("document_id", "paragraph_id"))
    twice = F.raise_error(F.concat(F.lit("duplicate evaluation row "), F.concat_ws("/", "document_id", "paragraph_id")))
    checked = found.withColumn("_n", n).filter(F.when(F.col("_n") > 1, twice.cast("boolean")).otherwise(F.lit(True))).drop("_n")
    return checked, files.select(name, F.explode("d.errors").alias("r")).filter("r is not null").select("document_id", "r.*")


def synthesize_ids(reviews: DataFrame) -> DataFrame:
    made = F.concat_ws("::", "document_id", "term_id", F.col("occurrence_index").cast("string"), F.col("paragraph_id").cast("string"))
    return reviews.withColumn("occurrence_id", F.coalesce(F.nullif(F.col("occurrence_id"), F.lit("")), made))


REVIEW_COLUMNS = ("document_id", "term_id", "source_term", "frequency", "extraction_method", "definition_paragraph_ids", "definition_context", "suggested_term_type", "suggested_criticality", "suggested_include", "term_type", "criticality", "include_in_benchmark", "reviewer_notes")


def read_review_csv(spark: SparkSession, path: str) -> DataFrame:
    """A review file; a header that is not the expected one is an error. Spark drops a byte-order mark."""
    schema = ", ".join(f"{c} string" for c in REVIEW_COLUMNS)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"').csv(path)


def plain_document(paragraphs: DataFrame) -> DataFrame:
    """The paragraphs of each document in order, a blank line between them."""
    rows = paragraphs.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("paragraph_id", "text"))).alias("ps"))
    return rows.select("document_id", F.array_join(F.transform("ps", lambda p: p["text"]), "\n\n").alias("text"))


def markdown_rows(table: DataFrame) -> DataFrame:
    """A Markdown line a row: numbers with four decimals, a dash for null."""
    cell = lambda c, kind: F.when(F.col(c).isNull(), "—").otherwise(F.format_string("%.4f", F.col(c)) if kind in ("double", "float") else F.col(c).cast("string"))
    return table.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c, k) for c, k in table.dtypes]), F.lit(" |")).alias("line"))
