"""Metadata records: builders, validation, completeness, format fan-out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..functions.text import document_attributes, strip, truncate
from . import tables as tb

# The block types and extraction methods that records may have, and the fields that each must have.
BLOCK_TYPES = (
    "paragraph", "heading", "subheading", "header", "footer", "caption", "footnote", "text_block", "structured_content", "table", "table_header", "table_cell", "list", "list_item", "image", "chart",
    "diagram", "signature", "logo", "column", "text_region", "layout_block", "form_field", "checkbox", "barcode", "qr_code", "ai_analysis", "docling_section", "google_ai_entity", "unknown",
)
METHODS = (
    "pdfplumber_text", "pypdf_text", "docling_text", "google_ai_text", "camelot_stream", "camelot_lattice", "pdfplumber_table", "tabula", "hybrid_table_extraction_camelot_stream", "hybrid_table_extraction_pdfplumber",
    "layout_detection", "google_ai_layout", "docling_layout", "docling_ai_analysis", "docling_markdown_extraction", "google_document_ai", "openai_analysis", "hybrid_extraction", "unified_extraction", "multi_method_extraction", "manual_extraction", "unknown_method",
)
REQUIRED = ("doc_id", "company", "fiscal_year", "source_path", "extraction_timestamp", "page", "section", "block_type", "text", "extraction_method")


def text_records(df: DataFrame, doc_id, page, text, block_type, method: str, confidence: float = 0.9, section=None) -> DataFrame:
    """Records of any text-bearing frame; texts of white space only give none. ``completed`` adds the other columns."""
    page, text = F.col(page) if isinstance(page, str) else page, F.col(text) if isinstance(text, str) else text
    section = F.concat(F.lit("Page "), page.cast("string")) if section is None else section
    return df.where(strip(text) != "").select(
        F.col(doc_id).cast("string").alias("doc_id"), page.cast("int").alias("page"), section.alias("section"), (F.lit(block_type) if isinstance(block_type, str) else block_type).alias("block_type"),
        text.alias("text"), F.lit(method).alias("extraction_method"), F.lit(confidence).alias("confidence"),
    )


def word_records(words: DataFrame) -> DataFrame:
    """A record a word, in (top, x0) order."""
    seq = F.row_number().over(W.partitionBy("doc_id", "page").orderBy("top", "x0", "word_idx"))
    return words.select("doc_id", "page", seq.alias("seq"), "text", F.lit("text_block").alias("block_type"), F.struct(F.col("x0").alias("x1"), F.col("top").alias("y1"), F.col("x1").alias("x2"), F.col("bottom").alias("y2")).alias("bbox"))


def block_records(layout: DataFrame) -> DataFrame:
    """pages(doc_id, page_num, blocks[]) to a record a block; a missing confidence is 0.8."""
    b = layout.select("doc_id", "page_num", F.explode("blocks").alias("b"))
    return b.select("doc_id", F.col("page_num").alias("page"), F.lower("b.type").alias("block_type"), "b.text", F.coalesce("b.confidence", F.lit(0.8)).alias("confidence"), F.col("b.bounding_box").alias("bbox"))


def union(*frames: DataFrame) -> DataFrame:
    """U1."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def completed(records: DataFrame, documents: DataFrame | None, extracted_at) -> DataFrame:
    """``records`` with all columns of the record schema, those they lack as nulls.

    documents(doc_id, company, fiscal_year, source_path) gives what holds for a whole document; where it is None, that is read from
    the document's name. ``extracted_at``: a timestamp, or a column.
    """
    own = ["company", "fiscal_year", "source_path"]
    base = records.drop(*own)
    if documents is None:
        at = document_attributes(F.col("doc_id"), [])
        base = base.withColumns({"company": at["company"], "fiscal_year": at["fiscal_year"], "source_path": F.col("doc_id")})
    else:
        one = documents.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(*[F.min(c).alias(c) for c in own])
        base = base.join(one, "doc_id", "left")
    base = base.withColumn("extraction_timestamp", F.lit(extracted_at).cast("timestamp"))

    def column(f):
        if f.name not in base.columns:
            return F.lit(None).cast(f.dataType).alias(f.name)
        if not isinstance(f.dataType, StructType):
            return F.col(f.name).cast(f.dataType).alias(f.name)
        have = base.schema[f.name].dataType.names
        parts = [(F.col(f.name)[x.name] if x.name in have else F.lit(None)).cast(x.dataType).alias(x.name) for x in f.dataType.fields]
        return F.when(F.col(f.name).isNotNull(), F.struct(*parts)).alias(f.name)

    return base.select(*map(column, StructType.fromDDL(schemas.RECORDS).fields))


def errors(types=BLOCK_TYPES, required=REQUIRED):
    """the array of what is wrong with a record; empty if nothing is. A page of 0 counts as missing, as an empty text does."""
    blank = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == ("0" if c == "page" else ""))
    return F.filter(
        F.array(
            *[F.when(blank(c), f"missing {c}") for c in required],
            F.when(F.col("confidence").isNotNull() & ~F.col("confidence").between(0, 1), "bad confidence"), F.when(F.col("block_type").isNull() | ~F.col("block_type").isin(*types), "bad block type"),
        ),
        lambda x: x.isNotNull(),
    )


def completeness(records: DataFrame, by: list[str]) -> DataFrame:
    """Pages, types and methods, coverage flags, score."""
    t = F.col("block_type")
    has = lambda *ts: F.max(t.isin(*ts))
    return records.groupBy(*by).agg(
        F.count("*").alias("n_records"), F.countDistinct("page").alias("n_pages"), F.countDistinct("block_type").alias("n_types"), F.countDistinct("extraction_method").alias("n_methods"),
        has("paragraph", "text_block").alias("has_text"), has("table").alias("has_tables"), has("heading", "subheading").alias("has_headings"), has("image", "chart", "diagram").alias("has_images"),
    ).withColumn("complete", F.col("has_text") & F.col("has_tables") & F.col("has_headings")).withColumn("score", F.least(F.lit(1.0), F.col("n_types") / 8))


def type_counts(records: DataFrame, by: list[str]) -> DataFrame:
    return records.groupBy(*by, "block_type").agg(F.count("*").alias("n"))


def as_json(df: DataFrame, out: str = "json") -> DataFrame:
    """One JSON object a row, nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(out))


def from_json(df: DataFrame, schema: str, col: str = "json") -> DataFrame:
    """Back, with every nested part."""
    return df.select(F.from_json(col, schema).alias("r")).select("r.*")


def fan_out(records: DataFrame, order: list) -> DataFrame:
    """K5: (seq, jsonl, markdown, plain) of each record; blank texts have no markdown, but count. Numbered within each document."""
    n = records.withColumn("seq", F.row_number().over(W.partitionBy("doc_id").orderBy(*order)))
    return n.select("seq", F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("jsonl"), F.when(strip(F.col("text")) != "", F.concat(F.lit("## Record "), F.col("seq").cast("string"), F.lit("\n\n"), "text")).alias("markdown"), F.col("text").alias("plain"))


def fit_width(row, headers):
    """A row of cells padded or cut to the headers' width."""
    n = F.size(headers)
    return F.slice(F.concat(row, F.array_repeat(F.lit(""), n)), 1, n)


def table_records(cells: DataFrame, confidence: float = 0.85) -> DataFrame:
    """P25: a record a table, its text rendered (P17) and its shape beside it."""
    shape = cells.groupBy(*tb.TABLE).agg(F.countDistinct("row_idx").cast("int").alias("rows"), F.countDistinct("col_idx").cast("int").alias("cols"), F.max(F.col("header").isNotNull()).alias("has_headers"))
    t = tb.render(cells).join(shape, tb.TABLE)
    info = F.struct("rows", "cols", F.col("table_num").alias("table_id"), F.col("method").alias("extraction_method"), "has_headers").alias("table_info")
    return t.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("page").cast("int").alias("page"), F.concat(F.lit("Table "), F.col("table_num").cast("string")).alias("section"), F.lit("table").alias("block_type"), "text", F.col("method").alias("extraction_method"), F.lit(confidence).alias("confidence"), info)


def section_records(sections: DataFrame, confidence: float = 0.9, limit: int = 1500) -> DataFrame:
    """sections(doc_id, section_number, title, content) to records; the ordinal stands for the page, long contents are cut."""
    info = F.struct("title", F.length("content").cast("int").alias("content_length"), F.col("section_number").cast("int").alias("section_number")).alias("section_info")
    return sections.where(F.length("content") > 50).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("section_number").cast("int").alias("page"), F.coalesce("title", F.lit("Introduction")).alias("section"), F.lit("docling_section").alias("block_type"), truncate(F.col("content"), limit).alias("text"), F.lit("docling_markdown_extraction").alias("extraction_method"), F.lit(confidence).alias("confidence"), info)


def analysis_records(docs: DataFrame, model: str, confidence: float = 0.9, preview: int = 1500) -> DataFrame:
    """docs(doc_id, markdown) to one summary row a document: how long its text is, how many headings, and its beginning."""
    n = F.regexp_count(F.concat(F.lit("\n"), F.col("markdown")), F.lit("\n#"))
    text = F.concat(F.lit("Document of "), F.length("markdown").cast("string"), F.lit(" characters and "), n.cast("string"), F.lit(" headings: "), truncate(F.col("markdown"), preview))
    return docs.where(strip(F.col("markdown")) != "").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page"), F.lit("Document Analysis").alias("section"), F.lit("ai_analysis").alias("block_type"), text.alias("text"), F.lit("docling_ai_analysis").alias("extraction_method"), F.lit(confidence).alias("confidence"), F.struct(F.lit(model).alias("model_name"), F.lit("structure").alias("analysis_type"), F.array().cast("array<string>").alias("entities_detected"), F.lit(None).cast("double").alias("sentiment_score"), F.array().cast("array<string>").alias("topics")).alias("ai_analysis"))


def object_records(objects: DataFrame) -> DataFrame:
    """Drawn objects (doc_id, page, kind, x0, top, x1, bottom) to a record a page and kind: how many, and the box around them."""
    g = objects.groupBy("doc_id", "page", "kind").agg(F.count("*").alias("n"), F.struct(F.min("x0").alias("x1"), F.min("top").alias("y1"), F.max("x1").alias("x2"), F.max("bottom").alias("y2")).alias("bbox"))
    return g.select("doc_id", "page", F.concat(F.lit("Page "), F.col("page").cast("string")).alias("section"), F.when(F.col("kind") == "image", "image").otherwise("diagram").alias("block_type"), F.concat(F.col("n").cast("string"), F.lit(" "), "kind").alias("text"), F.lit("layout_detection").alias("extraction_method"), F.lit(0.9).alias("confidence"), "bbox")


def page_totals(records: DataFrame, by: list[str]) -> DataFrame:
    """Characters of text and number of tables by page."""
    return records.groupBy(*by).agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("text_length"), F.count_if(F.col("block_type") == "table").alias("n_tables"))


def structure_summary(docs: DataFrame, tables: DataFrame, preview: int = 500) -> DataFrame:
    """docs(doc_id, markdown, text) and their tables(doc_id, table_num, rows, cols): lengths, tables' shapes, a preview."""
    shapes = tables.groupBy("doc_id").agg(F.count("*").alias("n_tables"), F.array_sort(F.collect_list(F.struct("table_num", "rows", "cols"))).alias("shapes"))
    none = F.lit(0).cast("long")
    return docs.join(shapes, "doc_id", "left").select("doc_id", F.length("markdown").alias("markdown_length"), F.length("text").alias("text_length"), F.coalesce("n_tables", none).alias("n_tables"), "shapes", F.substring("markdown", 1, preview).alias("preview"))


def layout_counts(ocr: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pages of a nested OCR document, and which kinds of parts it has."""
    size = lambda c: F.greatest(F.size(c), F.lit(0))
    total = lambda part: F.aggregate(F.coalesce("pages", F.array()), F.lit(0), lambda n, p: n + size(p[part])).alias(f"n_{part}")
    has = lambda part: F.coalesce(F.exists("pages", lambda p: size(p[part]) > 0), F.lit(False)).alias(f"has_{part}")
    return ocr.select(key, size(F.col("pages")).alias("n_pages"), F.length(F.coalesce("text", F.lit(""))).alias("text_length"), *[total(p) for p in ("blocks", "paragraphs", "lines", "tables", "form_fields")], has("tables"), has("form_fields"), size(F.col("entities")).alias("n_entities"))
