"""Sources: page texts, JSON lines, CSV tables as cells, XBRL instances, OCR documents, markdown.

Rendering of PDF pages, optical recognition and layout models are outside this library; what they give is read here.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions import text as tx

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A quote opens a quoted part at the start of a field only; line ends inside it belong to the field. Possessive throughout: no
# part is tried again, so long fields need no deep stack.
CSV_QUOTED = r'"([^"]*+(?:""[^"]*+)*+)"'
CSV_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"[^,\r\n]*+|[^,\r\n]*+)'
CSV_RECORD = rf"{CSV_FIELD}(?:,{CSV_FIELD})*+"


def _files(spark: SparkSession, path: str, glob: str, recursive: bool = True) -> DataFrame:
    """(file, text) of each file, whole."""
    r = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", recursive)
    return r.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("n_bytes"), F.col("value").alias("text"))


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    """page_*.txt files; the page number comes from the name."""
    f = _files(spark, path, "page_*.txt")
    return f.select("file", F.regexp_extract("file", r"page_([0-9]+)", 1).try_cast("int").alias("page"), "text", tx.n_words(F.col("text")).alias("word_count"), F.length("text").alias("char_count"))


def json_lines(spark: SparkSession, path: str, schema: str = schemas.RECORDS) -> DataFrame:
    """Blank and malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_documents(spark: SparkSession, path: str, schema: str = schemas.OCR_DOCUMENTS) -> DataFrame:
    """One JSON document a file; what cannot be parsed stands in _corrupt_record."""
    return spark.read.schema(schema + ", _corrupt_record STRING").option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """Every CSV table under ``path`` as long cells; files named with a leading underscore are indexes, not tables."""
    f = _files(spark, path, "*.csv").where(~F.col("file").startswith("_"))
    lines = f.select("file", F.posexplode(F.filter(F.regexp_extract_all("text", F.lit(CSV_RECORD), F.lit(0)), lambda x: x != "")).alias("line", "raw"))
    fields = F.transform(F.regexp_extract_all(F.concat(F.lit(","), "raw"), F.lit(rf",({CSV_FIELD})"), F.lit(1)), lambda x: F.when(x.startswith('"'), F.regexp_replace(F.regexp_replace(x, f"^{CSV_QUOTED}", "$1"), '""', '"')).otherwise(x))
    lines = lines.select("file", "line", fields.alias("fields"))
    heads = lines.where("line = 0").select("file", F.col("fields").alias("heads"))
    body = lines.where("line > 0").join(heads, "file").select("file", (F.col("line") - 1).alias("row_idx"), "heads", F.posexplode("fields").alias("col_idx", "value"))
    return named_cells(body.withColumn("header", F.coalesce(F.try_element_at("heads", F.col("col_idx") + 1), F.concat(F.lit("Col_"), F.col("col_idx").cast("string")))))


def excel_cells(spark: SparkSession, path: str) -> DataFrame:
    """First sheet of each workbook as cells, with the columns of ``csv_cells``. Needs an Excel reader for pandas on the workers."""
    def run(frames):
        import io

        import pandas as pd

        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                t = pd.read_excel(io.BytesIO(content), header=0, dtype=str)
                long = t.reset_index(drop=True).melt(ignore_index=False).reset_index()
                yield pd.DataFrame({"doc_id": name.rsplit("/", 1)[-1], "row_idx": long["index"].astype("int32"), "col_idx": long["variable"].map({c: i for i, c in enumerate(t.columns)}).astype("int32"), "header": long["variable"].astype(str), "value": long["value"]})

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.xls*").option("recursiveFileLookup", True).load(path).mapInPandas(run, "doc_id string, row_idx int, col_idx int, header string, value string")
    return named_cells(found.withColumnRenamed("doc_id", "file"))


def named_cells(cells: DataFrame) -> DataFrame:
    """(file, row_idx, col_idx, header, value) to cells with doc_id, method, page and table_num from the file's name."""
    at = tx.table_file(F.col("file"))
    name = F.regexp_replace("file", r"(_(camelot_lattice|camelot_stream|pdfplumber)_p[0-9]+_t[0-9]+)?\.(csv|xls[a-z]*)$", "")
    return cells.select(name.alias("doc_id"), at["method"].alias("method"), at["page"].alias("page"), at["table_id"].alias("table_num"), "row_idx", "col_idx", "header", F.nullif("value", F.lit("")).alias("value"))


def _xbrl_row(e, name: str) -> tuple | None:
    """What an element that has ended says: a context, a unit, a fact or nothing."""
    local = lambda x: x.tag.rsplit("}", 1)[-1]
    kind = local(e)
    if kind == "context":
        got = {local(x): (x.text or "").strip() for x in e.iter()}
        seg = ";".join((x.get("dimension") or "") + "=" + (x.text or "").strip() for x in e.iter() if local(x) in ("explicitMember", "typedMember"))
        return ("context", name, e.get("id"), None, None, None, None, None, got.get("startDate") or None, got.get("endDate") or None, got.get("instant") or None, seg or None, got.get("identifier"))
    if kind == "unit":
        return ("unit", name, e.get("id"), None, next(((x.text or "").strip() for x in e.iter() if local(x) == "measure"), None), *[None] * 8)
    if e.get("contextRef") and (e.text or "").strip():
        space = e.tag[1:].split("}")[0] if e.tag.startswith("{") else ""
        return ("fact", name, e.get("contextRef"), kind, e.text.strip(), space, e.get("unitRef"), e.get("decimals"), *[None] * 5)
    return None


def _walk_xbrl(name: str, pieces, some: int = 5_000):
    """Lists of the rows of one instance, which comes as pieces of text in order; of a bad file only one row of kind ``error``.

    Elements go when they end, unless a context or unit around them is open; rows wait in a temporary file until the instance has ended well. So what is held
    in memory does not grow with the file.
    """
    import pickle
    import tempfile
    import xml.etree.ElementTree as ET

    parser, path, around, rows = ET.XMLPullParser(("start", "end")), [], 0, []

    def take():
        nonlocal around
        for event, e in parser.read_events():
            bound = e.tag.rsplit("}", 1)[-1] in ("context", "unit")
            if event == "start":
                path.append(e)
                around += bound
                continue
            path.pop()
            around -= bound
            if (row := _xbrl_row(e, name)) is not None:
                rows.append(row)
            if not around:
                del e[:]
                if path:
                    del path[-1][:]

    with tempfile.TemporaryFile() as kept:
        try:
            for piece in pieces:
                if "<!DOCTYPE" in piece or "<!ENTITY" in piece:  # entities may expand without bound
                    raise ET.ParseError("a document type is not accepted")
                parser.feed(piece)
                take()
                if len(rows) >= some:
                    pickle.dump(rows, kept)
                    rows.clear()
            parser.close()
            take()
        except ET.ParseError as e:
            yield [("error", name, None, None, str(e), *[None] * 8)]
            return
        last = kept.tell()
        kept.seek(0)
        while kept.tell() < last:
            yield pickle.load(kept)
        if rows:
            yield rows


def xbrl_parts(spark: SparkSession, path: str, glob: str = "*.x*") -> DataFrame:
    """Facts, contexts and units of each instance file as rows; a bad file gives one row of kind ``error``.

    A file's lines come to one worker in their order and are parsed as they come; no file is held whole. Spark leaves empty files out.
    """
    def run(frames):
        import itertools

        import pandas as pd

        names = ["kind", "file", "id", "name", "value", "namespace", "unit", "decimals", "start", "end", "instant", "segment", "entity"]
        stretches = ((k, "".join(v + "\n" for v in g["text"])) for frame in frames for k, g in frame.groupby("file_path", sort=False))
        for at, own in itertools.groupby(stretches, lambda x: x[0]):
            for rows in _walk_xbrl(at.rsplit("/", 1)[-1], (piece for _, piece in own)):
                yield pd.DataFrame(rows, columns=names)

    read = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path)
    # within a stretch of a file rows are read in order, so their ids ascend
    lines = read.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("i"), F.col("value").alias("text"))
    dealt = lines.repartition("file_path").sortWithinPartitions("file_path", "start", "i").select("file_path", "text")
    return dealt.mapInPandas(run, "kind string, file string, id string, name string, value string, namespace string, unit string, decimals string, start string, `end` string, instant string, segment string, entity string")


def facts(parts: DataFrame) -> DataFrame:
    """Facts joined with their contexts' periods and their units' currency; schema FACTS."""
    from ..functions.numeric import parse_signed

    c = parts.where("kind = 'context'").select("file", F.col("id").alias("context_id"), F.col("start").try_cast("date").alias("start_date"), F.col("end").try_cast("date").alias("end_date"), F.col("instant").try_cast("date").alias("instant_date"), F.col("segment").alias("segment"), F.col("entity").alias("entity"))
    u = parts.where("kind = 'unit'").select("file", F.col("id").alias("unit"), F.when(F.lower("value").contains("iso4217"), F.regexp_extract("value", "([A-Z]{3})$", 1)).alias("currency"))
    f = parts.where("kind = 'fact'").select(F.col("file"), F.col("name").alias("concept"), "namespace", F.col("value").alias("value_text"), parse_signed(F.col("value")).alias("numeric_value"), F.col("id").alias("context_id"), "unit", "decimals")
    j = f.join(c, ["file", "context_id"], "left").join(u, ["file", "unit"], "left")
    period = F.when(F.col("instant_date").isNotNull(), "instant").when(F.col("start_date").isNotNull() & F.col("end_date").isNotNull(), "duration")
    return j.select(F.col("file").alias("source_file"), "concept", "namespace", "value_text", "numeric_value", "context_id", "unit", "currency", "decimals", F.lit(None).cast("string").alias("precision"), period.alias("period_type"), "start_date", "end_date", "instant_date", "segment", "entity")


def markdown_sections(spark: SparkSession, path: str, level: int = 2, least: int = 50) -> DataFrame:
    """Sections of each markdown file above ``least`` characters, numbered."""
    s = _files(spark, path, "*.md").select("file", F.posexplode(tx.sections(F.col("text"), level)).alias("i", "s"))
    return s.where(F.length("s.content") > least).select("file", (F.col("i") + 1).alias("section_number"), F.col("s.title").alias("title"), F.col("s.content").alias("content"))


def ocr_pages(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per page its text (paragraphs, else lines, else tokens) and how many parts it has."""
    p = docs.select(key, F.explode("pages").alias("p"))
    joined = lambda c, sep: F.nullif(tx.strip(F.array_join(F.transform(f"p.{c}", lambda x: x["text"]), sep)), F.lit(""))
    n = lambda c: F.greatest(F.size(f"p.{c}"), F.lit(0)).alias(f"n_{c}")
    return p.select(key, F.col("p.page_number").alias("page"), F.coalesce(joined("paragraphs", "\n"), joined("lines", "\n"), joined("tokens", " "), F.lit("")).alias("text"), *map(n, ("blocks", "paragraphs", "lines", "tokens", "tables", "form_fields")))


def ocr_cells(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tables of OCR documents as cells, header rows first; ids are p{page}_t{table}."""
    t = docs.select(key, F.explode("pages").alias("p")).select(key, F.col("p.page_number").alias("page"), F.posexplode("p.tables").alias("i", "t"))
    rows = t.select(key, "page", F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("_t"), (F.col("i") + 1).cast("string")).alias("table_id"), F.size("t.header_rows").alias("n_head"), F.posexplode(F.concat("t.header_rows", "t.body_rows")).alias("row_idx", "cells"))
    return rows.select(key, "page", "table_id", "row_idx", (F.col("row_idx") < F.col("n_head")).alias("is_header"), F.posexplode("cells").alias("col_idx", "c")).select(key, "page", "table_id", "row_idx", "is_header", "col_idx", F.col("c.text").alias("value"))


def ocr_forms(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.select(key, F.explode("pages").alias("p")).select(key, F.col("p.page_number").alias("page"), F.explode("p.form_fields").alias("f")).select(key, "page", "f.field_name", "f.field_value")


def ocr_entities(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.select(key, F.explode("entities").alias("e")).select(key, "e.type", "e.mention_text", "e.normalized_value", "e.confidence", F.transform("e.page_refs", lambda r: r["page"]).alias("pages"))


def page_subset(pages: DataFrame, wanted: list[int] | None = None, n: int | None = None, seed: int = 0, page: str = "page") -> DataFrame:
    """The named pages of one document, or ``n`` of them drawn by hash. Pages out of range, and more than there are, raise."""
    last, total = pages.agg(F.coalesce(F.max(page), F.lit(0)), F.countDistinct(page)).first()
    if wanted is not None:
        bad = [p for p in wanted if not 1 <= p <= last]
        if bad:
            raise ValueError(f"pages go from 1 to {last}: {bad}")
        return pages.where(F.col(page).isin(*wanted))
    if (n or 0) > total:
        raise ValueError(f"{n} pages of {total}")
    return pages.orderBy(F.xxhash64(page, F.lit(seed)), page).limit(n or 0)


def existing_only(index: DataFrame, files: DataFrame, name: str = "filename") -> DataFrame:
    """Rows of ``index`` whose file is among ``files`` (file)."""
    return index.join(files.select(F.col("file").alias(name)).distinct(), name, "left_semi")


def page_info(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Name and size in megabytes of each file under ``path``; contents are not read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("file"), (F.col("length") / (1024 * 1024)).alias("size_mb"), F.col("modificationTime").alias("modified"))


def page_counts(pages: DataFrame) -> DataFrame:
    """How many pages each document has, and its full text in page order."""
    own = F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("t"))))
    return pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.array_join(F.transform(own, lambda x: x["t"]), "\n").alias("text"))


def newest(files: DataFrame, by: str = "modified", n: int = 1) -> DataFrame:
    """The ``n`` most recent files; of equal times the later name."""
    return files.orderBy(F.desc(by), F.desc("file")).limit(n)
