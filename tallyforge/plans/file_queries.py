"""Queries that write a table as files of a kind, read them back with the library's reader or after its sink, and give what was read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import mapping, reconcile as rc, records, tables as tb
from ..sources import readers, scratch, sinks
from .common import r6, registrar, table
from .page_queries import _drawn

QUERIES: dict = {}
ORACLES: dict = {}
register = registrar(QUERIES, ORACLES)


def _text(c):
    return F.col(c).cast("string")


def _files(spark, rows, label: str):
    """rows(name, order, line) as files: a file's lines in their order, each but the last with a line end."""
    return scratch.named_lines(rows, scratch.folder(spark, label))


def _parts(spark, sf_dir):
    """The instances' parts, parsed once and kept for the joins of facts with contexts and units."""
    readers.xbrl_parts(spark, _instances(spark, sf_dir)).write.parquet(path := scratch.folder(spark, "xbrl-parts"))
    return spark.read.parquet(path)


def _instances(spark, sf_dir):
    """Orders as XBRL instances, one for each of eight groups of customers: a fact an order, contexts and units beside them."""
    o = table(spark, sf_dir, "orders").select("*", (F.col("o_custkey") % 8).alias("g"), (F.col("o_orderkey") % 40).alias("c"))
    name = F.concat(F.lit("group"), F.col("g").cast("string"), F.when(F.col("g") % 2 == 0, ".xml").otherwise(".xbrl")).alias("name")
    concept = F.when(F.col("o_orderstatus") == "F", "Revenues").when(F.col("o_orderstatus") == "O", "Assets").otherwise("Liabilities")
    value = F.when(F.col("o_orderkey") % 13 == 0, "  ").when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("("), (F.col("o_custkey") + 1).cast("string"), F.lit(")"))).otherwise(F.concat(F.lit(" 1,"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0")))
    fact = F.concat(F.lit("<us-gaap:"), concept, F.lit(' contextRef="c'), _text("c"), F.when(F.col("c") == 7, "0").otherwise(""), F.lit('" unitRef="'), F.when(F.col("o_orderkey") % 2 == 0, "usd").otherwise("pure"), F.lit('" decimals="-2">'), value, F.lit("</us-gaap:"), concept, F.lit(">\n"))
    facts = o.select(name, (F.col("o_orderkey") + 100).alias("order"), fact.alias("line"))
    c = o.select("g", "c").distinct()
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int")).cast("string")
    period = F.when(F.col("c") % 3 == 0, F.concat(F.lit("<instant>"), day(F.col("c")), F.lit("</instant>"))).otherwise(F.concat(F.lit("<startDate>2024-01-01</startDate><endDate>"), day(F.col("c") + 30), F.lit("</endDate>")))
    segment = F.when(F.col("c") % 4 == 0, F.concat(F.lit('<segment><explicitMember dimension="axis">m'), _text("c"), F.lit("</explicitMember></segment>"))).otherwise("")
    context = F.concat(F.lit('<context id="c'), _text("c"), F.lit('"><entity><identifier scheme="x">e'), _text("g"), F.lit("</identifier>"), segment, F.lit("</entity><period>"), period, F.lit("</period></context>\n"))
    contexts = c.select(name, (F.col("c") + 1).cast("long").alias("order"), context.alias("line"))
    ends = o.select("g").distinct().select(name, F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("order"), F.lit('<xbrl xmlns="http://www.xbrl.org/2003/instance" xmlns:us-gaap="http://fasb.org/us-gaap/2023" xmlns:iso4217="http://www.xbrl.org/2003/iso4217"><unit id="usd"><measure>iso4217:USD</measure></unit><unit id="pure"><measure>pure</measure></unit>\n').alias("line")),
        F.struct(F.lit(1 << 60).alias("order"), F.lit("</xbrl>").alias("line")),
    )).alias("x")).select("name", "x.*")
    bad = spark.range(1).select(F.lit("broken.xml").alias("name"), F.lit(0).cast("long").alias("order"), F.lit("<xbrl><unclosed></xbrl>").alias("line"))
    return _files(spark, facts.unionByName(contexts).unionByName(ends).unionByName(bad), "xbrl")


_INSTANCES = """WITH o AS (SELECT *, o_custkey % 8 AS g, o_orderkey % 40 AS c FROM orders WHERE o_orderkey % 13 <> 0),
f AS (SELECT 'group' || g || CASE WHEN g % 2 = 0 THEN '.xml' ELSE '.xbrl' END AS source_file, CASE o_orderstatus WHEN 'F' THEN 'Revenues' WHEN 'O' THEN 'Assets' ELSE 'Liabilities' END AS concept, 'http://fasb.org/us-gaap/2023' AS namespace,
  CASE WHEN o_orderkey % 5 = 0 THEN '(' || (o_custkey + 1) || ')' ELSE '1,' || lpad((o_custkey % 1000)::VARCHAR, 3, '0') END AS value_text, CASE WHEN o_orderkey % 5 = 0 THEN -(o_custkey + 1) ELSE 1000 + o_custkey % 1000 END::DOUBLE AS numeric_value,
  'c' || c || CASE WHEN c = 7 THEN '0' ELSE '' END AS context_id, CASE WHEN o_orderkey % 2 = 0 THEN 'usd' ELSE 'pure' END AS unit, CASE WHEN o_orderkey % 2 = 0 THEN 'USD' END AS currency,
  CASE WHEN c = 7 THEN NULL WHEN c % 3 = 0 THEN 'instant' ELSE 'duration' END AS period_type, CASE WHEN c <> 7 AND c % 3 > 0 THEN DATE '2024-01-01' END AS start_date, CASE WHEN c <> 7 AND c % 3 > 0 THEN DATE '2024-01-31' + c::INT END AS end_date,
  CASE WHEN c <> 7 AND c % 3 = 0 THEN DATE '2024-01-01' + c::INT END AS instant_date, CASE WHEN c <> 7 AND c % 4 = 0 THEN 'axis=m' || c END AS segment, CASE WHEN c <> 7 THEN 'e' || g END AS entity FROM o)"""


@register(_INSTANCES + " SELECT * FROM f UNION ALL SELECT 'broken.xml', 'error' " + ", NULL" * 12)
def xbrl_facts(spark, sf_dir):
    """Facts with periods and currencies; one context is missing, and a broken file gives an error row."""
    parts = _parts(spark, sf_dir)
    found = readers.facts(parts).drop("precision", "decimals")
    bad = parts.where("kind = 'error'").select(F.col("file").alias("source_file"), F.col("kind").alias("concept"))
    return found.unionByName(bad, allowMissingColumns=True)


@register(_INSTANCES + """, r AS (SELECT source_file, concept, numeric_value, unit, period_type, start_date, end_date, instant_date, context_id, row_number() OVER (ORDER BY concept, end_date NULLS LAST, instant_date NULLS LAST) AS n FROM f WHERE regexp_matches(lower(concept), 'liabilities|assets'))
SELECT source_file, concept, numeric_value, unit, period_type, start_date, end_date, instant_date, context_id FROM r""")
def facts_saved(spark, sf_dir):
    """Relevant facts in their order as CSV, and back."""
    f = readers.facts(_parts(spark, sf_dir))
    f = f.where(rc.relevant(F.col("concept"), parts=("Liabilities", "Assets"))).select("context_id", "unit", "concept", "source_file", "numeric_value", "start_date", "end_date", "instant_date", "period_type")
    sinks.save_facts(f, path := scratch.folder(spark, "facts"))
    return spark.read.option("header", True).schema("source_file string, concept string, numeric_value double, unit string, period_type string, start_date date, end_date date, instant_date date, context_id string").csv(path)


@register("""
SELECT 'n' || c_nationkey AS doc_id, 'camelot_stream' AS method, (c_nationkey % 9 + 1)::INT AS page, c_nationkey::INT AS table_num, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INT AS row_idx, unnest([0, 1, 2]) AS col_idx, unnest(['Name', 'Note', 'Col_2']) AS header,
  unnest([c_name, 'says "' || c_mktsegment || '", or' || chr(10) || c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey::VARCHAR END]) AS value FROM customer
""")
def csv_tables(spark, sf_dir):
    """A CSV table a nation, with quotes, commas, line ends inside fields, empty fields and a column without a name; an index is left out."""
    c = table(spark, sf_dir, "customer")
    name = F.concat(F.lit("n"), _text("c_nationkey"), F.lit("_camelot_stream_p"), (F.col("c_nationkey") % 9 + 1).cast("string"), F.lit("_t"), _text("c_nationkey"), F.lit(".csv")).alias("name")
    line = F.concat("c_name", F.lit(',"says ""'), "c_mktsegment", F.lit('"", or\n'), _text("c_custkey"), F.lit('",'), F.when(F.col("c_custkey") % 2 == 0, _text("c_custkey")).otherwise(""), F.lit("\n"))
    rows = c.select(name, F.col("c_custkey").cast("long").alias("order"), line.alias("line")).unionByName(c.select(name).distinct().select("name", F.lit(-1).cast("long").alias("order"), F.lit("Name,Note\n").alias("line")))
    index = spark.range(1).select(F.lit("_index.csv").alias("name"), F.col("id").alias("order"), F.lit("a,b\n1,2\n").alias("line"))
    return readers.csv_cells(spark, _files(spark, rows.unionByName(index), "csv"))


@register("SELECT 'page_' || n_nationkey || '.txt' AS file, n_nationkey::INT AS page, string_agg(c_name || ' ' || c_mktsegment, chr(10) ORDER BY c_custkey) || chr(10) AS text, 2 * count(*)::INT AS word_count, (sum(length(c_name) + length(c_mktsegment) + 2))::INT AS char_count FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def page_text_files(spark, sf_dir):
    """S16."""
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.concat(F.lit("page_"), _text("c_nationkey"), F.lit(".txt")).alias("name"), F.col("c_custkey").cast("long").alias("order"), F.concat("c_name", F.lit(" "), "c_mktsegment", F.lit("\n")).alias("line"))
    other = spark.range(1).select(F.lit("notes.txt").alias("name"), F.col("id").alias("order"), F.lit("no page").alias("line"))
    return readers.page_texts(spark, _files(spark, rows.unionByName(other), "pages"))


@register("SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE source END AS section, 0.5 + (doc_id % 5) / 10.0::DOUBLE AS confidence, (doc_id % 3)::DOUBLE AS x1, CASE WHEN doc_id % 2 = 0 THEN doc_id::INT END AS table_id FROM documents WHERE doc_id % 7 <> 0")
def json_lines_read(spark, sf_dir):
    """Records as JSON lines with nested parts and nulls; blank and malformed lines are skipped."""
    d = table(spark, sf_dir, "documents")
    r = d.select(_text("doc_id").alias("doc_id"), F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("section"), (0.5 + F.col("doc_id") % 5 / 10).alias("confidence"), F.struct((F.col("doc_id") % 3).cast("double").alias("x1")).alias("bbox"), F.when(F.col("doc_id") % 2 == 0, F.struct(F.col("doc_id").cast("int").alias("table_id"))).alias("table_info"))
    sinks.save_json_lines(r.where("doc_id % 7 <> 0"), path := scratch.folder(spark, "jsonl"))
    d.where("doc_id % 7 = 0").select(F.when(F.col("doc_id") % 2 == 0, F.lit('{"doc_id": "x", "section')).otherwise("")).write.mode("append").text(path)
    return readers.json_lines(spark, path).select("doc_id", "section", "confidence", F.col("bbox.x1").alias("x1"), F.col("table_info.table_id").alias("table_id"))


def _ocr(spark, sf_dir):
    """A JSON document a nation; its customers stand on three pages, as paragraphs, lines or tokens, and in a table on each."""
    c = table(spark, sf_dir, "customer").withColumn("p", (F.col("c_custkey") % 3).cast("int"))
    cell = lambda v: F.struct(v.alias("text"))
    g = c.groupBy("c_nationkey", "p").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("xs"))
    parts = F.transform("xs", lambda x: F.struct(x["c_name"].alias("text")))
    rows = F.transform("xs", lambda x: F.array(cell(x["c_custkey"].cast("string")), cell(x["c_name"])))
    none = F.array().cast("array<struct<text:string>>")
    only = lambda n, name: F.when(F.col("p") == n, parts).otherwise(none).alias(name)
    tables = F.array(F.struct(F.array(F.array(cell(F.lit("Key")), cell(F.lit("Name")))).alias("header_rows"), rows.alias("body_rows"))).alias("tables")
    pages = g.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct((F.col("p") + 1).alias("page_number"), only(0, "paragraphs"), only(1, "lines"), only(2, "tokens"), tables))).alias("pages"))
    files = pages.select(F.concat(F.lit("n"), _text("c_nationkey"), F.lit(".json")).alias("name"), F.to_json(F.struct(F.concat(F.lit("n"), _text("c_nationkey")).alias("text"), "pages")).alias("text"))
    bad = spark.range(1).select(F.lit("bad.json").alias("name"), F.lit('{"text": ').alias("text"))
    return readers.json_documents(spark, scratch.named_files(files.unionByName(bad), scratch.folder(spark, "ocr")))


@register("SELECT 'n' || c_nationkey AS doc, (c_custkey % 3 + 1)::INT AS page, CASE WHEN c_custkey % 3 = 2 THEN string_agg(c_name, ' ' ORDER BY c_custkey) ELSE string_agg(c_name, chr(10) ORDER BY c_custkey) END AS text, count(*)::INT * (c_custkey % 3 = 0)::INT AS n_paragraphs, count(*)::INT * (c_custkey % 3 = 1)::INT AS n_lines, count(*)::INT * (c_custkey % 3 = 2)::INT AS n_tokens, 1 AS n_tables FROM customer GROUP BY c_nationkey, c_custkey % 3")
def ocr_page_texts(spark, sf_dir):
    """Paragraphs, else lines, else tokens; the broken document has no pages."""
    docs = _ocr(spark, sf_dir).withColumnRenamed("text", "doc")
    sinks.save_ocr(docs.select("doc", "pages", "entities", F.lit("").alias("text")), path := scratch.folder(spark, "ocr-out"), "doc")
    return spark.read.json(f"{path}/pages").select("doc", F.col("page").cast("int").alias("page"), "text", *[F.col(c).cast("int").alias(c) for c in ("n_paragraphs", "n_lines", "n_tokens", "n_tables")])


@register("""
WITH r AS (SELECT 'n' || c_nationkey AS doc, (c_custkey % 3 + 1)::INT AS page, row_number() OVER (PARTITION BY c_nationkey, c_custkey % 3 ORDER BY c_custkey) AS i, c_custkey::VARCHAR AS k, c_name AS n FROM customer),
a AS (SELECT * FROM r UNION ALL SELECT DISTINCT doc, page, 0, 'Key', 'Name' FROM r)
SELECT doc, page, 'p' || page || '_t1' AS table_id, i::INT AS row_idx, i = 0 AS is_header, unnest([0, 1]) AS col_idx, unnest([k, n]) AS value FROM a
""")
def ocr_table_cells(spark, sf_dir):
    """Header rows first."""
    return readers.ocr_cells(_ocr(spark, sf_dir).withColumnRenamed("text", "doc"), "doc")


@register("""
WITH c AS (SELECT c_nationkey, c_mktsegment, string_agg(c_name, chr(10) ORDER BY c_custkey) AS content FROM customer GROUP BY 1, 2),
s AS (SELECT 'n' || c_nationkey || '.md' AS file, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) + 1 AS section_number, c_mktsegment AS title, content FROM c)
SELECT file, section_number::INT AS section_number, title, content FROM s WHERE length(content) > 50
""")
def markdown_files(spark, sf_dir):
    """A file a nation, a section a market segment, sections of fifty characters at most left out."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x["c_name"]), "\n").alias("content"))
    md = c.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_mktsegment", "content"))), lambda x: F.concat(F.lit("\n## "), x["c_mktsegment"], F.lit("\n\n"), x["content"])), "\n").alias("t"))
    files = md.select(F.concat(F.lit("n"), _text("c_nationkey"), F.lit(".md")).alias("name"), F.concat(F.lit("# Customers\n"), "t").alias("text"))
    return readers.markdown_sections(spark, scratch.named_files(files, scratch.folder(spark, "md")))


@register("""
WITH p AS (SELECT conv_id AS doc_id, turn AS page, coalesce(text, '') AS text, role FROM conversations)
SELECT doc_id, string_agg('--- PAGE ' || page || ' ---' || chr(10) || text, chr(10) ORDER BY page, text) AS text, count(*) AS n_pages, count(*) FILTER (role = 'user') AS n_ocr FROM p GROUP BY 1
""")
def pages_saved(spark, sf_dir):
    """K1: combined texts and the log of recognised pages; conversations stand for documents."""
    p = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 16).alias("shelf"), F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text", (F.col("role") == "user").alias("needs_ocr"), F.lit("pdfplumber").alias("extraction_method"))
    sinks.save_pages(p.drop("shelf"), path := scratch.folder(spark, "pages-out"))
    log = spark.read.schema("doc_id long, n_pages long, n_ocr long").json(f"{path}/ocr_log")
    return spark.read.parquet(f"{path}/combined").join(log, "doc_id")


@register("SELECT p_type AS type, count(*) AS n, 'custom' AS kind FROM part GROUP BY 1 UNION ALL SELECT p_type, count(*), 'blocks' FROM part WHERE p_size > 25 GROUP BY 1")
def layout_saved(spark, sf_dir):
    """K3: blocks by document, and the count of each type."""
    b = table(spark, sf_dir, "part").select((F.col("p_size") % 10).alias("doc_id"), F.col("p_type").alias("type"), F.col("p_size").alias("size"))
    sinks.save_layout(b, path := scratch.folder(spark, "layout"))
    counts = spark.read.schema("type string, count long").json(f"{path}/counts").select("type", F.col("count").alias("n"), F.lit("custom").alias("kind"))
    blocks = spark.read.schema("type string, size int, doc_id int").json(f"{path}/blocks").where("size > 25").groupBy("type").agg(F.count("*").alias("n"))
    return counts.unionByName(blocks.withColumn("kind", F.lit("blocks")))


@register("SELECT l_returnflag AS method, count(*) AS n_tables, round(avg(l_quantity), 6) AS avg_quality, count(DISTINCT l_linenumber) AS page_coverage, count(*) AS in_index FROM lineitem GROUP BY 1")
def tables_saved(spark, sf_dir):
    """K2: the index in its order as CSV, and the methods' summary as JSON."""
    li = table(spark, sf_dir, "lineitem")
    index = li.select(F.concat("l_shipdate", F.lit("_"), _text("l_orderkey")).alias("filename"), F.col("l_returnflag").alias("method"), F.col("l_linenumber").alias("page"), F.lit(2).alias("rows"), F.lit(2).alias("cols"), F.lit(None).cast("double").alias("accuracy"), F.col("l_quantity").cast("double").alias("content_quality"), F.lit(0).alias("financial_score"))
    sinks.save_tables(li.select((F.col("l_orderkey") % 8).alias("doc_id"), "l_quantity"), index, path := scratch.folder(spark, "tables"))
    lines = spark.read.option("header", True).csv(f"{path}/index").groupBy("method").agg(F.count("*").alias("in_index"))
    found = spark.read.schema("method string, n_tables long, avg_quality double, page_coverage long").json(f"{path}/analysis")
    return found.join(lines, "method").select("method", "n_tables", r6("avg_quality").alias("avg_quality"), "page_coverage", "in_index")


@register("SELECT 'now' AS session_id, o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 2 UNION ALL SELECT 'then', o_orderstatus, count(*) FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 2")
def sessions_saved(spark, sf_dir):
    """K7, K8: two sessions; the second run of one replaces its rows only."""
    o, path = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), scratch.folder(spark, "sessions")
    for session, rows in (("now", o), ("then", o.where("o_orderkey % 3 = 0")), ("now", o.where("o_orderkey % 2 = 0"))):
        sinks.save_session({"details": rows}, path, session)
    return spark.read.parquet(f"{path}/details").groupBy("session_id", F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@register("SELECT doc_id, length(text)::INT AS markdown_length, length(source)::INT AS text_length, (doc_id % 3)::BIGINT AS n_tables, substr(text, 1, 500) AS preview FROM documents WHERE doc_id % 5 = 0 AND text IS NOT NULL")
def structure_saved(spark, sf_dir):
    """The summary of converted documents, of every fifth one as a set of its own."""
    d = table(spark, sf_dir, "documents").where("doc_id % 5 = 0 AND text IS NOT NULL")
    docs = d.select("doc_id", F.col("text").alias("markdown"), F.col("source").alias("text"))
    tables = d.where("doc_id % 3 > 0").select("doc_id", F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 3).cast("int"))).alias("table_num"), F.lit(2).alias("rows"), F.lit(3).alias("cols"))
    s = records.structure_summary(docs, tables)
    sinks.save_suite(s.withColumn("report_content", F.lit("long")), path := scratch.folder(spark, "structure"))
    back = spark.read.json(path)
    assert "report_content" not in back.columns
    return back.select("doc_id", F.col("markdown_length").cast("int").alias("markdown_length"), F.col("text_length").cast("int").alias("text_length"), "n_tables", "preview")


@register("SELECT o_custkey AS metric, count(*) AS n, max(o_orderdate) AS last FROM orders GROUP BY 1")
def history_appended(spark, sf_dir):
    """A history in two runs, each appended."""
    o, path = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), scratch.folder(spark, "history")
    for part in (o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 <> 0")):
        sinks.append_run(part, path)
    return spark.read.parquet(path).groupBy(F.col("o_custkey").alias("metric")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last"))


@register("""
SELECT l_orderkey::VARCHAR AS doc_id, 'Page 1' AS section, 'diagram' AS block_type, (6 * count(*) + 2 + count(*) FILTER (l_suppkey % 3 <> 0) + count(*) FILTER (opens))::INT AS kept FROM (SELECT *, l_partkey % 5 <> 0 OR row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) = 1 AS opens FROM lineitem) GROUP BY l_orderkey
""")
def drawn_objects(spark, sf_dir):
    """How many lines each page holds."""
    _, objects = _drawn(spark, sf_dir)
    r = records.object_records(objects)
    return r.select(_text("doc_id").alias("doc_id"), "section", "block_type", F.regexp_extract("text", "^([0-9]+) line$", 1).cast("int").alias("kept"))


@register("SELECT p_partkey, CASE WHEN contains(p_name, split_part(p_name, ' ', 2)) THEN 90.0 ELSE 0.0 END::DOUBLE AS own, CASE WHEN contains(p_name, 'ring') THEN 90.0 ELSE 0.0 END::DOUBLE AS ring, 0.0::DOUBLE AS blank FROM part")
def contain_scores(spark, sf_dir):
    """T4."""
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", mapping.contain_score(n, F.split_part(n, F.lit(" "), F.lit(2))).alias("own"), mapping.contain_score(F.lit("ring"), n).alias("ring"), mapping.contain_score(F.lit(""), n).alias("blank"))


@register("SELECT p_partkey, CASE WHEN p_size > 14 THEN 'heading' WHEN p_size > 12 THEN 'subheading' ELSE 'paragraph' END AS block_type FROM part")
def block_classify_sized(spark, sf_dir):
    """The size of the type decides first."""
    return table(spark, sf_dir, "part").select("p_partkey", tx.classify(F.col("p_name"), font_size=F.col("p_size").cast("double")).alias("block_type"))


@register("SELECT p_partkey, array_to_string(list_slice(list_concat(['a', p_name, 'b', 'c'], ['', '', '']), 1, 3), '|') AS long_row, array_to_string([p_name, '', ''], '|') AS short_row FROM part")
def cell_rows_fitted(spark, sf_dir):
    """P22."""
    heads = F.array(F.lit("x"), F.lit("y"), F.lit("z"))
    row = F.array(F.lit("a"), F.col("p_name"), F.lit("b"), F.lit("c"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(records.fit_width(row, heads), "|").alias("long_row"), F.array_join(records.fit_width(F.array("p_name"), heads), "|").alias("short_row"))


@register("SELECT conv_id, turn, role FROM conversations WHERE turn IN (1, 2)")
def page_subset_read(spark, sf_dir):
    """Named pages; turns stand for pages."""
    return readers.page_subset(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), [1, 2], page="turn")
