"""Queries over facts, labels, files' names, records and runs whose operators no other query reaches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as nm, text as tx
from ..operators import bench, layout, mapping, monitor as mo, quality, reconcile as rc, records as rec, tables as tb
from ..sources import readers
from .common import r6, registrar, table

QUERIES: dict = {}
ORACLES: dict = {}
register = registrar(QUERIES, ORACLES)
_S = f"'{tx.WHITE}'"


_NAMES = ("Liabilities", "Goodwill", "PropertyPlantAndEquipmentNet", "IntangibleAssetsNetExcludingGoodwill", "EntityRegistrantName", "DeferredRevenueNoncurrent", "RESEARCHANDDEVELOPMENTEXPENSE", "DocumentType", "CommonStockValue", "InterestPaidNet")
#: Those of them that F2 keeps, as the rule's own two lists give them.
_KEPT = (0, 1, 2, 3, 5, 6)


@register(f"SELECT p_partkey, p_name IN ('red widget', 'blue bolt') AS exact, p_partkey % {len(_NAMES)} IN {_KEPT} AS part FROM part")
def relevant_concepts(spark, sf_dir):
    """F1 by names, F2 by concepts dealt over the parts."""
    n = F.col("p_name")
    concept = F.get(F.array(*map(F.lit, _NAMES)), F.col("p_partkey").cast("int") % len(_NAMES))
    return table(spark, sf_dir, "part").select("p_partkey", rc.relevant(n, exact=["red widget", "blue bolt"]).alias("exact"), rc.relevant(concept).alias("part"))


_TERMS = "t AS (SELECT lower(n_name) AS term, 'nation' AS concept FROM nation UNION SELECT lower(r_name), 'region' FROM region)"


@register(f"""
WITH {_TERMS}, l AS (SELECT c_custkey AS label, lower(CASE WHEN c_custkey % 3 = 0 THEN n_name WHEN c_custkey % 3 = 1 THEN n_name || 's' ELSE c_mktsegment END) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey),
x AS (SELECT lower(n_name) AS c, 'rule' AS concept FROM nation WHERE n_nationkey % 2 = 0),
s AS (SELECT c, term, concept, 100.0 * (1 - levenshtein(c, term)::DOUBLE / greatest(length(c), length(term))) AS k FROM (SELECT DISTINCT c FROM l WHERE c NOT IN (SELECT c FROM x)), t),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY k DESC, term, concept) AS r FROM s WHERE k >= 80) WHERE r = 1)
SELECT label, coalesce(x.concept, b.concept) AS concept, round(CASE WHEN x.concept IS NOT NULL THEN 100.0 ELSE coalesce(k, 0) END, 6)::DOUBLE AS confidence, CASE WHEN x.concept IS NOT NULL THEN 'exact' WHEN b.concept IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS method,
  coalesce(x.concept, b.concept) IS NOT NULL AS mapped FROM l LEFT JOIN x USING (c) LEFT JOIN b USING (c)
""")
def label_cascade(spark, sf_dir):
    """Exact rules, then fuzzy terms."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    k = F.col("c_custkey") % 3
    name = F.lower(F.when(k == 0, F.col("n_name")).when(k == 1, F.concat("n_name", F.lit("s"))).otherwise(F.col("c_mktsegment")))
    labels = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("label"), name.alias("clean_label"))
    rules = n.where("n_nationkey % 2 = 0").select(F.lower("n_name").alias("clean_label"), F.lit("rule").alias("concept"))
    terms = n.select(F.lower("n_name").alias("term"), F.lit("nation").alias("concept")).unionByName(r.select(F.lower("r_name").alias("term"), F.lit("region").alias("concept")))
    return mapping.cascade(labels, rules, terms, "edit").select("label", "concept", r6("confidence").alias("confidence"), "method", "mapped")


@register("SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), 'red|hot') THEN 'Warm' WHEN regexp_matches(lower(p_name), 'blue|cold') THEN 'Cold' ELSE 'Not Found' END AS grp FROM part")
def keyword_groups(spark, sf_dir):
    """J19."""
    return table(spark, sf_dir, "part").select("p_partkey", mapping.keyword_group(F.col("p_name"), [("red|hot", "Warm"), ("blue|cold", "Cold")]).alias("grp"))


@register("""
WITH l AS (SELECT DISTINCT p_name AS label FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part),
c AS (SELECT split_part(p_name, ' ', 2) AS col, length(p_name) AS i, length(p_name) % 2 = 0 AS num FROM part UNION SELECT p_name, 100 + length(p_name), bool_or(p_size > 20) FROM part GROUP BY 1, 2),
m AS (SELECT label, min(struct_pack(i, col)) FILTER (col = label AND num) AS e, min(struct_pack(i, col, num)) AS s FROM l LEFT JOIN c ON contains(lower(col), lower(label)) OR contains(lower(label), lower(col)) GROUP BY 1)
SELECT label, coalesce(e.col, CASE WHEN s.num THEN s.col END) AS col FROM m
""")
def column_resolution(spark, sf_dir):
    """Names and the nouns in them against columns of both; half of the nouns' columns, and some names', hold no number."""
    p = table(spark, sf_dir, "part")
    noun = F.split_part("p_name", F.lit(" "), F.lit(2))
    columns = p.select(noun.alias("column"), F.length("p_name").alias("col_idx"), (F.length("p_name") % 2 == 0).alias("numeric")).distinct().unionByName(p.groupBy(F.col("p_name").alias("column"), (F.length("p_name") + 100).alias("col_idx")).agg(F.bool_or(F.col("p_size") > 20).alias("numeric")))
    labels = p.select(F.col("p_name").alias("label")).unionByName(p.select(noun.alias("label")))
    return rc.resolve_column(labels, columns).select("label", F.col("column").alias("col"))


@register("SELECT a.event_type AS stage, a.v AS a, b.v AS b, round(b.v - a.v, 6) AS difference FROM (SELECT event_type, count(*)::DOUBLE AS v FROM events WHERE user_id % 2 = 0 GROUP BY 1) a JOIN (SELECT event_type, count(*)::DOUBLE AS v FROM events WHERE user_id % 2 = 1 GROUP BY 1) b USING (event_type)")
def run_comparison(spark, sf_dir):
    """Stages that both runs have."""
    e = table(spark, sf_dir, "events")
    run = lambda k: e.where(F.col("user_id") % 2 == k).groupBy(F.col("event_type").alias("stage")).agg(F.count("*").cast("double").alias("value"))
    return mo.compare_runs(run(0), run(1)).select("stage", "a", "b", r6("difference").alias("difference"))


@register("""
WITH f AS (SELECT l_orderkey AS page, l_returnflag AS m, l_partkey AS v, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_partkey) AS r FROM lineitem WHERE l_returnflag IN ('A', 'R'))
SELECT a.page, a.v AS v_a, b.v AS v_b FROM f a JOIN f b ON a.page = b.page AND a.m = 'A' AND b.m = 'R' AND a.r = 1 AND b.r = 1
""")
def methods_side_by_side(spark, sf_dir):
    """The first row of two methods on pages that have both."""
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_returnflag").alias("m"), F.col("l_partkey").alias("v"))
    return quality.first_of_methods(m, ["page"], "m", "v", "A", "R", ["v"])


@register("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def index_with_files(spark, sf_dir):
    """Orders as an index, every second customer as the files there are."""
    files = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("file"))
    return readers.existing_only(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), files, "o_custkey")


@register("""
WITH s AS (SELECT DISTINCT lower(p_brand) || '_' || (p_partkey % 5) AS name FROM part), f AS (SELECT DISTINCT lower(p_brand) || '-' || (p_partkey % 7) || '-files' AS partner FROM part)
SELECT s.name, min(partner) AS partner FROM s LEFT JOIN f ON starts_with(partner, split_part(s.name, '_', 1)) AND contains(partner, split_part(s.name, '_', 2)) GROUP BY 1
""")
def directory_pairs(spark, sf_dir):
    """J17."""
    p = table(spark, sf_dir, "part")
    short = p.select(F.concat(F.lower("p_brand"), F.lit("_"), (F.col("p_partkey") % 5).cast("string")).alias("name")).distinct()
    full = p.select(F.concat(F.lower("p_brand"), F.lit("-"), (F.col("p_partkey") % 7).cast("string"), F.lit("-files")).alias("name")).distinct()
    return mapping.pair_directories(short, full)


@register("""
WITH b AS (SELECT l_orderkey AS doc_id, 1 AS page, CASE l_returnflag WHEN 'A' THEN 'Title' WHEN 'R' THEN 'Table' ELSE 'Text' END AS type, l_partkey * 10 + l_linenumber AS block FROM lineitem)
SELECT doc_id, block, type, row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE type WHEN 'Text' THEN 0 WHEN 'Table' THEN 1 ELSE 2 END, block)::INT AS block_id, CASE type WHEN 'Table' THEN 'camelot' ELSE 'pdfplumber' END AS route FROM b
""")
def block_numbers(spark, sf_dir):
    """W9 and P18."""
    t = F.when(F.col("l_returnflag") == "A", "Title").when(F.col("l_returnflag") == "R", "Table").otherwise("Text")
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), t.alias("type"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("block"))
    return layout.block_ids(b).select("doc_id", "block", "type", "block_id", layout.routing(F.col("type")).alias("route"))


@register("SELECT o_orderkey, CASE WHEN abs(v) > 100 THEN v END AS large FROM (SELECT o_orderkey, (CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * (floor(o_totalprice)::BIGINT % 300))::DOUBLE AS v FROM orders)")
def numeric_large(spark, sf_dir):
    """Prices as texts, every second in parentheses."""
    v = (F.floor("o_totalprice") % 300).cast("int").cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", nm.parse_large(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("("), v, F.lit(")"))).otherwise(F.concat(F.lit("$"), v))).alias("large"))


_FILE = "p_brand || CASE p_partkey % 4 WHEN 0 THEN ' Report 2021-2023' WHEN 1 THEN '_camelot_stream_p' || p_partkey || '_t2.csv' ELSE '__x?y' END"


@register(rf"""
WITH f AS (SELECT p_partkey, {_FILE} AS name FROM part), y AS (SELECT *, regexp_extract_all(name, '20[0-9]{{2}}') AS ys, replace(replace(lower(name), ' ', '_'), '-', '_') AS plain FROM f)
SELECT p_partkey, CASE WHEN contains(lower(name), 'brand#1') THEN 'b1_' || coalesce(ys[-1], '2024') WHEN len(ys) > 0 THEN plain ELSE plain || '_2024' END AS doc_id, CASE WHEN contains(lower(name), 'brand#1') THEN 'Brand One' ELSE 'Unknown Company' END AS company, coalesce(ys[-1], '2024') AS fiscal_year,
  CASE WHEN p_partkey % 4 = 1 THEN 'camelot_stream' END AS method, CASE WHEN p_partkey % 4 = 1 THEN p_partkey::INT END AS page, CASE WHEN p_partkey % 4 = 1 THEN 2 END AS table_id, regexp_replace(regexp_replace(name, '[<>:"/\\|?*]', '_', 'g'), '_+', '_', 'g') AS clean FROM y
""")
def file_names(spark, sf_dir):
    """S22, S18 and P21 on files' names."""
    kind = F.col("p_partkey") % 4
    tail = F.when(kind == 0, " Report 2021-2023").when(kind == 1, F.concat(F.lit("_camelot_stream_p"), F.col("p_partkey").cast("string"), F.lit("_t2.csv"))).otherwise("__x?y")
    f = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", tail).alias("name"))
    a, t = tx.document_attributes(F.col("name"), [("brand#1", "Brand One", "b1")]), tx.table_file(F.col("name"))
    return f.select("p_partkey", a["doc_id"].alias("doc_id"), a["company"].alias("company"), a["fiscal_year"].alias("fiscal_year"), t["method"].alias("method"), t["page"].alias("page"), t["table_id"].alias("table_id"), tx.clean_filename(F.col("name")).alias("clean"))


@register(f"""
WITH m AS (SELECT doc_id, '## ' || coalesce(source, '') || chr(10) || replace(text, '. ', '.' || chr(10) || '## ') AS md FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, string_split(chr(10) || md, chr(10) || '## ') AS ps FROM m), e AS (SELECT doc_id, i, ps[i + 1] AS p FROM (SELECT doc_id, ps, unnest(range(1, len(ps))) AS i FROM p))
SELECT doc_id, (i - 1)::INT AS idx, trim(split_part(p, chr(10), 1), {_S}) AS title, CASE WHEN contains(p, chr(10)) THEN trim(substr(p, strpos(p, chr(10)) + 1), {_S}) ELSE '' END AS content FROM e
""")
def markdown_sections(spark, sf_dir):
    """S17, second-level headings: each sentence of a document begins a section."""
    md = F.concat(F.lit("## "), F.coalesce("source", F.lit("")), F.lit("\n"), F.replace("text", F.lit(". "), F.lit(".\n## ")))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(tx.sections(md)).alias("idx", "s")).select("doc_id", "idx", "s.title", "s.content")


@register("SELECT doc_id, page, seq::INT AS seq, text FROM (SELECT l_orderkey AS doc_id, 1 AS page, l_shipdate::VARCHAR AS text, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_tax, l_discount, l_partkey * 1000000 + l_suppkey * 10 + l_linenumber) AS seq FROM lineitem)")
def word_sequence(spark, sf_dir):
    """P23, O4."""
    w = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("word_idx"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("text"), F.col("l_tax").alias("top"), F.col("l_discount").alias("x0"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("bottom"))
    return rec.word_records(w).select("doc_id", "page", "seq", "text")


@register("SELECT conv_id AS doc_id, seq::INT AS seq, '## Record ' || seq || chr(10) || chr(10) || text AS markdown FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS seq FROM conversations)"
          f" WHERE trim(text, {_S}) <> ''")
def record_markdown(spark, sf_dir):
    """K5: records numbered within their document."""
    r = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "role", "text")
    f = rec.fan_out(r, ["turn", "role", "text"])
    return f.where("markdown IS NOT NULL").select(F.get_json_object("jsonl", "$.doc_id").cast("long").alias("doc_id"), "seq", "markdown")


@register("SELECT event_id, 'value' AS metric, value FROM events WHERE value IS NOT NULL UNION ALL SELECT event_id, 'by.user', user_id::DOUBLE FROM events WHERE user_id IS NOT NULL UNION ALL SELECT event_id, 'by.late', (value > 10)::INT::DOUBLE FROM events WHERE value IS NOT NULL")
def metrics_flattened(spark, sf_dir):
    """P20: nested values and flags to rows."""
    m = F.struct("value", F.struct(F.col("user_id").alias("user"), (F.col("value") > 10).alias("late"), F.col("event_type").alias("kind")).alias("by")).alias("m")
    return mo.flatten_metrics(table(spark, sf_dir, "events").select("event_id", m), ["event_id"], "m")


@register("WITH r AS (SELECT p_name AS c, max(p_type) AS k FROM part WHERE p_partkey % 3 = 0 GROUP BY 1), m AS (SELECT p_name AS c, min(p_brand) AS k FROM part WHERE p_partkey % 5 = 0 GROUP BY 1) SELECT c AS clean_label, k AS concept FROM m UNION ALL SELECT c, k FROM r WHERE c NOT IN (SELECT c FROM m)")
def rules_merged(spark, sf_dir):
    """K11, U3."""
    p = table(spark, sf_dir, "part")
    rules = p.where("p_partkey % 3 = 0").groupBy(F.col("p_name").alias("clean_label")).agg(F.max("p_type").alias("concept"))
    return mapping.upsert_rules(rules, p.where("p_partkey % 5 = 0").groupBy(F.col("p_name").alias("clean_label")).agg(F.min("p_brand").alias("concept")))


@register("""
WITH t AS (SELECT p_partkey AS k, p_retailprice AS truth FROM part), v AS (SELECT l_partkey AS k, l_extendedprice / l_quantity AS v FROM lineitem WHERE l_quantity > 0),
a AS (SELECT t.k, truth, v, CASE WHEN truth = 0 THEN (v = 0)::INT::DOUBLE ELSE greatest(0.0, 1 - abs(v - truth) / abs(truth)) END AS acc FROM t LEFT JOIN v USING (k)),
b AS (SELECT k, truth, max(acc) AS acc FROM a GROUP BY 1, 2)
SELECT count(*) AS n, round(avg(coalesce(acc, 0)), 6) AS avg_accuracy, round(avg(CASE WHEN acc IS NULL THEN 1.0 ELSE 0.0 END), 6) AS no_value FROM b
""")
def truth_rates(spark, sf_dir):
    """Prices of parts against unit prices of their lines."""
    truth = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("truth"))
    parsed = table(spark, sf_dir, "lineitem").where("l_quantity > 0").select(F.col("l_partkey").alias("key"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("value"))
    m = rc.best_match(truth, parsed)
    return rc.accuracy_rates(m).select("n", r6("avg_accuracy").alias("avg_accuracy")).join(m.agg(F.round(F.avg(F.col("accuracy").isNull().cast("int")), 6).alias("no_value")), F.lit(True))


@register("SELECT o_orderpriority AS run_id, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 1")
def best_run(spark, sf_dir):
    """O7."""
    r = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("run_id")).agg(F.sum("o_totalprice").alias("total"))
    return bench.best_run(r, "total").select("run_id", F.round("total", 2).alias("total"))


@register("SELECT l_orderkey AS doc_id, count(*) AS n_tables, sum(l_linenumber * l_suppkey)::BIGINT AS cells FROM lineitem GROUP BY 1")
def structure_summary(spark, sf_dir):
    """Orders as converted documents, lines as their tables."""
    li = table(spark, sf_dir, "lineitem")
    docs = li.select(F.col("l_orderkey").alias("doc_id")).distinct().select("doc_id", F.lit("# x").alias("markdown"), F.lit("x").alias("text"))
    t = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("table_num"), F.col("l_linenumber").alias("rows"), F.col("l_suppkey").alias("cols"))
    s = rec.structure_summary(docs, t)
    return s.select("doc_id", "n_tables", F.aggregate("shapes", F.lit(0).cast("long"), lambda z, x: z + x["rows"] * x["cols"]).alias("cells"))


@register("SELECT user_id AS doc_id, count(*)::INT AS n_pages, sum(length(event_type))::INT AS text_length, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::INT AS n_tables, bool_or(event_type = 'error') AS has_tables FROM events GROUP BY 1")
def nested_counts(spark, sf_dir):
    """A29 over nested documents made of a user's events: an event is a page, an error its table."""
    page = F.struct(F.col("event_id").cast("int").alias("page_number"), *[F.array().cast("array<string>").alias(c) for c in ("blocks", "paragraphs", "lines", "form_fields")], F.when(F.col("event_type") == "error", F.array("event_type")).otherwise(F.array().cast("array<string>")).alias("tables"))
    d = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.array_join(F.sort_array(F.collect_list("event_type")), "").alias("text"), F.collect_list(page).alias("pages")).withColumn("entities", F.array().cast("array<string>"))
    return rec.layout_counts(d).select("doc_id", "n_pages", "text_length", "n_tables", "has_tables")
