"""Queries over candidate tables, facts and reported values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as nm
from ..operators import bench, quality, reconcile as rc, tables as tb
from .common import parts, r6, registrar, table

QUERIES: dict = {}
ORACLES: dict = {}
register = registrar(QUERIES, ORACLES)


def _candidates(spark, sf_dir):
    """lineitem rows as candidate tables: order = document, line = page and table number, return flag = method."""
    m = F.when(F.col("l_returnflag") == "A", "camelot_stream").when(F.col("l_returnflag") == "N", "pdfplumber").otherwise("camelot_lattice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 3 + 1).alias("page"), F.col("l_linenumber").alias("table_num"), m.alias("method"), ((F.col("l_partkey") % 25) + 1).cast("int").alias("rows"), ((F.col("l_suppkey") % 8) + 1).cast("int").alias("cols"),
        F.when(F.col("l_returnflag") != "N", 100 - 100 * F.col("l_tax")).alias("accuracy"), (1 - F.col("l_discount") * 8).alias("content_quality"), (F.col("l_partkey") % 12).cast("int").alias("financial_score"), F.concat_ws("-", F.col("l_suppkey") % 5, F.col("l_quantity").cast("int")).alias("signature"),
    )


_C = """WITH c AS (SELECT l_orderkey AS doc_id, (l_linenumber % 3 + 1) AS page, l_linenumber AS table_num, CASE l_returnflag WHEN 'A' THEN 'camelot_stream' WHEN 'N' THEN 'pdfplumber' ELSE 'camelot_lattice' END AS method,
  CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 0 END AS mo, (l_partkey % 25 + 1)::INT AS "rows", (l_suppkey % 8 + 1)::INT AS cols, CASE WHEN l_returnflag <> 'N' THEN 100 - 100 * l_tax END AS accuracy, 1 - l_discount * 8 AS content_quality, (l_partkey % 12)::INT AS financial_score,
  (l_suppkey % 5) || '-' || l_quantity::INT AS signature FROM lineitem),
s AS (SELECT *, 2 * content_quality + coalesce(accuracy, 0) / 50 + least(financial_score / 10, 0.5) + least("rows" * cols / 200, 0.3) + CASE WHEN method = 'camelot_stream' THEN 0.3 WHEN method = 'camelot_lattice' AND coalesce(accuracy, 0) > 90 THEN 0.4 WHEN method = 'pdfplumber' THEN 0.2 ELSE 0 END AS score FROM c)
"""


@register(_C + "SELECT doc_id, page, table_num, method FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY score DESC, mo, table_num) AS r FROM s) WHERE r = 1")
def best_per_group(spark, sf_dir):
    return tb.best_table_per_page(_candidates(spark, sf_dir)).select("doc_id", "page", "table_num", "method")


@register(_C + """SELECT method, count(*) AS n, count(*) FILTER (content_quality >= 0.4 AND "rows" >= 2 AND cols >= 2 AND "rows" * cols <= 500 AND content_quality >= CASE WHEN financial_score >= 5 THEN 0.3 WHEN financial_score >= 2 THEN 0.4 ELSE 0.5 END) AS passed,
  count(*) FILTER (content_quality >= CASE WHEN page <= 20 THEN 0.2 ELSE 0.35 END) AS page_passed FROM c GROUP BY method""")
def quality_gate(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    ok = tb.passes_gate(F.col("content_quality"), F.col("rows"), F.col("cols"), F.col("financial_score"))
    return c.groupBy("method").agg(F.count("*").alias("n"), F.count_if(ok).alias("passed"), F.count_if(tb.page_gate(F.col("page"), F.col("content_quality"))).alias("page_passed"))


@register(_C + """SELECT method, count(*) AS n_tables, round(avg(accuracy), 6) AS avg_accuracy, round(avg(content_quality), 6) AS avg_quality, round(avg("rows"), 6) AS avg_rows, round(avg(cols), 6) AS avg_cols, count(DISTINCT page) AS page_coverage, array_to_string(list_sort(list(DISTINCT page)), ',') AS pages, count(*) FILTER (financial_score > 0) AS n_financial FROM c GROUP BY method""")
def method_summary(spark, sf_dir):
    m = tb.method_summary(_candidates(spark, sf_dir))
    return m.select("method", "n_tables", *[r6(x).alias(x) for x in ("avg_accuracy", "avg_quality", "avg_rows", "avg_cols")], "page_coverage", F.array_join("pages", ",").alias("pages"), "n_financial")


@register(_C + """, g AS (SELECT method, mo, count(*) AS n, avg(accuracy) AS a, avg(content_quality) AS q FROM c GROUP BY method, mo)
SELECT method, round(CASE WHEN method = 'pdfplumber' THEN n + 1.2 * q ELSE n + coalesce(a, 0) + q + CASE WHEN method = 'camelot_stream' THEN 0.2 ELSE 0 END END, 6) AS score FROM g ORDER BY score DESC, mo LIMIT 1""")
def preferred_method(spark, sf_dir):
    return tb.preferred_method(_candidates(spark, sf_dir)).select("method", r6("score").alias("score"))


@register(_C + """, m AS (SELECT method, avg(content_quality) AS v FROM c GROUP BY method)
SELECT count(*) AS n_pairs, round(avg(CASE WHEN greatest(a.v, b.v) = 0 THEN 1.0 ELSE greatest(0, 1 - abs(a.v - b.v) / greatest(a.v, b.v)) END), 6) AS agreement FROM m a JOIN m b ON a.method < b.method""")
def cross_group_agreement(spark, sf_dir):
    m = quality.method_comparison(_candidates(spark, sf_dir), "method", F.col("content_quality"))
    return quality.method_agreement(m, "method", "avg_quality").select("n_pairs", r6("agreement").alias("agreement"))


@register(_C + """, g AS (SELECT doc_id, method, count(content_quality) AS n FROM c GROUP BY 1, 2), h AS (SELECT doc_id, count(*) AS m, stddev_samp(n) AS sd, avg(n) AS mean FROM g GROUP BY doc_id)
SELECT count(*) AS n_groups, count(*) FILTER (m > 1) AS n_overlap, round(avg((m > 1)::INT), 6) AS overlap_ratio, round(avg(CASE WHEN m > 1 THEN 1 - sd / greatest(mean, 1) END), 6) AS count_similarity FROM h""")
def overlap_ratio(spark, sf_dir):
    m = quality.method_overlap(_candidates(spark, sf_dir), "doc_id", "method", "content_quality")
    return m.select("n_groups", "n_overlap", r6("overlap_ratio").alias("overlap_ratio"), r6("count_similarity").alias("count_similarity"))


@register(_C + """SELECT doc_id, page, table_num, CASE WHEN "rows" * cols <= 20 THEN 'small' WHEN "rows" * cols <= 100 THEN 'medium' WHEN "rows" * cols <= 400 THEN 'large' ELSE 'very_large' END AS size_category FROM
  (SELECT *, row_number() OVER (PARTITION BY doc_id, page, "rows", cols, signature ORDER BY content_quality + coalesce(accuracy, 0) / 100 DESC, mo, table_num) AS r FROM c) WHERE r = 1""")
def table_dedupe(spark, sf_dir):
    return tb.dedupe_tables(_candidates(spark, sf_dir)).select("doc_id", "page", "table_num", tb.size_class(F.col("rows") * F.col("cols")).alias("size_category"))



def _found(words, k: int) -> str:
    return " + ".join(f"{k} * contains(txt, '{w}')::INT" for w in words)


@register(rf"""
WITH n AS (SELECT c_custkey // 25 AS t, c_custkey AS r, c_name || ' ' || lower(c_mktsegment) AS a, '$' || c_custkey AS m, row_number() OVER (PARTITION BY c_custkey // 25 ORDER BY c_custkey) AS i, count(*) OVER (PARTITION BY c_custkey // 25) AS k FROM customer),
x AS (SELECT t, (max(r) - min(r) + 1)::INT AS "rows", lower('Column_1 ' || string_agg(a, ' ' ORDER BY r) || ' Column_2 ' || string_agg(m, ' ' ORDER BY r) || ' Column_3 ' || repeat(' ', any_value(k)::INT - 1)) AS txt,
  'Table Headers: Column_1, Column_2, Column_3' || chr(10) || string_agg('Row ' || i || ': ' || a || ' | ' || m || ' | ', chr(10) ORDER BY i) FILTER (i <= 10) || CASE WHEN any_value(k) > 10 THEN chr(10) || '... (' || (any_value(k) - 10) || ' more rows)' ELSE '' END AS text FROM n GROUP BY t)
SELECT t AS table_num, "rows", 3::INT AS cols, round(2 / 3.0 + 0.25, 6)::DOUBLE AS content_quality, round(2 / 3.0, 6)::DOUBLE AS filled_ratio, text, ({" OR ".join(f"contains(txt, '{w}')" for w in tb.FINANCIAL_WORDS)}) AS is_financial,
  ({_found(tb.WORDS_HIGH, 3)} + {_found(tb.WORDS_MEDIUM, 2)} + length(txt) - length(translate(txt, '$%', '')) + {" + ".join(f"regexp_matches(txt, '{x}')::INT" for x in tb.PATTERNS)} + 1)::INT AS financial_score FROM x
""")
def table_cells_scored(spark, sf_dir):
    """P1-P3, P17, F9 and T13-T16 on tables made of customers, 25 to a table."""
    n = table(spark, sf_dir, "customer").where("c_custkey IS NOT NULL").withColumn("row_idx", F.col("c_custkey").cast("int"))
    values = (F.concat("c_name", F.lit(" "), F.lower("c_mktsegment")), F.concat(F.lit("$"), F.col("c_custkey").cast("string")), F.lit(" NULL "))
    cols = F.array(*[F.struct(F.lit(i).alias("col_idx"), v.alias("value")) for i, v in enumerate(values)])
    body = n.select(F.lit("customers").alias("doc_id"), F.lit("pdfplumber").alias("method"), F.lit(1).alias("page"), F.floor(F.col("c_custkey") / 25).alias("table_num"), "row_idx", F.explode(cols).alias("c")).select("doc_id", "method", "page", "table_num", "row_idx", "c.*")
    headed = tb.infer_headers(tb.clean_cells(body.withColumn("header", F.concat(F.lit("Column_"), F.col("col_idx").cast("string")))))
    return tb.score_tables(headed).join(tb.render(headed), tb.TABLE).select("table_num", "rows", "cols", r6("content_quality").alias("content_quality"), "financial_score", r6("filled_ratio").alias("filled_ratio"), "is_financial", "text")


@register("""
WITH g AS (SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS k FROM orders GROUP BY 1, 2), m AS (SELECT p, s FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY k DESC, s) AS r FROM g) WHERE r = 1)
SELECT o_orderpriority, count(o_totalprice) AS n, round(sum(o_totalprice), 0) AS sum, round(avg(o_totalprice), 2) AS mean, min(o_totalprice) AS min, max(o_totalprice) AS max, m.s AS o_orderstatus_mode FROM orders JOIN m ON m.p = o_orderpriority GROUP BY 1, m.s
""")
def concept_summary_mode(spark, sf_dir):
    return rc.concept_summary(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", ["o_orderstatus"]).withColumn("sum", F.round("sum", 0))


@register("""
WITH m AS (SELECT o_custkey, max(date_trunc('month', o_orderdate)) AS e FROM orders GROUP BY 1)
SELECT o_custkey AS concept, round(sum(o_totalprice), 2) AS value FROM orders JOIN m USING (o_custkey) WHERE date_trunc('month', o_orderdate) = e GROUP BY 1
""")
def latest_period_sum(spark, sf_dir):
    f = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("concept"), F.trunc("o_orderdate", "month").alias("end_date"), F.lit(None).cast("date").alias("instant_date"), "o_totalprice")
    return rc.aggregate_values(rc.latest_period(f), ["concept"], "o_totalprice").select("concept", F.round("value", 2).alias("value"))


_NUM = "CASE WHEN o_orderkey % 2 = 0 THEN '($' || t || ')' WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE t END"


@register(rf"""
WITH a AS (SELECT o_orderkey, (o_orderkey // 1000) || ',' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') AS t FROM orders), b AS (SELECT o_orderkey, {_NUM} AS v FROM a)
SELECT o_orderkey, v AS raw, try_cast(regexp_replace(v, '[,$]', '', 'g') AS DOUBLE) AS plain, try_cast(replace(replace(regexp_replace(v, '[,$]', '', 'g'), '(', '-'), ')', '') AS DOUBLE) AS signed,
  try_cast(CASE WHEN regexp_matches(v, '^\(.*\)$') THEN '-' ELSE '' END || regexp_replace(v, '[,$\s()]', '', 'g') AS DOUBLE) AS accounting, try_cast(v AS DOUBLE) AS strict FROM b
""")
def numeric_parse(spark, sf_dir):
    k = F.col("o_orderkey")
    t = F.concat(F.floor(k / 1000).cast("string"), F.lit(","), F.lpad((k % 1000).cast("string"), 3, "0"))
    v = F.when(k % 2 == 0, F.concat(F.lit("($"), t, F.lit(")"))).when(k % 3 == 0, "n/a").otherwise(t)
    d = table(spark, sf_dir, "orders").select("o_orderkey", v.alias("raw"))
    return d.select("o_orderkey", "raw", nm.parse_plain(F.col("raw")).alias("plain"), nm.parse_signed(F.col("raw")).alias("signed"), nm.parse_accounting(F.col("raw")).alias("accounting"), nm.parse_strict(F.col("raw")).alias("strict"))


def _sides(spark, sf_dir):
    """Reported: line totals of each order, at thousandths for some; facts: the orders' own totals, missing for some."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("label")).agg(F.round(F.sum("l_extendedprice"), 2).alias("s"))
    o = table(spark, sf_dir, "orders")
    reported = li.select("label", F.when(F.col("label") % 11 == 0, F.col("s") / 1000).otherwise(F.col("s")).alias("pdf_value"))
    mapping = o.select(F.col("o_orderkey").alias("label"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderkey")).alias("concept"))
    base = o.join(li, o["o_orderkey"] == li["label"], "left")
    facts = base.where("o_orderkey % 17 <> 0").select(F.col("o_orderkey").alias("concept"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice")).otherwise(F.col("s")).alias("fact_value"))
    return mapping, reported, facts


_R = """WITH li AS (SELECT l_orderkey AS k, round(sum(l_extendedprice), 2) AS s FROM lineitem GROUP BY 1),
j AS (SELECT o_orderkey AS label, o_orderkey AS concept, CASE WHEN k % 11 = 0 THEN s / 1000 ELSE s END AS p, CASE WHEN o_orderkey % 17 <> 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice ELSE s END END AS x FROM orders LEFT JOIN li ON k = o_orderkey WHERE o_orderkey % 13 <> 0),
q AS (SELECT *, CASE WHEN p IS NULL OR x IS NULL THEN NULL WHEN x = 0 THEN 'Infinity'::DOUBLE ELSE abs(p - x) / abs(x) * 100 END AS pct,
  CASE WHEN abs(p * 1e3 - x) <= .01 THEN 1e3 WHEN abs(p - x * 1e3) <= .01 THEN 1e-3 WHEN abs(p * 1e6 - x) <= .01 THEN 1e6 WHEN abs(p - x * 1e6) <= .01 THEN 1e-6 WHEN abs(p * 1e9 - x) <= .01 THEN 1e9 WHEN abs(p - x * 1e9) <= .01 THEN 1e-9 END AS f FROM j),
d AS (SELECT *, CASE WHEN p IS NULL AND x IS NULL THEN NULL WHEN p IS NULL THEN 'missing_pdf_value' WHEN x IS NULL THEN 'missing_xbrl_value' WHEN abs(p - x) <= .01 OR pct <= .1 OR abs(p - x) / greatest(abs(p), abs(x)) <= 1e-6 THEN NULL WHEN f IS NOT NULL THEN 'scale_mismatch' ELSE 'value_mismatch' END AS discrepancy_type FROM q),
z AS (SELECT *, CASE WHEN starts_with(discrepancy_type, 'missing') THEN 'missing_data' WHEN discrepancy_type = 'scale_mismatch' THEN 'moderate' WHEN pct > 10 THEN 'critical' WHEN pct > 1 THEN 'moderate' ELSE 'minor' END AS severity FROM d WHERE discrepancy_type IS NOT NULL)
"""


@register(_R + "SELECT label, round(pct, 6) AS percentage_difference, round(f, 9) AS scale_factor, discrepancy_type, severity FROM z")
def reconcile(spark, sf_dir):
    d = rc.reconcile(*_sides(spark, sf_dir))
    return d.select("label", r6("percentage_difference").alias("percentage_difference"), F.round("scale_factor", 9).alias("scale_factor"), "discrepancy_type", "severity")


@register(_R + """SELECT count(*) AS n, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'moderate') AS moderate, count(*) FILTER (severity = 'minor') AS minor, count(*) FILTER (severity = 'missing_data') AS missing_data, 0 AS unmapped, count(*) FILTER (severity = 'missing_data') AS data_issues, 0 AS errors,
  round(avg(c), 6) AS mean_pct, round(median(c), 6) AS median_pct, round(max(c), 6) AS max_pct, round(min(c), 6) AS min_pct FROM (SELECT *, CASE WHEN coalesce(pct, 0) < 'Infinity'::DOUBLE THEN coalesce(pct, 0) END AS c FROM z)""")
def reconcile_severity(spark, sf_dir):
    s = rc.severity_counts(rc.reconcile(*_sides(spark, sf_dir)))
    return s.select("n", "critical", "moderate", "minor", "missing_data", "unmapped", "data_issues", "errors", *[r6(c).alias(c) for c in ("mean_pct", "median_pct", "max_pct", "min_pct")])


@register("""
WITH a AS (SELECT c_custkey AS id, c_acctbal AS v FROM customer), b AS (SELECT s_suppkey AS id, s_acctbal AS v FROM supplier)
SELECT a.id AS left_id, b.id AS right_id, CASE WHEN a.v = b.v THEN 'Exact' ELSE 'Close' END AS quality FROM a JOIN b ON sign(a.v) = sign(b.v) AND abs(a.v - b.v) <= 0.002 * greatest(abs(a.v), abs(b.v))
""")
def value_range_join(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("value"))
    return rc.value_range_join(a, b, 0.002).select("left_id", "right_id", "quality")


@register("""
WITH b AS (SELECT l_orderkey AS k, l_quantity AS v FROM lineitem), t AS (SELECT o_orderkey AS k, (o_orderkey % 40 + 10)::DOUBLE AS t FROM orders),
s AS (SELECT t.k, t.t, b.v, greatest(0, 1 - abs(b.v - t.t) / abs(t.t)) AS acc FROM t LEFT JOIN b USING (k)),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY coalesce(acc, -1) DESC, v) AS r FROM s) WHERE r = 1)
SELECT k AS key, round(acc, 6) AS accuracy, v AS value, CASE WHEN round(acc, 6) >= 0.9 THEN 'match' WHEN round(acc, 6) >= 0.5 THEN 'near' ELSE 'missing' END AS match FROM m
""")
def best_truth_match(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 40 + 10).cast("double").alias("truth"))
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_quantity").alias("value"))
    return rc.best_match(t, p, parts=parts(table(spark, sf_dir, "lineitem"), 500_000)).select("key", "accuracy", "value", "match")


@register("""
WITH a AS (SELECT l_suppkey AS f, l_extendedprice AS v, l_orderkey * 10 + l_linenumber AS seq FROM lineitem WHERE l_extendedprice > 1000), k AS (SELECT DISTINCT l_extendedprice AS v FROM lineitem WHERE l_linenumber = 1)
SELECT f AS file, seq, v AS value FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY seq) AS r FROM a WHERE v NOT IN (SELECT v FROM k)) WHERE r <= 20
""")
def anti_residual(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    f = li.select(F.col("l_suppkey").alias("file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_extendedprice").alias("value"))
    return rc.uncategorised_large(f, li.where("l_linenumber = 1").select(F.col("l_extendedprice").alias("value")), "file", "value", "seq")


@register("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(l_{a}, l_{b}), 6) AS corr FROM lineitem" for i, a in enumerate(("quantity", "extendedprice", "discount", "tax")) for b in ("quantity", "extendedprice", "discount", "tax")[i + 1 :]) + ")")
def corr_matrix(spark, sf_dir):
    from ..operators.monitor import correlations

    cols = ("quantity", "extendedprice", "discount", "tax")
    return correlations(table(spark, sf_dir, "lineitem").select(*[F.col(f"l_{c}").alias(c) for c in cols]), list(cols)).select("a", "b", r6("corr").alias("corr"))


def _results(spark, sf_dir):
    """Benchmark results by supplier: quantities as seconds, lines as pages."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("operation")).agg(
        F.round(F.sum("l_quantity"), 2).alias("runtime_seconds"), F.max("l_quantity").alias("memory_peak_mb"), F.min("l_quantity").alias("memory_baseline_mb"), F.round(F.avg(F.col("l_tax") * 100), 6).alias("cpu_percent_avg"),
        F.count("*").alias("pages_processed"), F.count_if(F.col("l_returnflag") != "R").alias("success_count"), F.count_if(F.col("l_returnflag") == "R").alias("failure_count"),
    )


_B = """WITH b AS (SELECT l_suppkey AS operation, round(sum(l_quantity), 2) AS rt, max(l_quantity) - min(l_quantity) AS memory_delta_mb, round(avg(l_tax * 100), 6) AS cpu, count(*) AS n, count(*) FILTER (l_returnflag <> 'R') AS ok FROM lineitem GROUP BY 1) """


@register(_B + "SELECT operation, round(rt / n, 6) AS runtime_per_page, memory_delta_mb, round(100.0 * ok / n, 6)::DOUBLE AS success_percent, round(n * 3600 / rt, 6) AS pages_per_hour FROM b ORDER BY rt / n DESC, operation LIMIT 3")
def bottleneck_topk(spark, sf_dir):
    d = bench.top(bench.derive(_results(spark, sf_dir)), "runtime_per_page", ["operation"])
    return d.select("operation", r6("runtime_per_page").alias("runtime_per_page"), "memory_delta_mb", r6("success_percent").alias("success_percent"), r6("pages_per_hour").alias("pages_per_hour"))


@register(_B + """, r AS (SELECT avg(rt / n) AS x FROM b), g AS (SELECT * FROM (VALUES ('ocr', 0.0015), ('text', 0.0001)) AS p(service, price), (VALUES (100), (1000), (5000), (10000)) AS q(pages))
SELECT service, pages, round(price * pages, 6)::DOUBLE AS service_cost, round(pages * x / 3600 * 0.096 * 1.3, 6) AS own_cost, CASE WHEN pages < 1000 THEN 'small' WHEN pages < 10000 THEN 'medium' ELSE 'large' END AS tier, CASE WHEN pages * x / 3600 * 0.096 * 1.3 < price * pages THEN 'own' ELSE 'service' END AS cheaper FROM g, r""")
def cost_model(spark, sf_dir):
    r = bench.derive(_results(spark, sf_dir)).agg(F.avg("runtime_per_page").alias("runtime_per_page"))
    c = bench.cost_model(r, [("ocr", 0.0015), ("text", 0.0001)], [100, 1000, 5000, 10000])
    return c.select("service", "pages", r6("service_cost").alias("service_cost"), r6("own_cost").alias("own_cost"), "tier", "cheaper")


@register(_C + """SELECT method, count(*) AS n_tables, round(avg("rows"), 6) AS avg_rows, round(stddev_samp("rows"), 6) AS std_rows, round(avg(cols), 6) AS avg_cols, round(stddev_samp(cols), 6) AS std_cols, median("rows" * cols)::DOUBLE AS median_cells,
  round(avg(content_quality), 6) AS avg_quality, round(stddev_samp(content_quality), 6) AS std_quality, round(avg((content_quality > 0.7)::INT), 6) AS high_quality_ratio FROM c GROUP BY method""")
def table_structure_stats(spark, sf_dir):
    s = tb.structure_stats(_candidates(spark, sf_dir), ["method"])
    return s.select("method", "n_tables", "median_cells", *[r6(x).alias(x) for x in ("avg_rows", "std_rows", "avg_cols", "std_cols", "avg_quality", "std_quality", "high_quality_ratio")])


_CATEGORIES = {"pressing": ("urgent", "high"), "planned": ("MEDIUM", "LOW"), "levels": ("HIGH", "MEDIUM", "LOW")}


def _categorised(spark, sf_dir):
    """orders as facts: priorities as concepts, clerks as contexts, totals as values; not every fact has a unit."""
    f = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("concept"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("context_id"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("USD")).alias("unit"), F.col("o_totalprice").alias("numeric_value"), F.trunc("o_orderdate", "year").alias("end_date"), "o_custkey")
    return rc.categorise(f, _CATEGORIES)


_K = """WITH k AS (SELECT * FROM (VALUES ('pressing', 'urgent|high'), ('planned', 'medium|low'), ('levels', 'high|medium|low')) AS v(category, p)),
f AS (SELECT category, orders.*, 10 * (o_orderkey % 7 <> 0)::INT + 5 * (o_orderkey % 3 = 0)::INT + least(abs(o_totalprice) / 1e6, 50) AS score FROM orders JOIN k ON regexp_matches(lower(o_orderpriority), p))
"""


@register(_K + "SELECT category, o_custkey, o_orderkey, o_totalprice AS numeric_value FROM (SELECT *, row_number() OVER (PARTITION BY category, o_custkey ORDER BY score DESC, o_orderkey) AS r FROM f) WHERE r = 1")
def category_best_fact(spark, sf_dir):
    return rc.best_fact(_categorised(spark, sf_dir), ["category", "o_custkey"], "o_orderkey").select("category", "o_custkey", "o_orderkey", "numeric_value")


@register(_K + """, m AS (SELECT category, max(date_trunc('year', o_orderdate)) AS e FROM f GROUP BY 1)
SELECT category, o_orderkey, concept, numeric_value FROM (SELECT category, o_orderkey, o_orderpriority AS concept, o_totalprice AS numeric_value, row_number() OVER (PARTITION BY category ORDER BY o_orderkey) AS r FROM f JOIN m USING (category) WHERE date_trunc('year', o_orderdate) = e) WHERE r <= 3""")
def category_tops(spark, sf_dir):
    return rc.category_tops(_categorised(spark, sf_dir), "o_orderkey", "end_date").select("category", "o_orderkey", "concept", "numeric_value")


@register("""WITH b AS (SELECT l_suppkey AS operation, round(sum(l_quantity), 2) AS rt, max(l_quantity) AS mem, round(avg(l_tax * 100), 6) AS cpu, count(*) AS n FROM lineitem GROUP BY 1)
SELECT operation, round(n / rt, 6) AS pages_per_second, round(n / (rt * mem), 6) AS efficiency_score, round(3600 * (n / rt) / (mem + cpu), 6) AS resource_efficiency FROM b""")
def throughput(spark, sf_dir):
    t = bench.throughput(_results(spark, sf_dir))
    return t.select("operation", *[r6(c).alias(c) for c in ("pages_per_second", "efficiency_score", "resource_efficiency")])


@register(_C + """, p AS (SELECT doc_id, page, method, mo, count(*) AS n, min(struct_pack(i := table_num, r := "rows", k := cols)) AS t FROM c GROUP BY 1, 2, 3, 4),
f AS (SELECT list(method ORDER BY mo) AS ms FROM (SELECT DISTINCT method, mo FROM c ORDER BY mo LIMIT 2)),
g AS (SELECT doc_id, page, count(*) AS m, stddev_samp(n) AS sd, avg(n) AS mean, any_value(t) FILTER (method = ms[1]) AS t0, any_value(t) FILTER (method = ms[2]) AS t1 FROM p, f GROUP BY 1, 2)
SELECT count(*) AS n_pages, count(*) FILTER (m > 1) AS n_overlap, round(avg(1 - sd / greatest(mean, 1)) FILTER (m > 1), 6) AS count_similarity, round(count(*) FILTER (m > 1)::DOUBLE / count(*), 6) AS overlap_ratio,
  round(avg((1 - abs(t0.r - t1.r) / greatest(t0.r + t1.r, 1)::DOUBLE + 1 - abs(t0.k - t1.k) / greatest(t0.k + t1.k, 1)::DOUBLE) / 2) FILTER (m > 1), 6) AS structure_similarity FROM g""")
def method_consistency(spark, sf_dir):
    """A13."""
    c = tb.consistency(_candidates(spark, sf_dir))
    return c.select("n_pages", "n_overlap", *[r6(x).alias(x) for x in ("count_similarity", "overlap_ratio", "structure_similarity")])


@register("""
WITH l AS (SELECT l_suppkey AS f, count(*) AS n, avg(abs(l_extendedprice)) AS a, avg(abs(l_extendedprice * CASE WHEN l_suppkey % 3 = 0 THEN 2.5 ELSE 1.5 END)) AS b, count(*) FILTER (l_partkey % 3 = 0) AS hit, count(DISTINCT l_linenumber % 2) AS periods, avg((l_partkey % 2)::DOUBLE) AS rate FROM lineitem GROUP BY 1),
k AS (SELECT f, count(*) FILTER (t ~ '[OlI]') AS odd FROM (SELECT l_suppkey AS f, CASE WHEN l_suppkey % 4 = 0 THEN l_linestatus || l_quantity ELSE l_quantity::VARCHAR END AS t, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS r FROM lineitem) WHERE r <= 20 GROUP BY 1)
SELECT f AS supplier, round(CASE WHEN hit > 0 THEN hit::DOUBLE / n ELSE 0 END, 6) AS match_rate, concat_ws(',', CASE WHEN periods > 1 THEN 'several periods' END, CASE WHEN abs(a - b) / greatest(a, b) > 0.5 THEN 'scales differ' END, CASE WHEN rate < 0.5 THEN 'few labels map' END, CASE WHEN odd > 3 THEN 'look-alike characters' END) AS causes FROM l JOIN k USING (f)
""")
def discrepancy_causes(spark, sf_dir):
    """Each supplier's lines as one comparison; its first twenty quantities as texts."""
    li = table(spark, sf_dir, "lineitem")
    v = F.col("l_extendedprice")
    g = li.groupBy(F.col("l_suppkey").alias("supplier")).agg(
        F.count("*").alias("n"), F.avg(F.abs(v)).alias("a"), F.avg(F.abs(v * F.when(F.col("l_suppkey") % 3 == 0, 2.5).otherwise(1.5))).alias("b"), F.count_if(F.col("l_partkey") % 3 == 0).alias("hit"),
        F.countDistinct(F.col("l_linenumber") % 2).alias("periods"), F.avg((F.col("l_partkey") % 2).cast("double")).alias("rate"),
    )
    text = F.when(F.col("l_suppkey") % 4 == 0, F.concat("l_linestatus", F.col("l_quantity").cast("string"))).otherwise(F.col("l_quantity").cast("string"))
    first = rc.head(li.withColumn("t", text), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], 20)
    odd = first.groupBy(F.col("l_suppkey").alias("supplier")).agg(F.count_if(F.col("t").rlike("[OlI]")).alias("odd"))
    d = rc.diagnose(F.col("n"), F.col("n"), F.col("hit"), F.col("a"), F.col("b"), F.col("periods"), F.col("rate"), F.col("odd"))
    return g.join(odd, "supplier").select("supplier", d.alias("d")).select("supplier", r6("d.match_rate").alias("match_rate"), F.array_join("d.causes", ",").alias("causes"))
