"""Worked cases of single operators."""

import datetime
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.functions import numeric as nm, text as tx
from tallyforge.operators import bench, layout, mapping, monitor, quality, reconcile as rc, records, tables as tb
from tallyforge.sources import readers, reports, sinks
from tallyforge.streaming import monitor as stream


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def s(x):
    return F.lit(x).cast("string")


def test_number_parsers(spark):
    r = one(spark, *[f(s("(1,200)")) for f in (nm.parse_plain, nm.parse_signed, nm.parse_accounting, nm.parse_strict)])
    assert tuple(r) == (None, -1200.0, -1200.0, None)
    assert one(spark, nm.parse_large(s("$50")), nm.parse_large(s("$500"))) == (None, 500.0)
    assert one(spark, nm.parse_plain(s(None)), nm.parse_accounting(s(""))) == (None, None)


def test_tolerance_and_scale(spark):
    v = lambda a: F.lit(float(a))
    assert one(spark, nm.within_tolerance(v(1000), v(1000.5)), nm.within_tolerance(v(25000), v(25100)))[:] == (True, False)
    a, b = one(spark, nm.scale_match(v(25), v(25000)), nm.scale_match(v(25000), v(25)))
    assert (a["factor"], a["direction"], b["factor"], b["direction"]) == (1000.0, "pdf_to_xbrl", 0.001, "xbrl_to_pdf")
    assert one(spark, nm.percentage_difference(v(5), v(0)))[0] == math.inf


def test_change_thresholds_alerts(spark):
    v = lambda a: F.lit(float(a))
    assert one(spark, nm.relative_change(v(3), v(0)), nm.relative_change(v(0), v(0)))[:] == (1.0, 0.0)
    assert one(spark, nm.metric_threshold(s("ocr_rate")), nm.metric_threshold(s("runtime")), nm.metric_threshold(s("x")))[:] == (0.1, 0.2, 0.25)
    assert one(spark, nm.alert_severity(v(0.21), v(0.1)), nm.alert_severity(v(-0.15), v(0.1)), nm.alert_severity(v(0.05), v(0.1)))[:] == ("critical", "warning", None)


def test_reconcile_cases(spark):
    m = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C"), ("d", "D"), ("e", None), ("f", "F")], "label string, concept string")
    p = spark.createDataFrame([("a", 100000.0), ("b", 25000.0), ("c", 25.0), ("f", 5.0)], "label string, pdf_value double")
    f = spark.createDataFrame([("A", 100000.0), ("B", 25100.0), ("C", 25000.0), ("D", 5.0), ("F", 0.0)], "concept string, fact_value double")
    got = {r["label"]: r for r in rc.reconcile(m, p, f).collect()}
    assert "a" not in got and "e" not in got
    assert (got["b"]["discrepancy_type"], got["b"]["severity"]) == ("value_mismatch", "minor") and round(got["b"]["percentage_difference"], 4) == 0.3984
    assert (got["c"]["discrepancy_type"], got["c"]["scale_factor"], got["c"]["severity"]) == ("scale_mismatch", 1000.0, "moderate")
    assert got["d"]["discrepancy_type"] == "missing_pdf_value" and got["f"]["severity"] == "critical"
    assert {r["label"]: r["discrepancy_type"] for r in rc.reconcile(m, p, f, ignore_unmapped=False).collect()}["e"] == "no_xbrl_mapping"
    c = rc.severity_counts(rc.reconcile(m, p, f)).first()
    assert (c["n"], c["critical"], c["moderate"], c["minor"], c["data_issues"]) == (4, 1, 1, 1, 1) and c["max_pct"] < math.inf


def test_label_cleaning(spark):
    c = lambda x, **k: one(spark, tx.clean_label(s(x), **k))[0]
    assert c("Revenue (in $millions)") == "revenue" and c("COGS") == "cost of goods sold" and c(None) == ""
    assert c("R&D") == "research and development" and c("R&D", expand_first=False) == "randd"
    assert one(spark, tx.clean_phrase(s("  Total net Income: ")))[0] in ("income", "total net income:", "total net income")
    assert one(spark, tx.clean_phrase(s("Total net Income")))[0] == "income"


def test_headers(spark):
    cell = lambda t, r, c, v: ("d", "m", 1, t, r, c, None, v)
    rows = [cell(1, r, c, v) for r, row in enumerate([["A", "B"], ["1", "2"]]) for c, v in enumerate(row)] + [cell(2, r, c, v) for r, row in enumerate([["1", "2"], ["3", "4"]]) for c, v in enumerate(row)]
    got = tb.infer_headers(spark.createDataFrame(rows, schemas.CELLS)).collect()
    assert sorted((r["header"], r["value"]) for r in got if r["table_num"] == 1) == [("A", "1"), ("B", "2")]
    assert sorted({r["header"] for r in got if r["table_num"] == 2}) == ["Column_1", "Column_2"] and sum(r["table_num"] == 2 for r in got) == 4


def test_cleaning_modes(spark):
    rows = [("d", "m", 1, 1, r, c, "h", v) for r, row in enumerate([["a", " N/A "], [None, None], ["", "b"]]) for c, v in enumerate(row)]
    df = spark.createDataFrame(rows, schemas.CELLS)
    assert sorted(r["value"] for r in tb.clean_cells(df).collect()) == ["", " N/A ", "a", "b"]
    assert sorted(r["value"] for r in tb.clean_cells(df, missing=tb.MISSING_WIDE, any_case=True).collect()) == ["", "", "a", "b"]
    marks = spark.createDataFrame([("d", "m", 1, 1, 0, i, "h", v) for i, v in enumerate(("<NA>", "nan", "NaN", "None", " ", "—", "-", "null", "NULL", "NA", "n/a", "--", "nil", "NAN", "Null"))], schemas.CELLS)
    assert [r["value"] for r in tb.clean_cells(marks).orderBy("col_idx").collect()] == [""] * 9 + ["NA", "n/a", "--", "nil", "NAN", "Null"]
    assert sorted((r["value"] or "-") for r in tb.clean_cells(df, blank_first=False).collect()) == ["-", "N/A", "a", "b"]


def test_gates_scores_best(spark):
    lit = F.lit
    assert one(spark, tb.passes_gate(lit(0.35), lit(5), lit(5), lit(9)), tb.passes_gate(lit(0.45), lit(5), lit(5), lit(2)))[:] == (False, True)
    rows = [("d", 1, 1, "camelot_stream", 2, 2, 96.0, 0.8, 0), ("d", 1, 2, "pdfplumber", 2, 2, None, 1.0, 0)]
    t = spark.createDataFrame(rows, schemas.TABLE_META)
    sc = t.select(tb.table_score(F.col("content_quality"), F.col("accuracy"), F.col("financial_score"), F.col("rows"), F.col("cols"), F.col("method"))).collect()
    assert [round(r[0], 2) for r in sc] == [4.04, 2.22] or [round(r[0], 2) for r in sc] == [3.84, 2.22]
    assert tb.best_table_per_page(t).first()["method"] == "camelot_stream"
    again = tb.best_table_per_page(tb.best_table_per_page(t))
    assert again.count() == 1
    assert [one(spark, tb.size_class(lit(n)))[0] for n in (20, 21, 100, 101, 400, 401)] == ["small", "medium", "medium", "large", "large", "very_large"]


def test_layout(spark):
    w = lambda i, t, x, text="w": ("d", 1, i, text, float(x), float(x) + 10, float(t), float(t) + 8)
    words = spark.createDataFrame([w(0, 10, 0, "a"), w(1, 15, 109, "b"), w(2, 15.5, 219, "c")], schemas.WORDS)
    assert sorted(r["text"] for r in layout.word_blocks(words).collect()) == ["a b", "c"]
    lines = spark.createDataFrame([w(0, 10, 0, "a"), w(1, 14, 20, "b"), w(2, 18, 0, "c")], schemas.WORDS)
    assert sorted(r["text"] for r in layout.word_lines(lines).collect()) == ["a b", "c"]
    page = spark.createDataFrame([w(0, 1, 0, "running"), w(1, 1, 30, "head"), w(2, 50, 0, "body"), w(3, 95, 0, "footer-text")], schemas.WORDS)
    assert {(r["region"], r["text"]) for r in layout.regions(page).collect()} == {("header", "running head"), ("footer", "footer-text")}
    assert layout.titles(page).count() == 1
    assert one(spark, layout.routing(s("Table")), layout.routing(s("Figure")))[:] == ("camelot", "image_store")


def test_entropy_of_equal_values_is_zero(spark):
    df = spark.createDataFrame([("a", 3), ("a", 3), ("b", 1), ("b", 2)], "k string, v int")
    assert {r["k"]: r["entropy"] for r in quality.histogram_entropy(df, ["k"], "v").collect()} == {"a": 0.0, "b": 1.0}


def test_trend_needs_three_points(spark):
    d = datetime.date
    h = spark.createDataFrame([("a", d(2024, 1, 1), 1.0), ("a", d(2024, 1, 2), 2.0)] + [("b", d(2024, 1, i), float(i)) for i in range(1, 5)], "metric string, ts date, value double")
    assert {r["metric"]: r["direction"] for r in monitor.trend(h).collect()} == {"a": "insufficient_data", "b": "increasing"}


def test_flatten_metrics(spark):
    df = spark.createDataFrame([("x", ((1.0, 2), 3.0, "t"))], "id string, m struct<a:struct<b:double,c:int>,d:double,e:string>")
    assert {(r["metric"], r["value"]) for r in monitor.flatten_metrics(df, ["id"], "m").collect()} == {("a.b", 1.0), ("a.c", 2.0), ("d", 3.0)}


def test_cascade_gives_one_row_a_label(spark):
    labels = spark.createDataFrame([(1, "revenue"), (2, "revenues x"), (3, "zzz"), (4, "revenue")], "label int, clean_label string")
    rules = spark.createDataFrame([("revenue", "Revenues")], "clean_label string, concept string")
    terms = spark.createDataFrame([("revenues", "Revenues"), ("assets", "Assets")], "term string, concept string")
    got = {r["label"]: (r["concept"], r["method"]) for r in mapping.cascade(labels, rules, terms).collect()}
    assert got == {1: ("Revenues", "exact"), 2: ("Revenues", "fuzzy"), 3: (None, "none"), 4: ("Revenues", "exact")}
    st = mapping.strategies(labels, spark.createDataFrame([("Revenue",), ("Assets",)], "concept string"), spark.createDataFrame([("revenues", "Revenue")], "term string, concept string"))
    assert {r["label"]: r["method"] for r in st.collect()} == {1: "exact", 2: "synonym", 3: "none", 4: "exact"}


def test_strategies_end_with_tfidf(spark):
    concepts = spark.createDataFrame([("Revenue",), ("Assets",), ("Cash",)], "concept string")
    synonyms = spark.createDataFrame([("net sales", "Revenue"), ("sales", "Revenue"), ("property plant equipment", "Assets"), ("liquid funds", "Cash")], "term string, concept string")
    texts = ["equipment plant property", "revenue", "sales net", "liquid matter of quite other kinds", "zzz", ""]
    labels = spark.createDataFrame(list(enumerate(texts)) + [(9, None), (10, "sales net")], "label int, clean_label string")
    got = {r["label"]: r for r in mapping.strategies(labels, concepts, synonyms).collect()}
    assert {k: (r["concept"], r["method"]) for k, r in got.items()} == {0: ("Assets", "tfidf"), 1: ("Revenue", "exact"), 2: ("Revenue", "synonym"), 3: (None, "none"), 4: (None, "none"), 5: (None, "none"), 9: (None, "none"), 10: ("Revenue", "synonym")}
    assert got[2]["confidence"] == pytest.approx(10 / 14)  # difflib's ratio to "sales": the synonym's "net" goes, that of the label is not in front
    got = {r["label"]: r for r in mapping.strategies(labels, concepts, synonyms, least=0.8).collect()}
    assert {k: got[k]["method"] for k in (2, 10)} == {2: "tfidf", 10: "tfidf"}
    # idf over 5 different labels and 3 concepts; the concept's text is "revenue net sales sales"
    n = 8
    w = {t: math.log((1 + n) / (1 + df)) + 1 for t, df in (("revenue", 2), ("net", 2), ("sales", 2))}
    dot, a, b = w["net"] ** 2 + 2 * w["sales"] ** 2, math.hypot(w["net"], w["sales"]), math.hypot(w["revenue"], w["net"], 2 * w["sales"])
    assert got[2]["confidence"] == pytest.approx(dot / a / b, abs=1e-6) and got[4]["confidence"] == 0
    assert {r["method"] for r in mapping.strategies(labels.where("label = 2"), concepts, synonyms, least=0.8, least_cosine=0.99).collect()} == {"none"}


def test_tfidf_of_all_words(spark, tmp_path, monkeypatch):
    from tallyforge.plans import text_queries

    texts = [(1, "it is so"), (2, "ÉTÉ à la mer"), (3, "zzz"), (4, None), (5, "The sea"), (6, "of")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "so it is"), (2, "été mer"), (3, "the sea, the sea"), (4, "t")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def got():
        return {r["query"]: (r["doc"], r["cosine"]) for r in text_queries.document_tfidf_map(spark, str(tmp_path)).collect()}

    want = {1: (1, 1.0), 2: (2, 1.0), 3: (None, None), 4: (None, None), 5: (3, 1.0), 6: (None, None)}
    assert got() == want
    monkeypatch.setattr(mapping, "SMALL_POSTINGS", 0)
    assert got() == want
    assert one(spark, tx.tokens(s("The cafe\u0301 is OPEN_24"), ("the", "is")))[0] == ["cafe\u0301", "open", "24"]


def test_range_join_equals_brute_force(spark):
    import random

    rnd = random.Random(3)
    a = [(i, rnd.choice([-1, 1]) * 10 ** rnd.uniform(-2, 6)) for i in range(200)] + [(900, 0.0), (901, None)]
    b = [(i, x * rnd.uniform(0.8, 1.25)) for i, x in a if x] + [(950, 0.0)]
    got = {(r["left_id"], r["right_id"]) for r in rc.value_range_join(spark.createDataFrame(a, "id int, value double"), spark.createDataFrame(b, "id int, value double")).collect()}
    want = {(i, j) for i, x in a if x is not None for j, y in b if (x > 0) == (y > 0) and (x < 0) == (y < 0) and abs(x - y) <= 0.1 * max(abs(x), abs(y))}
    assert got == want
    n = rc.range_partners(spark.createDataFrame(a, "id int, value double"), spark.createDataFrame(b + b, "id int, value double"))
    assert sum(r["partners"] for r in n.collect()) == 2 * len(want)


def test_file_names(spark):
    got = one(spark, tx.document_attributes(s("tesla-10k-2023.pdf"), [("tesla", "Tesla Inc.", "tesla")]), tx.document_attributes(s("other.pdf"), []))
    assert tuple(got[0]) == ("tesla_2023", "Tesla Inc.", "2023") and got[1]["fiscal_year"] == "2024"
    assert tuple(one(spark, tx.table_file(s("acme_camelot_stream_p18_t22.csv")))[0]) == ("camelot_stream", 18, 22)
    assert one(spark, tx.clean_filename(s('a<b>:c"d')), nm.size_text(F.lit(1536)))[:] == ("a_b_c_d", "1.5 KB")


def test_records(spark):
    d = spark.createDataFrame([(1, 1, "hello"), (2, 0, "x"), (3, 1, " ")], "doc_id int, page int, text string")
    r = records.text_records(d, "doc_id", "page", "text", "nonsense", "m")
    assert {x["doc_id"]: x["e"] for x in r.select("doc_id", records.errors(required=r.columns[:6]).alias("e")).collect()} == {"1": ["bad block type"], "2": ["missing page", "bad block type"]}
    back = records.from_json(records.as_json(r), "doc_id string, page int, text string")
    assert {x["text"] for x in back.collect()} == {"hello", "x"}


def test_classes(spark):
    c = lambda t: one(spark, tx.classify(s(t)))[0]
    assert [c("Annual report"), c("OVERVIEW OF"), c("x" * 120 + " $5"), c("1. first " + "x" * 120), c("see table " + "x" * 120), c("x" * 120)] == ["heading", "subheading", "text_block", "list", "structured_content", "paragraph"]


def test_financial_values(spark, tmp_path):
    import duckdb

    from tallyforge.plans import text_queries

    texts = ["Net income was $1,234 and 5", "$2.50 million, then $3 BILLION, $7 mil", "up 12.5% to 1,234,567", "Total assets: none\nof 42", "cash 7", "no amount", "", None, "$1,000\nmilk 12345,678 €9,999"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    rows = text_queries.financial_values(spark, str(tmp_path)).collect()
    got = sorted((r["doc_id"], r["pattern_type"], r["context"], r["idx"], r["value"]) for r in rows)
    u = "unknown"
    assert got == sorted([
        (0, "contextual", "revenue", 0, 1234.0), (0, "contextual", "net_income", 0, 1234.0), (0, "currency_exact", u, 0, 1234.0), (0, "large_numbers", u, 0, 1234.0),
        (1, "currency_millions", u, 0, 2.5e6), (1, "currency_millions", u, 1, 7e6), (1, "currency_billions", u, 0, 3e9), (1, "currency_exact", u, 0, 2.5), (1, "currency_exact", u, 1, 3.0), (1, "currency_exact", u, 2, 7.0),
        (2, "percentage", u, 0, 12.5), (2, "large_numbers", u, 0, 1234567.0), (3, "contextual", "assets", 0, 42.0), (4, "contextual", "cash", 0, 7.0),
        (8, "currency_exact", u, 0, 1000.0), (8, "large_numbers", u, 0, 1000.0), (8, "large_numbers", u, 1, 9999.0),
    ])
    assert {r["original_text"] for r in rows if r["doc_id"] == 3} == {"total assets: none\nof 42"}
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.execute(f"SELECT doc_id, pattern_type, context, idx, value, original_text FROM ({text_queries.ORACLES['financial_values']})").fetchall()
    assert sorted(want) == sorted(tuple(r[k] for k in ("doc_id", "pattern_type", "context", "idx", "value", "original_text")) for r in rows)
    own = spark.range(1).select(F.explode(tx.financial_values(s("EBIT 9"), [("ebit", r"ebit (\d+)")], [])).alias("m")).select("m.*").collect()
    assert [(r["context"], r["value"]) for r in own] == [("ebit", 9.0)]


def test_sections(spark):
    got = one(spark, tx.sections(s("intro\n## One\nbody\nmore\n## Two\n")))[0]
    assert [(x["title"], x["content"]) for x in got] == [(None, "intro"), ("One", "body\nmore"), ("Two", "")]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "acme_pdfplumber_p2_t1.csv").write_text('Item,"A, B"\nx,"1,5"\ny,\n')
    (tmp_path / "t" / "_index.csv").write_text("a\n1\n")
    cells = readers.csv_cells(spark, str(tmp_path / "t")).collect()
    assert {(c["row_idx"], c["header"], c["value"]) for c in cells} == {(0, "Item", "x"), (0, "A, B", "1,5"), (1, "Item", "y"), (1, "A, B", None)} and cells[0]["doc_id"] == "acme"
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "q.csv").write_text('a,b\n"line one\nline two",5\n"he said ""no""",5" pipe\n,"' + 'x""' * 20_000 + '"\n\n3,\n')
    q = {(c["row_idx"], c["header"]): c["value"] for c in readers.csv_cells(spark, str(tmp_path / "q")).collect()}
    assert q == {(0, "a"): "line one\nline two", (0, "b"): "5", (1, "a"): 'he said "no"', (1, "b"): '5" pipe', (2, "a"): None, (2, "b"): 'x"' * 20_000, (3, "a"): "3", (3, "b"): None}
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.jsonl").write_text('{"doc_id":"a","page":1}\n\nbad\n{"doc_id":"b"}\n')
    assert {r["doc_id"] for r in readers.json_lines(spark, str(tmp_path / "j")).collect()} == {"a", "b"}
    x = '<x xmlns:g="urn:g" xmlns:i="urn:i"><i:context id="c1"><i:entity><i:identifier>E</i:identifier></i:entity><i:period><i:startDate>2024-01-01</i:startDate><i:endDate>2024-12-31</i:endDate></i:period></i:context><i:unit id="u"><i:measure>iso4217:USD</i:measure></i:unit><g:Revenues contextRef="c1" unitRef="u" decimals="0">1,200</g:Revenues></x>'
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.xml").write_text(x)
    (tmp_path / "x" / "b.xml").write_text("<broken")
    (tmp_path / "x" / "c.xml").write_text('<!DOCTYPE x [<!ENTITY a "aaaa">]><x>&a;</x>')
    parts = readers.xbrl_parts(spark, str(tmp_path / "x"))
    f = readers.facts(parts).first()
    assert (f["concept"], f["namespace"], f["numeric_value"], f["currency"], f["period_type"], str(f["end_date"])) == ("Revenues", "urn:g", 1200.0, "USD", "duration", "2024-12-31")
    assert parts.where("kind = 'error'").count() == 2
    doc = {"text": "t", "pages": [{"page_number": 1, "paragraphs": [], "lines": [{"text": "l1"}, {"text": "l2"}], "tables": [{"table_id": 0, "header_rows": [[{"text": "h"}]], "body_rows": [[{"text": "v"}]]}], "form_fields": [{"field_name": "n", "field_value": "v"}]}], "entities": [{"type": "T", "mention_text": "m", "page_refs": [{"page": 1}]}]}
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "d.json").write_text(json.dumps(doc))
    o = readers.json_documents(spark, str(tmp_path / "o")).drop("_corrupt_record").withColumn("doc_id", F.lit("d"))
    assert readers.ocr_pages(o).first()["text"] == "l1\nl2"
    assert {(r["is_header"], r["value"]) for r in readers.ocr_cells(o).collect()} == {(True, "h"), (False, "v")}
    assert readers.ocr_forms(o).count() == readers.ocr_entities(o).count() == 1
    rec = records.text_records(spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "doc_id int, page int, text string"), "doc_id", "page", "text", "paragraph", "m")
    sinks.save_formats(rec, str(tmp_path / "out"), ["page"])
    assert spark.read.text(str(tmp_path / "out" / "jsonl")).count() == 2
    with pytest.raises(ValueError):
        sinks.save_as(rec, str(tmp_path / "z"), "nope")
    assert "| n |" in reports.markdown("T", {"S": spark.createDataFrame([(1,)], "n int")})
    with pytest.raises(ValueError):
        readers.page_subset(rec, [0])


def test_reports_hold_every_row(spark):
    checks = spark.range(250).select(F.format_string("m%03d", "id").alias("metric"), (F.col("id") % 5 == 0).alias("passed"))
    none = spark.createDataFrame([], "n int")
    text = reports.regression_report({"checks": checks, "status": spark.createDataFrame([("FAIL",)], "status string"), "simulation": none})
    failed, rest = text.split("## Failed")[1].split("## All")
    names = [x.split(" | ")[0] for x in failed.splitlines() if x.startswith("| m") and "metric" not in x]
    assert names == [f"| m{i:03d}" for i in range(250) if i % 5] and rest.count("\n| m") == 251 and rest.split("## Simulated failures")[1].strip() == "none"


def test_stream(spark, tmp_path):
    t = datetime.datetime
    spark.createDataFrame([("ocr_rate", t(2024, 1, d), v) for d, v in ((1, 1.0), (2, 1.5), (3, 1.0), (9, 1.0))], "metric string, ts timestamp, value double").write.parquet(str(tmp_path / "in"))
    base = spark.createDataFrame([("ocr_rate", 1.0)], "metric string, baseline double")
    src = spark.readStream.schema("metric string, ts timestamp, value double").parquet(str(tmp_path / "in"))
    q = stream.start(stream.alert_stream(src, base), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert [(r["metric"], r["severity"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("ocr_rate", "critical")]


def test_bench_columns(spark):
    r = spark.createDataFrame([("a", 10.0, 5.0, 1.0, 50.0, 0, 0, 0), ("b", 20.0, 9.0, 1.0, 50.0, 4, 3, 1)], schemas.BENCH_RESULTS)
    d = {x["operation"]: x for x in bench.derive(r).collect()}
    assert d["a"]["runtime_per_page"] == 10.0 and d["a"]["success_percent"] == 0.0 and d["b"]["success_percent"] == 75.0 and d["b"]["pages_per_hour"] == 720.0
    assert bench.bottlenecks(bench.derive(r)).first()["avg_runtime_per_page"] == 7.5


def test_white_space_is_stripped_as_python_does(spark):
    texts = ["\t a b\n", "\x0b\x0c\r\x1c\x1d\x1e\x1f", "\u00a0x\u2003\u3000", "\x85y\u2028\u2029", "\u200bz\u200b", "", "  ", "\ufeffq"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.strip(F.col("t")).alias("s"), tx.route(F.col("t")).alias("r"))
    assert [r["s"] for r in df.orderBy("i").collect()] == [t.strip() for t in texts]
    white = spark.createDataFrame([("1", 1, "\n\t" * 60), ("1", 2, "\u00a0" * 60 + "word")], "doc_id string, page int, text string")
    assert {r["r"] for r in white.select(tx.route(F.col("text")).alias("r")).collect()} == {"failed"}
    assert [r["page"] for r in records.text_records(white, "doc_id", "page", "text", "paragraph", "x").collect()] == [2]
    assert one(spark, tx.classify(F.lit("\n\tSHOUTED\n")))[0] == "subheading"


def test_long_paragraphs_are_packed_by_sentence(spark):
    def plain(text, limit):
        out = []
        for para in text.split("\n\n"):
            para = para.strip()
            if len(para) < 15:
                continue
            if len(para) <= limit:
                out.append(para)
                continue
            held = ""
            for part in re.split(r"(?<=\.) ", para):
                if len(held) + len(part) <= limit:
                    held += part
                else:
                    out += [held.strip()] if held else []
                    held = part
            out += [held.strip()] if held else []
        return out

    rnd = random.Random(1)
    texts = ["\n\n".join(" ".join("w" * rnd.randint(1, 9) + rnd.choice(["", "", ".", "!", ". "]) for _ in range(rnd.randint(1, 60))) for _ in range(4)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.paragraphs(F.col("t"), limit=90).alias("p"))
    assert all(r["p"] == plain(texts[r["i"]], 90) for r in df.collect())


def test_sections_under_any_heading(spark):
    def plain(md):
        out, title, body = [], "Introduction", ""
        for line in md.split("\n"):
            if line.startswith("#"):
                out += [(title, body)] if body.strip() else []
                title, body = line.strip("# ").strip(), ""
            else:
                body += line + "\n"
        return out + ([(title, body)] if body.strip() else [])

    mds = ["a\nb\n# T #\nc\n\n## U\n### V\nd", "# only", "", "\n\n# x\n\n", "#\tq\nz\n", "x # y\n#z\n w \n"]
    df = spark.createDataFrame(list(enumerate(mds)), "i int, t string").select("i", tx.any_sections(F.col("t")).alias("s"))
    assert all([tuple(x) for x in r["s"]] == plain(mds[r["i"]]) for r in df.collect())


def test_token_sort_ratio(spark):
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rnd = random.Random(2)
    pairs = [("Net sales, total", "total net sales"), ("", "a"), ("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear"), ("a-b", "b a")] + [tuple("".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 20))) for _ in range(2)) for _ in range(100)]
    got = [r["s"] for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").orderBy("i").select(mapping.token_sort_ratio(F.col("a"), F.col("b")).alias("s")).collect()]
    for (a, b), s_ in zip(pairs, got):
        x, y = (" ".join(sorted(re.sub(r"[^\w]", " ", t.lower()).split())) for t in (a, b))
        assert s_ == (float(round(200 * lcs(x, y) / (len(x) + len(y)))) if x and y else 0.0), (a, b)


def test_records_have_all_columns(spark):
    r = records.text_records(spark.createDataFrame([("acme_2023", 1, "some text"), ("b", 0, "more text")], "doc_id string, page int, text string"), "doc_id", "page", "text", "paragraph", "pdfplumber_text")
    docs = spark.createDataFrame([("acme_2023", "Acme", "2023", "/a.pdf")], "doc_id string, company string, fiscal_year string, source_path string")
    full = records.completed(r, docs, "2024-05-06")
    assert full.schema.simpleString() == spark.createDataFrame([], schemas.RECORDS).schema.simpleString()
    bad = {x["doc_id"]: x["e"] for x in full.select("doc_id", records.errors().alias("e")).collect()}
    assert bad == {"acme_2023": [], "b": ["missing company", "missing fiscal_year", "missing source_path", "missing page"]}
    assert records.completed(r, None, "2024-05-06").select("doc_id", "company", "fiscal_year", "source_path").orderBy("doc_id").first()[1:] == ("Unknown Company", "2023", "acme_2023")
    assert len(records.BLOCK_TYPES) == len(set(records.BLOCK_TYPES)) == 30 and len(set(records.METHODS)) == 22
    a = records.analysis_records(spark.createDataFrame([("d", "# A\ntext\n## B\n"), ("e", " \n")], "doc_id string, markdown string"), "m")
    assert [x["text"] for x in a.collect()] == ["Document of 14 characters and 2 headings: # A\ntext\n## B\n"]
    assert not records.completed(a, docs.select(F.lit("d").alias("doc_id"), "company", "fiscal_year", "source_path"), "2024-05-06").select(records.errors().alias("e")).first()["e"]


def test_enhanced_tables(spark):
    t = lambda n, rows: [("d", "m", 1, n, i, j, None, v) for i, r in enumerate(rows) for j, v in enumerate(r)]
    cells = spark.createDataFrame(t(1, [["Item", "2024"], ["Cash", "12"]]) + t(2, [["x", "y"], ["1", "2"]]) + t(3, [["Name", "Other"]]) + t(4, [["ab", None], ["cd", None]]), schemas.CELLS)
    ids = lambda df: {r["table_num"] for r in df.collect()}
    assert ids(tb.enhance(cells)) == {1} and ids(tb.enhance(cells, 0.0)) == {1, 2}
    both = tb.enhance(cells, keep_poor=True)
    assert both.count() == cells.count() and ids(both.where("enhanced")) == {1}


def test_small_operators(spark):
    pages = spark.createDataFrame([(i, f"p{i}") for i in range(1, 6)], "page int, text string")
    assert [r["page"] for r in readers.page_subset(pages, [2, 5]).orderBy("page").collect()] == [2, 5] and readers.page_subset(pages, n=3, seed=1).count() == 3
    for wrong in ({"wanted": [6]}, {"wanted": [0]}, {"n": 6}):
        with pytest.raises(ValueError):
            readers.page_subset(pages, **wrong)
    files = spark.createDataFrame([("a", 1), ("b", 3), ("c", 3)], "file string, modified int")
    assert [r["file"] for r in readers.newest(files, n=2).collect()] == ["c", "b"]
    assert rc.reorder(pages, ["text", "none"]).columns == ["text", "page"]
    nested = spark.createDataFrame([((1, ("x",)),)], "a struct<b:int,c:struct<d:string>>")
    assert one_row(nested.select(monitor.nested_value(nested, "a.c.d").alias("x"), monitor.nested_value(nested, "a.z", 7).alias("y"))) == ("x", 7)
    h = monitor.synthetic_history(spark, {"m": (10.0, 1.0), "n": (0.0, 0.0)}, days=5)
    assert h.count() == 10 and {r["value"] for r in h.where("metric = 'n'").collect()} == {0.0}
    facts = spark.createDataFrame([("b", None, None), ("a", "2024-01-01", None), ("a", None, "2024-01-01"), (None, None, None)], "concept string, end_date string, instant_date string")
    assert [r["concept"] for r in facts.orderBy(*rc.fact_order()).collect()] == ["a", "a", "b", None]


def one_row(df):
    return tuple(df.first())


def test_large_lexicons_are_compared_in_lots(spark, monkeypatch):
    labels = spark.createDataFrame([(i, f"net sales {i % 7}") for i in range(20)], "label int, clean_label string")
    terms = spark.createDataFrame([(f"net sales {i}", f"c{i}") for i in range(9)] + [("other", "o")], "term string, concept string")
    run = lambda: sorted(map(tuple, mapping.fuzzy(labels, terms, "edit").collect()))
    whole, columns = run(), spark.createDataFrame([(c, i) for i, c in enumerate(("Sales 2024", "Sales", "Costs"))], "column string, col_idx int")
    asked = spark.createDataFrame([("sales",), ("Costs",), ("none",)], "label string")
    found = {r["label"]: r["column"] for r in rc.resolve_column(asked, columns).collect()}
    assert found == {"sales": "Sales 2024", "Costs": "Costs", "none": None}
    monkeypatch.setattr(mapping, "SMALL_DIMENSION", 2)
    assert run() == whole and {r["label"]: r["column"] for r in rc.resolve_column(asked, columns).collect()} == found
