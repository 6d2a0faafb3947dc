"""The end-to-end workflows and reports on worked cases."""

import datetime
import json

from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.operators import bench, mapping, monitor, records, reconcile as rc, tables as tb
from tallyforge.plans import workflows as wf
from tallyforge.sources import readers, reports, sinks


def cells(spark, tables):
    rows = [(d, m, p, t, r, c, None, v) for (d, m, p, t), grid in tables.items() for r, line in enumerate(grid) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, schemas.CELLS)


GOOD = [["Item", "Total Revenue"], ["north", "1,000"], ["south", "500"]]


def test_documents_to_records(spark, tmp_path):
    words = spark.createDataFrame([("acme", 1, i, w, 10.0 + 40 * i, 45.0 + 40 * i, t, t + 8) for i, (w, t) in enumerate((("Annual", 1.0), ("Report", 1.0), ("body", 60.0), ("end", 95.0)))], schemas.WORDS)
    pages = spark.createDataFrame([("acme", 1, "First paragraph of this page, long enough.\n\nshort"), ("acme", 2, "")], "doc_id string, page int, text string")
    c = cells(spark, {("acme", "pdfplumber", 1, 1): GOOD, ("acme", "camelot_stream", 1, 1): GOOD, ("acme", "pdfplumber", 2, 1): [["", None], [None, ""]]})
    s = spark.createDataFrame([("acme", 1, "One", "x" * 2000), ("acme", 2, "Two", "too short")], "doc_id string, section_number int, title string, content string")
    found = wf.document_pipeline(pages, words, c, s)
    assert [(r["method"], r["page"]) for r in found["tables"].collect()] == [("camelot_stream", 1)]
    got = {(r["block_type"], r["page"]) for r in found["records"].collect()}
    assert ("table", 1) in got and ("header", 1) in got and ("docling_section", 1) in got and ("docling_section", 2) not in got
    table = found["records"].where("block_type = 'table'").first()
    assert table["text"].splitlines() == ["Table Headers: Item, Total Revenue", "Row 1: north | 1,000", "Row 2: south | 500"] and (table["table_info"]["rows"], table["table_info"]["cols"]) == (2, 2)
    assert len(found["records"].where("block_type = 'docling_section'").first()["text"]) == 1503
    assert found["rejected"].count() == 0 and found["completeness"].first()["has_tables"]
    assert {r["reading_order"] for r in found["blocks"].collect()} == set(range(1, found["blocks"].count() + 1))
    wf.save_document_pipeline(found, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out" / "formats" / "jsonl")).count() == found["records"].count()
    assert {r["status"] for r in wf.overall_status({"a": found["tables"], "b": found["rejected"]}).collect()} == {"success", "empty"}


def test_tables_against_facts(spark):
    c = tb.infer_headers(tb.clean_cells(cells(spark, {("acme_2024", "pdfplumber", 1, 1): GOOD, ("other", "pdfplumber", 1, 1): GOOD})))
    d = datetime.date
    rows = [("acme.xml", "Revenues", "1500", 1500.0, "c1", d(2024, 12, 31), None), ("acme.xml", "Revenues", "1500", 1500.0, "c1", d(2024, 12, 31), None), ("acme.xml", "Revenues", "9", 9.0, "c0", d(2023, 12, 31), None), ("acme.xml", "Revenues", "7", 7.0, "c2", d(2024, 12, 31), "segment")]
    facts = spark.createDataFrame(rows, "source_file string, concept string, value_text string, numeric_value double, context_id string, end_date date, segment string").withColumn("instant_date", F.lit(None).cast("date"))
    rules = spark.createDataFrame([("total revenue", "Revenues"), ("revenue", "Revenues")], "clean_label string, concept string")
    terms = spark.createDataFrame([("revenue", "Revenues")], "term string, concept string")
    ok = wf.cross_verify(c, facts, rules, terms)
    assert sorted((r["doc_id"], r["source_file"]) for r in ok["pairs"].collect()) == [("acme_2024", "acme.xml"), ("other", None)]
    assert ok["discrepancies"].count() == 0 and "Status: PASS" in reports.reconciliation_report(ok)
    off = wf.cross_verify(c, facts.withColumn("numeric_value", F.col("numeric_value") * 2), rules, terms)
    wrong = ("Total Revenue", 1500.0, 3000.0, "critical")
    assert sorted((r["doc_id"], r["label"], r["pdf_value"], r["fact_value"], r["severity"]) for r in off["discrepancies"].collect()) == [("acme_2024", *wrong), ("other", *wrong)]  # without a partner all files count
    two = wf.cross_verify(c, facts.unionByName(facts.withColumn("source_file", F.lit("beta.xml"))), rules, terms)
    assert [(r["doc_id"], r["fact_value"]) for r in two["discrepancies"].collect()] == [("other", 3000.0)]
    assert "Status: FAIL" in reports.reconciliation_report(off)


def test_evaluation(spark):
    t = datetime.datetime
    history = spark.createDataFrame([("ocr_rate", t(2024, 1, i), v) for i, v in ((1, 1.0), (2, 1.5), (3, 2.0))], "metric string, ts timestamp, value double")
    rules = spark.createDataFrame([("ocr_rate", ">=", 3.0)], "metric string, op string, expected double")
    pages = spark.createDataFrame([("a", 1, "some text", "pdfplumber")], "doc_id string, page int, text string, extraction_method string")
    tables = spark.createDataFrame([("a", 1, 1, "pdfplumber", 3, 2, None, 0.9, 4), ("a", 1, 1, "camelot_stream", 3, 4, 90.0, 0.5, 0)], schemas.TABLE_META)
    results = spark.createDataFrame([("x", 10.0, 50.0, 1.0, 50.0, 5, 5, 0), ("y", 0.0, 0.0, 0.0, 0.0, 0, 0, 0)], schemas.BENCH_RESULTS)
    found = wf.evaluation_suite(pages, tables, history, rules, results)
    assert found["status"].first()["status"] == "FAIL" and found["alerts"].first()["severity"] == "critical"
    assert {r["method"]: r["median_cells"] for r in found["structure"].collect()} == {"pdfplumber": 6.0, "camelot_stream": 12.0}
    rates = {r["operation"]: (r["pages_per_second"], r["efficiency_score"], r["resource_efficiency"]) for r in found["throughput"].collect()}
    assert rates == {"x": (0.5, 0.01, 18.0), "y": (0.0, 0.0, 0.0)}
    for make in (reports.quality_report, reports.regression_report, reports.drift_report, reports.benchmark_report, reports.metrics_report):
        assert make(found).startswith("# ")
    assert "Status: FAIL" in reports.regression_report(found)


def test_two_systems(spark):
    s = "doc_id string, page int, text string, block_type string"
    a = spark.createDataFrame([("d", 1, "x" * 10, "paragraph"), ("d", 2, "x", "table")], s)
    b = spark.createDataFrame([("d", 1, "x" * 40, "paragraph"), ("d", 3, "y", "paragraph")], s)
    got = {r["page"]: (r["text_ratio"], r["table_difference"], r["finding"]) for r in wf.compare_systems(a, b).collect()}
    assert got == {1: (0.25, 0, "much_less"), 2: (None, 1, "missing"), 3: (0.0, 0, "much_less")}


def test_fact_categories(spark):
    f = spark.createDataFrame([(1, "NetIncomeLoss", 5.0, "c", None), (2, "netincome", 9e6, None, "USD"), (3, "Assets", 1.0, "c", "u"), (4, None, 1.0, "c", "u"), (5, "Assets", None, "c", "u")], "seq int, concept string, numeric_value double, context_id string, unit string")
    c = rc.categorise(f)
    assert {(r["seq"], r["category"]) for r in c.collect()} == {(1, "net_income"), (2, "net_income"), (3, "total_assets"), (5, "total_assets")}
    assert {(r["category"], r["seq"]) for r in rc.best_fact(c, ["category"], "seq").collect()} == {("net_income", 2), ("total_assets", 3)}
    assert rc.category_tops(c.withColumn("p", F.lit(1)), "seq", "p", n=1).count() == 2


def test_tracked_metrics(spark):
    e = spark.createDataFrame([("a", 1, "performance.overall_success_rate", 0.5), ("b", 2, "performance.overall_success_rate", 0.9)], "id string, ts int, metric string, value double")
    got = {r["metric"]: r["value"] for r in monitor.tracked_metrics(e).collect()}
    assert len(got) == 14 and got.pop("performance.overall_success_rate") == 0.9 and set(got.values()) == {0.0}
    assert monitor.tracked_metrics(e.limit(0)).count() == 0


def test_pairings_and_files(spark, tmp_path):
    n = lambda *xs: spark.createDataFrame([(x,) for x in xs], "name string")
    got = {r["name"]: r["partner"] for r in mapping.pair_directories(n("goog_2024", "plain", "ms_2023"), n("goog-10k-2024", "goog-10q-2023", "goog-a-2024")).collect()}
    assert got == {"goog_2024": "goog-10k-2024", "plain": None, "ms_2023": None}
    (tmp_path / "a.csv").write_text("x" * 1024)
    info = readers.page_info(spark, str(tmp_path))
    assert info.first()["size_mb"] == 1 / 1024
    index = spark.createDataFrame([("a.csv",), ("b.csv",)], "filename string")
    assert [r[0] for r in readers.existing_only(index, info).collect()] == ["a.csv"]


def test_objects_structure_and_counts(spark):
    o = spark.createDataFrame([("d", 1, "line", 1.0, 2.0, 3.0, 4.0), ("d", 1, "line", 0.0, 5.0, 2.0, 9.0), ("d", 1, "image", 0.0, 0.0, 1.0, 1.0)], "doc_id string, page int, kind string, x0 double, top double, x1 double, bottom double")
    got = {(r["block_type"], r["text"], tuple(r["bbox"])) for r in records.object_records(o).collect()}
    assert got == {("diagram", "2 line", (0.0, 2.0, 3.0, 9.0)), ("image", "1 image", (0.0, 0.0, 1.0, 1.0))}
    docs = spark.createDataFrame([("d", "m" * 600, "t"), ("e", None, None)], "doc_id string, markdown string, text string")
    tables = spark.createDataFrame([("d", 2, 3, 4), ("d", 1, 1, 1)], "doc_id string, table_num int, rows int, cols int")
    s = {r["doc_id"]: r for r in records.structure_summary(docs, tables).collect()}
    assert s["d"]["n_tables"] == 2 and [x["rows"] for x in s["d"]["shapes"]] == [1, 3] and len(s["d"]["preview"]) == 500 and s["e"]["n_tables"] == 0
    ocr = spark.createDataFrame([(None,) * 4], schemas.OCR_DOCUMENTS.replace("text STRING", "doc_id STRING, text STRING", 1))
    r = records.layout_counts(ocr).first()
    assert (r["n_pages"], r["n_tables"], r["has_tables"], r["n_entities"]) == (0, 0, False, 0)


def test_volume_tiers(spark):
    assert [spark.range(1).select(bench.volume_tier(F.lit(n))).first()[0] for n in (999, 1000, 10000)] == ["small", "medium", "large"]


def test_latest_period_keeps_null_keys(spark):
    d = datetime.date
    f = spark.createDataFrame([(1, "a", d(2024, 1, 1), None), (2, "a", d(2023, 1, 1), None), (3, "b", None, d(2022, 1, 1)), (4, "b", None, d(2021, 1, 1)), (5, "c", None, None), (6, None, d(2020, 1, 1), None), (7, None, d(2019, 1, 1), None)], "seq int, concept string, end_date date, instant_date date")
    assert sorted(r["seq"] for r in rc.latest_period(f).collect()) == [1, 3, 5, 6]


def test_median_of_differences(spark):
    f = spark.createDataFrame([("critical", 20.0), ("minor", 1.0), ("missing_data", None)], "severity string, percentage_difference double")
    assert [rc.severity_counts(f, exact=e).first()["median_pct"] for e in (True, False)] == [1.0, 1.0]


def test_sessions_and_rules(spark, tmp_path):
    one = spark.createDataFrame([(1,)], "n int")
    for session, df in (("a", one), ("b", one), ("a", one.unionByName(one))):
        sinks.save_session({"x": df}, str(tmp_path / "s"), session)
    assert {(r["session_id"], r["count"]) for r in spark.read.parquet(str(tmp_path / "s" / "x")).groupBy("session_id").count().collect()} == {("a", 2), ("b", 1)}
    rules = lambda *xs: spark.createDataFrame(xs, "clean_label string, concept string")
    sinks.export_rules(rules(("sales", "Revenues"), ("cash", "Cash")), str(tmp_path / "r"))
    got = sinks.import_rules(rules(("sales", "Old"), ("debt", "Debt")), str(tmp_path / "r"))
    assert {tuple(r) for r in got.collect()} == {("sales", "Revenues"), ("cash", "Cash"), ("debt", "Debt")}


def test_ocr_and_structure_sinks(spark, tmp_path):
    page = {"page_number": 1, "paragraphs": [{"text": "p"}], "tables": [{"table_id": 0, "header_rows": [[{"text": "h"}]], "body_rows": [[{"text": "v"}]]}], "form_fields": [{"field_name": "n", "field_value": "v"}]}
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "d.json").write_text(json.dumps({"text": "t", "pages": [page], "entities": [{"type": "T", "mention_text": "m", "page_refs": [{"page": 1}]}]}))
    docs = readers.json_documents(spark, str(tmp_path / "o")).drop("_corrupt_record").withColumn("doc_id", F.lit("d"))
    sinks.save_ocr(docs, str(tmp_path / "out"))
    assert [spark.read.json(str(tmp_path / "out" / n)).count() for n in ("pages", "cells", "forms", "entities", "summary")] == [1, 2, 1, 1, 1]
    assert spark.read.json(str(tmp_path / "out" / "summary")).first()["n_paragraphs"] == 1
    whole = spark.createDataFrame([("d", "# T\nbody", "body"), ("e", None, None)], "doc_id string, markdown string, text string")
    tables = spark.createDataFrame([("d", 1, 2, 2)], "doc_id string, table_num int, rows int, cols int")
    sinks.save_structure(whole, tables, str(tmp_path / "m"))
    assert {r["doc_id"]: r["n_tables"] for r in spark.read.json(str(tmp_path / "m" / "structure")).collect()} == {"d": 1, "e": 0}


def test_fallback_records(spark):
    pages = spark.createDataFrame([("acme_2023", 1, "First page"), ("acme_2023", 2, "\t\n")], "doc_id string, page int, text string")
    c = cells(spark, {("acme_2023", "pdfplumber", 1, 1): GOOD}).withColumn("header", F.concat(F.lit("H"), F.col("col_idx").cast("string")))
    boxes = spark.createDataFrame([("acme_2023", 1, 1, "Text", None, (0.0, 0.0, 1.0, 1.0), 2, None, None, "block text")], schemas.LAYOUT_BLOCKS)
    s = spark.createDataFrame([("acme_2023", i, f"S{i}", "x" * 60) for i in range(1, 13)], "doc_id string, section_number int, title string, content string")
    found = wf.fallback_records(pages, c, boxes, s, extracted_at="2024-01-01")
    kinds = {r["block_type"]: r["n"] for r in records.type_counts(found, []).collect()}
    assert kinds == {"text_block": 1, "table": 1, "layout_block": 1, "docling_section": 10}
    assert found.where(F.size(records.errors()) > 0).count() == 0
    assert {r["company"] for r in found.collect()} == {"Unknown Company"} and {r["fiscal_year"] for r in found.collect()} == {"2023"}


def test_facts_are_written_in_order(spark, tmp_path):
    f = spark.createDataFrame([("b", None, 1.0, "f"), ("a", "2024-02-01", 2.0, "f"), ("a", "2024-01-01", 3.0, "f")], "concept string, end_date string, numeric_value double, source_file string").withColumn("instant_date", F.lit(None).cast("string"))
    sinks.save_facts(f.coalesce(1), str(tmp_path / "facts"))
    got = spark.read.option("header", True).csv(str(tmp_path / "facts"))
    assert got.columns == ["source_file", "concept", "numeric_value", "end_date", "instant_date"] and [r["numeric_value"] for r in got.collect()] == ["3.0", "2.0", "1.0"]


def test_partner_does_not_hang_on_partitions(spark):
    left, right = spark.createDataFrame([("acme_x", 0)], "name string, seq int"), spark.createDataFrame([("acme_c", 0), ("acme_b", 0), ("acme_a", 1)], "name string, seq int")
    assert {mapping.pair_by_tokens(left, right.repartition(n)).first()["partner"] for n in (1, 2, 3, 5)} == {"acme_b"}


def test_consistency_of_methods(spark):
    t = spark.createDataFrame([("a", 1, 1, "pdfplumber", 4, 2, None, 0.9, 4), ("a", 1, 1, "camelot_stream", 2, 2, 90.0, 0.5, 0), ("a", 1, 2, "camelot_stream", 9, 9, 90.0, 0.5, 0), ("a", 1, 3, "camelot_stream", 9, 9, 90.0, 0.5, 0), ("a", 2, 1, "pdfplumber", 1, 1, None, 0.5, 0)], schemas.TABLE_META)
    r = tb.consistency(t).first()
    assert (r["n_pages"], r["n_overlap"], r["overlap_ratio"]) == (2, 1, 0.5)
    assert round(r["count_similarity"], 4) == round(1 - 2**0.5 / 2, 4)  # counts 1 and 3: the sample's deviation
    assert round(r["structure_similarity"], 4) == round((1 - 2 / 6 + 1) / 2, 4)


def test_diagnosis(spark):
    v = lambda x: F.lit(x)
    d = spark.range(1).select(rc.diagnose(v(10), v(4), v(2), v(1.0), v(2.5), v(1), v(0.5), v(4)).alias("d")).first()["d"]
    assert d["match_rate"] == 0.5 and d["causes"] == ["scales differ", "look-alike characters"]
    texts = spark.createDataFrame([(i, "O1" if i < 5 else "12") for i in range(30)], "i int, t string")
    assert rc.lookalikes(texts, "t", ["i"]).first()[0] == 5


def test_financial_tables(spark):
    got = spark.createDataFrame([("december",), ("a fiscal year",), ("x $ y",), ("equity only",), ("liabilities",)], "t string").select(tb.is_financial(F.col("t"))).collect()
    assert [r[0] for r in got] == [True, True, True, False, False]


def test_runs_are_archived_and_outputs_checked(spark, tmp_path):
    for run in ("r1", "r2", "r3"):
        (tmp_path / "runs" / run / "text").mkdir(parents=True)
        (tmp_path / "runs" / run / "text" / "page_1.txt").write_text(f"text of {run}")
        (tmp_path / "runs" / run / "text" / "_index.csv").write_text("a,b")
    (tmp_path / "runs" / "r1" / "empty").mkdir()
    (tmp_path / "runs" / "r1" / "empty" / "x.json").write_text("")
    e = spark.createDataFrame([("pages", "text", "^page_", 1), ("words", "text", "^words", 1), ("blank", "empty", "json$", 1), ("two pages", "text", "^page_", 2)], "output string, folder string, pattern string, least int")
    got = {r["output"]: (r["n_files"], r["status"]) for r in wf.output_checks(spark, str(tmp_path / "runs" / "r1"), e).collect()}
    assert got == {"pages": (1, "passed"), "words": (0, "failed"), "blank": (1, "failed"), "two pages": (1, "failed")}
    hidden = spark.createDataFrame([("index", "text", "^_index", 1)], "output string, folder string, pattern string, least int")
    assert wf.output_checks(spark, str(tmp_path / "runs" / "r1"), hidden).first()["status"] == "passed"
    assert wf.output_checks(spark, str(tmp_path / "nothing"), e).where("status = 'failed'").count() == 4
    registry = spark.createDataFrame([(r, str(tmp_path / "runs" / r), r != "r3") for r in ("r1", "r2", "r3", "r4")], "run_id string, run_directory string, archive boolean")
    gone = sinks.archive_runs(registry, str(tmp_path / "archive"))
    assert sorted(r["run_id"] for r in gone.collect()) == ["r1", "r2"]
    assert sorted(p.name for p in (tmp_path / "runs").iterdir()) == ["r3"]
    assert (tmp_path / "archive" / "r2" / "text" / "page_1.txt").read_text() == "text of r2" and (tmp_path / "archive" / "r1" / "text" / "_index.csv").exists() and (tmp_path / "archive" / "r1" / "empty" / "x.json").exists()
    assert sinks.archive_runs(registry, str(tmp_path / "archive")).count() == 0
