"""The end-to-end workflows: documents to records, tables against facts, evaluation, two systems side by side.

Each takes DataFrames of the data model (see ``schemas``) and returns named DataFrames; nothing runs until one is read or written.
All documents go through one plan together; there is no loop over them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .. import schemas
from ..functions import numeric as nm, text as tx
from ..operators import bench, layout, mapping, monitor, quality, reconcile as rc, records, scan, tables as tb
from ..sources import scratch, sinks


def tables_of(cells: DataFrame, accuracy: DataFrame | None = None, hybrid: bool = True) -> tuple[DataFrame, DataFrame]:
    """(cells, tables) that are kept: cleaned, headed and scored; then the best of each page among those that pass F4 (``hybrid``), or the
    best of each signature among those that pass S4.

    ``accuracy`` (doc_id, method, page, table_num, accuracy) comes from the extraction, where the method reports any.
    """
    clean = tb.infer_headers(tb.clean_cells(cells))
    scored = tb.score_tables(clean)
    scored = scored.join(accuracy, tb.TABLE, "left") if accuracy is not None else scored.withColumn("accuracy", F.lit(None).cast("double"))
    gate = tb.passes_gate(F.col("content_quality"), F.col("rows"), F.col("cols"), F.col("financial_score")) if hybrid else tb.page_gate(F.col("page"), F.col("content_quality"))
    good = scored.where(gate)
    kept = tb.best_table_per_page(good) if hybrid else tb.dedupe_tables(good)
    return clean.join(kept.select(*tb.TABLE), tb.TABLE, "left_semi"), kept


def document_pipeline(pages: DataFrame, words: DataFrame, cells: DataFrame | None = None, sections: DataFrame | None = None, accuracy: DataFrame | None = None, hybrid: bool = True, documents: DataFrame | None = None, extracted_at="2000-01-01", objects: DataFrame | None = None) -> dict[str, DataFrame]:
    """Pages, words, candidate tables and markdown sections of many documents to blocks, tables, one union of records, and what is complete.

    pages(doc_id, page, text), words(WORDS), cells(CELLS without headers), sections(doc_id, section_number, title, content),
    documents(DOCUMENTS); without these, company and year come from documents' names. ``extracted_at`` stamps the records. Without ``cells`` the
    tables are scanned from the words and the drawn ``objects`` (OBJECTS).
    """
    if cells is None:
        cells, accuracy = scan.scan(words, objects if objects is not None else words.sparkSession.createDataFrame([], schemas.OBJECTS))
    kept, tables = tables_of(cells, accuracy, hybrid)
    blocks = layout.word_blocks(words).withColumn("type", F.lit("Text"))
    heads = layout.titles(words).withColumn("type", F.lit("Title"))
    boxes = layout.block_ids(blocks.unionByName(heads)).withColumn("route", layout.routing(F.col("type")))
    parts = pages.select("doc_id", "page", F.posexplode(tx.paragraphs(F.col("text"))).alias("i", "text"))
    found = [
        records.text_records(parts, "doc_id", "page", "text", tx.classify(F.col("text")), "pdfplumber"),
        records.table_records(kept),
        records.text_records(layout.regions(words), "doc_id", "page", "text", F.col("region"), "pdfplumber", 0.8),
    ]
    if sections is not None:
        found.append(records.section_records(sections))
    every = records.completed(records.union(*found), documents, extracted_at).withColumn("errors", records.errors())
    return {
        "blocks": layout.reading_order(boxes, ["doc_id", "page"], ["bounding_box.y1", "bounding_box.x1", "block_id"]),
        "cells": kept, "tables": tables, "methods": tb.method_summary(tables),
        "records": every.where(F.size("errors") == 0).drop("errors"), "rejected": every.where(F.size("errors") > 0),
        "completeness": records.completeness(every.where(F.size("errors") == 0), ["doc_id"]),
    }


def save_document_pipeline(found: dict[str, DataFrame], path: str) -> None:
    """Every frame under its own name, and the records in all formats."""
    for name in ("blocks", "cells", "tables", "methods", "rejected", "completeness"):
        found[name].write.mode("overwrite").parquet(f"{path}/{name}")
    found["records"].write.mode("overwrite").parquet(f"{path}/records")
    sinks.save_formats(found["records"].sparkSession.read.parquet(f"{path}/records"), f"{path}/formats", ["page", "block_type", "text"])


def cross_verify(cells: DataFrame, facts: DataFrame, rules: DataFrame, terms: DataFrame, how: str = "sum", scorer: str = "token_sort", least: float = 80) -> dict[str, DataFrame]:
    """Table columns of each document against the facts of the file that its name pairs with; of all files together if it has no partner.

    cells(CELLS), facts(FACTS), rules(clean_label, concept), terms(term, concept). Headers are mapped by exact
    rules, then fuzzily; a column's values and a concept's latest values are aggregated by ``how`` and compared.
    """
    docs = cells.select(F.col("doc_id").alias("name"), F.lit(0).alias("seq")).distinct()
    files = facts.select(F.col("source_file").alias("name"), F.lit(0).alias("seq")).distinct()
    pairs = mapping.pair_by_tokens(docs, files).select(F.col("name").alias("doc_id"), F.col("partner").alias("source_file"))
    labels = cells.select("doc_id", F.col("header").alias("label")).where(tx.strip(F.col("label")) != "").distinct().withColumn("clean_label", tx.clean_label(F.col("label")))
    mapped = mapping.cascade(labels, rules, terms, scorer, least)
    reported = cells.withColumn("v", nm.parse_signed(F.col("value"))).where("v IS NOT NULL").withColumnRenamed("header", "label")
    reported = rc.aggregate_values(reported, ["doc_id", "label"], "v", how, "row_idx").withColumnRenamed("value", "pdf_value")
    whole = facts.where("segment IS NULL AND numeric_value IS NOT NULL").dropDuplicates(["source_file", "concept", "context_id", "numeric_value"])
    known = lambda keys: rc.aggregate_values(rc.latest_period(whole.withColumn("_key", F.struct(*keys)), "_key").drop("_key"), keys, "numeric_value", how, "context_id").withColumnRenamed("value", "fact_value")
    own = pairs.where("source_file IS NOT NULL").join(known(["source_file", "concept"]), "source_file").drop("source_file")
    asked = mapped.where("concept IS NOT NULL").select("doc_id", "concept").distinct().join(pairs.where("source_file IS NULL").select("doc_id"), "doc_id", "left_semi")
    found = rc.reconcile(mapped, reported, own.unionByName(asked.join(known(["concept"]), "concept").select("doc_id", "concept", "fact_value")), by=("doc_id",))
    return {"pairs": pairs, "mappings": mapped, "statistics": mapping.recommendations(mapping.statistics(mapped)), "discrepancies": found, "summary": rc.severity_counts(found)}


def evaluation_suite(pages: DataFrame, tables: DataFrame, history: DataFrame, rules: DataFrame, results: DataFrame) -> dict[str, DataFrame]:
    """Quality, regression, drift and benchmark of one extraction. history(metric, ts, value), rules(metric, op, expected), results(BENCH_RESULTS)."""
    newest = history.groupBy("metric").agg(F.max_by("value", "ts").alias("value"))
    oldest = history.groupBy("metric").agg(F.min_by("value", "ts").alias("value"))
    drifts = monitor.drift(newest, oldest)
    checks = monitor.check_rules(newest, rules)
    derived = bench.derive(results)
    return {
        "text": quality.text_consistency(pages, ["extraction_method"]), "methods": tb.method_summary(tables), "consistency": tb.consistency(tables), "structure": tb.structure_stats(tables, ["method"]), "preferred": tb.preferred_method(tables),
        "checks": checks, "status": monitor.suite_status(checks), "simulation": monitor.simulate_failures(newest, rules),
        "drift": drifts, "drift_summary": monitor.drift_summary(drifts), "alerts": monitor.alerts(drifts), "trend": monitor.trend(history),
        "bottlenecks": bench.bottlenecks(derived), "throughput": bench.throughput(results),
    }


def compare_systems(pages: DataFrame, other: DataFrame) -> DataFrame:
    """Two systems' records by page: characters, tables, and what their ratio means. Both (doc_id, page, text, block_type)."""
    def totals(df, s):
        return records.page_totals(df, ["doc_id", "page"]).toDF("doc_id", "page", f"text_{s}", f"tables_{s}")

    j = totals(pages, "a").join(totals(other, "b"), ["doc_id", "page"], "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    ratio = F.when(zero("text_b") > 0, zero("text_a") / F.col("text_b"))
    return j.select("doc_id", "page", *[zero(f"{c}_{s}").alias(f"{c}_{s}") for s in "ab" for c in ("text", "tables")], ratio.alias("text_ratio"), (zero("tables_a") - zero("tables_b")).alias("table_difference"), quality.band(ratio).alias("finding"))


def overall_status(stages: dict[str, DataFrame]) -> DataFrame:
    """(stage, n, status) of each named frame: ``empty`` if it holds no row."""
    one = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n", F.when(F.col("n") > 0, "success").otherwise("empty").alias("status")) for name, df in stages.items()]
    return reduce(lambda a, b: a.unionByName(b), one)


def fallback_records(pages: DataFrame, cells: DataFrame, layout_blocks: DataFrame, sections: DataFrame, documents: DataFrame | None = None, extracted_at="2000-01-01", n_sections: int = 10) -> DataFrame:
    """Records straight from what the steps wrote, without gates: pages' texts, all tables, layout blocks, the first sections of each document.

    pages(doc_id, page, text), cells(CELLS), layout_blocks(LAYOUT_BLOCKS), sections(doc_id, section_number, title, content).
    """
    blocks = layout_blocks.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("page_num").alias("page"), F.concat(F.lit("Page "), F.col("page_num").cast("string")).alias("section"), F.lit("layout_block").alias("block_type"), F.coalesce("text", "type").alias("text"), F.lit("layout_detection").alias("extraction_method"), F.coalesce("confidence", F.lit(0.8)).alias("confidence"), F.col("bounding_box").alias("bbox"))
    found = [records.text_records(pages, "doc_id", "page", "text", "text_block", "pdfplumber_text"), records.table_records(cells), blocks, records.section_records(sections.where(F.col("section_number") <= n_sections))]
    return records.completed(records.union(*found), documents, extracted_at)


def output_checks(spark, path: str, expected: DataFrame) -> DataFrame:
    """What a run has written, against what it should have: expected(output, folder, pattern, least) to (output, n_files, n_bytes, status).

    Files under ``path``/folder whose names match the pattern count; ``passed``: ``least`` of them, and not all empty. The run's files are listed, hidden
    ones too; contents are not read.
    """
    files = scratch.listed(spark, path)
    inside = F.startswith(F.col("path"), F.concat("folder", F.lit("/")))
    met = expected.join(files, inside & F.rlike(F.element_at(F.split("path", "/"), -1), F.col("pattern")), "left")
    g = met.groupBy("output", "least").agg(F.count("path").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"))
    return g.select("output", "n_files", "n_bytes", F.when((F.col("n_files") >= F.col("least")) & (F.col("n_bytes") > 0), "passed").otherwise("failed").alias("status"))
