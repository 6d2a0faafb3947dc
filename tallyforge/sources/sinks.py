"""Sinks: pages, tables, layout, records, facts, runs, metric history."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import mapping, reconcile as rc, records as rec, tables as tb
from . import readers

#: Rows of an Excel sheet, its header included.
SHEET_ROWS = 1_048_576


def save_pages(pages: DataFrame, path: str) -> None:
    """K1: pages by document, and each document's text with page marks."""
    pages.write.mode("overwrite").partitionBy("doc_id").parquet(f"{path}/pages")
    mark = F.concat(F.lit("--- PAGE "), F.col("page").cast("string"), F.lit(" ---\n"), F.coalesce("text", F.lit("")))
    combined = pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", mark.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    combined.write.mode("overwrite").parquet(f"{path}/combined")
    pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.count_if("needs_ocr").alias("n_ocr"), F.count_if(F.col("extraction_method") == "failed").alias("n_failed")).write.mode("overwrite").json(f"{path}/ocr_log")


def save_tables(cells: DataFrame, index: DataFrame, path: str) -> None:
    """K2: cells by document, the index by page, method and file name, and the methods' summary."""
    cells.write.mode("overwrite").partitionBy("doc_id").parquet(f"{path}/cells")
    index.orderBy("page", "method", "filename").write.mode("overwrite").option("header", True).csv(f"{path}/index")
    tb.method_summary(index).write.mode("overwrite").json(f"{path}/analysis")


def save_layout(blocks: DataFrame, path: str) -> None:
    """K3."""
    blocks.write.mode("overwrite").partitionBy("doc_id").json(f"{path}/blocks")
    blocks.groupBy("type").count().write.mode("overwrite").json(f"{path}/counts")


def save_json_lines(records: DataFrame, path: str) -> None:
    """K4: nulls are kept as fields."""
    records.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def save_formats(records: DataFrame, path: str, order: list) -> None:
    """K5: the same records as JSON lines, markdown and plain text."""
    f = rec.fan_out(records, order)
    for name, col in (("jsonl", "jsonl"), ("md", "markdown"), ("txt", "plain")):
        f.where(F.col(col).isNotNull()).select(col).write.mode("overwrite").text(f"{path}/{name}")


def save_as(df: DataFrame, path: str, kind: str) -> None:
    """K6, K7: csv, json or parquet; any other kind raises. Excel is written from the driver for small results."""
    if kind == "xlsx":
        if df.limit(SHEET_ROWS).count() == SHEET_ROWS:
            raise ValueError(f"a sheet holds fewer than {SHEET_ROWS} rows below its header")
        df.toPandas().to_excel(path)
    elif kind in ("csv", "json", "parquet", "orc"):
        df.write.mode("overwrite").option("header", True).format(kind).save(path)
    else:
        raise ValueError(f"unknown format: {kind}")


def save_facts(facts: DataFrame, path: str, kind: str = "csv", first=("source_file", "concept", "numeric_value", "unit", "period_type", "start_date", "end_date", "instant_date")) -> None:
    """Facts in their order, the named columns in front."""
    save_as(rc.reorder(facts.orderBy(*rc.fact_order()), list(first)), path, kind)


def append_run(runs: DataFrame, path: str) -> None:
    """Histories are append-only; the latest row of a key counts."""
    runs.write.mode("append").parquet(path)


def save_suite(results: DataFrame, path: str) -> None:
    """Without the bulky report text."""
    results.drop("report_content").write.mode("overwrite").json(path)


def save_session(found: dict[str, DataFrame], path: str, session_id: str) -> None:
    """K8: the frames of a cross-verification, each with its session as a partition, so that a rerun replaces its own session only."""
    for name, df in found.items():
        df.withColumn("session_id", F.lit(session_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(f"{path}/{name}")


def save_ocr(docs: DataFrame, path: str, key: str = "doc_id") -> None:
    """K9: pages, table cells, form fields, entities and counts of nested OCR documents, one write each."""
    parts = {"pages": readers.ocr_pages(docs, key), "cells": readers.ocr_cells(docs, key), "forms": readers.ocr_forms(docs, key), "entities": readers.ocr_entities(docs, key), "summary": rec.layout_counts(docs, key)}
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def save_structure(docs: DataFrame, tables: DataFrame, path: str) -> None:
    """Converted documents (doc_id, markdown, text) as markdown by document, and the summary of their structure."""
    docs.where("markdown IS NOT NULL").select("markdown", "doc_id").write.mode("overwrite").partitionBy("doc_id").text(f"{path}/markdown")
    rec.structure_summary(docs, tables).write.mode("overwrite").json(f"{path}/structure")


def export_rules(rules: DataFrame, path: str) -> None:
    """Label rules (clean_label, concept) as JSON lines."""
    rules.select("clean_label", "concept").write.mode("overwrite").json(path)


def import_rules(rules: DataFrame, path: str) -> DataFrame:
    """``rules`` with those of ``path``, which replace rules of the same label; equal rows once."""
    more = rules.sparkSession.read.schema("clean_label string, concept string").json(path)
    return mapping.upsert_rules(rules.select("clean_label", "concept"), more).distinct()


def archive_runs(registry: DataFrame, archive: str) -> DataFrame:
    """The folder of each run that the registry marks (run_id, run_directory, archive) moves to ``archive``/run_id, whole.

    Returns (run_id, path) of what was moved now; runs whose folder is gone are left out, and an archived run is not replaced. The registry holds a row a
    run, so the driver moves them one by one; nothing is read or copied where both places are in one file system.
    """
    spark = registry.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    moved = []
    for r in registry.where("archive").select(F.col("run_id").cast("string"), "run_directory").orderBy("run_id").collect():
        old, new = jvm.org.apache.hadoop.fs.Path(r["run_directory"]), jvm.org.apache.hadoop.fs.Path(archive, r["run_id"])
        fs = old.getFileSystem(conf)
        if fs.exists(old) and not fs.exists(new):
            fs.mkdirs(new.getParent())
            if not fs.rename(old, new):
                raise OSError(f"{r['run_directory']} cannot be moved to {archive}")
            moved.append((r["run_id"], new.toString()))
    return spark.createDataFrame(moved, "run_id string, path string")
