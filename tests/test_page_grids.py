"""Ruled and general scans over whole pages: their plans, pages cut by batches and limits, and the general scan against its parts."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import Window as W, functions as F

from tallyforge import schemas
from tallyforge.operators import page_grids as pg, scan, tables as tb
from tallyforge.plans import registry


# general_tables counts rows at its end
@pytest.mark.parametrize("name, exchanges", [("ruled_tables", 1), ("general_tables", 3)])
def test_pages_are_dealt_and_sorted_once(spark, sf_dir, name, exchanges):
    """Some twenty windows, each with a sort of all words or edges, took 300 CPU microseconds a line item."""
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= exchanges and plan.count("Window [") <= 1 and plan.count("Sort [") <= 1
    assert plan.count("MapInArrow") == 1


def drawings(n, seed):
    """(words, objects) of pages with a few grids each, lines and words left out, moved or without a place."""
    rnd = random.Random(seed)
    ws, segs = [], []
    for d in range(n):
        doc, page = f"d{d}", rnd.choice([1, 20, 21, 40])
        for k in range(rnd.randint(1, 3)):
            rows, cols, x, y = rnd.randint(1, 4), rnd.randint(1, 4), rnd.choice([0, 150]), 200.0 * k
            for r in range(rows + 1):
                for c in range(cols):
                    if rnd.random() < 0.9:
                        segs.append((doc, page, "line", x + 30.0 * c, y + 20.0 * r + rnd.choice([0, 0.5]), x + 30.0 * c + 30, y + 20.0 * r + rnd.choice([0, 0.5])))
            for c in range(cols + 1):
                for r in range(rows):
                    if rnd.random() < 0.9:
                        segs.append((doc, page, rnd.choice(["line", "rect"]), x + 30.0 * c, y + 20.0 * r, x + 30.0 * c + rnd.choice([0, 1]), y + 20.0 * r + 20))
            for i in range(rnd.randint(0, 16)):
                a, b = x + 30.0 * rnd.randint(0, cols) + rnd.choice([0, 5]), y + 20.0 * rnd.randint(0, rows) + rnd.choice([0, 5, 6])
                text = rnd.choice(["a", "Name", "7", "1,200", "n/a", "-", "—", " x\t", "nan", "NONE", "", None, "12 ", "3\x0b", "é", "$5"])
                ws.append((doc, page, rnd.choice([i, 0, None]), text, rnd.choice([a, a, a, None]), a + 8, b, b + 6))
        segs.append((doc, page, rnd.choice(["rect", "image"]), 10.0, rnd.choice([500.0, None]), 60.0, 560.0))
    return ws, segs


def test_general_scan_against_its_parts(spark):
    ws, segs = drawings(80, 3)
    w, o = spark.createDataFrame(ws, schemas.WORDS), spark.createDataFrame(segs, schemas.OBJECTS)
    headed = tb.infer_headers(tb.clean_cells(scan.ruled(w, o, method="pdfplumber")[0])).localCheckpoint()
    good = headed.join(tb.score_tables(headed).where(tb.page_gate(F.col("page"), F.col("content_quality"))).select(*tb.TABLE), tb.TABLE, "left_semi")
    number = F.dense_rank().over(W.partitionBy("doc_id", "method", "page").orderBy("table_num"))
    want = sorted(map(tuple, good.withColumn("table_num", number).select(*tb.TABLE, "row_idx", "col_idx", "header", "value").collect()))
    assert sorted(map(tuple, scan.general(w, o).collect())) == want and len(want) > 400
    assert headed.select(*tb.TABLE).distinct().count() > len({r[:4] for r in want})  # some fail the gate


def test_batches_and_limits_change_nothing(spark, monkeypatch):
    ws, segs = drawings(40, 5)
    rows = [r.asDict() for r in scan.pieces(spark.createDataFrame(ws, schemas.WORDS), spark.createDataFrame(segs, schemas.OBJECTS)).sortWithinPartitions("doc_id", "page").coalesce(1).orderBy("doc_id", "page", F.size("text"), "text", "word_idx", "word_x0", "word_x1", "word_top").collect()]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    schema = pa.schema([("doc_id", pa.string()), ("page", pa.int32()), *((c, pa.list_(kinds[t])) for c, t in {**pg.WORDS, **pg.OBJECTS}.items())])
    table = pa.Table.from_pylist(rows, schema)

    def run(f, names, size, least, *args):
        out = [b for b in pg.mapper(f, names, *args, least=least)(iter(table.to_batches(size)))]
        return [tuple(r.values()) for b in out for r in b.to_pylist()], len(out)

    cells = (pg.cells, ["doc_id", "page", "table_num", "row_idx", "col_idx", "value"]), (2, 2)
    headed = (pg.headed_cells, ["doc_id", "page", "table_num", "row_idx", "col_idx", "header", "value"]), (2, 2, list(tb.MISSING), tb.PAGE_GATE)
    accuracy = (pg.accuracy, ["doc_id", "page", "table_num", "accuracy"]), (2, 2)
    whole = [run(*f, 10**6, 10**9, *args) for f, args in (cells, headed, accuracy)]
    assert [n for _, n in whole] == [1, 1, 1]
    monkeypatch.setattr(pg, "CELLS", 7)
    monkeypatch.setattr(pg, "PAIRS", 5)
    for size, least in ((1, 1), (3, 1), (50, 200), (10**6, 1)):
        assert [run(*f, size, least, *args)[0] for f, args in (cells, headed, accuracy)] == [r for r, _ in whole]
    assert run(*cells[0], 50, 200, 2, 2)[1] > 10
