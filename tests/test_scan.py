"""Table scans on drawn pages, against a plain reading of the same drawing."""

import random

from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.operators import scan
from tallyforge.plans import workflows as wf


def lines(spark, *segments, kind="line", doc="d"):
    return spark.createDataFrame([(doc, 1, kind, *map(float, s)) for s in segments], schemas.OBJECTS)


def words(spark, *ws, doc="d"):
    return spark.createDataFrame([(doc, 1, i, t, float(x), float(x) + 8, float(y), float(y) + 6) for i, (t, x, y) in enumerate(ws)], schemas.WORDS)


def grid_of(cells):
    out = {}
    for r in cells.collect():
        out.setdefault(r["table_num"], {})[r["row_idx"], r["col_idx"]] = r["value"]
    return out


def test_edges(spark):
    o = lines(spark, (0, 10, 50, 10), (45, 11, 100, 11.5), (101, 10, 120, 10), (200, 10, 260, 10), (0, 0, 30, 40), (5, 0, 5, 80))
    got = sorted((r["axis"], r["at"], r["lo"], r["hi"]) for r in scan.edges(o).collect())
    assert got == [("h", 10.5, 0.0, 120.0), ("h", 10.5, 200.0, 260.0), ("v", 5.0, 0.0, 80.0)]  # the slanted line is none
    box = sorted((r["axis"], r["at"]) for r in scan.edges(lines(spark, (0, 0, 30, 40), kind="rect")).collect())
    assert box == [("h", 0.0), ("h", 40.0), ("v", 0.0), ("v", 30.0)]
    assert scan.edges(lines(spark, (0, 0, 30, 40), kind="image")).count() == 0


def test_two_tables_on_a_page(spark):
    box = lambda x, y: [(x, y, x + 40, y), (x, y + 20, x + 40, y + 20), (x, y + 40, x + 40, y + 40), (x, y, x, y + 40), (x + 20, y, x + 20, y + 40), (x + 40, y, x + 40, y + 40)]
    o = lines(spark, *box(0, 0), *box(100, 0), *box(0, 200), (0, 120, 300, 120))
    w = words(spark, ("a", 5, 5), ("b", 25, 5), ("c", 5, 25), ("x", 105, 25), ("low", 25, 225), ("outside", 60, 5))
    got = grid_of(scan.ruled(w, o)[0])
    assert got == {1: {(0, 0): "a", (0, 1): "b", (1, 0): "c", (1, 1): ""}, 2: {(0, 0): "", (0, 1): "", (1, 0): "x", (1, 1): ""}, 3: {(0, 0): "", (0, 1): "", (1, 0): "", (1, 1): "low"}}
    assert {r["table_num"]: r["accuracy"] for r in scan.ruled(w, o)[1].collect()} == {1: 100.0, 2: 100.0, 3: 100.0}
    half = scan.ruled(words(spark, ("cut", 15, 5)), o)[1].where("table_num = 1").first()["accuracy"]
    assert abs(half - 100 * 5 / 8) < 1e-9 or abs(half - 100 * 3 / 8) < 1e-9
    assert scan.ruled(w, o.limit(0))[0].count() == 0 and scan.ruled(w.limit(0), o)[1].select(F.max("accuracy")).first()[0] == 0.0


def test_random_grids_against_a_plain_reading(spark):
    """Lines left out at random; a word goes left, then up, until a line stops it."""
    rnd = random.Random(4)
    segs, ws, want = [], [], {}
    for d in range(12):
        n, m = rnd.randint(1, 5), rnd.randint(1, 5)
        doc, left, top = f"d{d}", {}, {}
        for r in range(n + 1):
            for c in range(m):
                if r in (0, n) or rnd.random() < 0.7:
                    segs.append((doc, 1, "line", 30.0 * c, 20.0 * r, 30.0 * c + 30, 20.0 * r))
                    top[r, c] = True
        for c in range(m + 1):
            for r in range(n):
                if c in (0, m) or rnd.random() < 0.7:
                    segs.append((doc, 1, "line", 30.0 * c, 20.0 * r, 30.0 * c, 20.0 * r + 20))
                    left[r, c] = True
        xs = [c for c in range(m + 1) if any((r, c) in left for r in range(n))]
        ys = [r for r in range(n + 1) if any((r, c) in top for c in range(m))]
        cells = {(i, j): [] for i in range(len(ys) - 1) for j in range(len(xs) - 1)}
        covered = lambda side, i, j: all((r, xs[j]) in side for r in range(ys[i], ys[i + 1]))  # noqa: B023, E731
        above = lambda i, j: all((ys[i], c) in top for c in range(xs[j], xs[j + 1]))  # noqa: B023, E731
        for r in range(n):
            for c in range(m):
                ws.append((doc, 1, r * m + c, f"w{r}.{c}", 30.0 * c + 5, 30.0 * c + 25, 20.0 * r + 5, 20.0 * r + 15))
                i, j = max(k for k, y in enumerate(ys) if y <= r), max(k for k, x in enumerate(xs) if x <= c)
                while j and not covered(left, i, j):
                    j -= 1
                while i and not above(i, j):
                    i -= 1
                cells[i, j].append((r, c, f"w{r}.{c}"))
        for k, v in cells.items():
            by_line = {}
            for r, _, t in sorted(v):
                by_line.setdefault(r, []).append(t)
            want[doc, *k] = "\n".join(" ".join(by_line[r]) for r in sorted(by_line))
    o, w = spark.createDataFrame(segs, schemas.OBJECTS), spark.createDataFrame(ws, schemas.WORDS)
    got = {(r["doc_id"], r["row_idx"], r["col_idx"]): r["value"] for r in scan.ruled(w, o)[0].collect()}
    assert got == want


def test_borderless(spark):
    rows = [("Item", 0, 0), ("count", 100, 0), ("pears", 0, 20), ("7", 105, 20), ("a", 0, 40), ("b", 14, 40), ("9", 101, 41)]
    prose = [("some", 0, 60), ("words", 12, 60)]
    far = [("x", 0, 200), ("y", 60, 200)]
    cells, accuracy = scan.borderless(words(spark, *rows, *prose, *far))
    assert grid_of(cells) == {1: {(0, 0): "Item", (0, 1): "count", (1, 0): "pears", (1, 1): "7", (2, 0): "a b", (2, 1): "9"}}
    assert [r["accuracy"] for r in accuracy.collect()] == [100.0]
    assert scan.borderless(words(spark, *prose))[0].count() == 0


def test_general_scan_gates_and_variants(spark):
    box = [(0, 0, 40, 0), (0, 20, 40, 20), (0, 40, 40, 40), (0, 0, 0, 40), (20, 0, 20, 40), (40, 0, 40, 40)]
    empty = [(x0, y0 + 100, x1, y1 + 100) for x0, y0, x1, y1 in box]
    later = [(x0, y0 + 200, x1, y1 + 200) for x0, y0, x1, y1 in box]
    one_row = [(0, 300, 40, 300), (0, 320, 40, 320), (0, 300, 0, 320), (20, 300, 20, 320), (40, 300, 40, 320)]
    o = lines(spark, *box, *empty, *later, *one_row)
    w = words(spark, ("Name", 5, 5), ("Sum", 25, 5), ("a", 5, 25), ("1", 25, 25), ("7", 5, 205), ("8", 25, 205), ("9", 5, 225), ("3", 25, 225), ("z", 5, 305), ("5", 25, 305))
    got = scan.general(w, o)
    assert sorted({r["table_num"] for r in got.collect()}) == [1, 2, 3]  # the empty table is gone, the others are renumbered
    assert sorted((r["header"], r["value"]) for r in got.where("table_num = 1").collect()) == [("Name", "a"), ("Sum", "1")]
    cells, _ = scan.scan(w, o, ("pdfplumber",), least_rows=2)
    assert cells.select("table_num").distinct().count() == 3
    every, accuracy = scan.scan(w, o)
    assert {r[0] for r in every.select("method").distinct().collect()} == {"camelot_lattice", "camelot_stream", "pdfplumber"} and accuracy.where("accuracy IS NULL").count() == 0
    found = wf.document_pipeline(spark.createDataFrame([("d", 1, "text")], "doc_id string, page int, text string"), w, objects=o)
    assert found["cells"].count() > 0
