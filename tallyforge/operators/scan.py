"""Tables from positioned words and drawn objects: ruled, borderless and general scans.

All pages of all documents go through one plan: the ruled and the general scan over whole pages in numpy (``page_grids``), the borderless one by
sweeps in windows. What stands on one page is a bounded group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from . import page_grids as pg, tables as tb
from .layout import PAGE, gap_groups

GRID = [*PAGE, "table_num"]


def _before(w):
    return w.rowsBetween(W.unboundedPreceding, -1)


def sweep(df: DataFrame, keys: list[str], lo: str, hi: str, gap: float, out: str) -> DataFrame:
    """Number the groups of intervals [lo, hi] that meet or come within ``gap``, in ascending order."""
    return gap_groups(df, keys, [lo, hi], lambda w: F.coalesce(F.col(lo) > F.max(hi).over(_before(w)) + gap, F.lit(True)), out)


def _dealt(df: DataFrame, parts: int | None) -> DataFrame:
    """Pages dealt once for all that follows: over ``parts`` tasks, or over as many as the session sets."""
    return df.repartition(parts, *PAGE) if parts else df.repartition(*PAGE)


def pieces(words: DataFrame | None, objects: DataFrame, parts: int | None = None) -> DataFrame:
    """Words and drawn objects as pieces of pages (doc_id, page, and the arrays ``page_grids`` names), dealt by page."""
    def side(df, **own):
        return df.select(*PAGE, *[(F.array(own[c]) if c in own else F.array()).cast(f"array<{t}>").alias(c) for c, t in {**pg.WORDS, **pg.OBJECTS}.items()])

    drawn = side(objects.where(F.col("kind").isin("line", "rect")), box=F.col("kind") == "rect", **{c: F.col(c) for c in ("x0", "top", "x1", "bottom")})
    if words is None:
        return _dealt(drawn, parts)
    ws = side(words, word_idx=F.col("word_idx"), text=F.col("text"), **{f"word_{c}": F.col(c) for c in ("x0", "x1", "top", "bottom")})
    return _dealt(ws.unionByName(drawn), parts)


def _over_pages(of: DataFrame, scan, columns: str, *args) -> DataFrame:
    """``scan`` of ``page_grids`` over pieces, those of a page in one task; they are sorted, where they are not, so that they stand next to each other."""
    rows = of.select(*PAGE, *[F.col(c).cast(f"array<{t}>").alias(c) for c, t in {**pg.WORDS, **pg.OBJECTS}.items()]).sortWithinPartitions(*PAGE)
    keys = [f"`{c}` {of.schema[c].dataType.simpleString()}" for c in PAGE]
    names = [*PAGE, *(c.split()[0] for c in columns.split(", "))]
    return rows.mapInArrow(pg.mapper(scan, names, *args), ", ".join([*keys, columns]))


def edges(objects: DataFrame, thin: float = 2, snap: float = 2, join: float = 2, parts: int | None = None) -> DataFrame:
    """Drawn objects (doc_id, page, kind, x0, top, x1, bottom) to edges (doc_id, page, axis, at, lo, hi).

    Lines and thin boxes are one edge, other rectangles four; slanted lines, curves and images none. Positions that follow
    each other within ``snap`` become one, halfway between the first and the last; edges at one position that meet, or nearly (``join``), become one.
    """
    return _over_pages(pieces(None, objects, parts), pg.edges, "axis string, at double, lo double, hi double", thin, snap, join)


def _lines(words: DataFrame, row_tol: float) -> DataFrame:
    """Words with ``_line``: tops that follow each other within ``row_tol`` are one line."""
    return gap_groups(words, PAGE, ["top", "x0", "word_idx"], lambda w: F.coalesce(F.col("top") - F.lag("top").over(w) > row_tol, F.lit(True)), "_line")


def _word():
    """What a cell keeps of a word, in the order of its text; words without a text stand last in their line."""
    return F.struct("_line", F.col("text").isNull().alias("none"), "x0", "word_idx", "text")


def _cell_texts(cells: DataFrame) -> DataFrame:
    """A text for each cell of rows with ``_ws``, arrays of words or null: words of a line by x0, with blanks between, and a line end between lines; without words an empty text."""
    at = [*GRID, "row_idx", "col_idx"]
    own = cells.groupBy(*at).agg(F.sort_array(F.flatten(F.collect_list("_ws"))).alias("_ws"))
    mark = lambda w, i: F.when(i == 0, "").when(F.get("_ws", i - 1)["_line"] != w["_line"], "\n").when(w["none"], "").otherwise(" ")
    return own.select(*at, F.array_join(F.transform("_ws", lambda w, i: F.concat(mark(w, i), F.coalesce(w["text"], F.lit("")))), "").alias("value"))


def ruled(words: DataFrame, objects: DataFrame, tol: float = 2, row_tol: float = 2, method: str = "camelot_lattice", parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells, accuracy) of the tables that lines draw. words(WORDS), objects(doc_id, page, kind, x0, top, x1, bottom).

    Edges that cross make a grid; a word goes to the square that holds its middle, and where no line parts that from the square to its left or
    above, to the first square of the span. Every square has a row; empty ones hold an empty text. accuracy: the mean share of a word's
    box inside its square, in per cent; 0 for a table without words.
    """
    return ruled_pages(pieces(words, objects, parts), tol, row_tol, method)


def ruled_pages(of: DataFrame, tol: float = 2, row_tol: float = 2, method: str = "camelot_lattice") -> tuple[DataFrame, DataFrame]:
    """``ruled`` over ``pieces``; a row may hold any part of a page's words and objects, but all of a page's rows are in one partition."""
    cells = _over_pages(of, pg.cells, "table_num int, row_idx int, col_idx int, value string", tol, row_tol)
    accuracy = _over_pages(of, pg.accuracy, "table_num int, accuracy double", tol, row_tol)
    named = ["doc_id", F.lit(method).alias("method"), "page", "table_num"]
    return cells.select(*named, "row_idx", "col_idx", "value"), accuracy.select(*named, "accuracy")


def borderless(words: DataFrame, row_tol: float = 2, edge_tol: float = 50, column_tol: float = 0, word_gap: float = 10, method: str = "camelot_stream", parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """S3: (cells, accuracy) of tables without lines.

    Rows: tops within ``row_tol`` of the one before. In a row, words with at most ``word_gap`` between make a run. Rows of several runs that
    follow each other, with at most ``edge_tol`` between, make a table of two rows at least. Its columns are those of the runs' projection on
    x: a gap wider than ``column_tol`` in all rows parts two of them; tables of one column are none. No run crosses a column, so accuracy is 100.
    """
    words = sweep(_lines(_dealt(words, parts), row_tol), [*PAGE, "_line"], "x0", "x1", word_gap, "_part")
    runs = words.groupBy(*PAGE, "_line", "_part").agg(F.min("x0").alias("left"), F.max("x1").alias("right"), F.min("top").alias("y0"), F.max("bottom").alias("y1"), F.collect_list(_word()).alias("_ws"))
    rows = runs.groupBy(*PAGE, "_line").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.collect_list(F.struct("left", "right", "_ws")).alias("_runs")).where(F.size("_runs") > 1)
    rows = gap_groups(rows, PAGE, ["_line"], lambda w: F.coalesce((F.col("_line") - F.lag("_line").over(w) > 1) | (F.col("y0") - F.lag("y1").over(w) > edge_tol), F.lit(True)), "_run")
    run = W.partitionBy(*PAGE, "_run")
    rows = rows.withColumns({"row_idx": F.row_number().over(run.orderBy("_line")) - 1, "rows": F.count("*").over(run)}).where("rows > 1")
    placed = sweep(rows.select(*PAGE, "_run", "row_idx", "rows", F.posexplode("_runs").alias("_i", "_r")).select("*", "_r.*").drop("_r"), [*PAGE, "_run"], "left", "right", column_tol, "_col")
    placed = placed.withColumn("cols", F.max("_col").over(run)).where("cols > 1").withColumn("table_num", F.dense_rank().over(W.partitionBy(*PAGE).orderBy("_run")))
    shape = placed.select(*GRID).distinct()
    own = F.array(F.struct((F.col("_col") - 1).alias("col_idx"), "_ws"))
    blank = F.transform(F.sequence(F.lit(0), F.col("cols") - 1), lambda c: F.struct(c.alias("col_idx"), F.lit(None).cast(placed.schema["_ws"].dataType).alias("_ws")))
    cells = _cell_texts(placed.select(*GRID, "row_idx", F.inline(F.when(F.col("_i") == 0, F.concat(own, blank)).otherwise(own))))  # a row's first run brings all its cells
    cells = cells.select("doc_id", F.lit(method).alias("method"), "page", "table_num", "row_idx", "col_idx", "value")
    return cells, shape.select("doc_id", F.lit(method).alias("method"), "page", "table_num", F.lit(100.0).alias("accuracy"))


def general(words: DataFrame, objects: DataFrame, tol: float = 2, parts: int | None = None) -> DataFrame:
    """Cells with headers of the ruled tables that pass their page's gate, renumbered by page."""
    return general_pages(pieces(words, objects, parts), tol)


def general_pages(of: DataFrame, tol: float = 2, row_tol: float = 2) -> DataFrame:
    """``general`` over ``pieces`` (as ``ruled_pages`` takes them), in the scan's own pass: headers, quality and the gate need no more than a page's tables."""
    cells = _over_pages(of, pg.headed_cells, "table_num int, row_idx int, col_idx int, header string, value string", tol, row_tol, list(tb.MISSING), tb.PAGE_GATE)
    return cells.select("doc_id", F.lit("pdfplumber").alias("method"), "page", "table_num", "row_idx", "col_idx", "header", "value")


def scan(words: DataFrame, objects: DataFrame, methods: tuple[str, ...] = tb.METHOD_ORDER, least_rows: int = 1, tol: float = 2) -> tuple[DataFrame, DataFrame]:
    """(cells, accuracy) of all methods' candidates, without scores; ``least_rows`` holds for the general scan's tables (two in its simple variant)."""
    found = []
    if "camelot_lattice" in methods:
        found.append(ruled(words, objects, tol))
    if "camelot_stream" in methods:
        found.append(borderless(words))
    if "pdfplumber" in methods:
        cells, _ = ruled(words, objects, tol, method="pdfplumber")
        big = cells.groupBy(*tb.TABLE).agg(F.countDistinct("row_idx").alias("n")).where(F.col("n") >= least_rows)
        found.append((cells.join(big.select(*tb.TABLE), tb.TABLE, "left_semi"), None))
    both = [a for _, a in found if a is not None]
    none = words.sparkSession.createDataFrame([], found[0][0].select(*tb.TABLE).schema.add("accuracy", "double"))
    return reduce(lambda a, b: a.unionByName(b), [c for c, _ in found]), reduce(lambda a, b: a.unionByName(b), both, none)
