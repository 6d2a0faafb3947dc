"""Page geometry: word blocks, lines, regions, titles, reading order, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

PAGE = ["doc_id", "page"]


def gap_groups(df: DataFrame, keys: list[str], order: list, breaks, out: str) -> DataFrame:
    """Number runs of rows; a run begins where ``breaks`` (over lag columns it makes itself) is true. W6's shape."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_new", F.when(breaks(w), 1).otherwise(0)).withColumn(out, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("_new")


def word_blocks(words: DataFrame, dy: float = 20, dx: float = 100) -> DataFrame:
    """Words in (top, x0) order join a block while both gaps stay below the limits."""
    def new(w):
        return F.lag("top").over(w).isNull() | ~((F.abs(F.col("top") - F.lag("top").over(w)) < dy) & (F.abs(F.col("x0") - F.lag("x1").over(w)) < dx))

    g = gap_groups(words, PAGE, ["top", "x0", "word_idx"], new, "block")
    return g.groupBy(*PAGE, "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "x0", "word_idx", "text"))), lambda x: x["text"]), " ").alias("text"), F.count("*").cast("int").alias("word_count"),
        F.struct(F.min("x0").alias("x1"), F.min("top").alias("y1"), F.max("x1").alias("x2"), F.max("bottom").alias("y2")).alias("bounding_box"),
    )


def anchor_groups(xs, within: float, chunk: int = 256):
    """W7's fold: for an ordered array of numbers, each one's group; a group holds what is nearer than ``within`` to its first.

    The groups of ``chunk`` numbers are gathered at a time, as each step copies what it has gathered.
    """
    def step(acc, x):
        same = F.coalesce(F.abs(x - acc["anchor"]) < within, F.lit(False))
        n = F.when(same, acc["n"]).otherwise(acc["n"] + 1)
        return F.struct(F.concat(acc["g"], F.array(n)).alias("g"), n.alias("n"), F.when(same, acc["anchor"]).otherwise(x.cast("double")).alias("anchor"))

    def part(acc, ys):
        start = F.struct(F.array().cast("array<int>").alias("g"), acc["n"].alias("n"), acc["anchor"].alias("anchor"))
        done = F.aggregate(ys, start, step)
        return F.transform(F.array(done), lambda d: F.struct(F.concat(acc["gs"], F.array(d["g"])).alias("gs"), d["n"].alias("n"), d["anchor"].alias("anchor")))[0]

    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(xs) - 1, F.lit(0)) / chunk).cast("int")), lambda c: F.slice(xs, c * chunk + 1, chunk))
    start = F.struct(F.array().cast("array<array<int>>").alias("gs"), F.lit(0).alias("n"), F.lit(None).cast("double").alias("anchor"))
    return F.aggregate(chunks, start, part, lambda acc: F.flatten(acc["gs"]))


def word_lines(words: DataFrame, within: float = 5) -> DataFrame:
    """Words in input order, a line for those near its first word's top. A page's words are the bounded group."""
    page = words.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("word_idx", "top", "x0", "x1", "bottom", "text"))).alias("ws"))
    page = page.withColumn("gs", anchor_groups(F.transform("ws", lambda x: x["top"].cast("double")), within))
    each = page.select(*PAGE, F.explode(F.arrays_zip("ws", "gs")).alias("z")).select(*PAGE, "z.ws.*", F.col("z.gs").alias("line"))
    return each.groupBy(*PAGE, "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda x: x["text"]), " ").alias("text"),
        F.min_by("x0", "word_idx").alias("x0"), F.max("x1").alias("x1"), F.min_by("top", "word_idx").alias("top"), F.min_by("bottom", "word_idx").alias("bottom"),
    )


def page_height(words: DataFrame):
    """The page's height, from a column ``page_height`` of the words; where that is absent or null, how far down the page's words reach."""
    reach = F.max("bottom").over(W.partitionBy(*PAGE))
    return F.coalesce(F.col("page_height"), reach) if "page_height" in words.columns else reach


def regions(words: DataFrame, share: float = 0.1, least: int = 5) -> DataFrame:
    """Header and footer text of each page: words inside the top and the bottom tenth of its height."""
    h = page_height(words)
    r = words.withColumn("_h", h).withColumn("region", F.when(F.col("bottom") <= share * F.col("_h"), "header").when(F.col("top") >= (1 - share) * F.col("_h"), "footer")).where("region IS NOT NULL")
    return r.groupBy(*PAGE, "region").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "x0", "word_idx", "text"))), lambda x: x["text"]), " ").alias("text")).where(F.length("text") > least)


def titles(words: DataFrame, share: float = 0.2, n: int = 2) -> DataFrame:
    """The first blocks of the page's top fifth."""
    top = words.withColumn("_h", page_height(words)).where(F.col("top") < share * F.col("_h")).drop("_h")
    return word_blocks(top).where(F.col("block") <= n)


def block_ids(blocks: DataFrame) -> DataFrame:
    """Ids by page, Text before Table before Title."""
    rank = F.when(F.col("type") == "Text", 0).when(F.col("type") == "Table", 1).when(F.col("type") == "Title", 2).otherwise(3)
    return blocks.withColumn("block_id", F.row_number().over(W.partitionBy(*PAGE).orderBy(rank, "block")))


def reading_order(df: DataFrame, keys: list[str], order: list, out: str = "reading_order") -> DataFrame:
    """1-based position in each page, and whether the page has several."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("int")).withColumn("multicolumn", F.count("*").over(W.partitionBy(*keys)) > 1)


def routing(block_type):
    """P18."""
    return F.when(block_type.isin("Text", "Title"), "pdfplumber").when(block_type == "Table", "camelot").when(block_type == "Figure", "image_store").otherwise("manual_review")


def type_counts(blocks: DataFrame, by: str = "type") -> DataFrame:
    """A18."""
    return blocks.groupBy(by).agg(F.count("*").alias("n"), F.countDistinct("page").alias("n_pages"))
