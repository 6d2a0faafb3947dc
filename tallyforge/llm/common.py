"""Helpers shared by the corpus operators: shared scratch tables, words, running offsets."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PREFIX = "tallyforge-"
_own_dir: list[str] = []
_spent: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where that is unset, a folder of our own if all runs in one process, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="tallyforge-"))
    return _own_dir[0]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared scratch folder and read it back.

    Survives lost executors, as the files lie in shared storage; removed when the session ends. All tables of an application are in
    one folder, named by its id, so that those of a driver that was killed can be told (see ``clear_left``).
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{PREFIX}{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")  # the write's own shuffle files go with it, not at some later collection
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    _spent.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(*tables: DataFrame) -> None:
    """Delete materialized tables early. Nothing that is still to be computed may read them; derive a materialized result first."""
    for t in tables:
        _delete(t.sparkSession, t._scratch_path)
        _spent.remove((t.sparkSession, t._scratch_path))


def clear_left(spark: SparkSession, days: float = 7) -> list[str]:
    """Delete the scratch folders of other applications that were last written to more than ``days`` ago; returns their names."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [x for x in (fs.listStatus(top) if fs.exists(top) else []) if x.isDirectory() and x.getPath().getName().startswith(PREFIX)]
    gone = []
    for x in found:
        name = x.getPath().getName()
        if name != PREFIX + spark.sparkContext.applicationId and x.getModificationTime() < (time.time() - days * 86400) * 1000:
            fs.delete(x.getPath(), True)
            gone.append(name)
    return gone


@atexit.register
def _sweep() -> None:
    for spark, folder in {(spark, path.rpartition("/")[0]) for spark, path in _spent}:
        try:
            _delete(spark, folder)
        except Exception:  # the session has gone; clear_left finds the folder
            continue
    for own in _own_dir:
        shutil.rmtree(own.removeprefix("file://"), ignore_errors=True)


def word_count(text) -> F.Column:
    """Words in a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_running_offset(df: DataFrame, group: str, segment: str, order: list, value: str, out: str, totals: DataFrame | None = None) -> DataFrame:
    """Exclusive running sum of ``value`` per ``group`` without gathering a group in one task.

    Rows are ordered by (segment, order). Each (group, segment) is summed first; only those sums are
    accumulated per group, and rows are accumulated inside their segment. ``totals`` may carry the
    (group, segment, total) table when it is at hand; its further columns are joined on.
    """
    if totals is None:
        totals = df.groupBy(group, segment).agg(F.sum(value).alias("_total"))
    before = W.partitionBy(group).orderBy(segment).rowsBetween(W.unboundedPreceding, -1)
    base = totals.withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    inner = W.partitionBy(group, segment).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        df.join(base, [group, segment])
        .withColumn(out, (F.col("_base") + F.coalesce(F.sum(value).over(inner), F.lit(0))).cast("long"))
        .drop("_base")
    )


def prefix_sums(lengths: F.Column, chunk: int = 256) -> F.Column:
    """Exclusive prefix sums of an int array, in SQL functions only.

    A plain fold copies the growing array at each step; folding chunks of ``chunk`` first and then
    their totals keeps the work near linear for long arrays.
    """

    def running(xs):
        return F.aggregate(xs, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    n = F.size(lengths)
    chunks = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int")), lambda c: running(F.slice(lengths, c * chunk + 1, chunk))))
    return F.coalesce(
        F.flatten(F.transform(F.array(chunks), lambda cs: F.flatten(F.zip_with(cs, running(F.transform(cs, lambda c: F.element_at(c, -1))), lambda c, base: F.when(c.isNotNull(), F.transform(F.slice(c, 1, F.size(c) - 1), lambda x: x + base)).otherwise(F.array().cast("array<bigint>")))))),
        F.array().cast("array<bigint>"),
    )


def span_list(spans: F.Column) -> F.Column:
    """kind:start:end by start, then kind's rank, comma-joined."""
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def find_spans(df: DataFrame, text: str, pattern: str, out: str, gate: F.Column | None = None, near: int = 0) -> DataFrame:
    """Add ``out``: array of (start, end, m) of every leftmost non-overlapping match of ``pattern``.

    Positions are code points, end exclusive. Between matches lie the pieces of split(), so the lengths of
    pieces and matches add up to positions; no Python is needed. ``gate``: a cheap condition
    that must hold where the pattern can match. ``near``: also (ahead, after): up to so many characters of what stands before the
    match, back to the start of the match before it, and the character behind. They come from the pieces, as each substring of a
    long text would be searched from its start.
    """
    m, s, p = f"_{out}_m", f"_{out}_s", f"_{out}_p"
    ok = F.col(text).isNotNull() if gate is None else F.coalesce(gate, F.lit(False))
    none = F.array().cast("array<string>")
    df = df.withColumn(m, F.when(ok, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn(s, F.when(F.size(m) > 0, F.split(text, pattern, -1)).otherwise(none))
    lens = F.zip_with(F.slice(s, 1, F.size(m)), F.col(m), lambda a, b: F.length(a) + F.length(b))
    df = df.withColumn(p, F.when(F.size(m) > 0, prefix_sums(lens)))

    def span(x, i):
        start = F.get(F.col(p), i) + F.length(F.get(F.col(s), i))
        fields = [start.alias("start"), (start + F.length(x)).alias("end"), x.alias("m")]
        if near:
            back = F.concat(F.coalesce(F.get(F.col(m), i - 1), F.lit("")), F.get(F.col(s), i))
            fields += [F.right(back, F.lit(near)).alias("ahead"), F.left(F.concat(F.left(F.get(F.col(s), i + 1), F.lit(1)), F.left(F.coalesce(F.get(F.col(m), i + 1), F.lit("")), F.lit(1))), F.lit(1)).alias("after")]
        return F.struct(*fields)

    empty = F.array().cast("array<struct<start:bigint,end:bigint,m:string" + (",ahead:string,after:string>>" if near else ">>"))
    return df.withColumn(out, F.when(F.size(m) > 0, F.transform(m, span)).otherwise(empty)).drop(m, s, p)
