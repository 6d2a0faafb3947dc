"""A shared folder for what one job writes and the next reads."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_own: list[str] = []


def folder(spark: SparkSession, label: str) -> str:
    """A new path under the folder that spark.checkpoint.dir names; in local mode, where that is unset, under a temporary one of our own, else an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="tallyforge-files-"))
        top = f"file://{_own[0]}"
    return f"{top.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def named_files(files: DataFrame, path: str) -> str:
    """Write files(name, text), a row a file, under their own names in ``path``; each ends with one line end. For as many files as one listing holds: they are renamed one by one."""
    files.select(F.regexp_replace("text", r"\n\z", "").alias("value"), "name").write.partitionBy("name").text(path)
    return _renamed(files.sparkSession, path)


def named_lines(rows: DataFrame, path: str) -> str:
    """Write rows(name, order, line), a row a line with its line end, as ``named_files`` does: a file's lines are sorted and written one by one, none is held whole."""
    dealt = rows.select(F.regexp_replace("line", r"\n\z", "").alias("value"), "name", "order").repartition("name").sortWithinPartitions("name", "order")
    dealt.drop("order").write.partitionBy("name").text(path)
    return _renamed(rows.sparkSession, path)


def _renamed(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for one in fs.listStatus(top):
        if one.isDirectory():
            (part,) = [x.getPath() for x in fs.listStatus(one.getPath()) if x.getPath().getName().startswith("part-")]
            fs.rename(part, jvm.org.apache.hadoop.fs.Path(top, one.getPath().getName().removeprefix("name=")))
            fs.delete(one.getPath(), True)
        else:
            fs.delete(one.getPath(), False)
    return path


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of all files under ``path``, hidden ones too, relative to it; listed by the driver."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, start = [], len(fs.makeQualified(top).toString().rstrip("/")) + 1
    if fs.exists(top):
        files = fs.listFiles(top, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString()[start:], f.getLen()))
    return spark.createDataFrame(found, "path string, length long")


@atexit.register
def _sweep() -> None:
    for path in _own:
        shutil.rmtree(path, ignore_errors=True)
