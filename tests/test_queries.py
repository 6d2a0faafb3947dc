"""Every registered core query runs; those with SQL give the same rows."""

import pytest

from tallyforge.plans import registry

from oracle import compare


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, name):
    if name in registry.ORACLES:
        compare(spark, sf_dir, registry.QUERIES[name], registry.ORACLES[name])
    else:
        assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_chunks_hold_every_line(spark, sf_dir):
    from pyspark.sql import functions as F

    from tallyforge.functions import text as tx

    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", tx.pack(F.split("text", "\n"), 2000, "\n").alias("c"))
    for r in d.collect():
        assert "\n".join(r["c"]) == r["text"].lstrip("\n") or "\n\n" in r["text"]
        assert all(len(x) <= 2000 or "\n" not in x for x in r["c"])
