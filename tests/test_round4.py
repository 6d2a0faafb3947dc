"""Plans of the scans and tables: rows are dealt once, and nothing is computed twice."""

import pytest
from pyspark.sql import functions as F

from tallyforge.plans import registry


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


# lineitem's own window, then words and drawn objects by page; what a query sums at its end
@pytest.mark.parametrize("name, most", [("ruled_tables", 4), ("borderless_tables", 4), ("table_enhance", 1), ("table_features", 1), ("general_tables", 4)])
def test_rows_are_dealt_once(spark, sf_dir, name, most):
    assert exchanges(registry.QUERIES[name](spark, sf_dir)) <= most


def test_tasks_follow_the_rows(spark):
    from tallyforge.plans.common import parts

    assert parts(spark.range(1000), 10) == 100
    assert parts(spark.range(10), 10) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_an_instance_is_not_held_whole():
    import tracemalloc

    from tallyforge.sources.readers import _walk_xbrl

    def pieces(n, end="</xbrl>"):
        yield '<xbrl><context id="c1"><entity><identifier>e</identifier></entity><period><instant>2024-01-01</instant></period></context>\n'
        for i in range(n):
            yield f'<group><Revenues\n contextRef="c1"\n unitRef="usd">{i}<note>x</note></Revenues></group>\n'
        yield end

    tracemalloc.start()
    kinds = {}
    for rows in _walk_xbrl("a.xml", pieces(40_000)):
        for r in rows:
            kinds[r[0]] = kinds.get(r[0], 0) + 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert kinds == {"context": 1, "fact": 40_000}
    assert peak < 12_000_000  # 40,000 facts as a tree and a list take several times that
    bad = list(_walk_xbrl("b.xml", pieces(20_000, "</oops>")))
    assert [r[0] for rows in bad for r in rows] == ["error"]


def test_instances_over_lines_and_files(spark, tmp_path):
    from tallyforge.sources.readers import xbrl_parts

    (tmp_path / "x").mkdir()
    body = '<xbrl>\n<context id="c">\n<period>\n<startDate>2024-01-01</startDate>\n<endDate>2024-02-01</endDate>\n</period></context>\n' + "".join(f'<A contextRef="c"\n>{i}</A>\n' for i in range(3000)) + "</xbrl>"
    for name in ("a", "b"):
        (tmp_path / "x" / f"{name}.xml").write_text(body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")  # a file is read in several stretches
    try:
        got = {(r["file"], r["kind"]): (r["count"], r["values"]) for r in xbrl_parts(spark, str(tmp_path / "x")).groupBy("file", "kind").agg(F.count("*").alias("count"), F.countDistinct("value").alias("values")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {("a.xml", "context"): (1, 0), ("a.xml", "fact"): (3000, 3000), ("b.xml", "context"): (1, 0), ("b.xml", "fact"): (3000, 3000)}


@pytest.fixture
def unbroadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_quantiles_merge_values_before_the_shuffle(spark, unbroadcast):
    from tallyforge.operators import quantiles

    df = spark.range(10_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 100).cast("double").alias("v"))
    found = quantiles.quantile(df, ["k"], "v", small=1000, accuracy=1000)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    want = df.groupBy("k").agg(F.percentile("v", 0.5).alias("quantile"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_few_rows_with_many_pairs_take_many_tasks(spark):
    from tallyforge.operators import reconcile as rc

    a = spark.range(300).select("id", F.lit(100.0).alias("value"))
    found = rc.value_range_join(a, a, 0.1, pairs=5_000)
    assert found.count() == 90_000 and found.select("left_id").distinct().count() == 300
    assert found.rdd.getNumPartitions() >= 18


def test_truths_and_queries_are_dealt_over_the_tasks_given(spark):
    from tallyforge.operators import mapping, reconcile as rc

    t, p = spark.range(50).select(F.col("id").alias("key"), F.lit(10.0).alias("truth")), spark.range(200).select((F.col("id") % 40).alias("key"), (F.col("id") % 23).cast("double").alias("value"))
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(rc.best_match(t, p, parts=9)) == rows(rc.best_match(t, p))
    docs, queries = (spark.createDataFrame([(i, w) for i in range(20) for w in (f"w{i % 5}", "all")], f"{n} long, token string") for n in ("doc", "query"))
    assert rows(mapping.tfidf(docs, queries, parts=9)) == rows(mapping.tfidf(docs, queries))


def test_media_batches_are_cut():
    import pyarrow as pa

    from tallyforge.llm.media_tiff import _slices

    cut = list(_slices([pa.RecordBatch.from_pydict({"a": list(range(150))}), pa.RecordBatch.from_pydict({"a": [7]})]))
    assert [b.num_rows for b in cut] == [64, 64, 22, 1] and [x for b in cut for x in b.column(0).to_pylist()] == [*range(150), 7]
