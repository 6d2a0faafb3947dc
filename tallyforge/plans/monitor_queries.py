"""Queries over metric history: events by day and type.

Daily means are sums of whole ten-thousandths, so that the order of summation does not matter.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bench, layout, monitor as mo, reconcile
from .common import r6, registrar, table

QUERIES: dict = {}
ORACLES: dict = {}
register = registrar(QUERIES, ORACLES)


def _history(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.concat("event_type", F.lit("_rate")).alias("metric"), F.to_date("ts").alias("ts")).agg((F.sum(F.round(F.col("value") * 10000).cast("long")).cast("double") / F.count("value") / 10000).alias("value"))


_H = "WITH h AS (SELECT event_type || '_rate' AS metric, ts::DATE AS ts, sum(round(value * 10000)::BIGINT)::DOUBLE / count(value) / 10000 AS value FROM events GROUP BY 1, 2) "
_D = _H + """, m AS (SELECT metric, max(ts) AS t FROM h GROUP BY 1), n AS (SELECT metric, min(ts) AS t FROM h GROUP BY 1),
d AS (SELECT a.metric, a.value AS current, b.value AS baseline, CASE WHEN b.value = 0 THEN CASE WHEN a.value <> 0 THEN 1.0 ELSE 0.0 END ELSE (a.value - b.value) / b.value END AS rc FROM h a JOIN m ON a.metric = m.metric AND a.ts = m.t JOIN h b ON b.metric = a.metric JOIN n ON b.metric = n.metric AND b.ts = n.t) """


def _drift(spark, sf_dir):
    h = _history(spark, sf_dir)
    return mo.drift(h.groupBy("metric").agg(F.max_by("value", "ts").alias("value")), h.groupBy("metric").agg(F.min_by("value", "ts").alias("value")))


@register(_D + "SELECT metric, current, baseline, round(rc, 6) AS relative_change FROM d")
def metric_drift(spark, sf_dir):
    return _drift(spark, sf_dir).select("metric", "current", "baseline", r6("relative_change").alias("relative_change"))


@register(_D + "SELECT metric, round(rc, 6) AS relative_change, CASE WHEN abs(rc) > 0.2 THEN 'critical' ELSE 'warning' END AS severity FROM d WHERE abs(rc) > 0.1")
def drift_alerts(spark, sf_dir):
    return mo.alerts(_drift(spark, sf_dir)).select("metric", r6("relative_change").alias("relative_change"), "severity")


@register(_D + "SELECT count(*) AS n, round(max(abs(rc)), 6) AS drift_score, round(avg(abs(rc)), 6) AS avg_change, max(abs(rc)) > 0.15 AS drift_detected, CASE WHEN max(abs(rc)) > 0.5 OR avg(abs(rc)) > 0.3 THEN 'high' WHEN max(abs(rc)) > 0.2 OR avg(abs(rc)) > 0.1 THEN 'medium' ELSE 'low' END AS level FROM d")
def drift_score(spark, sf_dir):
    return mo.drift_summary(_drift(spark, sf_dir)).select("n", r6("drift_score").alias("drift_score"), r6("avg_change").alias("avg_change"), "drift_detected", "level")


@register(_H + """, x AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts) - 1 AS i FROM h), t AS (SELECT metric, count(*) AS n, regr_slope(value, i) AS slope, regr_intercept(value, i) AS intercept, arg_min(value, ts) AS f FROM x GROUP BY 1)
SELECT metric, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, CASE WHEN n < 3 THEN 'insufficient_data' WHEN slope / abs(f) > 0.05 THEN 'increasing' WHEN slope / abs(f) < -0.05 THEN 'decreasing' ELSE 'stable' END AS direction FROM t""")
def trend_slope(spark, sf_dir):
    return mo.trend(_history(spark, sf_dir)).select("metric", "n", r6("slope").alias("slope"), r6("intercept").alias("intercept"), "direction")


@register(_H + "SELECT metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(avg(value) + 2 * stddev_samp(value), 6) AS upper, round(avg(value) - 2 * stddev_samp(value), 6) AS lower FROM h GROUP BY 1")
def control_limits(spark, sf_dir):
    return mo.control_limits(_history(spark, sf_dir)).select("metric", *[r6(c).alias(c) for c in ("mean", "std", "upper", "lower")])


@register(_H + ", s AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY metric ORDER BY ts)) AS step FROM h), q AS (SELECT metric, quantile_cont(step, 0.8) AS l FROM s GROUP BY 1) SELECT s.metric, s.ts, round(step, 6) AS step FROM s JOIN q USING (metric) WHERE step > l")
def diff_outliers(spark, sf_dir):
    return mo.diff_outliers(_history(spark, sf_dir)).select("metric", "ts", r6("step").alias("step"))


@register(_H + ", f AS (SELECT metric, arg_min(value, ts) AS f, arg_max(value, ts) AS l FROM h GROUP BY 1) SELECT metric, f AS first, l AS last, round(abs(l - f) / f, 6) AS drift, CASE WHEN abs(l - f) / f > 0.3 THEN 'red' WHEN abs(l - f) / f > 0.1 THEN 'orange' ELSE 'green' END AS colour FROM f")
def first_last_drift(spark, sf_dir):
    return mo.first_last(_history(spark, sf_dir)).select("metric", "first", "last", r6("drift").alias("drift"), "colour")


@register(_H + """, w AS (SELECT *, value - lag(value) OVER o AS delta, lag(value, 2) OVER o AS t, row_number() OVER (PARTITION BY metric ORDER BY ts DESC) AS r FROM h WINDOW o AS (PARTITION BY metric ORDER BY ts))
SELECT metric, ts, round(delta, 6) AS delta, round((value - t) / 2, 6) AS slope3, CASE WHEN (value - t) / t > 0.2 THEN 'up' WHEN (value - t) / t < -0.2 THEN 'down' WHEN t IS NULL THEN 'unknown' ELSE 'flat' END AS trend3 FROM w WHERE r = 1""")
def run_delta(spark, sf_dir):
    return mo.run_deltas(_history(spark, sf_dir)).select("metric", "ts", r6("delta").alias("delta"), r6("slope3").alias("slope3"), "trend3")


@register(_H + ", w AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts DESC) AS r FROM h) SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(stddev_pop(value) / avg(value) * 100, 6) AS cv_percent FROM w WHERE r <= 5 GROUP BY 1")
def reproducibility(spark, sf_dir):
    return mo.reproducibility(_history(spark, sf_dir)).select("metric", *[r6(c).alias(c) for c in ("mean", "std", "cv_percent")])


_CLAMPS = [("click_rate", ">=", 0.8, 0.5), ("view_rate", ">=", 1.5, 0.5), ("purchase_rate", "<=", 1.2, 1000.0), ("signup_rate", "<=", 0.5, 1000.0), ("error_rate", "<=", 2.0, 1000.0)]
_V = ", ".join(f"('{m}', '{o}', {f}, {b})" for m, o, f, b in _CLAMPS)
_RULES = _H + f""", c AS (SELECT * FROM (VALUES {_V}) AS v(metric, op, factor, bound)), a AS (SELECT metric, avg(value) AS base, arg_max(value, ts) AS actual FROM h GROUP BY 1),
k AS (SELECT metric, op, CASE WHEN op = '>=' THEN greatest(base * factor, bound) ELSE least(base * factor, bound) END AS expected, actual FROM a JOIN c USING (metric)) """


def _checked(spark, sf_dir):
    h = _history(spark, sf_dir)
    rules = mo.baseline_rules(h.groupBy("metric").agg(F.avg("value").alias("value")), _CLAMPS)
    return h.groupBy("metric").agg(F.max_by("value", "ts").alias("value")), rules


@register(_RULES + "SELECT metric, op, round(expected, 6) AS expected, actual, CASE WHEN op = '>=' THEN actual >= expected ELSE actual <= expected END AS passed FROM k")
def regression_checks(spark, sf_dir):
    now, rules = _checked(spark, sf_dir)
    return mo.check_rules(now, rules).select("metric", "op", r6("expected").alias("expected"), "actual", "passed")


@register(_RULES + "SELECT metric, NOT (CASE WHEN op = '>=' THEN actual >= greatest(expected, 0) * 1.5 ELSE actual <= expected / 1.5 END) AS detected FROM k")
def failure_simulation(spark, sf_dir):
    now, rules = _checked(spark, sf_dir)
    return mo.simulate_failures(now, rules)


@register(_RULES + ", p AS (SELECT count(*) AS run, count(*) FILTER (NOT CASE WHEN op = '>=' THEN actual >= expected ELSE actual <= expected END) AS failed FROM k) SELECT run, failed, CASE WHEN failed = 0 THEN 'PASS' WHEN failed::DOUBLE / greatest(run, 1) > 0.2 THEN 'FAIL' ELSE 'WARNING' END AS status FROM p")
def regression_status(spark, sf_dir):
    now, rules = _checked(spark, sf_dir)
    return mo.suite_status(mo.check_rules(now, rules)).select("run", F.col("failed").cast("long").alias("failed"), "status")


@register("""
WITH s AS (SELECT event_type AS stage, round(sum(value), 2) AS t, count(*) AS n, round(max(value), 4) AS mb, CASE WHEN event_type = 'error' THEN 'failed' END AS error FROM events GROUP BY 1)
SELECT count(*) AS n_stages, round(sum(t), 2) AS total_seconds, sum(n)::BIGINT AS total_files, round(sum(mb), 2) AS total_mb, round(avg((error IS NULL)::INT), 6) AS success_share FROM s
""")
def pipeline_summary(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(F.round(F.sum("value"), 2).alias("processing_time_seconds"), F.count("*").alias("files_processed"), F.round(F.max("value"), 4).alias("output_size_mb"))
    s = s.withColumn("error", F.when(F.col("stage") == "error", "failed"))
    return bench.pipeline_summary(s).select("n_stages", F.round("total_seconds", 2).alias("total_seconds"), "total_files", F.round("total_mb", 2).alias("total_mb"), r6("success_share").alias("success_share"))


@register("""
WITH w AS (SELECT *, CASE WHEN lag(ts) OVER o IS NULL OR ts - lag(ts) OVER o >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::INT AS block FROM w)
SELECT user_id, block, count(*) AS n, min(event_id) AS first_event FROM g GROUP BY 1, 2
""")
def word_blocks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    late = lambda w: F.lag("ts").over(w).isNull() | (F.col("ts") - F.lag("ts").over(w) >= F.expr("INTERVAL 1 HOUR"))
    return layout.gap_groups(e, ["user_id"], ["ts", "event_id"], late, "block").groupBy("user_id", "block").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@register("""
WITH RECURSIVE e AS (SELECT user_id, ts::DATE AS day, event_id, epoch_us(ts) / 6e7 AS m, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT user_id, day, event_id, n, 1 AS line, m AS anchor FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.day, e.event_id, e.n, CASE WHEN abs(e.m - w.anchor) < 60 THEN w.line ELSE w.line + 1 END, CASE WHEN abs(e.m - w.anchor) < 60 THEN w.anchor ELSE e.m END FROM w JOIN e ON e.user_id = w.user_id AND e.day = w.day AND e.n = w.n + 1)
SELECT user_id, day, event_id, line FROM w
""")
def line_anchor_group(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("es"))
    e = e.withColumn("gs", layout.anchor_groups(F.transform("es", lambda x: F.unix_micros(x["ts"].cast("timestamp")) / 6e7), 60))
    return e.select("user_id", "day", F.explode(F.arrays_zip("es", "gs")).alias("z")).select("user_id", "day", F.col("z.es.event_id").alias("event_id"), F.col("z.gs").alias("line"))


@register(_H + ", l AS (SELECT * FROM h WHERE ts >= (SELECT max(ts) FROM events)::TIMESTAMP - INTERVAL 7 DAY) SELECT metric, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts DESC) AS r FROM l) WHERE r <= 3")
def history_cutoff(spark, sf_dir):
    return mo.retain(mo.cutoff(_history(spark, sf_dir), 7), ["metric"], 3, [F.desc("ts")]).select("metric", "ts", "value")


@register("SELECT event_type, count(*) AS n, count(DISTINCT props) AS n_props, max(length(props))::INT AS longest FROM events GROUP BY 1")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("props").alias("n_props"), F.max(F.length("props")).alias("longest"))


@register("SELECT user_id, arg_max(event_type, struct_pack(ts, event_id)) AS status, max(ts) AS ts FROM events GROUP BY 1")
def latest_status(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return mo.latest_status(e, "user_id", "at", "event_type").select("user_id", "status", F.col("ts.ts").alias("ts"))


@register("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY event_id) AS r FROM events) WHERE r = 1")
def dedupe_keep_first(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("concept"), F.col("event_type").alias("context_id"), F.to_date("ts").alias("numeric_value"), F.lit(None).cast("string").alias("segment"))
    return reconcile.first_facts(e, "event_id").select("event_id", F.col("concept").alias("user_id"), F.col("context_id").alias("event_type"))


@register("""WITH e AS (SELECT event_id AS id, ts, event_type || '.value' AS metric, value FROM events UNION ALL SELECT event_id, ts, event_type || '.user', user_id::DOUBLE FROM events),
l AS (SELECT arg_max(id, struct_pack(ts, id)) AS id FROM e), w AS (SELECT DISTINCT metric FROM e)
SELECT l.id AS id, w.metric AS metric, coalesce(e.value, 0)::DOUBLE AS value FROM l CROSS JOIN w LEFT JOIN e ON e.id = l.id AND e.metric = w.metric""")
def tracked_metrics(spark, sf_dir):
    """The last event as an evaluation; metrics of the other types are missing from it and count as 0."""
    e = table(spark, sf_dir, "events")
    kinds = e.select("event_type").distinct().select(F.explode(F.array(*[F.concat("event_type", F.lit(f".{x}")) for x in ("value", "user")])).alias("metric"))
    long = e.select(F.col("event_id").alias("id"), F.struct("ts", "event_id").alias("ts"), F.explode(F.array(F.struct(F.concat("event_type", F.lit(".value")).alias("m"), F.col("value").cast("double").alias("v")), F.struct(F.concat("event_type", F.lit(".user")).alias("m"), F.col("user_id").cast("double").alias("v")))).alias("x"))
    found = mo.tracked_metrics(long.select("id", "ts", F.col("x.m").alias("metric"), F.col("x.v").alias("value")), names=kinds)
    return found.select("id", "metric", "value")


@register(_H + """, b AS (SELECT metric, arg_min(value, ts) AS b, min(ts) AS t FROM h GROUP BY 1),
r AS (SELECT metric, ts, b AS baseline, value AS current, CASE WHEN b = 0 THEN CASE WHEN value <> 0 THEN 1.0 ELSE 0.0 END ELSE (value - b) / b END AS rc FROM h JOIN b USING (metric) WHERE ts > t)
SELECT metric, ts, round(current, 6) AS current, round(baseline, 6) AS baseline, CASE WHEN abs(rc) > 0.2 THEN 'critical' ELSE 'warning' END AS severity FROM r WHERE abs(rc) > 0.1""")
def first_run_alerts(spark, sf_dir):
    """J11, K14 as a stream: daily means in three batches of files, the second of which comes twice."""
    from ..sources import scratch
    from ..streaming import monitor as stream

    path, h = scratch.folder(spark, "stream"), _history(spark, sf_dir).select("metric", F.col("ts").cast("timestamp").alias("ts"), "value")
    third = F.pmod(F.datediff("ts", F.lit("2024-01-01")), F.lit(31))
    for part in (h.where(third < 10), h.where((third >= 10) & (third < 20)), h.where((third >= 10) & (third < 20)), h.where(third >= 20)):
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
    history = spark.readStream.schema(h.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    stream.start(stream.first_run_alerts(history), f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.schema("metric string, ts timestamp, baseline double, current double, relative_change double, threshold double, severity string").parquet(f"{path}/out").select("metric", F.to_date("ts").alias("ts"), r6("current").alias("current"), r6("baseline").alias("baseline"), "severity")
