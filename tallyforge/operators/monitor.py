"""Metric history: flattening, drift, alerts, trends, limits, regression checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..functions.numeric import alert_severity, metric_threshold, relative_change
from .quantiles import quantile


def flatten_metrics(df: DataFrame, keys: list[str], nested: str) -> DataFrame:
    """P20: a nested struct of numbers to rows (keys, metric, value), names joined by dots."""
    def walk(kind, path):
        for f in kind.fields:
            at = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, at)
            elif isinstance(f.dataType, (T.NumericType, T.BooleanType)):
                yield at

    paths = list(walk(df.schema[nested].dataType, []))
    cols = [F.struct(F.lit(".".join(p)).alias("metric"), F.col(".".join(f"`{x}`" for x in [nested, *p])).cast("double").alias("value")) for p in paths]
    return df.select(*keys, F.explode(F.array(*cols)).alias("m")).select(*keys, "m.metric", "m.value").where("value IS NOT NULL")


def drift(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(metric, current, baseline, relative_change) of metrics that both sides have."""
    return current.select("metric", F.col("value").alias("current")).join(baseline.select("metric", F.col("value").alias("baseline")), "metric").withColumn("relative_change", relative_change(F.col("current"), F.col("baseline")))


def alerts(drifts: DataFrame) -> DataFrame:
    """M5, M6: drifts beyond their metric's threshold."""
    t = metric_threshold(F.col("metric"))
    return drifts.withColumn("threshold", t).withColumn("severity", alert_severity(F.col("relative_change"), F.col("threshold"))).where("severity IS NOT NULL")


def drift_summary(drifts: DataFrame) -> DataFrame:
    """A22, A23."""
    rc = F.abs("relative_change")
    d = drifts.agg(F.count("*").alias("n"), F.max(rc).alias("drift_score"), F.avg(rc).alias("avg_change"))
    return d.withColumn("drift_detected", F.col("drift_score") > 0.15).withColumn("critical", F.col("drift_score") > 0.3).withColumn("level", F.when((F.col("drift_score") > 0.5) | (F.col("avg_change") > 0.3), "high").when((F.col("drift_score") > 0.2) | (F.col("avg_change") > 0.1), "medium").otherwise("low"))


def by_day(history: DataFrame, metric: str, ts: str, *sums) -> tuple[DataFrame, DataFrame]:
    """(history with its day _d, one row for each metric and day): no task has to order all of a metric's points."""
    h = history.withColumn("_d", F.to_date(ts))
    return h, h.groupBy(metric, "_d").agg(*sums)


def trend(history: DataFrame, metric: str = "metric", ts: str = "ts", value: str = "value") -> DataFrame:
    """M7, M8: slope over the index of each metric's points, its line, and a direction; under three points there is none.

    A point's index is its place in its day behind all days before.
    """
    h, days = by_day(history, metric, ts, F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(metric).orderBy("_d").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    h = h.join(days.select(F.col(metric), F.col("_d"), before.alias("_before")), [metric, "_d"])
    h = h.withColumn("_x", (F.row_number().over(W.partitionBy(metric, "_d").orderBy(ts)) - 1 + F.col("_before")).cast("double"))
    t = h.groupBy(metric).agg(F.count("*").alias("n"), F.regr_slope(value, "_x").alias("slope"), F.regr_intercept(value, "_x").alias("intercept"), F.min_by(value, ts).alias("first"), F.max_by(value, ts).alias("last"))
    rel = F.when(F.col("first") != 0, F.col("slope") / F.abs("first")).otherwise(F.lit(0.0))
    t = t.withColumn("relative_slope", rel)
    half = metric_threshold(F.col(metric)) / 2
    return t.withColumn("direction", F.when(F.col("n") < 3, "insufficient_data").when(F.col("relative_slope") > half, "increasing").when(F.col("relative_slope") < -half, "decreasing").otherwise("stable"))


def control_limits(history: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """Mean and mean +- 2 sample deviations of each metric."""
    return history.groupBy(metric).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")).withColumn("upper", F.col("mean") + 2 * F.col("std")).withColumn("lower", F.col("mean") - 2 * F.col("std"))


def diff_outliers(history: DataFrame, metric: str = "metric", ts: str = "ts", value: str = "value", q: float = 0.8) -> DataFrame:
    """Points whose step from the one before exceeds the metric's ``q`` quantile of steps."""
    h, days = by_day(history, metric, ts, F.max_by(value, ts).alias("_last"))
    days = days.withColumn("_prev", F.lag("_last").over(W.partitionBy(metric).orderBy("_d"))).drop("_last")
    one = F.row_number().over(W.partitionBy(metric, "_d").orderBy(ts)) == 1
    prev = F.when(one, F.col("_prev")).otherwise(F.lag(value).over(W.partitionBy(metric, "_d").orderBy(ts)))
    d = h.join(days, [metric, "_d"]).withColumn("step", F.abs(F.col(value) - prev)).drop("_d", "_prev")
    return d.join(quantile(d, [metric], "step", q, "limit"), metric).where("step > limit")


def first_last(history: DataFrame, metric: str = "metric", ts: str = "ts", value: str = "value") -> DataFrame:
    """Drift from the first to the last point; the divisor keeps its sign."""
    h = history.groupBy(metric).agg(F.min_by(value, ts).alias("first"), F.max_by(value, ts).alias("last"))
    h = h.withColumn("drift", F.when(F.col("first") != 0, F.abs(F.col("last") - F.col("first")) / F.col("first")))
    return h.withColumn("colour", F.when(F.col("drift") > 0.3, "red").when(F.col("drift") > 0.1, "orange").otherwise("green"))


def run_deltas(history: DataFrame, metric: str = "metric", ts: str = "ts", value: str = "value") -> DataFrame:
    """Each metric's last point against the one before and the one two before."""
    w = W.partitionBy(metric).orderBy(F.desc(ts))
    newest = history.withColumn("_r", F.row_number().over(w)).where("_r <= 3")  # cut to three in each task before any of them meet
    d = newest.withColumn("delta", F.col(value) - F.lead(value).over(w)).withColumn("third", F.lead(value, 2).over(w)).where("_r = 1")
    d = d.withColumn("slope3", (F.col(value) - F.col("third")) / 2)
    change = F.when(F.col("third") != 0, (F.col(value) - F.col("third")) / F.col("third"))
    return d.withColumn("trend3", F.when(change.isNull(), "unknown").when(change > 0.2, "up").when(change < -0.2, "down").otherwise("flat")).drop("_r", "third")


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """M9: each pair of columns once, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")


def baseline_rules(metrics: DataFrame, clamps: list[tuple[str, str, float, float]]) -> DataFrame:
    """rules(metric, op, expected) from current metrics. clamps: (metric, op '>=' or '<=', factor, bound)."""
    c = metrics.sparkSession.createDataFrame(clamps, "metric string, op string, factor double, bound double")
    scaled = F.col("value") * F.col("factor")
    return metrics.join(F.broadcast(c), "metric").select("metric", "op", F.when(F.col("op") == ">=", F.greatest(scaled, "bound")).otherwise(F.least(scaled, "bound")).alias("expected"))


def check_rules(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """(metric, op, expected, actual, passed)."""
    j = rules.join(metrics.select("metric", F.col("value").alias("actual")), "metric")
    return j.withColumn("passed", F.when(F.col("op") == ">=", F.col("actual") >= F.col("expected")).otherwise(F.col("actual") <= F.col("expected")))


def suite_status(checks: DataFrame) -> DataFrame:
    """A24."""
    s = checks.agg(F.count("*").alias("run"), F.sum(F.when(F.col("passed"), 0).otherwise(1)).alias("failed"))
    return s.withColumn("status", F.when(F.col("failed") == 0, "PASS").when(F.col("failed") / F.greatest("run", F.lit(1)) > 0.2, "FAIL").otherwise("WARNING"))


def simulate_failures(metrics: DataFrame, rules: DataFrame, factor: float = 1.5) -> DataFrame:
    """Every rule made harder by ``factor`` must be able to fail: (metric, detected)."""
    hard = rules.withColumn("expected", F.when(F.col("op") == ">=", F.greatest(F.col("expected"), F.lit(0.0)) * factor).otherwise(F.col("expected") / factor))
    return check_rules(metrics, hard).select("metric", (~F.col("passed")).alias("detected"))


def cutoff(history: DataFrame, days: int, now=None, ts: str = "ts") -> DataFrame:
    """rows of the last ``days`` days before ``now``; where that is None, before the newest row."""
    if now is None:
        newest = history.agg(F.max(ts).alias("_now"))
        return history.join(F.broadcast(newest), F.col(ts) >= F.col("_now") - F.make_dt_interval(F.lit(days))).drop("_now")
    return history.where(F.col(ts) >= F.lit(now) - F.make_dt_interval(F.lit(days)))


def retain(history: DataFrame, keys: list[str], n: int, ts: list) -> DataFrame:
    """The newest ``n`` rows of each key."""
    return history.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*ts))).where(F.col("_r") <= n).drop("_r")


def latest_status(runs: DataFrame, key: str, ts: str, status: str) -> DataFrame:
    """The last status of each run."""
    return runs.groupBy(key).agg(F.max_by(status, ts).alias("status"), F.max(ts).alias("ts"))


def reproducibility(history: DataFrame, n: int = 5, metric: str = "metric", ts: str = "ts", value: str = "value") -> DataFrame:
    """Mean, population deviation and CV % of each metric's last ``n`` points."""
    g = retain(history, [metric], n, [F.desc(ts)]).groupBy(metric).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return g.withColumn("cv_percent", F.when(F.col("mean") != 0, F.col("std") / F.col("mean") * 100))


def compare_runs(a: DataFrame, b: DataFrame, key: str = "stage", value: str = "value") -> DataFrame:
    """Stages of both runs and their difference."""
    return a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key).withColumn("difference", F.col("b") - F.col("a")).orderBy(key)


def write_baseline(current: DataFrame, path: str, name: str, source_id: str, created) -> None:
    """Overwrite the named baseline's partition only."""
    out = current.select("metric", "value", F.lit(created).cast("timestamp").alias("created"), F.lit(source_id).alias("source_id"), F.lit(name).alias("name"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name").parquet(path)


# The metrics of an evaluation that are tracked.
TRACKED = (
    "text_extraction.successful_extraction_rate", "text_extraction.avg_chars_per_page", "text_extraction.ocr_rate", "text_extraction.content_distribution_entropy",
    "table_extraction.total_tables_extracted", "table_extraction.avg_content_quality", "table_extraction.methods_used",
    "performance.avg_runtime_per_page", "performance.avg_throughput_pages_per_hour", "performance.avg_memory_usage_mb", "performance.overall_success_rate",
    "regression_testing.tests_passed", "regression_testing.tests_failed", "regression_testing.overall_status_numeric",
)


def tracked_metrics(evaluations: DataFrame, key: str = "id", ts: str = "ts", names=TRACKED) -> DataFrame:
    """Of the latest evaluation (id, ts, metric, value; rows as flatten_metrics makes them) every tracked metric, 0 where it is missing.

    ``names``: the metrics' names, or a frame (metric).
    """
    last = evaluations.agg(F.max_by(key, ts).alias(key), F.max(ts).alias(ts)).where(F.col(key).isNotNull())
    if isinstance(names, DataFrame):
        wanted = names.select("metric").distinct().join(F.broadcast(last), F.lit(True))  # the latest is one row
    else:
        wanted = last.select(key, ts, F.explode(F.array(*map(F.lit, names))).alias("metric"))
    return wanted.join(evaluations.select(key, "metric", "value"), [key, "metric"], "left").select(key, ts, "metric", F.coalesce("value", F.lit(0.0)).alias("value"))


def run_registry(runs: DataFrame, keep_recent: int, now, days: int) -> DataFrame:
    """Each run's last state with ``archive``: true for those older than ``days`` that are not among the newest ``keep_recent``. runs(run_id, ts, status)."""
    last = latest_status(runs, "run_id", "ts", "status")
    newest = last.orderBy(F.desc("ts"), "run_id").limit(keep_recent).select("run_id", F.lit(True).alias("_new"))  # a bound of the caller's
    old = F.col("ts") < F.lit(now) - F.make_dt_interval(F.lit(days))
    return last.join(F.broadcast(newest), "run_id", "left").select("run_id", "status", "ts", (old & F.col("_new").isNull()).alias("archive"))


def nested_value(df: DataFrame, path: str, default=None):
    """P20: the column at a dotted path, or ``default`` where the schema has no such path."""
    here = df.schema
    for part in path.split("."):
        if part not in getattr(here, "names", []):
            return F.lit(default)
        here = here[part].dataType
    return F.col(".".join(f"`{p}`" for p in path.split(".")))


def group_spread(df: DataFrame, by: str, value: str) -> DataFrame:
    """Count, mean, deviation and distinct values of each group, and whether its mean is the largest (ties: the smaller name)."""
    g = df.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.countDistinct(value).alias("n_distinct"))
    top = g.agg(F.min_by(by, F.struct(-F.col("mean"), by)).alias("_top"))
    return g.join(F.broadcast(top), F.lit(True)).withColumn("is_top", F.col(by).eqNullSafe(F.col("_top"))).drop("_top")


def synthetic_history(spark, metrics: dict[str, tuple[float, float]], days: int = 30, end="2024-12-31", seed: int = 0) -> DataFrame:
    """A demonstration history: (metric, ts, value) for ``days`` days up to ``end``; metrics: name to (mean, deviation)."""
    names = F.array(*[F.struct(F.lit(k).alias("metric"), F.lit(float(m)).alias("m"), F.lit(float(d)).alias("d")) for k, (m, d) in metrics.items()])
    each = spark.range(days).select(F.expr(f"timestamp'{end}'").alias("_end"), F.col("id").alias("_i"), F.explode(names).alias("x"))
    return each.select("x.metric", (F.col("_end") - F.make_dt_interval(F.col("_i").cast("int"))).alias("ts"), (F.col("x.m") + F.col("x.d") * F.randn(seed)).alias("value"))
