"""Metric monitor on Structured Streaming: windowed means with a watermark, held against a baseline; baselines kept as state."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.numeric import alert_severity, metric_threshold, relative_change

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def windowed(history: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Mean of each metric by window; works on a stream or a table with (metric, ts, value)."""
    h = history.withWatermark("ts", late) if history.isStreaming else history
    return h.groupBy(F.window("ts", window).alias("w"), "metric").agg(F.avg("value").alias("current"), F.count("*").alias("n")).select("metric", F.col("w.start").alias("ts"), "current", "n")


def alert_stream(history: DataFrame, baseline: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Alert rows of windows that drift from ``baseline`` (metric, baseline), a static table."""
    j = windowed(history, window, late).join(baseline, "metric").withColumn("relative_change", relative_change(F.col("current"), F.col("baseline"))).withColumn("threshold", metric_threshold(F.col("metric")))
    return j.withColumn("severity", alert_severity(F.col("relative_change"), F.col("threshold"))).where("severity IS NOT NULL")


def start(alerts: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Write alerts exactly once to Parquet files; by default until what is there is done."""
    return alerts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _baselined(key, frames, state):
    """A metric's new points beside its baseline, the first point ever seen; points not behind the last one are replays or too late and give nothing."""
    import pandas as pd

    rows = pd.concat(list(frames))
    rows = rows[rows["value"].notna() & rows["ts"].notna()].sort_values(["ts", "value"]).drop_duplicates("ts")
    baseline, last = state.get if state.exists else (None, None)
    out = []
    for ts, value in zip(rows["ts"], rows["value"]):
        if last is not None and ts.value <= last:
            continue
        if baseline is None:
            baseline = float(value)
        else:
            out.append((key[0], ts, baseline, float(value)))
        last = ts.value
    if last is not None:
        state.update((baseline, last))
    yield pd.DataFrame(out, columns=["metric", "ts", "baseline", "current"])


def _judged(points: DataFrame) -> DataFrame:
    j = points.withColumn("relative_change", relative_change(F.col("current"), F.col("baseline"))).withColumn("threshold", metric_threshold(F.col("metric")))
    return j.withColumn("severity", alert_severity(F.col("relative_change"), F.col("threshold"))).where("severity IS NOT NULL")


def first_run_alerts(history: DataFrame) -> DataFrame:
    """J11, K14 on a stream of (metric, ts, value): each metric's first point is its baseline, every later one is held against it.

    The state of a metric is its baseline and the time of its last point, so a batch that comes again gives nothing. Null metrics are left out.
    """
    points = history.where("metric IS NOT NULL").select("metric", "ts", F.col("value").cast("double").alias("value")).groupBy("metric")
    return _judged(points.applyInPandasWithState(_baselined, "metric string, ts timestamp, baseline double, current double", "baseline double, last long", "append", GroupStateTimeout.NoTimeout))
