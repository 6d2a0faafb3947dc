"""Run summaries and cost: derived columns, bottlenecks, totals, price models, projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

COMPUTE_PRICE, OVERHEAD = 0.096, 1.3  # USD an hour; factor for overhead


def derive(results: DataFrame) -> DataFrame:
    """P19."""
    one = lambda c: F.greatest(F.col(c), F.lit(1))
    return (
        results.withColumn("runtime_per_page", F.col("runtime_seconds") / one("pages_processed"))
        .withColumn("memory_delta_mb", F.col("memory_peak_mb") - F.col("memory_baseline_mb"))
        .withColumn("success_percent", 100 * F.col("success_count") / F.greatest(F.col("success_count") + F.col("failure_count"), F.lit(1)))
        .withColumn("pages_per_hour", F.when(F.col("runtime_seconds") > 0, F.col("pages_processed") * 3600 / F.col("runtime_seconds")).otherwise(0.0))
    )


def top(df: DataFrame, by: str, ties: list[str], n: int = 3) -> DataFrame:
    """A top-n report."""
    return df.orderBy(F.desc(by), *ties).limit(n)


def bottlenecks(derived: DataFrame) -> DataFrame:
    """Spread of the derived columns and what to look at."""
    s = derived.agg(*[f(c).alias(f"{n}_{c}") for c in ("runtime_per_page", "memory_delta_mb", "pages_per_hour") for n, f in (("avg", F.avg), ("std", F.stddev_samp), ("max", F.max))], F.avg("cpu_percent_avg").alias("avg_cpu"))
    tips = F.array(F.when(F.col("avg_runtime_per_page") > 10, "slow pages"), F.when(F.col("avg_memory_delta_mb") > 500, "memory"), F.when(F.col("avg_cpu") < 50, "idle processors"), F.when(F.col("avg_pages_per_hour") < 120, "throughput"))
    return s.withColumn("recommendations", F.filter(tips, lambda x: x.isNotNull()))


def pipeline_summary(stages: DataFrame) -> DataFrame:
    """A19."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    ok = F.col("error").isNull()
    return stages.agg(F.count("*").alias("n_stages"), F.sum(z("processing_time_seconds")).alias("total_seconds"), F.sum(z("files_processed")).alias("total_files"), F.sum(z("output_size_mb")).alias("total_mb"), F.avg(ok.cast("double")).alias("success_share"), F.sum(F.when(ok, 0).otherwise(1)).alias("n_errors"))


def cost(runtime_per_page, pages):
    """USD for ``pages`` pages."""
    return pages * runtime_per_page / 3600 * COMPUTE_PRICE * OVERHEAD


def volume_tier(pages):
    return F.when(pages < 1000, "small").when(pages < 10000, "medium").otherwise("large")


def cost_model(runtime: DataFrame, prices: list[tuple[str, float]], pages: list[int]) -> DataFrame:
    """Own cost against each service's at each volume. ``runtime`` has one row, runtime_per_page; the lists are constants."""
    grid = [F.struct(F.lit(s).alias("service"), F.lit(float(p)).alias("price"), F.lit(int(n)).alias("pages")) for s, p in prices for n in pages]
    g = runtime.select("runtime_per_page", F.explode(F.array(*grid)).alias("g")).select("runtime_per_page", "g.*")
    return g.select("service", "pages", (F.col("price") * F.col("pages")).alias("service_cost"), cost(F.col("runtime_per_page"), F.col("pages")).alias("own_cost"), volume_tier(F.col("pages")).alias("tier")).withColumn("cheaper", F.when(F.col("own_cost") < F.col("service_cost"), "own").otherwise("service"))


def best_run(runs: DataFrame, by: str, lowest: bool = False) -> DataFrame:
    """First wins among equals, by run id."""
    return runs.orderBy(F.col(by).asc_nulls_last() if lowest else F.col(by).desc_nulls_last(), "run_id").limit(1)


def throughput(results: DataFrame, memory: str = "memory_peak_mb", cpu: str = "cpu_percent_avg") -> DataFrame:
    """Pages a second and an hour, pages by second and megabyte, and pages an hour over memory and processor use."""
    rate = lambda per: F.when(per > 0, F.col("pages_processed") / per).otherwise(0.0)
    r = results.withColumn("pages_per_second", rate(F.col("runtime_seconds"))).withColumn("pages_per_hour", 3600 * F.col("pages_per_second"))
    used = F.col(memory) + F.col(cpu)
    return r.withColumn("efficiency_score", rate(F.col("runtime_seconds") * F.col(memory))).withColumn("resource_efficiency", F.when(used > 0, F.col("pages_per_hour") / used).otherwise(0.0))
