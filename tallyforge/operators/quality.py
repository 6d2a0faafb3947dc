"""Consistency of extraction: text and method statistics, histogram entropy, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def text_consistency(pages: DataFrame, by: list[str], text: str = "text", ocr=None) -> DataFrame:
    """Pages, success rate, means, spread."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    words = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != ""))
    digits = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit("[0-9]"))
    ocr = F.lit(False) if ocr is None else ocr
    p = pages.select(*by, n.alias("_n"), words.alias("_w"), digits.alias("_d"), ocr.alias("_o"))
    return p.groupBy(*by).agg(
        F.count("*").alias("n_pages"), F.avg(F.when(F.col("_n") > 0, 1.0).otherwise(0.0)).alias("success_rate"), F.avg("_n").alias("avg_chars"), F.avg("_w").alias("avg_words"),
        F.avg(F.col("_d") / F.greatest("_n", F.lit(1))).alias("avg_numeric_ratio"), F.stddev_samp("_n").alias("std_chars"),
        (F.stddev_samp("_n") / F.greatest(F.avg("_n"), F.lit(1.0))).alias("char_count_cv"), (F.stddev_samp("_w") / F.greatest(F.avg("_w"), F.lit(1.0))).alias("word_count_cv"), F.avg(F.col("_o").cast("double")).alias("ocr_rate"),
    )


def histogram_entropy(df: DataFrame, by: list[str], value: str, bins: int = 10) -> DataFrame:
    """M3: entropy in bits of at most ``bins`` equal-width bins; the last one is closed, equal values give 0. Only bin counts are shuffled."""
    r = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("n"))
    k = F.least("n", F.lit(bins))
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * k), k - 1))
    c = df.where(F.col(value).isNotNull()).join(r, by).groupBy(*by, "n", at.alias("bin")).agg(F.count("*").alias("c"))
    p = F.col("c") / F.col("n")
    return c.groupBy(*by).agg(F.round(-F.sum(p * F.log2(p)), 6).alias("entropy"))


def method_comparison(df: DataFrame, method: str, quality) -> DataFrame:
    """Mean, population spread, count by method."""
    return df.select(method, quality.alias("_q")).groupBy(method).agg(F.avg("_q").alias("avg_quality"), F.coalesce(F.stddev_pop("_q"), F.lit(0.0)).alias("std_quality"), F.count("_q").alias("n"))


def method_agreement(means: DataFrame, method: str, value: str) -> DataFrame:
    """Mean of max(0, 1 - |a - b| / max) over pairs of methods. ``means`` has one row a method: few."""
    a, b = means.select(F.col(method).alias("a"), F.col(value).alias("va")), means.select(F.col(method).alias("b"), F.col(value).alias("vb"))
    top = F.greatest("va", "vb")
    s = F.when(top == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(F.col("va") - F.col("vb")) / top))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).agg(F.count("*").alias("n_pairs"), F.avg(s).alias("agreement"))


def method_overlap(df: DataFrame, group: str, method: str, value: str) -> DataFrame:
    """How many groups several methods reach, and how alike their counts are."""
    g = df.groupBy(group, method).agg(F.count(value).alias("n")).groupBy(group).agg(F.count("*").alias("m"), F.stddev_samp("n").alias("sd"), F.avg("n").alias("mean"))
    many = F.col("m") > 1
    return g.agg(F.count("*").alias("n_groups"), F.sum(F.when(many, 1).otherwise(0)).alias("n_overlap"), F.avg(many.cast("double")).alias("overlap_ratio"), F.avg(F.when(many, 1 - F.col("sd") / F.greatest("mean", F.lit(1.0)))).alias("count_similarity"))


def first_of_methods(df: DataFrame, page: list[str], method: str, order: str, a: str, b: str, cols: list[str]) -> DataFrame:
    """The first row of method ``a`` beside the first of ``b``, on pages that have both."""
    first = df.where(F.col(method).isin(a, b)).withColumn("_r", F.row_number().over(W.partitionBy(*page, method).orderBy(order))).where("_r = 1")
    return first.groupBy(*page).agg(*[F.max(F.when(F.col(method) == m, F.col(c))).alias(f"{c}_{s}") for m, s in ((a, "a"), (b, "b")) for c in cols], F.countDistinct(method).alias("_m")).where("_m = 2").drop("_m")


def band(ratio):
    """J15's message of a ratio."""
    return F.when(ratio.isNull(), "missing").when(ratio < 0.5, "much_less").when(ratio > 1.5, "much_more").otherwise("similar")
