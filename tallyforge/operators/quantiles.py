"""Exact quantiles of keys of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def quantile(df: DataFrame, keys: list[str], value: str, q: float = 0.5, out: str = "quantile", small: int = 100_000, accuracy: int = 100_000) -> DataFrame:
    """(keys, ``out``): the exact ``q``-quantile of each key's values that are not null, interpolated as ``percentile`` does; null keys are a key.

    No task holds a key's values. A sketch of bounded size gives each key of more than ``small`` values two bounds, around the rank by more than
    the sketch's error; values below them are only counted, equal ones between them are merged, and that remainder is ranked. The bounds are broadcast, so values
    are merged before they are shuffled.
    """
    base = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    room = 2.0 / accuracy + 2.0 / small
    ends = F.percentile_approx("_v", [max(0.0, q - room), min(1.0, q + room)], accuracy)
    b = base.groupBy(*keys).agg(F.count("*").alias("_n"), ends.alias("_e")).where(F.col("_n") > small)  # at most a row for each ``small`` rows
    b = b.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n", F.col("_e")[0].alias("_lo"), F.col("_e")[1].alias("_hi"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    met = base.join(F.broadcast(b), same, "left").where("_hi IS NULL OR _v <= _hi")
    c = met.groupBy(*keys, "_n", F.when(F.col("_lo").isNull() | (F.col("_v") >= F.col("_lo")), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    own = W.partitionBy(*(keys or [F.lit(0)]))
    c = c.withColumns({"_upto": F.sum("_c").over(own.orderBy(F.asc_nulls_first("_v"))), "_n": F.coalesce("_n", F.sum("_c").over(own))})
    at = (F.col("_n") - 1) * F.lit(float(q))
    v = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_v")))
    r = c.groupBy(*keys, "_n").agg(v(F.floor(at)).alias("_a"), v(F.ceil(at)).alias("_b"))
    share = at - F.floor(at)
    return r.select(*keys, F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((1 - share) * F.col("_a") + share * F.col("_b")).alias(out))


def with_quantile(grouped: DataFrame, df: DataFrame, keys: list[str], value: str, q: float, out: str) -> DataFrame:
    """``grouped``, a row for each key, with the quantile beside it."""
    found = quantile(df, keys, value, q, out)
    if not keys:
        return grouped.join(F.broadcast(found), F.lit(True), "left")
    same = F.lit(True)
    for i, k in enumerate(keys):
        found = found.withColumnRenamed(k, f"_q{i}")
        same = same & grouped[k].eqNullSafe(F.col(f"_q{i}"))
    return grouped.join(found, same, "left").drop(*[f"_q{i}" for i in range(len(keys))])
