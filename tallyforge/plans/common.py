"""Registering a query with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(df: DataFrame, rows: int = 50_000) -> int:
    """Tasks for the rows that a table gives, some ``rows`` of it each and no fewer than the session sets: what a task holds stays the same however large the table is."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def fixed(value, of: str):
    """A fixed value as a column of rows that have ``of``. A literal drops out of grouping keys, so that rows dealt by those keys would be dealt again at each step."""
    return F.when(F.col(of).isNotNull(), F.lit(value))


def r6(c):
    """Six decimals: sums of floats differ in their last bits between engines."""
    return F.round(c, 6)


def registrar(queries: dict, oracles: dict):
    def register(sql: str | None = None):
        def keep(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return keep

    return register
