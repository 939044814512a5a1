"""How queries are named and paired with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import small_batches


class Book:
    """Queries of a module by name, and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(f: Callable[[SparkSession, str], DataFrame]):
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """Rows that portable SQL makes of the given tables, the same in Spark and in the oracle."""
    return spark.sql(sql.format(**{n: "{" + n + "}" for n in names}) if names else sql, **{n: table(spark, sf_dir, n) for n in names})
