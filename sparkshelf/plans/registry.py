"""Registration of queries: a key, a function of the tables, and the same result as DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The tables of one directory as attributes, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


class Registry:
    def __init__(self) -> None:
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.ORACLE: dict[str, str] = {}

    def __call__(self, key: str, sql: str | None = None) -> Callable:
        def register(build: Callable[[Tables], DataFrame]) -> Callable:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return build(Tables(spark, sf_dir))

            run.__name__, run.__doc__ = key, build.__doc__
            if key in self.QUERIES:
                raise ValueError(f"{key} is registered twice")
            self.QUERIES[key] = run
            if sql is not None:
                self.ORACLE[key] = sql
            return build

        return register
