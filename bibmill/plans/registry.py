"""Where queries register, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, source: DataFrame) -> DataFrame:
    """df dealt out evenly, over two tasks a core at least and four for each split of source,
    which is only listed. Rows that cost much are few bytes: a file of one row group
    would be one task, whatever its number of splits."""
    return df.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, 4 * source.rdd.getNumPartitions()))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
