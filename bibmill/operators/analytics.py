"""Rollups, series, quotas and paging over event and record tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def zero_filled(df: DataFrame, at: str, *aggs) -> DataFrame:
    """A row for each day from the first to the last, zeros where nothing happened."""
    daily = df.groupBy(F.to_date(at).alias("day")).agg(*aggs)
    days = daily.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(daily, "day", "left").na.fill(0)


def running_quota(df: DataFrame, scope: list[str], order: list[str], amount, limit) -> DataFrame:
    """Adds used (with this row) and allowed."""
    w = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("used", F.sum(amount).over(w)).withColumn("allowed", F.col("used") <= limit)


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    return df.where(F.col(key) > after).orderBy(key).limit(size)


def sessions(df: DataFrame, who: str, at: str, tie: str, gap_seconds: int) -> DataFrame:
    """Adds session, counted from 1 for each who: a gap of more than gap_seconds opens one."""
    w = Window.partitionBy(who).orderBy(at, tie)
    gap = F.col(at).cast("timestamp").cast("double") - F.lag(at).over(w).cast("timestamp").cast("double")
    rows = df.withColumn("_new", (gap.isNull() | (gap > gap_seconds)).cast("int"))
    return rows.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def islands(df: DataFrame, who: str, value: str, order: list[str]) -> DataFrame:
    """Runs of equal values in a row's order: who, value, run, n."""
    w = Window.partitionBy(who).orderBy(*order)
    rows = df.withColumn("_new", F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(1)))
    return rows.withColumn("run", F.sum("_new").over(w)).groupBy(who, value, "run").agg(F.count("*").alias("n"))
