"""Matching records with authority tables, overlays and interval matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the order given."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def overlay(df: DataFrame, tables: list[DataFrame], key: str, value: str) -> DataFrame:
    """value from the first table that has one for the key, else df's own; tables have one row a key."""
    out, names = df, []
    for k, t in enumerate(tables):
        out = out.join(t.select(key, F.col(value).alias(f"_v{k}")), key, "left")
        names.append(f"_v{k}")
    return out.withColumn(value, F.coalesce(*names, value)).drop(*names)


def within(left: DataFrame, right: DataFrame, keys: list[str], at: str, start: str, seconds: int) -> DataFrame:
    """left rows whose time lies in [start, start + seconds) of a right row of the same
    keys. Times are cut into buckets of that length, so it is an equi-join with at
    most two buckets for each right row, not a product."""
    cell = lambda c: F.floor(F.col(c).cast("timestamp").cast("long") / seconds)
    r = right.withColumn("_cell", F.explode(F.array(cell(start), cell(start) + 1)))
    met = left.withColumn("_cell", cell(at)).join(r, [*keys, "_cell"])
    return met.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(start) + F.expr(f"INTERVAL {seconds} SECONDS"))).drop("_cell")


def upsert_sum(old: DataFrame, new: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """Adds new counters to old ones; keys of either side stay."""
    a, b = old.select(*keys, *[F.col(c).alias(f"_a{c}") for c in counters]), new.select(*keys, *[F.col(c).alias(f"_b{c}") for c in counters])
    return a.join(b, keys, "full").select(*keys, *[(F.coalesce(f"_a{c}", F.lit(0)) + F.coalesce(f"_b{c}", F.lit(0))).alias(c) for c in counters])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those rows of new whose keys old lacks, one a key."""
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti"))
