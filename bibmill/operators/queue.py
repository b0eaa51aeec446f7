"""Review queues, record lists, caches and allowances over many users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import doi

#: Fixed value: references that a free user may have enriched in all.
FREE_REFS = 10


def record_key(raw_doi: Column, title: Column, author: Column, year: Column) -> Column:
    """The DOI, else title, first author and year in lower case."""
    text = lambda c: F.lower(F.coalesce(c.cast("string"), F.lit("")))
    return F.coalesce(F.concat(F.lit("doi:"), doi(raw_doi)), F.concat(F.lit("fallback:"), F.concat_ws("::", text(title), text(author), text(year))))


def first_of_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with kept: whether it is the first of its key. Minima are taken before the shuffle."""
    first = rows.groupBy(key).agg(F.min(order).alias("_first"))
    return rows.join(first, key).withColumn("kept", F.col(order) == F.col("_first")).drop("_first")


def group_queue(rows: DataFrame, key: str) -> DataFrame:
    """One row a key: the item to show (open before processed, then the last processed, the
    highest priority, the newest, the least item), and the group's figures. rows: item,
    processed, processed_at, priority, created_at, source (of few kinds), promoted_to. Items of a
    group are never gathered; their keys tell which belong together."""
    rank = F.struct(~F.col("processed"), F.when(F.col("processed"), F.coalesce("processed_at", "created_at")), F.col("priority"), F.col("created_at"), -F.col("item"))
    return rows.groupBy(key).agg(
        F.max_by("item", rank).alias("item"), F.max("priority").alias("priority"), F.every("processed").alias("processed"), F.max("processed_at").alias("processed_at"),
        F.max_by("created_at", rank).alias("created_at"), F.count("*").alias("duplicates"), F.array_sort(F.collect_set("source")).alias("sources"), F.max_by("promoted_to", F.when(F.coalesce("promoted_to", F.lit("")) != "", rank)).alias("promoted_to"),
    )


def cache_lookup(rows: DataFrame, cache: DataFrame, user: str, key: str, value: str) -> DataFrame:
    """value of the user's own entry, else of the shared one (without user); one entry a user and key."""
    own = cache.where(F.col(user).isNotNull()).select(user, key, F.col(value).alias("_own"))
    shared = cache.where(F.col(user).isNull()).select(key, F.col(value).alias("_shared"))
    return rows.join(own, [user, key], "left").join(shared, key, "left").withColumn(value, F.coalesce("_own", "_shared")).drop("_own", "_shared")


def enrichment_allowance(paid: Column, scope: Column, used: Column, asked: Column) -> Column:
    """ok, no_identity, over_limit or bulk."""
    left = F.greatest(F.lit(0), FREE_REFS - F.coalesce(used, F.lit(0)))
    return F.when(paid, "ok").when(scope.isNull(), "no_identity").when(left <= 0, "over_limit").when(asked > left, "bulk").otherwise("ok")


def worker_imbalance(workers: DataFrame, *measures: str) -> DataFrame:
    """The largest of each measure by its least, positive ones alone; null with fewer than two."""
    def ratio(c: str) -> Column:
        there = F.when(F.col(c) > 0, F.col(c))
        return F.when((F.count("*") > 1) & (F.count(there) > 1), F.max(there) / F.min(there)).alias(f"{c}_ratio")

    return workers.agg(F.count("*").alias("workers"), *map(ratio, measures))


def divergence(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Of two long tables (keys, field, value): by field how many were changed, added, removed."""
    both = old.where("value is not null").withColumnRenamed("value", "_old").join(new.where("value is not null").withColumnRenamed("value", "_new"), [*keys, "field"], "full")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return both.groupBy("field").agg(count(F.col("_old") != F.col("_new")).alias("changed"), count(F.col("_old").isNull()).alias("added"), count(F.col("_new").isNull()).alias("removed"))


def page(rows: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """One page in that order with the count of all rows, which is one more pass."""
    total = rows.agg(F.count("*").alias("total")).scalar()
    return rows.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)


def expand_names(rows: DataFrame, names: DataFrame, value: str) -> DataFrame:
    """value by a table (short, full), one row a short name: as it stands, then without
    periods, then whatever its case (the least short name's); else as it is."""
    exact = names.select(F.col("short").alias("_a"), F.col("full").alias("_fa"))
    plain = names.select(F.col("short").alias("_b"), F.col("full").alias("_fb"))
    low = names.groupBy(F.lower("short").alias("_c")).agg(F.min_by("full", "short").alias("_fc"))
    t = F.trim(F.col(value))
    out = rows.join(exact, t == F.col("_a"), "left").join(plain, F.replace(t, F.lit(".")) == F.col("_b"), "left").join(low, F.lower(t) == F.col("_c"), "left")
    return out.select(*[c for c in rows.columns if c != value], F.coalesce("_fa", "_fb", "_fc", t).alias(value))


def provider_rollup(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Calls, share of calls with a value, and the mean value by lower-case group."""
    return rows.groupBy(F.lower(F.trim(F.col(group))).alias(group)).agg(F.count("*").alias("calls"), F.avg(F.col(value).isNotNull().cast("int")).alias("hit_rate"), F.avg(value).alias("mean_value"))
