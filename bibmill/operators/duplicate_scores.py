"""Scores of duplicate groups against expected ones, from sizes alone.

A contingency table counts rows by predicted and expected group; pairs follow from the
sizes of its cells, rows and columns, so no pair of records is ever made and a group
of any size costs one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def contingency(df: DataFrame, predicted: str, expected: str, method: str | None = None) -> DataFrame:
    """predicted, expected, method and n of rows; groups of one row predict and expect nothing."""
    told = F.col(f"`{method}`") if method else F.lit(None).cast("string")
    return df.groupBy(F.col(f"`{predicted}`").alias("predicted"), F.col(f"`{expected}`").alias("expected")).agg(F.count("*").alias("n"), F.min(told).alias("method"))


def group_scores(df: DataFrame, predicted: str, expected: str, method: str | None = None) -> DataFrame:
    """A row a predicted group of two rows or more: predicted, method, size, true_pairs and
    false_pairs. Null groups are rows alone; a null expected key matches nothing."""
    cells = contingency(df.where(F.col(f"`{predicted}`").isNotNull()), predicted, expected, method)
    true = F.when(F.col("expected").isNotNull(), pairs(F.col("n"))).otherwise(0)
    sizes = cells.groupBy("predicted").agg(F.min("method").alias("method"), F.sum("n").alias("size"), F.sum(true).cast("long").alias("true_pairs"), F.countDistinct("expected").alias("kinds"), F.min("expected").alias("expected"))
    return sizes.where("size > 1").select("predicted", "method", "size", "true_pairs", (pairs(F.col("size")).cast("long") - F.col("true_pairs")).alias("false_pairs"), "expected")


def duplicate_evaluation(df: DataFrame, predicted: str, expected: str, method: str | None = None) -> DataFrame:
    """One row: predicted_groups, predicted_pairs, expected_pairs, pair_precision, pair_recall,
    missed_pairs, false_groups, largest_bad_group, group_precision (groups without a
    false pair) and group_recall (expected groups of two rows or more met by one)."""
    groups = group_scores(df, predicted, expected, method)
    wanted = df.where(F.col(f"`{expected}`").isNotNull()).groupBy(F.col(f"`{expected}`").alias("k")).agg(F.count("*").alias("n")).where("n > 1")
    good = (F.col("false_pairs") == 0).cast("int")
    a = groups.agg(F.count("*").alias("predicted_groups"), F.coalesce(F.sum("true_pairs"), F.lit(0)).alias("tp"), F.coalesce(F.sum("false_pairs"), F.lit(0)).alias("fp"), F.coalesce(F.sum(1 - good), F.lit(0)).alias("false_groups"), F.coalesce(F.max(F.when(good == 0, F.col("size"))), F.lit(0)).alias("largest_bad_group"), F.countDistinct(F.when(good == 1, F.col("expected"))).alias("met"))
    b = wanted.agg(F.count("*").alias("wanted"), F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0)).cast("long").alias("expected_pairs"))
    share = lambda x, y: F.when(y > 0, F.round(x / y, 4)).otherwise(0.0)
    tp, fp = F.col("tp"), F.col("fp")
    one = a.join(b, F.lit(True))  # one row each
    return one.select(
        "predicted_groups", (tp + fp).alias("predicted_pairs"), "expected_pairs", share(tp, tp + fp).alias("pair_precision"), share(tp, F.col("expected_pairs")).alias("pair_recall"), (F.col("expected_pairs") - tp).alias("missed_pairs"), "false_groups", "largest_bad_group",
        share(F.col("predicted_groups") - F.col("false_groups"), F.col("predicted_groups")).alias("group_precision"), share(F.col("met"), F.col("wanted")).alias("group_recall"),
    )


def causes(df: DataFrame, predicted: str, expected: str, method: str) -> DataFrame:
    """method, groups and false_groups, by what made the groups."""
    return group_scores(df, predicted, expected, method).groupBy("method").agg(F.count("*").alias("groups"), F.sum((F.col("false_pairs") > 0).cast("int")).alias("false_groups"))
