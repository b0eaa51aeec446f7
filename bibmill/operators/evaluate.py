"""Scores of predictions against truth, from counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import rounded


def precision(tp: Column, fp: Column) -> Column:
    return F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))


def recall(tp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    return [rounded(precision(tp, fp)).alias("precision"), rounded(recall(tp, fn)).alias("recall"), rounded(f1(tp, fp, fn)).alias("f1")]


def pairs(df: DataFrame, part: Column, fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """A row a field: field, part, expected, predicted. Missing values are null."""
    each = F.array(*[F.struct(F.lit(name).alias("field"), e.alias("expected"), p.alias("predicted")) for name, (e, p) in fields.items()])
    return df.select(part.alias("part"), F.explode(each).alias("x")).select("part", "x.*")


def field_scores(rows: DataFrame) -> DataFrame:
    """By field and part, and by field over all parts: counts, precision, recall and f1.
    A wrong value counts against both."""
    wrong = ~F.col("expected").eqNullSafe(F.col("predicted"))
    counts = [F.count_if(F.col("expected") == F.col("predicted")).alias("tp"), F.count_if(F.col("predicted").isNotNull() & wrong).alias("fp"), F.count_if(F.col("expected").isNotNull() & wrong).alias("fn")]
    out = rows.groupingSets([["field", "part"], ["field"]], "field", "part").agg(*counts)
    return out.select("field", F.coalesce("part", F.lit("all")).alias("part"), "tp", "fp", "fn", *scores(F.col("tp"), F.col("fp"), F.col("fn")))


def topline(by_field: DataFrame) -> DataFrame:
    """One row: the mean of the fields' f1, f1 of the summed counts, and the worst field."""
    each = f1(F.col("tp"), F.col("fp"), F.col("fn"))
    whole = f1(F.sum("tp"), F.sum("fp"), F.sum("fn"))
    return by_field.agg(rounded(F.avg(each)).alias("macro_f1"), rounded(whole).alias("micro_f1"), rounded(F.min(each)).alias("worst_f1"), F.min_by("field", each).alias("worst_field"))


def batch_health(df: DataFrame, batch: str, status: str, score: str) -> DataFrame:
    """Counts by status, the share of ready rows, mean and worst score, and the worst label."""
    n = {s: F.count_if(F.col(status) == s) for s in ("ready", "needs_review", "needs_action")}
    out = df.groupBy(batch).agg(F.count("*").alias("n"), *[c.alias(s) for s, c in n.items()], F.avg(score).alias("mean"), F.min(score).alias("worst_score"))
    label = F.when(F.col("needs_action") > 0, "needs_action").when(F.col("needs_review") > 0, "needs_review").otherwise("ready")
    return out.select(batch, "n", *n, rounded(F.col("ready") / F.col("n")).alias("success_rate"), rounded(F.col("mean"), 2).alias("mean_score"), "worst_score", label.alias("label"))
