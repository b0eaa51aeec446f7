"""Token tags and entity spans, as windows over token rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import rounded


def spans(df: DataFrame, text: str, at: str, token: str, tag: str, confidence: str | None = None) -> DataFrame:
    """Spans of B- and I- tags: text, label, first, last, value (the tokens joined) and the
    mean confidence. B- opens a span, and so does I- after another label or O; flawed tells
    that an I- had to."""
    w = Window.partitionBy(text).orderBy(at)
    label = F.when(F.col(tag) != "O", F.substring_index(tag, "-", -1))
    rows = df.select(text, F.col(at).alias("at"), F.col(token).alias("token"), label.alias("label"), F.col(tag).startswith("B-").alias("opens"), (F.col(confidence) if confidence else F.lit(1.0)).alias("c"))
    rows = rows.withColumn("before", F.lag("label").over(w.orderBy("at")))
    new = F.col("label").isNotNull() & (F.col("opens") | ~F.col("label").eqNullSafe(F.col("before")))
    rows = rows.withColumn("new", new.cast("int")).withColumn("span", F.sum("new").over(w.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))).where("label is not null")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]), " ")
    out = rows.groupBy(text, "span", "label").agg(F.min("at").alias("first"), F.max("at").alias("last"), joined.alias("value"), rounded(F.avg("c")).alias("confidence"), F.max((F.col("new") == 1) & ~F.col("opens")).alias("flawed"))
    return out.drop("span")


def entity_f1(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp and fn of spans that agree in all keys, by label."""
    a, b = truth.select("label", *keys).distinct().withColumn("t", F.lit(1)), found.select("label", *keys).distinct().withColumn("f", F.lit(1))
    met = a.join(b, ["label", *keys], "full")
    return met.groupBy("label").agg(F.count_if(F.col("t").isNotNull() & F.col("f").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
