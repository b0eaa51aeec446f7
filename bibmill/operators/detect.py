"""Format detection by rules, and scores over groups of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import let
from .split import NUMBERED, lines

SIGNALS = {
    "numbered": NUMBERED,
    "doi": r"10\.\d{4,9}/\S+",
    "url": r"https?://",
    "year": r"\b(1[5-9]|20)\d{2}\b",
    "quoted": r'"[^"]+"',
    "terminated": r"[.!?]\s*$",
    "capital": r"^\s*[A-Z]",
}


def signal_ratios(text: Column) -> dict[str, Column]:
    found = lines(text)
    return {name: F.when(F.size(found) > 0, F.size(F.filter(found, lambda x: x.rlike(p))) / F.size(found)).otherwise(0.0) for name, p in SIGNALS.items()}


def detect_format(text: Column) -> Column:
    """The first rule that holds. The lines are split once and passed on."""

    def told(found: Column) -> Column:
        n, counted = F.size(found), lambda p: F.size(F.filter(found, lambda x: x.rlike(p)))
        return (
            F.when(n == 0, "unknown")
            .when(F.forall(found, lambda x: x.rlike(r"^\s*(https?://(dx\.)?doi\.org/|doi:\s*)?10\.\d{4,9}/\S+\s*$")), "doi_list")
            .when(text.rlike(r"@\w+\s*\{"), "bibtex")
            .when(text.rlike(r"(?m)^TY  - "), "ris")
            .when(counted(NUMBERED) >= 2, "numbered")
            .when(F.size(F.split(F.trim(text), r"\n[ \t]*\n+")) >= 2, "blank_line")
            .when(counted(r"^\s{2,}\S") * 3 >= n, "hanging")
            .otherwise("plain")
        )

    return let(lines(text), told)


def softmax(values: Column) -> Column:
    """An array's maximum and sum are worked out once, not again for each element."""
    shifted = let(F.array_max(values), lambda top: F.transform(values, lambda x: F.exp(x - top)))
    return let(shifted, lambda each: let(F.aggregate(each, F.lit(0.0), lambda a, y: a + y), lambda total: F.transform(each, lambda x: x / total)))


def normalized_entropy(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, entropy (0 for one value, 1 for all alike). Counts are added up before the shuffle."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"))
    totals = counts.groupBy(group).agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
    parts = counts.join(totals, group).select(group, "kinds", (F.col("n") / F.col("all")).alias("p"))
    return parts.groupBy(group, "kinds").agg((-F.sum(F.col("p") * F.log2("p"))).alias("h")).select(group, F.when(F.col("kinds") > 1, F.col("h") / F.log2("kinds")).otherwise(0.0).alias("entropy"))


def dominant(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """The most frequent value of each group; the one seen first wins a tie."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(group).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias("dominant"), F.max("n").alias("n"))
