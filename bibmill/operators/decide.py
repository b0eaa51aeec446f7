"""Decisions on records and outputs, as rules in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Producers of a field, a higher number wins; and how sure a DOI is that was read, or recovered.
OWNERS = {"deterministic": 1, "bio": 2, "enrichment": 3}
DOI_CONFIDENCE, RECOVERED_CONFIDENCE, LOW_CONFIDENCE = 0.98, 0.72, 0.7


def publish_gate(failed_examples: Column, critical: Column, changed_styles: Column, reviewed: Column) -> Column:
    """status and reasons; the arguments but the last are arrays of strings."""
    listed = lambda label, c, on: F.when((F.size(c) > 0) & on, F.concat(F.lit(f"{label}:"), F.array_join(c, ",")))
    reasons = F.array_compact(F.array(listed("golden_examples_failed", failed_examples, F.lit(True)), listed("critical_failures", critical, F.lit(True)), listed("output_diff_review_required", changed_styles, ~reviewed)))
    return F.struct(F.when(F.size(reasons) == 0, "publishable").otherwise("blocked").alias("status"), reasons.alias("reasons"))


def output_status(critical: Column, abstained: Column, confidence: Column, needs_review: Column, repaired: Column) -> Column:
    return F.when(critical, "failed").when(abstained, "abstained").when(needs_review | F.coalesce(confidence < LOW_CONFIDENCE, F.lit(False)), "needs_review").when(repaired, "repaired").otherwise("ready")


def parse_outcome(failed: Column, status: Column, open_fields: Column) -> Column:
    """open_fields: how many mandatory fields are missing, invalid or unsure."""
    return F.when(failed | (status == "needs_action"), "needs_action").when((status != "ready") | (open_fields > 0), "partial_parse_with_abstentions").otherwise("high_confidence_parse")


def doi_confidence(doi: Column, recovered: Column) -> Column:
    return F.when(doi.isNotNull(), F.when(recovered, RECOVERED_CONFIDENCE).otherwise(DOI_CONFIDENCE))


def owner_rank(owner: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in OWNERS.items() for x in kv])[owner]


#: What makes a text look like a reference.
ANCHORS = r"(?i)10\.\d{4,9}/\S+|https?://\S+|\b(19|20)\d{2}\b"


def not_citation_like(text: Column, weak: Column) -> Column:
    """Empty, up to three words without a DOI or address, or weak signals without any anchor."""
    words = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""))
    return (words == 0) | ((words <= 3) & ~text.rlike(r"(?i)10\.\d{4,9}/\S+|https?://\S+")) | (weak & ~text.rlike(ANCHORS))


def ood_score(text: Column, weak: Column, truncated_url: Column, top_confidence: Column) -> Column:
    """How far a text is from what the classifier knows, 0 to 1 with four places."""
    words = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""))
    on = lambda c, w: F.when(c, w).otherwise(0.0)
    total = F.greatest(F.lit(0.0), 1 - top_confidence) + on(weak, 0.22) + on(truncated_url, 0.26) + on(words <= 8, 0.12) + on(~text.rlike(ANCHORS), 0.18)
    return F.floor(F.least(F.lit(1.0), total) * 10000 + 0.5) / 10000


def within_days(df: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Rows of the last days, of which there are 1 to 90."""
    return df.where(F.col(at) >= now - F.expr(f"INTERVAL {max(1, min(90, days))} DAYS"))


def slice_rows(df: DataFrame, number: str, first: int, last: int) -> DataFrame:
    """Rows first to last by a number from 1, both included; an error past the end."""
    if first < 1 or last < first:
        raise ValueError("a slice goes from a row to a later one")
    if df.where(F.col(number) >= first).isEmpty():
        raise ValueError("the slice starts past the end")
    return df.where(F.col(number).between(first, last))


def contains_filter(df: DataFrame, **wanted: str) -> DataFrame:
    """Rows whose columns hold the texts wanted, whatever the case; empty ones don't filter."""
    for name, text in wanted.items():
        if text:
            df = df.where(F.contains(F.lower(name), F.lit(text.lower())))
    return df
