"""Record health: status and scores. Which fields a type must have stands in schemas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def status(missing_fields: Column, invalid_fields: Column, unsure_fields: Column, severities: Column) -> Column:
    """needs_action for a mandatory field that is missing or invalid or a warning of that
    severity; needs_review for an unsure one or a warning to review; else ready. Arrays."""
    asks = (F.size(missing_fields) > 0) | (F.size(invalid_fields) > 0) | F.array_contains(severities, "action")
    return F.when(asks, "needs_action").when((F.size(unsure_fields) > 0) | F.array_contains(severities, "review"), "needs_review").otherwise("ready")


def raw_score(field: Column, form: Column, structure: Column, penalty: Column) -> Column:
    """0 to 100, half up."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(100 * (0.4 * field + 0.35 * form + 0.25 * structure) - penalty + 0.5))).cast("int")


def certainty(score: Column) -> Column:
    return F.when(score >= 85, "high").when(score >= 60, "medium").otherwise("low")
