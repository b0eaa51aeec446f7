"""Rows of training data: checks before certification, quarantine, tagged rows; and limits on open jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers
from ..functions.text import truth_hash

#: Jobs that a scope of each plan may have open, and the mark of a row set aside.
OPEN_JOBS = {"anonymous": 1, "free": 2, "pro": 10}
QUARANTINED = "quarantined"


def lint(doi: Column, url: Column, isbn: Column, issn: Column, year: Column, pages: Column) -> Column:
    """Codes of what is wrong with a row's fields; null and empty fields are not checked."""
    there = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    read, linked = identifiers.doi(doi), identifiers.doi(url)
    return F.array_compact(F.array(
        F.when(there(doi) & read.isNull(), "DOI_INVALID"), F.when(read != linked, "DOI_URL_MISMATCH"), F.when(there(isbn) & identifiers.isbn(isbn).isNull(), "ISBN_INVALID"),
        F.when(there(issn) & identifiers.issn(issn).isNull(), "ISSN_INVALID"), F.when(there(year) & ~F.trim(year).rlike(r"^\d{4}$"), "YEAR_FORMAT_INVALID"), F.when(there(pages) & ~pages.rlike(r"\d"), "PAGES_FORMAT_INVALID"),
    ))


def quarantine(rows: DataFrame, synthetic: Column, reason: str) -> DataFrame:
    """Sets synthetic rows aside by row_status and quarantine_reason; the others stay as they are."""
    on = F.coalesce(synthetic, F.lit(False)) & ~F.coalesce(F.col("row_status") == QUARANTINED, F.lit(False))
    return rows.withColumns({"row_status": F.when(on, QUARANTINED).otherwise(F.col("row_status")), "quarantine_reason": F.when(on, reason).otherwise(F.col("quarantine_reason"))})


def restore(rows: DataFrame, synthetic: Column) -> DataFrame:
    """Takes back what quarantine did."""
    on = F.coalesce(synthetic, F.lit(False)) & F.coalesce(F.col("row_status") == QUARANTINED, F.lit(False))
    return rows.withColumns({"row_status": F.when(~on, F.col("row_status")), "quarantine_reason": F.when(~on, F.col("quarantine_reason"))})


def gold_rows(rows: DataFrame, quarantined: bool = False) -> DataFrame:
    """Tagged rows fit for training, with problem: null, or what a reader would refuse them
    for. rows: raw_text, bio_tokens, bio_tags, row_status, trust_level, input_hash. Drafts
    and rows set aside go, unless quarantined asks for them; a missing hash is made."""
    kept = rows if quarantined else rows.where((F.coalesce("row_status", F.lit("")) != QUARANTINED) & (F.coalesce("trust_level", F.lit("")) != "draft"))
    none = lambda c: F.coalesce(F.size(c) <= 0, F.lit(True)) | F.coalesce(F.exists(c, lambda x: x.isNull()), F.lit(False))
    problem = (
        F.when(F.trim(F.coalesce("raw_text", F.lit(""))) == "", "no text").when(none("bio_tokens"), "no tokens").when(none("bio_tags"), "no tags")
        .when(F.size("bio_tokens") != F.size("bio_tags"), "unequal lengths")
    )
    return kept.withColumns({"problem": problem, "input_hash": F.coalesce("input_hash", truth_hash(F.col("raw_text")))})


def job_admission(requests: DataFrame, jobs: DataFrame, scope: str, plan: str, active: Column, overall: int) -> DataFrame:
    """requests with reason: ok, scope_limit or global_limit, by how many jobs are active in
    their scope and in all. Jobs are counted by scope first."""
    held = jobs.where(active).groupBy(scope).agg(F.count("*").alias("_open"))
    every = held.agg(F.coalesce(F.sum("_open"), F.lit(0))).scalar()
    limit = F.create_map(*[F.lit(x) for kv in OPEN_JOBS.items() for x in kv])[F.col(plan)]
    told = F.when(F.coalesce("_open", F.lit(0)) >= F.coalesce(limit, F.lit(OPEN_JOBS["anonymous"])), "scope_limit").when(every >= overall, "global_limit").otherwise("ok")
    return requests.join(held, scope, "left").withColumn("reason", told).drop("_open")
