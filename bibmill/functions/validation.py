"""Predicates and policies on record fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole values that mean "not known".
PLACEHOLDERS = ["unknown", "untitled", "n/a", "na", "none", "null", "placeholder", "tbd", "to be determined", "?", "journal", "vol", "vol.", "issue", "n.d.", "s.n.", "[s.n.]"]
#: A source's rank; a strictly higher one wins.
PRIORITY = {
    "ingestion": 1, "regex_fallback": 2, "ml_extraction": 3, "ml_author_ner": 3, "ml_type_classifier": 3, "normalization": 4, "shared_repair": 4, "llm_fallback": 4,
    "doi_resolution": 5, "enrichment_crossref": 5, "enrichment_openalex": 5, "enrichment_semantic_scholar": 5, "user_correction": 6, "admin_confirmed": 7,
}
PROVIDERS = ["enrichment_crossref", "enrichment_openalex", "enrichment_semantic_scholar"]
OVERWRITE_FLOOR = 0.85


def priority(source: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[source], F.lit(0))


def is_placeholder(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(PLACEHOLDERS), F.lit(False))


def only_placeholders(c: Column) -> Column:
    """A placeholder, or a list of nothing else."""
    parts = F.filter(F.transform(F.split(c, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")
    return is_placeholder(c) | F.coalesce((F.size(parts) >= 2) & F.forall(parts, is_placeholder), F.lit(False))


def clear_placeholder(c: Column) -> Column:
    return F.when(~only_placeholders(c), c)


def valid_year(c: Column, as_of_year: int) -> Column:
    return F.coalesce(c.between(1000, as_of_year), F.lit(False))


def valid_url(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^https?://[^\s/?#]+"), F.lit(False))


def valid_pages(c: Column) -> Column:
    """One locator or a range in order, with or without a letter before."""
    start = F.regexp_extract(c, r"^[A-Za-z]?(\d+)(-[A-Za-z]?(\d+))?$", 1)
    end = F.regexp_extract(c, r"^[A-Za-z]?(\d+)(-[A-Za-z]?(\d+))?$", 3)
    return F.coalesce((start != "") & ((end == "") | (F.try_to_number(start, F.lit("9999999999")) <= F.try_to_number(end, F.lit("9999999999")))), F.lit(False))


def locator(c: Column) -> Column:
    """Without a label such as pp. or article no."""
    c = F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^pages?:\s*", ""), r"(?i)^pp?\.?:?\s*", "")
    return F.nullif(F.trim(F.regexp_replace(c, r"(?i)^article(\s+(no\.?|number))?:\s*", "")), F.lit(""))


def valid_article_number(c: Column) -> Column:
    bare = locator(c)
    return F.coalesce(bare.rlike(r"\d") & bare.rlike(r"^[\p{L}\p{N}][\p{L}\p{N}_.:/()+-]{0,80}$"), F.lit(False))


def valid_report_number(c: Column) -> Column:
    return F.coalesce(c.rlike("[A-Za-z0-9]"), F.lit(False))


def valid_authors(people: Column) -> Column:
    """At least one, and each with a family name that is one; a lone initial needs a given name."""
    def one(p: Column) -> Column:
        family, given = F.trim(F.coalesce(p["family"], F.lit(""))), F.trim(F.coalesce(p["given"], F.lit("")))
        return (family != "") & ~family.rlike(r"(?i)^et\s+al\.?$") & ~family.rlike(r"^[,.;]+$") & ~(family.rlike(r"^[A-Za-z]\.?$") & (given == ""))

    return F.coalesce((F.size(people) > 0) & F.forall(people, one), F.lit(False))


def may_overwrite(old_source: Column, old_confidence: Column, new_source: Column, new_confidence: Column) -> Column:
    """What an admin confirmed stands; providers need the floor and more than what is
    there; others need a strictly higher rank."""
    return (
        F.when(old_source == "admin_confirmed", False)
        .when(new_source.isin(PROVIDERS), (new_confidence >= OVERWRITE_FLOOR) & (new_confidence > F.coalesce(old_confidence, F.lit(0.0))))
        .otherwise(priority(new_source) > priority(old_source))
    )


def model_may_overwrite(value: Column, source: Column, reference_confidence: Column) -> Column:
    """A missing value may always be filled and an admin's never; a sure reference gives way, else nothing does."""
    return F.when(source.isNull(), True).when(source == "admin_confirmed", False).when(reference_confidence >= OVERWRITE_FLOOR, True).otherwise(value.isNull())


def merge_field(old: Column, old_source: Column, old_confidence: Column, new: Column, new_source: Column, new_confidence: Column) -> Column:
    """A null target is filled at any confidence, unless an admin confirmed it. What was
    there stays as previous."""
    take = (F.coalesce(old_source, F.lit("")) != "admin_confirmed") & new.isNotNull() & (old.isNull() | ((new_confidence >= OVERWRITE_FLOOR) & (new_confidence > F.coalesce(old_confidence, F.lit(0.0)))))
    none = F.lit(None).cast("string")
    mine = F.struct(old.alias("value"), old_source.alias("source"), old_confidence.alias("confidence"), none.alias("previous_value"), none.alias("previous_source"))
    theirs = F.struct(new.alias("value"), new_source.alias("source"), new_confidence.alias("confidence"), old.alias("previous_value"), old_source.alias("previous_source"))
    return F.when(take, theirs).otherwise(mine)
