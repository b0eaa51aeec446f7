"""Field values in their normal form, with a log of what was done and why.

Rules are one table: a field, the rule's name, its normal form, and the least confidence
of a value that it changed. A record goes through all of them in one projection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import validation
from ..functions.text import strip_markup

# Which fields are looked through for placeholders, and the least confidences.
NAMED = ["title", "journal", "conferenceTitle", "bookTitle", "publisher", "institution", "repository", "siteName", "volume", "issue", "pages", "edition"]
CHANGED, MARKED, DATED = 0.85, 0.84, 0.9
# End of the fixed values.


def bare_doi(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^https?://(?:dx\.)?doi\.org/", ""), r"(?i)^doi:\s*", ""))


def bare_url(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\s+", ""), r"[.)]+$", "")


def bare_pages(c: Column) -> Column:
    """Without brackets or a label around it, with plain hyphens."""
    c = F.regexp_replace(F.regexp_replace(c, r"^[\[(]\s*", ""), r"\s*[\])]$", "")
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)^(?:pp?|pages?)\.?\s*", ""), "[–—]", "-")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s*-\s*", "-"), "-{2,}", "-"))


def plain_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(strip_markup(c), r"\s+", " "))


def plain_container(c: Column) -> Column:
    """Without quotes, brackets and question marks that a failed parse left at its ends."""
    c = F.regexp_replace(plain_text(c), r"^[\s\"'“”(]+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[\s,;]*\??\s*\(\s*$", ""), r"[\s\"'“”]+$", ""))


def plain_year(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(c, r"((?:19|20)\d{2})", 1), F.lit("")), c)


#: field, rule, normal form, least confidence.
RULES: list[tuple[str, str, Callable[[Column], Column], float]] = [
    ("title", "title_text_normalize", plain_text, MARKED), ("journal", "journal_text_normalize", plain_container, MARKED), ("year", "year_normalize", plain_year, DATED), ("doi", "doi_normalize", bare_doi, CHANGED), ("url", "url_normalize", bare_url, CHANGED), ("pages", "pages_normalize", bare_pages, CHANGED),
    ("edition", "edition_normalize", lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")), CHANGED), ("volume", "volume_normalize", lambda c: F.trim(F.regexp_replace(c, r"(?i)^vol(?:ume)?\.?\s*", "")), CHANGED), ("issue", "issue_normalize", lambda c: F.trim(F.regexp_replace(c, r"(?i)^(?:no|issue|number)\.?\s*", "")), CHANGED),
]


def normalize_fields(df: DataFrame, fields: list[str], suffix: str = "_confidence") -> DataFrame:
    """df with the fields (strings) in their normal forms, their confidences (columns named
    with the suffix) raised to the least of the rule that changed them, and rules: an
    array of field, rule, before and after, in the order of the rules. Placeholders go
    first. A form that would be empty leaves the value as it is; nulls stay."""
    now, sure, log = {f: F.col(f"`{f}`") for f in fields}, {f: F.col(f"`{f}{suffix}`") for f in fields}, []
    entry = lambda f, rule, before, after: F.struct(F.lit(f).alias("field"), F.lit(rule).alias("rule"), before.alias("before"), after.alias("after"))
    none = F.lit(None).cast("string")
    for f in [x for x in NAMED if x in fields]:
        gone = F.coalesce(validation.only_placeholders(now[f]), F.lit(False))
        log.append(F.when(gone, entry(f, "placeholder_clear", now[f], none)))
        now[f] = F.when(~gone, now[f])
    for f, rule, form, least in [r for r in RULES if r[0] in fields]:
        made = F.nullif(form(now[f]), F.lit(""))
        changed = F.coalesce(made != now[f], F.lit(False))
        log.append(F.when(changed, entry(f, rule, now[f], made)))
        sure[f] = F.when(changed, F.greatest(F.coalesce(sure[f], F.lit(0.0)), F.lit(least))).otherwise(sure[f])
        now[f] = F.when(changed, made).otherwise(now[f])
    others = [c for c in df.columns if c not in {*fields, *(f + suffix for f in fields), "rules"}]
    return df.select(*(F.col(f"`{c}`") for c in others), *(c.alias(f) for f, c in now.items()), *(c.alias(f + suffix) for f, c in sure.items()), F.array_compact(F.array(F.lit(None).cast("struct<field:string,rule:string,before:string,after:string>"), *log)).alias("rules"))


def corrected_type(kind: Column, has_conference: Column, cue: Column, has_journal: Column, has_book: Column) -> Column:
    """A conference paper without a conference's title or word for one is what its other containers say, else a book."""
    return F.when((kind == "conference-paper") & ~has_conference & ~cue, F.when(has_journal, "article-journal").when(has_book, "book-chapter").otherwise("book")).otherwise(kind)
