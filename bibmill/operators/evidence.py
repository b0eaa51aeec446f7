"""What can be wrong with a record's fields: a reason for each value that isn't valid, how
much evidence the fields give, and how well they are kept apart from each other."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import identifiers, validation
from ..functions.bind import let
from ..functions.text import comparable
from .schemas import SCHEMAS

# Fields by the kind of check, and the reasons.
IDENTIFIERS = {"doi": "DOI format", "pmid": "PMID format", "arxiv": "arXiv format", "isbn": "ISBN format", "issn": "ISSN format", "handle": "Handle format", "patent": "patent identifier"}
NAMED = ["title", "journal", "conferenceTitle", "bookTitle", "siteName", "publisher", "institution", "repository"]
OTHERS = {"year": "year value", "url": "URL format", "pages": "pages locator", "articleNumber": "articleNumber locator", "reportNumber": "report number"}
CONTAINERS = ["journal", "bookTitle", "conferenceTitle", "repository", "siteName"]
# End of the fixed values.

NUMBERS = r"\b(?:19|20)\d{2}\b|(?i:\bpp?\.?\s*[A-Z]?\d+)|\b\d+\s*[-–]\s*\d+\b|\b\d+\(\d+\)"


def problem(field: str, value: Column, as_of_year: int = 2100) -> Column:
    """Why a field's value isn't valid, null if it is. Values are strings, authors and editors
    lists of structs; a missing value is invalid."""
    if field in ("authors", "editors"):
        good = validation.valid_authors(value)
    elif field in IDENTIFIERS:
        good = identifiers.normalize(field, value).isNotNull()
    elif field in NAMED:
        good = (F.trim(value) != "") & ~validation.is_placeholder(value)
    elif field in OTHERS:
        good = {"year": lambda v: validation.valid_year(v.try_cast("int"), as_of_year), "url": validation.valid_url, "pages": validation.valid_pages, "articleNumber": validation.valid_article_number, "reportNumber": validation.valid_report_number}[field](value)
    else:
        good = F.trim(value) != ""
    return F.when(~F.coalesce(good, F.lit(False)), f"invalid {({**IDENTIFIERS, **OTHERS}).get(field, f'{field} value')}")


def field_evidence(kind: Column, fields: dict[str, Column], confidences: dict[str, Column], as_of_year: int = 2100) -> Column:
    """score, completeness and mandatory_confidence: valid mandatory units and half of the
    valid preferred ones over as much of all, averaged with the mean confidence of the
    mandatory ones, which is 0 for a missing or invalid one. Of a group the first field
    that has a value counts."""
    has = {k: (F.size(c) > 0) if k in ("authors", "editors") else F.coalesce(F.trim(c.cast("string")) != "", F.lit(False)) for k, c in fields.items()}
    valid = {k: F.coalesce(has[k], F.lit(False)) & problem(k, c, as_of_year).isNull() for k, c in fields.items()}
    zero = F.lit(0.0)

    def unit(names: list[str]) -> tuple[Column, Column]:
        """Whether the unit's field is valid, and its confidence."""
        known = [k for k in names if k in fields]
        ok = reduce(lambda rest, k: F.when(F.coalesce(has[k], F.lit(False)), valid[k]).otherwise(rest), reversed(known), F.lit(False))
        sure = reduce(lambda rest, k: F.when(F.coalesce(has[k], F.lit(False)), F.when(valid[k], F.coalesce(confidences.get(k, zero), zero)).otherwise(zero)).otherwise(rest), reversed(known), zero)
        return ok, sure

    def of(s) -> Column:
        must = [unit([k]) for k in s.mandatory] + [unit(g) for _, g, severity in s.groups if severity == "mandatory"]
        may = [unit([k]) for k in s.preferred] + [unit(g) for _, g, severity in s.groups if severity == "preferred"]
        count = lambda us: reduce(add, [ok.cast("int") for ok, _ in us], F.lit(0))
        complete = (count(must) + 0.5 * count(may)) / (len(must) + 0.5 * len(may))
        mean = reduce(add, [c for _, c in must], zero) / max(1, len(must))
        return F.struct(((complete + mean) / 2).alias("score"), complete.alias("completeness"), mean.alias("mandatory_confidence"))

    return reduce(lambda rest, k: F.when(kind == k, of(SCHEMAS[k])).otherwise(rest), [k for k in SCHEMAS if k != "unknown"], of(SCHEMAS["unknown"]))


def steps(minor: Column) -> Column:
    return F.when(minor >= 2, 0.0).when(minor == 1, 0.5).otherwise(1.0)


def structural_scores(fields: dict[str, Column], authors: Column, type_confidence: Column, type_unknown: Column, severities: Column) -> Column:
    """Seven scores of 0 to 1 and mean: the type's confidence, no field twice, no artifacts (by
    warnings' severities), containers without numbers, fields within their bounds, no
    author twice, and locators that are some. fields: strings by name."""
    text = lambda k: F.coalesce(F.trim(fields[k].cast("string")), F.lit("")) if k in fields else F.lit("")
    names = F.filter(F.array(*(comparable(text(k)) for k in NAMED)), lambda x: x != "")
    counts = lambda xs: F.transform(F.array_distinct(xs), lambda x: F.size(F.filter(xs, lambda y: y == x)))
    often = let(names, lambda xs: F.filter(counts(xs), lambda n: n > 1))
    doi = identifiers.doi(text("doi"))
    twice = F.when(doi.isNotNull() & F.coalesce(identifiers.doi(text("url")) == doi, F.lit(False)), 0.75).otherwise(let(often, lambda o: F.when(F.size(o) == 0, 1.0).when((F.size(o) > 1) | F.exists(o, lambda n: n > 2), 0.0).otherwise(0.5)))
    artifacts = F.when(F.array_contains(severities, "action"), 0.0).when(F.array_contains(severities, "review"), 0.5).otherwise(1.0)
    held = F.filter(F.array(*(text(k) for k in CONTAINERS)), lambda x: x != "")
    container = let(held, lambda xs: F.when(F.exists(xs, lambda x: x.rlike(NUMBERS)), 0.0).otherwise(steps(F.size(F.filter(xs, lambda x: x.rlike(r"[,.;:]{2,}|\s{2,}|\d$"))))))
    people = F.coalesce(authors, F.array().cast("array<struct<family:string,given:string>>"))
    title = text("title")
    broken = F.exists(people, lambda a: F.concat_ws(" ", a["family"], a["given"]).rlike(r"\d")) | title.rlike(r"(?i)https?://|\b10\.\d{4,9}/|\bpp?\.?\s*\d+|\b\d+\(\d+\)") | text("journal").rlike(r"\b\d+\s*[-–]\s*\d+\b")
    slips = ((text("year") != "") & F.coalesce(F.regexp_like(title, F.concat(F.lit(r"\b"), F.regexp_extract(text("year"), r"^\d{4}$", 0), F.lit(r"\b"))) & text("year").rlike(r"^\d{4}$"), F.lit(False))).cast("int") + F.exists(people, lambda a: (comparable(a["family"]) != "") & (comparable(a["family"]) == comparable(title))).cast("int")
    bounds = F.when(broken, 0.0).otherwise(steps(slips))
    keys = F.filter(F.transform(people, lambda a: comparable(F.concat_ws("|", a["family"], F.coalesce(a["given"], F.lit(""))))), lambda x: x != "")
    repeated = let(keys, lambda xs: let(F.filter(counts(xs), lambda n: n > 1), lambda o: F.when(F.size(o) == 0, 1.0).when((F.size(o) == 1) & (F.get(o, F.lit(0)) == 2), 0.5).otherwise(0.0)))
    page, article, report = text("pages"), text("articleNumber"), text("reportNumber")
    place = F.when(page != "", page).otherwise(article)
    locator = F.when((page == "") & (article == "") & (report == ""), 1.0).when(place != "", F.when(validation.valid_pages(place), 1.0).when(place.rlike(r"\d"), 0.5).otherwise(0.0)).otherwise(F.when(validation.valid_report_number(report), 1.0).otherwise(0.0))
    found = {"type_confidence": F.when(type_unknown, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), type_confidence))), "no_duplicate_fields": twice, "no_artifacts": artifacts, "no_corrupted_container": container, "field_boundaries": bounds, "no_duplicate_authors": repeated, "locator_consistency": locator}
    return let(F.struct(*(c.alias(k) for k, c in found.items())), lambda x: F.struct(*(x[k].alias(k) for k in found), (reduce(add, [x[k] for k in found]) / len(found)).alias("mean")))


def quality_gate(fields: dict[str, Column], kind: Column, rendered: list[Column]) -> Column:
    """A title, a year, authors or an institution (but for web pages and patents), valid
    identifiers where there are any, and a text in every style."""
    there = lambda k: F.coalesce(F.trim(fields[k].cast("string")) != "", F.lit(False)) if k in fields else F.lit(False)
    people = F.coalesce(F.size(fields["authors"]) > 0, F.lit(False)) if "authors" in fields else F.lit(False)
    sound = reduce(lambda a, b: a & b, [~there(k) | problem(k, fields[k]).isNull() for k in ("doi", "pmid", "arxiv", "isbn", "handle", "patent") if k in fields], F.lit(True))
    shown = reduce(lambda a, b: a & b, [F.coalesce(F.trim(c) != "", F.lit(False)) for c in rendered], F.lit(True))
    return there("title") & there("year") & (people | there("institution") | kind.isin("webpage", "patent")) & sound & shown
