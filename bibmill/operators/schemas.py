"""Field schemas by reference type: what must be there, what should be, and the score of what is."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Schema:
    mandatory: list[str]
    preferred: list[str] = field(default_factory=list)
    #: label, fields of which one must be there, severity
    groups: list[tuple[str, list[str], str]] = field(default_factory=list)


#: Fields of each reference type.
SCHEMAS = {
    "article-journal": Schema(["authors", "title", "journal", "year", "volume"], ["issue", "doi", "pmid", "pmcid", "issn", "url"], [("pages or articleNumber", ["pages", "articleNumber"], "preferred")]),
    "book": Schema(["title", "year", "publisher"], ["edition", "placeOfPublication", "doi", "isbn", "url"], [("authors or editors", ["authors", "editors"], "mandatory")]),
    "book-chapter": Schema(["authors", "title", "bookTitle", "year", "publisher"], ["editors", "pages", "edition", "doi", "isbn"]),
    "thesis": Schema(["authors", "title", "institution", "year", "thesisType"], ["url", "handle"]),
    "conference-paper": Schema(["authors", "title", "conferenceTitle", "year"], ["pages", "articleNumber", "placeOfPublication", "publisher", "doi", "isbn"], [("pages or articleNumber or placeOfPublication", ["pages", "articleNumber", "placeOfPublication"], "preferred")]),
    "webpage": Schema(["title", "url"], ["authors", "siteName", "year", "accessedDate"]),
    "report": Schema(["title", "year"], ["reportNumber", "institution", "publisher", "placeOfPublication", "url", "doi", "isbn", "issn"], [("authors or institution", ["authors", "institution"], "mandatory")]),
    "patent": Schema(["title", "year", "patent"], ["authors", "institution", "url"]),
    "dataset": Schema(["authors", "title", "year", "repository"], ["doi", "url", "edition", "handle"]),
    "preprint": Schema(["authors", "title", "year", "repository"], ["doi", "arxiv", "url"]),
    "unknown": Schema(["title"], ["authors", "year", "doi", "pmid", "pmcid", "arxiv", "isbn", "issn", "handle", "patent", "url"]),
}
#: The confidence that each field needs, and the lower one of a value that is valid as it is written.
THRESHOLDS = {
    "authors": 0.75, "title": 0.8, "year": 0.9, "doi": 0.95, "pmid": 0.95, "pmcid": 0.95, "arxiv": 0.95, "isbn": 0.92, "issn": 0.92, "handle": 0.9, "patent": 0.92, "url": 0.8, "journal": 0.7, "volume": 0.65, "issue": 0.65, "pages": 0.65,
    "publisher": 0.7, "placeOfPublication": 0.7, "conferenceTitle": 0.7, "bookTitle": 0.7, "institution": 0.7, "edition": 0.7, "editors": 0.72, "thesisType": 0.8, "repository": 0.72, "articleNumber": 0.7, "accessedDate": 0.75, "siteName": 0.72, "database": 0.72, "reportNumber": 0.72,
}
VALIDATED = {"year": 0.7, "doi": 0.8, "isbn": 0.8, "url": 0.65}
TRUSTED = ["admin_confirmed", "user_correction"]


def units(schema: Schema, severity: str) -> list[list[str]]:
    """Each unit as the fields of which one is enough."""
    own = schema.mandatory if severity == "mandatory" else schema.preferred
    return [[f] for f in own] + [fields for _, fields, s in schema.groups if s == severity]


def _by_kind(kind: Column, make) -> Column:
    out = make(SCHEMAS["unknown"])
    for name, schema in SCHEMAS.items():
        out = F.when(kind == name, make(schema)).otherwise(out)
    return out


def _any(fields: list[str], there: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(there.get(f, F.lit(False)), F.lit(False)) for f in fields])


def missing(kind: Column, there: dict[str, Column]) -> Column:
    """Labels of mandatory fields and groups of the type that aren't there, in the schema's order."""
    def make(s: Schema) -> Column:
        labels = [(f, [f]) for f in s.mandatory] + [(label, fields) for label, fields, severity in s.groups if severity == "mandatory"]
        return F.array_compact(F.array(*[F.when(~_any(fields, there), label) for label, fields in labels]))

    return _by_kind(kind, make)


def completeness(kind: Column, there: dict[str, Column]) -> Column:
    """Mandatory units that are there and half of the preferred ones, over as much of all."""
    def make(s: Schema) -> Column:
        must, may = units(s, "mandatory"), units(s, "preferred")
        count = lambda us: reduce(add, [_any(u, there).cast("int") for u in us], F.lit(0))
        return (count(must) + 0.5 * count(may)) / (len(must) + 0.5 * len(may))

    return _by_kind(kind, make)


def threshold(name: str, valid: Column) -> Column:
    base = THRESHOLDS.get(name, 0.7)
    return F.when(valid, VALIDATED.get(name, base)).otherwise(base)


def uncertain(name: str, source: Column, confidence: Column, valid: Column) -> Column:
    """Trusted sources never are."""
    return ~source.isin(TRUSTED) & (confidence < threshold(name, valid))


def calibrated(name: str, source: Column, confidence: Column, valid: Column) -> Column:
    """A valid value has at least its field's threshold; trusted sources keep theirs."""
    return F.when(valid & ~source.isin(TRUSTED), F.greatest(confidence, threshold(name, valid))).otherwise(confidence)
