"""Identifier scalars as column expressions: each returns the normal form or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let

#: Forms of identifiers.
DOI, PMID, PMCID, HANDLE = r"(?i)^10\.\d{4,9}/[-._;()/:a-z0-9]+$", r"^[1-9]\d{0,8}$", r"^PMC\d+$", r"^\d+(\.\d+)*/\S+$"
ARXIV = r"(?i)^(\d{4}\.\d{4,5}|[a-z-]+(\.[A-Z]{2})?/\d{7})(v\d+)?$"
PATENT = r"\b((US|EP|WO|CN|JP|GB|DE|FR|KR|CA|AU)\s*)?(RE|PP|D)?\s*\d{6,}[A-Z0-9/-]*\b"
#: Hosts whose addresses don't tell one work from another.
GENERIC_HOSTS = ["doi.org", "dx.doi.org", "handle.net", "hdl.handle.net", "arxiv.org", "www.arxiv.org", "patents.google.com"]


def when_matches(value: Column, pattern: str) -> Column:
    return let(value, lambda x: F.when(x.rlike(pattern), x))


def drop_surplus(c: Column, opening: str, closing: str) -> Column:
    """Takes trailing closing brackets off, as many as have no opening one."""
    count = lambda x, mark: F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit("")))
    trailing = F.length(c) - F.length(F.rtrim(c, F.lit(closing)))
    return F.substring(c, F.lit(1), F.length(c) - F.greatest(F.lit(0), F.least(trailing, count(c, closing) - count(c, opening))))


def strip_tail(c: Column) -> Column:
    """Without <...> around it, query or fragment, trailing marks and surplus brackets."""
    c = F.regexp_replace(F.regexp_replace(F.trim(c), r"^<(.*)>$", "$1"), r"[?#].*$", "")
    c = let(F.regexp_replace(c, r"[.,;:]+$", ""), lambda x: drop_surplus(x, "(", ")"))
    return F.regexp_replace(let(c, lambda x: drop_surplus(x, "[", "]")), r"[.,;:]+$", "")


def doi(c: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(c)), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")
    return when_matches(strip_tail(bare), DOI)


def dois_in(text: Column) -> Column:
    """All DOIs of a text in order of appearance, each once."""
    found = F.regexp_extract_all(text, F.lit(r"""(10\.\d{4,9}/[^\s"'<>]+)"""), 1)
    return F.array_distinct(F.filter(F.transform(found, doi), lambda x: x.isNotNull()))


def pmid(c: Column) -> Column:
    return when_matches(F.regexp_replace(F.lower(F.trim(c)), r"^pmid:?\s*", ""), PMID)


def pmcid(c: Column) -> Column:
    return when_matches(F.upper(F.regexp_replace(c, r"\s+", "")), PMCID)


def arxiv(c: Column) -> Column:
    """With its version, if it has one; also out of the DOI that arXiv gives."""
    def told(bare: Column) -> Column:
        rest = F.regexp_replace(bare, r"(?i)^https?://(www\.)?arxiv\.org/(abs|pdf)/", "")
        rest = strip_tail(F.regexp_replace(F.regexp_replace(rest, r"(?i)\.pdf$", ""), r"(?i)^arxiv:\s*", ""))
        return F.coalesce(strip_tail(F.nullif(F.regexp_extract(bare, r"(?i)10\.48550/arxiv\.([^\s/]+)", 1), F.lit(""))), when_matches(rest, ARXIV))

    return let(strip_tail(c), told)


def patent(c: Column) -> Column:
    """Needs a jurisdiction or the word patent, six digits, and not to be part of a DOI."""
    google = r"(?i)^https?://(www\.)?patents\.google\.com/patent/"
    word = r"(?i)\bpatent(\s+application)?(\s+no\.?)?\b"

    def found(raw: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(raw, google, ""), r"(?i)/[a-z]{2}(-[a-z]{2})?/?$", "")
        bare = F.upper(F.trim(F.regexp_replace(F.regexp_replace(bare, word, ""), r"\s+", " ")))
        return let(F.regexp_replace(F.regexp_extract(bare, PATENT, 0), r"\s+", ""), lambda x: checked(raw, x))

    def checked(raw: Column, number: Column) -> Column:
        tight = F.upper(F.regexp_replace(raw, r"\s+", ""))
        inside = F.instr(F.regexp_extract(tight, r"(10\.\d{4,9}/.*)$", 1), number) > 0
        told = raw.rlike(word) | raw.rlike(google)
        ok = (F.length(F.regexp_replace(number, r"\D", "")) >= 6) & (told | (~inside & number.rlike("^(US|EP|WO|CN|JP|GB|DE|FR|KR|CA|AU|RE|PP|D)")))
        return F.when(ok, number)

    return let(strip_tail(c), found)


def handle(c: Column) -> Column:
    return when_matches(F.regexp_replace(F.trim(c), r"^(https?://hdl\.handle\.net/|hdl:)", ""), HANDLE)


def _digits(c: Column, n: int, weight) -> Column:
    at = lambda i: F.when(F.substring(c, i, 1) == "X", 10).otherwise(F.substring(c, i, 1).cast("int"))
    out = F.lit(0)
    for i in range(1, n + 1):
        out = out + at(i) * weight(i)
    return out


def isbn(c: Column) -> Column:
    """ISBN-10 or ISBN-13 without separators, if its check digit is right."""
    bare = F.upper(F.regexp_replace(F.regexp_replace(c, r"(?i)^isbn(-1[03])?:?\s*", ""), r"[\s-]", ""))
    ten = bare.rlike(r"^\d{9}[\dX]$")
    thirteen = bare.rlike(r"^\d{13}$")
    return F.when(ten, F.when(_digits(bare, 10, lambda i: 11 - i) % 11 == 0, bare)).when(thirteen, F.when(_digits(bare, 13, lambda i: 1 if i % 2 else 3) % 10 == 0, bare))


def issn(c: Column) -> Column:
    bare = F.upper(F.regexp_replace(F.regexp_replace(c, r"(?i)^issn:?\s*", ""), r"[\s-]", ""))
    return F.when(bare.rlike(r"^\d{7}[\dX]$"), F.when(_digits(bare, 8, lambda i: 9 - i) % 11 == 0, F.concat(F.substring(bare, 1, 4), F.lit("-"), F.substring(bare, 5, 4))))


def url_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1)), r":(80|443)$", "")


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)


def url_key(url: Column) -> Column:
    """A DOI's address for a DOI; else lower-case scheme and host without default port,
    path and query; no fragment. Null for what is no web address."""
    def made(bare: Column) -> Column:
        rest = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z]+://[^/?#]*([^#]*)", 1), "^(?!/)", "/")
        plain = F.concat(F.lower(F.regexp_extract(bare, r"^([A-Za-z]+)://", 1)), F.lit("://"), url_host(bare), rest)
        return F.coalesce(F.concat(F.lit("https://doi.org/"), doi(bare)), F.when(bare.rlike(r"(?i)^https?://[^/?#]+"), plain))

    return let(F.regexp_replace(F.trim(url), r"[)\],.;:]+$", ""), made)


def url_propagation_key(url: Column) -> Column:
    """Host and path, one slash at a time; null for hosts that many works share and
    for addresses without a path."""
    def made(bare: Column) -> Column:
        host, path = F.regexp_replace(url_host(bare), r":\d+$", ""), F.regexp_replace(F.regexp_replace(url_path(bare), r"/+", "/"), r"/$", "")
        return F.when(bare.rlike(r"(?i)^https?://") & (host != "") & ~host.isin(GENERIC_HOSTS) & (path != ""), F.concat(host, path))

    return let(strip_tail(url), made)


def normalize(kind: str, c: Column) -> Column:
    return {"doi": doi, "pmid": pmid, "pmcid": pmcid, "arxiv": arxiv, "handle": handle, "isbn": isbn, "issn": issn, "patent": patent, "url": url_key}[kind](c)
