"""Records held against those of a provider: fields, authors, addresses, conflicts."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.identifiers import doi, url_host, url_path
from ..functions.text import collapse, comparable, fold_marks

#: How alike two titles are to verify a DOI, to match without one, and not to be in conflict.
TITLE_VERIFIED, TITLE_MATCHED, TITLE_ALIKE = 0.8, 0.82, 0.5
#: Fields of which one at least must be comparable, and sources that enrich.
PRIMARY = ["title", "first_author", "year", "container"]
ENRICHED = ["enrichment_crossref", "enrichment_openalex"]


def scalar(c: Column) -> Column:
    """Without accents and case; all but letters, digits and commas are spaces."""
    return collapse(F.regexp_replace(F.lower(fold_marks(c)), r"[^\p{L}\p{N},\s]+", " "))


def same_scalar(a: Column, b: Column) -> Column:
    return scalar(a) == scalar(b)


def title_f1(a: Column, b: Column) -> Column:
    """F1 of the distinct words; 0 where one has none."""
    words = lambda c: F.array_distinct(F.filter(F.split(scalar(c), " "), lambda x: x != ""))
    return let(F.struct(words(a).alias("a"), words(b).alias("b")), lambda w: F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(w["a"], w["b"])), F.size(w["a"]) + F.size(w["b"])), F.lit(0.0)))


def same_locator(a: Column, b: Column) -> Column:
    plain = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, "[–—]", "-"), r"\s+", ""))
    return plain(a) == plain(b)


def urls_align(a: Column, b: Column) -> Column:
    """Equal hosts and paths, whatever their case and last slashes; false for what is no address."""
    path = lambda c: F.lower(F.regexp_replace(url_path(c), "/+$", ""))
    return F.coalesce((url_host(a) != "") & (url_host(a) == url_host(b)) & (path(a) == path(b)), F.lit(False))


def compare_authors(cited: Column, found: Column) -> Column:
    """comparable, matches and reason of two arrays of folded family names. The first
    must agree; then a list of up to three must begin the longer one, and others share
    more than half of the shorter list."""
    none = F.array().cast("array<string>")
    named = lambda c: F.filter(F.coalesce(c, none), lambda x: x != "")

    def told(w: Column) -> Column:
        a, b = w["a"], w["b"]
        there = (F.size(a) > 0) & (F.size(b) > 0)
        first = F.get(a, F.lit(0)) == F.get(b, F.lit(0))
        cut = (F.size(a) <= 3) & (F.size(b) > F.size(a))
        share = F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))
        matches = there & first & F.when(cut, F.slice(b, F.lit(1), F.greatest(F.size(a), F.lit(1))) == a).otherwise(share > 0.5)
        reason = F.when(there & ~matches, F.when(~first, "first author").when(cut, "author ordering").otherwise("author overlap"))
        return F.struct(there.alias("comparable"), F.coalesce(matches, F.lit(False)).alias("matches"), reason.alias("reason"))

    return let(F.struct(named(cited).alias("a"), named(found).alias("b")), told)


def verify_doi(cited: Column, found: Column, resolved: Column, checks: dict[str, tuple[Column, Column]], authors: Column) -> Column:
    """status and mismatches. checks: by field whether both sides have it, and whether they
    agree; authors is the struct of compare_authors. At least two fields must be
    comparable, one of them a primary one."""
    mine, theirs = doi(cited), doi(found)
    whole = {**checks, "first_author": (authors["comparable"], authors["matches"])}
    count = lambda names: reduce(add, [whole[k][0].cast("int") for k in names], F.lit(0))
    wrong = [F.when(there & ~agree, authors["reason"] if k == "first_author" else F.lit(k)) for k, (there, agree) in whole.items()]
    status = (
        F.when(mine.isNull(), "absent").when(~resolved, "unverified").when(~F.coalesce(mine == theirs, F.lit(False)), "conflicted")
        .when((count(whole) < 2) | (count([k for k in PRIMARY if k in whole]) < 1), "unverified")
    )
    bad = F.array_compact(F.array(*wrong))
    told = status.when(F.size(bad) > 0, "conflicted").otherwise("verified")
    return F.struct(told.alias("status"), F.when(status.isNull(), bad).otherwise(F.array().cast("array<string>")).alias("mismatches"))


def match_without_doi(title: tuple[Column, Column], year: tuple[Column, Column], authors: Column, kind: tuple[Column, Column]) -> Column:
    """matches, confidence, agreed and conflicts of a citation and a provider's record, each
    pair (cited, found). The title must agree, and the year or first author with it; a gap
    of one year is neither."""
    both = lambda p: p[0].isNotNull() & p[1].isNotNull()
    alike = title_f1(*title) >= TITLE_MATCHED
    gap = F.abs(year[0] - year[1])
    agreed = F.array_compact(F.array(F.when(both(title) & alike, "title"), F.when(gap == 0, "year"), F.when(authors["matches"], "author")))
    conflicts = F.array_compact(F.array(F.when(both(title) & ~alike, "title"), F.when(gap >= 2, "year"), F.when(authors["comparable"] & ~authors["matches"], "author"), F.when(kind[0] != kind[1], "type")))

    def told(w: Column) -> Column:
        ok = (F.size(w["conflicts"]) == 0) & F.array_contains(w["agreed"], "title") & (F.size(w["agreed"]) > 1)
        return F.struct(ok.alias("matches"), F.when(ok, F.least(F.lit(0.92), 0.72 + 0.07 * (F.size(w["agreed"]) - 1))).otherwise(0.0).alias("confidence"), w["agreed"].alias("agreed"), w["conflicts"].alias("conflicts"))

    return let(F.struct(agreed.alias("agreed"), conflicts.alias("conflicts")), told)


def author_conflict(before: Column, now: Column, source: Column) -> Column:
    """Whether enrichment put another first author in place of the cited one."""
    plain = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    return F.coalesce((source == "enrichment_crossref") & (plain(before) != plain(now)), F.lit(False))


def metadata_mismatch(kind: Column, year: tuple[Column, Column, Column], found_doi: tuple[Column, Column], isbn: tuple[Column, Column], title: tuple[Column, Column, Column]) -> Column:
    """year, type, title or null: the first sign of another work's record. year and title
    are (before, now, source), found_doi and isbn (now, source)."""
    enriched = lambda source: F.coalesce(source.isin(ENRICHED), F.lit(False))
    book = (enriched(found_doi[1]) & F.coalesce(found_doi[0], F.lit("")).rlike(r"(?i)/book|/chapter|97[89][\d-]{8,}")) | (enriched(isbn[1]) & (F.trim(F.coalesce(isbn[0], F.lit(""))) != ""))
    before, now = comparable(title[0]), comparable(F.coalesce(title[1], F.lit("")))
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda x: x != ""))
    alike = F.try_divide(F.size(F.array_intersect(words(before), words(now))), F.size(F.array_union(words(before), words(now))))
    return (
        F.when(enriched(year[2]) & (F.abs(year[1] - year[0]) > 1), "year")
        .when(kind.isin("article-journal", "conference-paper") & book, "type")
        .when(enriched(title[2]) & (before != "") & (now != "") & (before != now) & (alike < TITLE_ALIKE), "title")
    )
