"""Moves that put values into the fields where they belong, the ledger of what changed,
and fields that later stages may not empty.

A record is a struct of strings. Moves are proposed in order and applied in order; the
ledger is the difference of two snapshots; locked fields come back if they were lost.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import identifiers
from ..functions.bind import let
from .reference_types import CUES

# What tells a journal's name from a conference's or publisher's, the moves that are applied, and how sure a locked field is.
OTHER_JOURNAL, IMPRINTS = ["oncology"], ["press", "publisher", "publishing", "imprint", "springer", "elsevier", "wiley", "sage"]
CONFERENCES = ["conference", "symposium", "workshop", "congress", "meeting", "proceedings", "proc", "anais", "seminar", "forum", "abstracts publication"]
PUBLISHERS = ["press", "publishing", "publisher", "editorial", "books?", "editions?", "springer", "palgrave", "cambridge", "oxford", "routledge", "elsevier", "wiley", "thieme", "sciendo", "verlag"]
APPLIED = ["conference_container_journal_repair", "publisher_to_journal_repair", "book_container_journal_repair", "book_container_volume_repair", "book_container_issue_repair", "book_container_issn_repair"]
LOCKED = 0.75
LOCATORS = ["volume", "issue", "pages", "issn", "articleNumber"]
# End of the fixed values.

MOVE = "struct<reason:string,source:string,target:string,action:string,previous:string,next:string>"
SPILL = "struct<journal:string,volume:string,issue:string>"


def any_word(words: list[str]) -> str:
    return rf"(?i)\b(?:{'|'.join(words)})\b"


def container_spill(value: Column) -> Column:
    """journal, volume and issue out of a container such as Journal of Things, 12(3), or with
    (3) or No. 3 after the comma; null for what is no journal's name."""
    c = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(value, r"\s+", " ")), r"^[,.;:\s]+", ""), r"[\"”'’.,;:\s]+$", "")

    def told(x: Column) -> Column:
        forms = [(r"^(.+?),\s*(\d{1,4})(?:\(([^)]+)\))?$", 2, 3), (r"^(.+?),\s*()\(([^)]+)\)$", 2, 3), (r"(?i)^(.+?),\s*()(?:No\.?|№)\s*([A-Za-z]?\d[\w-]*)[^,]*$", 2, 3)]
        none = lambda p, g: F.nullif(F.trim(F.regexp_extract(x, p, g)), F.lit(""))
        made = reduce(lambda rest, f: F.when(x.rlike(f[0]), F.struct(none(f[0], 1).alias("journal"), none(f[0], f[1]).alias("volume"), F.nullif(F.regexp_replace(none(f[0], f[2]), r"\s+(?:19|20)\d{2}\s*$", ""), F.lit("")).alias("issue"))).otherwise(rest), reversed(forms), F.struct(x.alias("journal"), F.lit(None).cast("string").alias("volume"), F.lit(None).cast("string").alias("issue")))
        ok = (x != "") & ~x.rlike(any_word(CONFERENCES))
        return let(made, lambda m: F.when(ok & ~m["journal"].rlike(any_word(PUBLISHERS)) & m["journal"].rlike(any_word(CUES["journal"] + OTHER_JOURNAL)), m))

    return let(c, told)


def move(reason: str, source: str, target: str, action: str, previous: Column, following: Column) -> Column:
    return F.struct(F.lit(reason).alias("reason"), F.lit(source).alias("source"), F.lit(target).alias("target"), F.lit(action).alias("action"), previous.cast("string").alias("previous"), following.cast("string").alias("next"))


def proposed_moves(r: Column, kind: Column, raw: Column) -> Column:
    """Structs of reason, source, target, action, previous and next for a record (a struct with
    title, journal, conferenceTitle, bookTitle, publisher, volume, issue, issn, pages, doi)."""
    has = lambda k: F.coalesce(F.trim(r[k]) != "", F.lit(False))
    numbers = has("volume") | has("issue") | has("issn")
    article, venue = (kind == "article-journal") & ~has("journal"), r["conferenceTitle"]
    is_event = (has("conferenceTitle") & F.coalesce((venue != r["title"]) & (venue.rlike(any_word(CUES["conference"])) | venue.rlike(r"\b(?:[A-Z][a-z]+\d{1,4}|[A-Z]{2,}\d{1,4}|\d{1,3}(?:st|nd|rd|th))\b")), F.lit(False))) | raw.rlike(any_word(CUES["conference"]))
    from_venue = article & has("conferenceTitle") & numbers & ~venue.rlike(any_word(CUES["conference"])) & (has("issn") | venue.rlike(any_word(CUES["journal"])))
    from_publisher = article & has("publisher") & numbers & ~is_event & ~r["publisher"].rlike(any_word(IMPRINTS))
    tail = F.nullif(F.trim(F.regexp_extract(r["title"], r"(?i)((?:https?://|doi:\s*10\.)\S.*)$", 1)), F.lit(""))

    def told(spill: Column) -> Column:
        from_book = article & spill.isNotNull() & (numbers | has("pages") | has("doi"))
        when = lambda c, *m: F.when(F.coalesce(c, F.lit(False)), move(*m))
        address = F.coalesce(tail.startswith("http"), F.lit(False))
        return F.array_compact(F.array(
            when(from_venue, "conference_container_journal_repair", "conferenceTitle", "journal", "mutate", venue, venue), when(from_publisher, "publisher_to_journal_repair", "publisher", "journal", "mutate", r["publisher"], r["publisher"]), when(from_book, "book_container_journal_repair", "bookTitle", "journal", "mutate", r["bookTitle"], spill["journal"]),
            when(from_book & ~has("volume") & spill["volume"].isNotNull(), "book_container_volume_repair", "bookTitle", "volume", "set", r["bookTitle"], spill["volume"]), when(from_book & ~has("issue") & spill["issue"].isNotNull(), "book_container_issue_repair", "bookTitle", "issue", "set", r["bookTitle"], spill["issue"]),
            when(tail.isNotNull() & address, "title_tail_identifier_repair", "titleTail", "url", "mutate", r["title"], tail), when(tail.isNotNull() & ~address, "title_tail_identifier_repair", "titleTail", "doi", "mutate", r["title"], tail),
        ))

    return let(container_spill(r["bookTitle"]), told)


def applied(r: Column, moves: Column, fields: list[str]) -> Column:
    """The record after the moves of APPLIED reasons: each target's first move that finds it
    empty fills it; a container that became the journal is emptied. Others are proposals only."""
    mine = F.filter(moves, lambda m: m["reason"].isin(APPLIED))

    def after(ms: Column) -> Column:
        def one(k: str) -> Column:
            first = F.get(F.filter(ms, lambda m: m["target"] == k), F.lit(0))["next"]
            gone = F.exists(ms, lambda m: (m["source"] == k) & (m["target"] == "journal"))
            return F.when(F.coalesce(F.trim(r[k]) != "", F.lit(False)), F.when(~gone, r[k])).otherwise(first).alias(k)

        return F.struct(*(one(k) for k in fields))

    return let(mine, after)


def ledger(before: Column, after: Column, fields: list[str], phase: str, reason: str) -> Column:
    """An entry for each field that changed: set, clear or mutate."""
    def one(k: str) -> Column:
        a, b = F.nullif(F.trim(before[k]), F.lit("")), F.nullif(F.trim(after[k]), F.lit(""))
        action = F.when(a.isNull(), "set").when(b.isNull(), "clear").otherwise("mutate")
        return F.when(~a.eqNullSafe(b), F.struct(F.lit(phase).alias("phase"), F.lit(reason).alias("reason"), F.lit(k).alias("field"), action.alias("action"), a.alias("previous"), b.alias("next")))

    return F.array_compact(F.array(*map(one, fields)))


def sticky_fields(record: Column, confidence: Column, fields: list[str]) -> Column:
    """Fields that later stages may not empty: those sure enough, and the locators of an
    article that has its journal and a number. confidence: a map of field and double."""
    has = lambda k: F.coalesce(F.trim(record[k]) != "", F.lit(False))
    article = has("journal") & (has("volume") | has("issue") | has("issn"))
    sure = lambda k: has(k) & F.coalesce(confidence[k] >= LOCKED, F.lit(False))
    keep = lambda k: F.when(has(k) & (sure(k) if k not in LOCATORS else (sure(k) | article)), F.lit(k))
    return F.array_compact(F.array(*map(keep, fields)))


def restored(before: Column, after: Column, sticky: Column, fields: list[str]) -> Column:
    """record and restored: sticky fields that were emptied have their value again."""
    lost = lambda k: F.array_contains(sticky, k) & F.coalesce(F.trim(before[k]) != "", F.lit(False)) & ~F.coalesce(F.trim(after[k]) != "", F.lit(False))
    record = F.struct(*(F.when(lost(k), before[k]).otherwise(after[k]).alias(k) for k in fields))
    return F.struct(record.alias("record"), F.array_compact(F.array(*(F.when(lost(k), F.lit(k)) for k in fields))).alias("restored"))


def title_tail(title: Column) -> Column:
    """The DOI or address that hangs on a title, in normal form."""
    tail = F.regexp_extract(title, r"(?i)((?:https?://|doi:\s*10\.)\S*)$", 1)
    return F.coalesce(identifiers.doi(tail), F.when(tail.startswith("http"), tail))
