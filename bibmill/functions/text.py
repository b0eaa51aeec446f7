"""Text scalars. Built-in functions throughout, but for Unicode decomposition."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bind import let

MARKS = regex.compile(r"\p{M}+")
#: Entities that markup stripping decodes, in this order and whatever their case.
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&(?:apos|#0*39|#x0*27);", "'"), ("&nbsp;", " ")]
#: Small words that title case leaves alone.
SMALL_WORDS = ["a", "an", "and", "as", "at", "but", "by", "for", "from", "in", "nor", "of", "on", "or", "per", "the", "to", "via", "vs"]
#: Ligatures and what they stand for.
LIGATURES = [("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "ft"), ("ﬆ", "st")]


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\r\n\f\x0B]+", " "))


def sanitize(c: Column) -> Column:
    """Plain spaces, no soft hyphens, zero-width or control characters, no U+FFFD."""
    c = F.regexp_replace(F.regexp_replace(c, "\u00a0", " "), "[\u00ad\u200b-\u200d\u2060\ufeff]", "")
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.regexp_replace(F.regexp_replace(c, r"(?<=\p{L})\x{FFFD}(?=\p{L})", ""), "\ufffd", " ")


@F.pandas_udf(T.StringType())
def fold_marks(s: pd.Series) -> pd.Series:
    """NFKD without combining marks. ASCII texts are that already."""
    return s.map(lambda t: t if t is None or t.isascii() else MARKS.sub("", unicodedata.normalize("NFKD", t)))


@F.pandas_udf(T.StringType())
def compatible(s: pd.Series) -> pd.Series:
    """NFKC. ASCII texts are that already."""
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def key(c: Column) -> Column:
    return collapse(F.lower(fold_marks(c)))


def content_hash(c: Column) -> Column:
    """sha256 of the key of the sanitized text."""
    return F.sha2(key(sanitize(c)), 256)


def truth_hash(c: Column) -> Column:
    """Of single-spaced text, with the case as it is."""
    return F.sha2(collapse(c), 256)


def title_hash(c: Column) -> Column:
    """24 hex digits of the key's sha256; null for a title without any character."""
    return F.substring(F.sha2(F.nullif(key(c), F.lit("")), 256), 1, 24)


def training_hash(c: Column) -> Column:
    """Lower case, single spaces, repeated punctuation once."""
    return F.sha2(F.regexp_replace(F.lower(collapse(c)), r"([.,;:!?])\1+", "$1"), 256)


def slug(c: Column) -> Column:
    made = F.regexp_replace(F.regexp_replace(key(c), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(made, F.lit("")), F.lit("unknown"))


def ocr_fold(c: Column) -> Column:
    """A key under which common misreadings meet; the order of the steps matters."""
    c = F.lower(compatible(c))
    for a, b in (("rn", "m"), ("vv", "w"), ("cl", "d")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(F.translate(c, "01i589qe2", "ollsbggcz"), "[^a-z0-9]", "")


def strip_markup(c: Column) -> Column:
    """Tags become spaces; what only looks like one, as in a < b, stays."""
    c = F.regexp_replace(c, r"(?i)</?[a-z][a-z0-9]*(\s[^>]*)?>", " ")
    for entity, plain in ENTITIES:
        c = F.regexp_replace(c, f"(?i){entity}", plain)
    return c


def expand_ligatures(c: Column) -> Column:
    for a, b in LIGATURES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def comparable(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def soft(c: Column) -> Column:
    """As evaluation compares values: without the prefix of a DOI or arXiv id, case and
    punctuation; accents stay; null is empty."""
    c = F.regexp_replace(F.regexp_replace(compatible(F.coalesce(c, F.lit(""))), "(?i)&amp;", "&"), "[\u2010-\u2015\u2212]+", "-")
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)^(doi:\s*|https?://(dx\.)?doi\.org/)", ""), r"(?i)^arxiv:\s*", "")
    return comparable(F.replace(c, F.lit("&"), F.lit(" and ")))


def group_comparable(c: Column) -> Column:
    """Without accents, case and punctuation; an ampersand is the word."""
    return comparable(F.replace(fold_marks(c), F.lit("&"), F.lit(" and ")))


def queue_key(c: Column) -> Column:
    """Under which citations of one work meet in a review queue: no numbering, no cut
    words, no address or identifier at the end. Null where nothing is left."""
    from .ingest import strip_identifier_tail

    plain = F.regexp_replace(F.regexp_replace(compatible(strip_numbering(c)), "[“”„‟]", '"'), "(?i)&amp;", "&")
    plain = collapse(F.regexp_replace(plain, r"(\p{L})-\n[ \t]*(\p{Ll})", "$1$2"))
    return F.nullif(group_comparable(strip_identifier_tail(plain)), F.lit(""))


def tokens(c: Column) -> Column:
    """Distinct words of the comparable form."""
    return F.array_distinct(F.filter(F.split(comparable(c), " "), lambda x: x != ""))


def strip_numbering(c: Column) -> Column:
    """Without the numbers before it, one after another; a year stays."""
    return F.regexp_replace(c, r"^\s*(?:(?:\[\d{1,4}\]|\(\d{1,4}\)|(?!(?:19|20)\d{2}\b)\d{1,4}[.)])\s+)+", "")


def page_range(c: Column) -> Column:
    """A plain hyphen, and the end written out: 123-9 becomes 123-129."""
    c = F.regexp_replace(F.trim(c), "\\s*[\u2012-\u2015-]+\\s*", "-")
    start, end = F.regexp_extract(c, r"^(\d+)-(\d+)$", 1), F.regexp_extract(c, r"^(\d+)-(\d+)$", 2)
    short = (end != "") & (F.length(end) < F.length(start))
    return F.when(short, F.concat(start, F.lit("-"), F.left(start, F.length(start) - F.length(end)), end)).otherwise(c)


def initial_letters(given: Column) -> Column:
    names = F.filter(F.split(F.trim(given), r"[\s-]+"), lambda x: x != "")
    return F.transform(names, lambda x: F.upper(F.substring(x, 1, 1)))


def from_letters(letters: Column, dots: bool = True) -> Column:
    """Initials of initial_letters(); null without any."""
    return F.when(F.size(letters) > 0, F.concat(F.array_join(letters, ". "), F.lit(".")) if dots else F.array_join(letters, ""))


def initials(given: Column, dots: bool = True) -> Column:
    return let(initial_letters(given), lambda x: F.coalesce(from_letters(x, dots), F.array_join(x, "")))


def _field(k: str):
    return lambda x: x[k]


def _cased(c: Column, rules: dict) -> Column:
    """The text by each rule, as a struct. Each word by its rule: one with a digit or capitals inside stays, as does a short
    one in capitals, unless the whole is in capitals; rules tell by small(word, index) which words
    are written low. What follows a colon or a long dash starts with a capital."""
    def one(w: Column, i: Column, words: Column, shouting: Column) -> Column:
        def told(bare: Column) -> Column:
            stays = (bare == "") | (~shouting & (F.length(bare) <= 4) & (bare == F.upper(bare))) | bare.rlike(r"\d") | w.rlike(r"[a-z][A-Z]|[A-Z][a-z]+[A-Z]")
            lead, rest = F.regexp_extract(w, r"^([^\p{L}\p{N}]*)", 1), F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]*", ""))
            big = let(rest, lambda r: F.concat(lead, F.upper(F.substring(r, 1, 1)), F.substring(r, F.lit(2), F.length(r))))
            after = F.coalesce(F.get(words, i - 1), F.lit("")).rlike("[:–—]$")
            return F.struct(*(F.when(stays, w).when(small(F.lower(bare), i) & ~after, F.lower(w)).otherwise(big).alias(k) for k, small in rules.items()))

        return let(F.regexp_replace(w, r"[^A-Za-z0-9]", ""), told)

    def told(text: Column, x: Column) -> Column:
        shouting = (F.size(x) >= 4) & ~text.rlike(r"\p{Ll}") & text.rlike(r"\p{L}{5}")
        return let(shouting, lambda loud: F.transform(x, lambda w, i: one(w, i, x, loud)))

    # words, loudness and what a word is are worked out once, not again for each word or rule
    made = let(c, lambda text: let(F.split(text, " "), lambda x: told(text, x)))
    return let(made, lambda words: F.struct(*(F.array_join(F.transform(words, _field(k)), " ").alias(k) for k in rules)))


CASES = {"sentence": lambda w, i: i > 0, "title": lambda w, i: (i > 0) & w.isin(SMALL_WORDS)}


def cases(c: Column) -> Column:
    """sentence and title: the text in both cases."""
    return _cased(c, CASES)


def sentence_case(c: Column) -> Column:
    return _cased(c, {"sentence": CASES["sentence"]})["sentence"]


def title_case(c: Column) -> Column:
    return _cased(c, {"title": CASES["title"]})["title"]
