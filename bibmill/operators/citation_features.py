"""What a raw reference tells at one reading: its year, quoted title and identifiers,
with their places.

Years are all candidates of the text, scored by what stands around them. A quoted title
is the best pair of quotes. Identifiers come in an order of trust: as they stand, then
from the text without accents, then with the digits that OCR misread put right.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers
from ..functions.bind import let
from ..functions.ingest import ADDRESS, DOI, recover_doi, strip_identifier_tail
from ..functions.text import compatible, fold_marks

YEAR, AROUND, WIDE = r"(?i)\b\d{4}[a-z]?\b", 24, 32
#: What the text around a candidate year counts. Places are told by the
#: character on each side, the 24 before and after, and 32 on both sides.
YEAR_POINTS = {"in brackets": 4, "where the family has its year": 3, "after a mark": 1, "before a mark": 1, "in a range": -5, "after volume or issue": -4, "after an access date's word": -5, "before edition": -4, "near an identifier": -7, "in an address or number": -4, "beside long digits": -3}
EARLY, LATE = 120, 0.45
#: What counts for a quoted title besides its length.
TITLE_POINTS = {"three words": 12, "ends a sentence": 4, "a mark inside": 2, "a letter": 4, "a year before": 2, "a mark after": 2}
SLACK = sum(TITLE_POINTS.values())
#: What stands before each identifier, and its form.
LABELS = {"pmid": r"PMID[:\s]*", "arxiv": "", "isbn": r"ISBN(?:-1[03])?:?\s*", "issn": r"ISSN:?\s*", "handle": r"(?:hdl:\s*|https?://(?:hdl\.)?handle\.net/)"}
FORMS = {"pmid": r"\d{5,9}", "arxiv": r"(?:arXiv:\s*|10\.48550/arXiv\.)\d{4}\.\d{4,5}(?:v\d+)?", "isbn": r"(?:97[89][-\s]?)?\d(?:[-\s]?\d){8,}[0-9X]", "issn": r"\d{4}-?\d{3}[\dX]", "handle": r"\d+(?:\.\d+)*/\S+"}
LABELLED = {kind: rf"(?i)\b{label}({FORMS[kind]})\b" for kind, label in LABELS.items()}


def nonempty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def extraction_input(text: Column) -> Column:
    """Compatibility forms, straight quotes, words cut at a line's end joined, single spaces."""
    c = F.regexp_replace(F.regexp_replace(compatible(text), "[“”„‟«»]", '"'), "[‘’‚‛]", "'")
    c = F.regexp_replace(F.regexp_replace(c, "(?i)&amp;", "&"), r"(\p{L})-\n[ \t]*(\p{Ll})", "$1$2")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def places(text: Column, pattern: str) -> Column:
    """Structs of at (from 0) and hit for all matches, from what stands between them."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zero = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,hit:string>>").alias("found"))

    def step(s: Column, x: Column) -> Column:
        at = s["end"] + F.length(x["gap"])
        return F.struct((at + F.length(x["hit"])).alias("end"), F.concat(s["found"], F.array(F.struct(at.alias("at"), x["hit"].alias("hit")))).alias("found"))

    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), lambda x: x["hit"].isNotNull())
    return F.aggregate(pairs, zero, step, lambda s: s["found"])


def year_score(text: Column, at: Column, hit: Column, by_author: Column) -> Column:
    end, size = at + F.length(hit), F.length(text)
    cut = lambda a, b: F.lower(F.substring(text, F.greatest(F.lit(0), a) + 1, F.greatest(F.lit(0), b - F.greatest(F.lit(0), a))))

    def told(x: Column) -> Column:
        before, after, near = x["before"], x["after"], x["near"]
        prev, next_ = F.right(before, F.lit(1)), F.left(after, F.lit(1))
        either = lambda p: prev.rlike(p) | next_.rlike(p)
        holds = {
            "in brackets": (prev == "(") & (next_ == ")"),
            "where the family has its year": F.when(by_author, at < EARLY).otherwise(at > size * LATE),
            "after a mark": before.rlike(r"[;:,)]\s*$"),
            "before a mark": after.rlike(r"^\s*[;:.,)]"),
            "in a range": either("[–-]"),
            "after volume or issue": before.rlike(r"\b(?:vol|volume|issue|no)\.?\s*$"),
            "after an access date's word": before.rlike(r"\b(?:accessed|retrieved|available at)\b"),
            "before edition": after.rlike(r"\b(?:ed|edition)\b"),
            "near an identifier": near.rlike(r"\b(?:doi|https?://|doi\.org/|arxiv|isbn|issn|handle\.net|patent)\b"),
            "in an address or number": either("[/_.]"),
            "beside long digits": after.rlike(r"\.\d{3,}") | before.rlike(r"\d{3,}\."),
        }
        return reduce(add, [F.when(c, YEAR_POINTS[k]).otherwise(0) for k, c in holds.items()])

    return let(F.struct(cut(at - AROUND, at).alias("before"), cut(end, end + AROUND).alias("after"), cut(at - WIDE, end + WIDE).alias("near")), told)


def best_year(text: Column, family: Column) -> Column:
    """year, text and index of the candidate that scores best; among equals the first for
    families that date after the authors, else the last. Null without a candidate."""
    by_author = F.coalesce(family == "author_date", F.lit(False))
    score = lambda x: F.struct(year_score(text, x["at"], x["hit"], by_author).alias("score"), F.when(by_author, -x["at"]).otherwise(x["at"]).alias("order"), x["at"].alias("at"), x["hit"].alias("hit"))

    def best(found: Column) -> Column:
        # a lone candidate needs no score
        return F.when(F.size(found) > 1, let(F.array_max(F.transform(found, score)), lambda x: F.struct(x["at"].alias("at"), x["hit"].alias("hit")))).otherwise(F.get(found, F.lit(0)))

    return let(let(places(text, YEAR), best), lambda x: F.when(x.isNotNull(), F.struct(F.left(x["hit"], F.lit(4)).cast("int").alias("year"), x["hit"].alias("text"), x["at"].alias("index"))))


def quoted_title(text: Column) -> Column:
    """title, start and end (after the closing quote) of the best pair of quotes, which
    holds no DOI or address. A pair's points besides length are SLACK at most, so for
    each opening quote only the last SLACK quotes that it can reach are tried."""
    def best(parts: Column) -> Column:
        last = F.size(parts) - 1  # quotes
        bad = F.filter(F.transform(parts, lambda p, i: F.when(p.rlike(DOI) | p.rlike(ADDRESS), i)), lambda i: i.isNotNull())
        zero = F.struct(F.lit(0).alias("at"), F.array(F.lit(0)).alias("all"))
        ends = F.aggregate(F.slice(parts, F.lit(1), last), zero, lambda s, p: let(s["at"] + F.length(p) + 1, lambda at: F.struct(at.alias("at"), F.concat(s["all"], F.array(at)).alias("all"))), lambda s: s["all"])  # after quote k
        # both are worked out once, not again for each pair
        return F.when(last >= 2, let(F.struct(bad.alias("bad"), ends.alias("ends")), lambda x: chosen(last, x["bad"], x["ends"])))

    def chosen(last: Column, bad: Column, ends: Column) -> Column:

        def pair(a: Column, b: Column) -> Column:
            start, end = F.element_at(ends, a + 1) - 1, F.element_at(ends, b + 1)
            title = F.trim(F.substring(text, start + 2, end - start - 2))
            return F.struct(start.alias("start"), end.alias("end"), title.alias("title"))

        def points(x: Column) -> Column:
            title, before, after = x["title"], F.substring(text, F.lit(1), x["start"]), F.substring(text, x["end"] + 1, F.length(text))
            holds = {
                "three words": F.regexp_count(title, F.lit(r"[\p{L}\p{N}]+")) >= 3, "ends a sentence": title.rlike(r"[.?!]$"), "a mark inside": title.rlike("[,;:]"), "a letter": title.rlike(r"\p{L}"),
                "a year before": before.rlike(r"\b(?:19|20)\d{2}\b"), "a mark after": after.rlike(r"^\s*[,.;:]"),
            }
            return F.length(title) + reduce(add, [F.when(c, TITLE_POINTS[k]).otherwise(0) for k, c in holds.items()])

        def of(a: Column) -> Column:
            far = F.least(last, F.coalesce(F.array_min(F.filter(bad, lambda i: i >= a)), last))
            return F.when(far > a, F.transform(F.sequence(F.greatest(a + 1, far - SLACK), far), lambda b: pair(a, b)))

        pairs = F.filter(F.flatten(F.filter(F.transform(F.sequence(F.lit(1), last - 1), of), lambda x: x.isNotNull())), lambda x: F.length(x["title"]) >= 3)
        scored = F.transform(pairs, lambda x: F.struct(points(x).alias("score"), F.length(x["title"]).alias("size"), (-x["start"]).alias("order"), x["end"].alias("end"), x["title"].alias("title")))
        return let(F.array_max(scored), lambda x: F.when(x.isNotNull(), F.struct(x["title"].alias("title"), (-x["order"]).alias("start"), x["end"].alias("end"))))

    return let(F.split(text, '"', -1), best)


def relaxed_doi(folded: Column) -> Column:
    """value and recovered, from a text without accents: an address, what follows doi:, a
    bare one; else one with misread digits."""
    bare = DOI.removeprefix("(?i)")
    tries = [rf"(?i)https?://(?:dx\.)?doi\.org/({bare})", rf"(?i)\bdoi:\s*({bare})", rf"(?i)\b({bare})"]
    plain = F.coalesce(*(identifiers.doi(nonempty(F.regexp_extract(folded, p, 1))) for p in tries))
    odd = identifiers.doi(recover_doi(folded)["value"])
    return F.struct(F.coalesce(plain, odd).alias("value"), (plain.isNull() & odd.isNotNull()).alias("recovered"))


def bare_url(url: Column) -> Column:
    """Without marks after it, and without closing brackets that none opened."""
    return let(F.regexp_replace(url, r"[.,;:\]]+$", ""), lambda x: identifiers.drop_surplus(x, "(", ")"))


def citation_features(df: DataFrame, text_col: str = "text", family_col: str | None = None) -> DataFrame:
    """df with features: normalized, parseable (without identifiers at its end), year,
    quoted_title, and doi, url, pmid, arxiv, isbn, issn, handle, patent as raw and
    normalized (doi also recovered). A null text is an empty one, which has none of
    them; family_col (else by authors) tells where years stand."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    family = F.col(f"`{family_col}`") if family_col else F.lit("author_date")
    df = df.withColumns({"_raw": text, "_norm": extraction_input(text), "_folded": fold_marks(text)})
    df = df.withColumns({"_bare": strip_identifier_tail(F.col("_norm")), "_plain": fold_marks(F.col("_norm"))})
    raw, norm = F.col("_raw"), F.col("_norm")
    strict = F.coalesce(nonempty(F.regexp_extract(norm, DOI, 0)), nonempty(F.regexp_extract(F.col("_folded"), DOI, 0)))
    df = df.withColumns({"_strict": strict, "_url": nonempty(F.regexp_extract(norm, ADDRESS, 0))})
    # every form that relaxed_doi() finds has a slash
    df = df.withColumn("_relaxed", F.when(F.col("_strict").isNull() & F.col("_plain").contains("/"), relaxed_doi(F.col("_plain"))))
    relaxed = F.when(F.col("_strict").isNull(), F.col("_relaxed")["value"])
    doi = F.struct(F.coalesce("_strict", relaxed).alias("raw"), F.when(F.col("_strict").isNotNull(), identifiers.doi(F.col("_strict"))).otherwise(relaxed).alias("normalized"), F.coalesce(F.col("_strict").isNull() & F.col("_relaxed")["recovered"], F.lit(False)).alias("recovered"))
    own = lambda kind, group=1: let(nonempty(F.regexp_extract(raw, LABELLED[kind], group)), lambda x: F.struct(x.alias("raw"), identifiers.normalize(kind, x).alias("normalized")))
    patent = let(F.when(raw.rlike("[0-9]{6}"), identifiers.patent(raw)), lambda x: F.struct(x.alias("raw"), x.alias("normalized")))
    made = F.struct(
        norm.alias("normalized"), F.col("_bare").alias("parseable"), best_year(F.col("_bare"), family).alias("year"), quoted_title(F.col("_bare")).alias("quoted_title"), doi.alias("doi"), F.struct(F.col("_url").alias("raw"), bare_url(F.col("_url")).alias("normalized")).alias("url"),
        *(own(k).alias(k) for k in ("pmid", "arxiv", "isbn", "issn", "handle")), patent.alias("patent"),
    )
    return df.withColumn("features", made).drop("_raw", "_norm", "_folded", "_bare", "_plain", "_strict", "_relaxed", "_url")
