"""Fields out of a raw reference: authors, title, container, numbers, year and identifiers.

The title tells how the rest is cut: one in quotes stands between authors and
container; otherwise a year after the authors does, or the first two sentences. What
follows the title gives the container and its numbers by four layouts of locators.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import let
from .authors import author_list, suspect_authors
from .citation_features import citation_features

#: How sure each field is that is read this way, and a reference without any.
CONFIDENCE = {"doi": 0.95, "url": 0.90, "year": 0.92, "pages": 0.88, "volume": 0.87, "issue": 0.84, "authors": 0.70, "title": 0.72, "journal": 0.68}
NOTHING = 0.40

YEAR, PAGE = r"(?:1[6-9]|20)\d{2}[a-z]?", r"([A-Za-z]?\d[\w]*(?:\s*[-–—]\s*[A-Za-z]?\d\w*)?)"
MARK = r"^\s*(?:\[\d+\]|\(\d+\)|\d{1,3}[.)])\s*"
#: Layouts of what follows a container, each with the places of volume, issue and pages.
LOCATORS = [
    (rf"(?i)^(.*?),?\s*vol\.?\s*(\d+)(?:,\s*no\.?\s*([\w-]+))?(?:,\s*{YEAR})?(?:,\s*pp?\.?\s*{PAGE})?", 2, 3, 4),
    (rf"^(.*?)[.,]?\s*{YEAR}(?:\s+[A-Z][a-z]{{2}}(?:\s+\d+)?)?[;,]\s*(\d+)(?:\(([^)]+)\))?(?::\s*{PAGE})?", 2, 3, 4),
    (rf"^(.*?),?\s(\d+),\s*no\.?\s*([\w-]+)(?:\s*\((?:\w+\s+)?{YEAR}\))?(?::\s*{PAGE})?", 2, 3, 4),
    (rf"^(.*?),\s*(\d+)(?:\s*\(([^)]+)\))?(?:,\s*(?:pp?\.?\s*)?{PAGE})?", 2, 3, 4),
]
FIELDS = "struct<authors:string,title:string,rest:string>"


def filled(c: Column) -> Column:
    """nonempty(), where c is worked out once in a lambda too."""
    return let(c, lambda x: F.when(x != "", x))


def pieces(text: Column, quote: Column) -> Column:
    """authors, title and rest of a text without number and identifiers; quote is its quoted title with places."""
    made = lambda a, t, r: F.struct(filled(F.trim(F.regexp_replace(a, r"[\s,;:]+$", ""))).alias("authors"), filled(F.trim(F.regexp_replace(t, r"[\s.,]+$", ""))).alias("title"), filled(F.trim(F.regexp_replace(r, r"^[\s.,;:]+", ""))).alias("rest"))
    part = lambda p, k: F.regexp_extract(text, p, k)
    quoted = made(F.substring(text, F.lit(1), quote["start"]), quote["title"], F.substring(text, quote["end"] + 1, F.length(text)))
    sentence = r"((?:[^.?!]++|[.?!](?!\s))+[.?!]?)\s*(.*)$"
    dated = rf"^(.{{2,400}}?)\s*\({YEAR}(?:,[^)]*)?\)[.,:]?\s*{sentence}"
    bare = rf"^(.{{2,400}}?)[,.]\s*{YEAR}\.\s+{sentence}"
    plain = rf"^((?:(?:\p{{Lu}}\.\s*-?)+|[^.])+?\.)\s+{sentence}"
    one = r"(?:[\p{L}'’-]+\s+){1,3}\p{Lu}{1,4}"
    short = rf"^({one}(?:,\s*{one})*(?:,?\s*(?i:et al))?)\.\s+{sentence}"  # initials after names, without stops
    colon = rf"^([^:.]+):\s+{sentence}"

    def tried(p: str, other: Column, also: Column | None = None) -> Column:
        # the first group of each pattern holds something wherever the pattern matches
        return let(part(p, 1), lambda a: F.when((a != "") if also is None else (a != "") & also, made(a, part(p, 2), part(p, 3))).otherwise(other))

    named = text.rlike(r"^[^:.]*\p{L}\s\p{Lu}{1,3}\s*(?:,[^:]*)?:")
    tries = [(dated,), (bare,), (colon, named), (short,), (plain,)]
    return F.when(quote.isNotNull(), quoted).otherwise(reduce(lambda rest, t: tried(t[0], rest, *t[1:]), reversed(tries), made(F.lit(""), text, F.lit(""))))


def located(rest: Column) -> Column:
    """journal, volume, issue and pages of what follows a title."""
    trimmed = lambda c: filled(F.trim(F.regexp_replace(c, r"^[\s*.,;:]+|[\s*.,;:]+$", "")))
    none = F.lit(None).cast("string")

    def told(rest: Column) -> Column:
        def one(other: Column, layout: tuple) -> Column:
            # a volume stands wherever a layout matches
            p, v, i, g = layout
            part = lambda k: trimmed(F.regexp_extract(rest, p, k))
            return let(F.regexp_extract(rest, p, v), lambda volume: F.when(volume != "", F.struct(part(1).alias("journal"), trimmed(volume).alias("volume"), part(i).alias("issue"), part(g).alias("pages"))).otherwise(other))

        alone = F.struct(filled(F.trim(F.regexp_replace(F.regexp_replace(rest, rf"[,.]?\s*\(?{YEAR}\)?\.?$", ""), r"[\s.,;:]+$", ""))).alias("journal"), none.alias("volume"), none.alias("issue"), filled(F.regexp_extract(rest, rf"(?i)\bpp?\.?\s*{PAGE}", 1)).alias("pages"))
        return reduce(one, reversed(LOCATORS), alone)

    return let(F.regexp_replace(rest, r"(?i)^in:?\s+", ""), told)


def extract_fields(df: DataFrame, text_col: str = "text", family_col: str | None = None) -> DataFrame:
    """df with fields (authors, title, journal, volume, issue, pages, year, doi, url),
    confidences (a map of the fields that were found) and reference_confidence (their mean),
    and warnings. A null or empty text has no fields; its confidence is that of nothing
    known. What isn't found is null, authors an empty list."""
    df = citation_features(df, text_col, family_col)
    f = F.col("features")
    cut = F.length(F.regexp_extract(f["parseable"], MARK, 0))
    shifted = F.when(f["quoted_title"].isNotNull(), F.struct((f["quoted_title"]["start"] - cut).alias("start"), (f["quoted_title"]["end"] - cut).alias("end"), f["quoted_title"]["title"].alias("title")))
    df = df.withColumns({"_text": F.substring(f["parseable"], cut + 1, F.length(f["parseable"])), "_quote": shifted})
    df = df.withColumn("_p", pieces(F.col("_text"), F.col("_quote")))
    df = df.withColumns({"_l": located(F.coalesce(F.col("_p")["rest"], F.lit(""))), "_a": author_list(F.col("_p")["authors"])})
    pages = F.regexp_replace(F.col("_l")["pages"], "\\s*[-–—]\\s*", "-")
    doi = f["doi"]["normalized"]
    made = F.struct(F.col("_a").alias("authors"), F.when(F.col("_text") != "", F.col("_p")["title"]).alias("title"), F.col("_l")["journal"].alias("journal"), F.col("_l")["volume"].alias("volume"), F.col("_l")["issue"].alias("issue"), pages.alias("pages"), f["year"]["year"].alias("year"), doi.alias("doi"), F.when(doi.isNull(), f["url"]["normalized"]).alias("url"))
    df = df.withColumn("fields", made)
    there = {k: (F.size(F.col("fields")[k]) > 0) if k == "authors" else F.col("fields")[k].isNotNull() for k in CONFIDENCE}
    told = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(k).alias("key"), F.lit(CONFIDENCE[k]).alias("value"))) for k, c in there.items())))
    mean = let(told, lambda t: F.when(F.size(t) > 0, F.round(F.aggregate(t, F.lit(0.0), lambda s, x: s + x["value"]) / F.size(t), 3)).otherwise(NOTHING))
    warned = F.array_compact(F.array(F.when(F.coalesce(F.col("_p")["authors"].isNotNull() & suspect_authors(F.col("_a"), F.col("_p")["authors"]), F.lit(False)), "invalid_author_span")))
    return df.withColumns({"confidences": F.map_from_entries(told), "reference_confidence": mean, "warnings": warned}).drop("_text", "_quote", "_p", "_l", "_a")


def without_owned_tail(container: Column, volume: Column, issue: Column, pages: Column, year: Column) -> Column:
    """A container without the numbers at its end that other fields hold already, as often
    as they follow one another; one that would be left empty stays."""
    quoted = lambda c: F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|/-])", r"\\$1")
    known = [F.when(c.isNotNull() & (F.trim(c.cast("string")) != ""), quoted(c.cast("string"))) for c in (pages, volume, issue, year)]
    known[0] = F.regexp_replace(known[0], r"\\-", "[-–—]")
    words = F.array_join(F.array_compact(F.array(*known)), "|")
    pattern = F.concat(F.lit(r"(?:[\s,;:.(]*(?:vol\.?|no\.?|pp?\.?)?\s*(?<![\p{L}\d])(?:"), words, F.lit(r")\)?)+[\s,;:.?]*$"))
    cut = F.trim(F.regexp_replace(F.regexp_replace(container, pattern, F.lit("")), r"[\s,;:.]+$", ""))
    return F.when((words != "") & (cut != ""), cut).otherwise(container)
