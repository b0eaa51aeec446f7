"""What kind of work a reference stands for: evidence from its fields and raw text, an
ordered router that gives reasons, and a scorer that adds points for each type.

Evidence is worked out once as a struct of yes and no; the router's rules and the
scorer's points are tables over its names. A type is the router's where that is sure
enough for it, else the scorer's.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers
from ..functions.text import compatible, fold_marks

# Types, cues, forms of identifiers, how sure each type is by points alone, and how sure a route must be.
TYPES = ["article-journal", "book", "book-chapter", "thesis", "conference-paper", "webpage", "report", "patent", "dataset", "preprint"]
CUES = {
    "conference": ["conference", "symposium", "simposio", "workshop", "congress", "congreso", "congresso", "meeting", "proceedings", "proc", "anais", "prosiding", "jornadas", "seminar", "seminario", "abstracts publication"],
    "journal": ["journal", "revista", "review", "annals?", "letters?", "transactions?", "quarterly", "bulletin", "studies", "archives?"],
    "preprint": ["preprints?", "arxiv", "biorxiv", "medrxiv", "ssrn", "techrxiv", "research square"],
    "publisher": ["press", "publishing", "publisher", "editorial", "books?", "editions?", "media", "springer", "palgrave", "cambridge", "oxford", "routledge", "elsevier", "wiley", "dialetica", "gruyter", "verlag", "birkhauser", "hanser", "editora", "peter lang", "thieme", "sciendo"],
    "institution": ["department", "ministry", "agency", "commission", "bureau", "administration", "university", "institute", "laboratory", "office", "standards", "association", "society", "survey", "task force", "council"],
    "thesis": ["doctoral dissertation", "phd thesis", "master'?s thesis", "dissertation", "thesis", "tese", "tesis"],
    "report": ["report", "standard", "technical report", "white paper", "working paper", "guideline", "specification", "recommendation"],
    "web": ["accessed", "retrieved", "available at", "online"],
    "dataset": ["dataset", "data set", "figshare", "zenodo"],
    "presented": ["paper presented at"],
}
PREPRINT_DOI, REPORT_DOI = r"10\.(?:2139/ssrn\.|20944/preprints|21203/rs\.|36227/techrxiv\.)", r"10\.(?:31003/|3133/|46220/|54932/|55277/researchhub\.)"
CHAPTER_DOI, BOOK_DOI = r"10\.\d{4,9}/(?:97[89][-\d]+[A-Za-z./-]*_\d+|1-4020-[\d-]+_\d+|bfb\d{7,})", r"10\.\d{4,9}/97[89][-\d]{10,17}"
SURE = {"article-journal": 0.84, "conference-paper": 0.79, "book-chapter": 0.79, "book": 0.79, "thesis": 0.79, "report": 0.79, "preprint": 0.79, "patent": 0.75, "webpage": 0.75, "dataset": 0.7, "unknown": 0.4}
PROMOTE = {"article-journal": 0.95, "conference-paper": 0.93, "book-chapter": 0.93, "report": 0.9, "preprint": 0.95, "patent": 0.95, "thesis": 0.95, "webpage": 0.9, "book": 0.95}
UNKNOWN_BELOW = 0.6
# End of the fixed values.

FIELDS = ["title", "journal", "conference_title", "book_title", "publisher", "institution", "site_name", "volume", "issue", "pages", "issn", "isbn", "doi", "url", "patent", "thesis_type", "repository", "arxiv", "report_number", "accessed_date"]
DOI_STUB = r"(?i)^https?://(?:dx\.)?doi\.org/?\.?"


def cue(c: Column, *kinds: str) -> Column:
    return F.coalesce(c.rlike(rf"(?i)\b(?:{'|'.join(w for k in kinds for w in CUES[k])})\b"), F.lit(False))


def evidence(raw: Column, f: dict[str, Column]) -> dict[str, Column]:
    """raw: plain text without accents; f: fields by name, null where there is none."""
    has = {k: c.isNotNull() for k, c in f.items()}
    text = lambda k: F.coalesce(f[k], F.lit(""))
    same = lambda a, b: F.coalesce(F.lower(f[a]) == F.lower(f[b]), F.lit(False))
    year_like = text("volume").rlike(r"^(?:19|20)\d{2}$")
    real_url = F.coalesce(~f["url"].rlike(DOI_STUB), F.lit(False)) | raw.rlike(r"(?i)https?://(?!(?:dx\.)?doi\.org)\S+")
    doi = has["doi"] | raw.rlike(r"\b10\.\d{4,9}/\S+")
    numbers = has["volume"] | has["issue"] | has["issn"]
    locators = numbers | has["pages"] | raw.rlike(r"(?i)\b(?:vol|volume)\.?\s*\d+\b|\bno\.?\s*\d+\b|\bpp?\.?\s*[A-Za-z]?\d|;\s*\d+\s*\(\d+\)\s*[:;,]\s*[A-Za-z]?\d+")
    venue = text("conference_title")
    journalish = has["conference_title"] & cue(venue, "journal") & ~cue(venue, "conference")
    named = has["conference_title"] & ~same("conference_title", "title") & ~journalish & ~cue(venue, "report", "institution") & venue.rlike(r"\b(?:[A-Z][a-z]+\d{1,4}|[A-Z]{2,}\d{1,4}|\d{1,3}(?:st|nd|rd|th))\b|[-:]\s+[A-Z]")
    spill = has["book_title"] & (cue(text("book_title"), "journal")) & ~has["isbn"] & ~cue(text("book_title"), "publisher")
    chapter_doi = text("doi").rlike(CHAPTER_DOI) | raw.rlike(CHAPTER_DOI)
    web_form = real_url & ~doi & ~locators & (has["site_name"] | raw.rlike(r'"[^"]{4,220}"|\(\d{4}\)|,\s*(?:19|20)\d{2}(?:[.,]|$)'))
    out = {
        "patent": has["patent"] | identifiers.patent(raw).isNotNull() | cue_word(raw, "patent"), "thesis": has["thesis_type"] | cue(raw, "thesis") | cue(venue, "thesis"),
        "preprint": has["repository"] | has["arxiv"] | cue(raw, "preprint") | text("doi").rlike(PREPRINT_DOI) | raw.rlike(PREPRINT_DOI), "preprint_doi": text("doi").rlike(PREPRINT_DOI) | raw.rlike(PREPRINT_DOI), "dataset": cue(raw, "dataset") & ~has["journal"],
        "doi": doi, "isbn": has["isbn"] | raw.rlike(BOOK_DOI) | raw.rlike(r"\b97[89][-\s]?\d(?:[-\s]?\d){9,11}\b"), "issn": has["issn"] | raw.rlike(r"\b\d{4}-\d{3}[\dXx]\b"), "numbers": numbers, "locators": locators, "url": real_url,
        "journal": has["journal"], "journal_word": cue(text("journal"), "journal"), "journal_in_raw": has["journal"] & F.coalesce(F.instr(F.lower(raw), F.lower(f["journal"])) > 0, F.lit(False)), "publisher_as_journal": has["journal"] & cue(text("journal"), "publisher") & ~cue(text("journal"), "journal"),
        "conference": (has["conference_title"] & ~journalish & ~cue(venue, "thesis")) | cue(raw, "conference"), "conference_word": cue(venue, "conference") | cue(raw, "conference"), "conference_title": has["conference_title"], "journalish_venue": journalish, "named_venue": named, "presented": cue(raw, "presented"),
        "book_title": has["book_title"] & ~spill & ~web_form, "book_spill": spill, "chapter_doi": chapter_doi, "in_book": raw.rlike(r"(?:\.|\?|!|\"|”|^)\s*In:?\s+[^.]{4,160}\(?(?:pp?\.|[Ee]ds?\.)"), "publisher": has["publisher"] | cue(raw, "publisher"), "bookish": cue(text("publisher"), "publisher"),
        "article_publisher": cue(text("publisher"), "journal") & ~cue(text("publisher"), "publisher", "conference"), "institution": has["institution"] | (cue(raw, "institution") & ~web_form), "institution_field": has["institution"] & cue(text("institution"), "institution"),
        "institutional_publisher": cue(text("publisher"), "institution") & ~cue(text("publisher"), "publisher", "journal"), "report": has["report_number"] | cue(raw, "report"), "report_doi": text("doi").rlike(REPORT_DOI) | raw.rlike(REPORT_DOI), "site": has["site_name"], "web_form": web_form, "web_cue": has["accessed_date"] | cue(raw, "web"),
        "title_alone": has["title"] & ~has["journal"] & ~has["publisher"] & ~has["institution"], "year_as_volume": year_like & ~has["issue"] & ~has["pages"], "only_doi": has["doi"] & ~reduce(or_, [has[k] for k in ("title", "journal", "conference_title", "book_title", "publisher", "institution", "site_name", "volume", "issue", "pages", "issn", "isbn", "report_number")]),
    }
    return {k: F.coalesce(c, F.lit(False)) for k, c in out.items()}


def cue_word(c: Column, word: str) -> Column:
    return c.rlike(rf"(?i)\b{word}(?:\s+application)?(?:\s+no\.?)?\b")


def routes(e: Column) -> list[tuple[str, Column | float, Column, list[str]]]:
    """Type, confidence, condition and reasons, in the order in which they are tried."""
    strong_venue = e["conference_word"] | e["named_venue"]
    web = e["url"] & ~e["locators"] & ~strong_venue & (e["site"] | e["web_cue"] | e["title_alone"])
    bookish = e["isbn"] | e["book_title"] | e["bookish"]
    spill = e["book_spill"] & ~strong_venue & ~web & ~e["report"] & (e["locators"] | e["doi"])
    article = ~bookish & ((e["journal"] & (e["numbers"] | e["journal_word"])) | (e["conference_title"] & ~strong_venue & e["numbers"] & (e["journalish_venue"] | e["issn"])) | (e["article_publisher"] & e["numbers"]) | spill)
    report = (e["report"] | e["institution_field"] | e["institutional_publisher"]) & ~article & ~strong_venue & ~web & ~bookish
    venue_for_journal, book_for_journal = article & e["conference_title"] & ~e["journal"], article & spill & ~e["journal"]
    chapter = e["book_title"] | (e["isbn"] & e["in_book"]) | e["chapter_doi"]
    book = (e["isbn"] & ~strong_venue & ~e["report"] & ~web) | (e["bookish"] & ~e["locators"] & ~strong_venue & ~e["report"] & ~web & ~chapter)
    return [
        ("patent", 0.99, e["patent"], ["patent_identifier"]), ("thesis", 0.98, e["thesis"], ["thesis_cue"]), ("preprint", 0.96, e["preprint"], ["preprint_cue"]),
        ("article-journal", 0.95, venue_for_journal, ["article_locator_profile", "conference_container_article_override"]), ("article-journal", 0.96, book_for_journal, ["article_locator_profile", "book_container_article_override"]), ("article-journal", 0.97, article, ["article_locator_profile"]),
        ("book-chapter", 0.94, e["book_title"] & ~e["conference_title"] & ~report & ~web & bookish & (e["isbn"] | e["bookish"]), ["book_chapter_profile", "bookish_conference_override"]),
        ("conference-paper", 0.93, strong_venue | (e["conference_title"] & ~e["locators"] & ~report & ~web), ["conference_container_profile"]), ("webpage", 0.91, web, ["web_document_profile"]), ("book-chapter", 0.88, chapter, ["book_chapter_profile"]), ("book", 0.88, book, ["bookish_container_profile"]),
        ("report", 0.93, report & e["report"], ["institutional_report_profile"]), ("report", 0.87, report, ["institutional_report_profile"]), ("unknown", 0.45, e["only_doi"], ["doi_only_partial_parse"]),
    ]


def points(e: Column) -> list[tuple[Column, dict[str, float]]]:
    """What each piece of evidence adds to the types' sums."""
    venue, book, numbers = e["conference"], e["book_title"] | e["in_book"], e["locators"] & ~e["year_as_volume"]
    plain = ~venue & ~book
    owner = e["institution"] | e["report"] | e["institutional_publisher"]
    return [
        (e["patent"], {"patent": 18, "webpage": -8, "report": -5, "book": -5}), (e["thesis"], {"thesis": 16, "conference-paper": -12, "book": -6, "report": -3, "webpage": -5}), (e["preprint"], {"preprint": 10}), (e["preprint_doi"], {"preprint": 12, "article-journal": -3, "conference-paper": -8, "book": -6, "report": -5}),
        (e["dataset"] & ~venue, {"dataset": 9}), (e["isbn"] & ~e["journal"] & ~venue & book, {"book-chapter": 7}), (e["isbn"] & ~e["journal"] & ~venue & ~book, {"book": 7}), (e["issn"] & plain, {"article-journal": 6}),
        (book & venue, {"conference-paper": 9}), (book & ~venue, {"book-chapter": 9}), (e["book_title"] & e["publisher"] & ~venue, {"book-chapter": 13, "article-journal": -10}), (venue & ~book, {"conference-paper": 8}), (e["presented"], {"conference-paper": 14, "article-journal": -12, "report": -6}),
        ((e["named_venue"] | (e["conference_title"] & e["conference_word"])) & ~e["journal_in_raw"], {"conference-paper": 10, "article-journal": -8}), (e["chapter_doi"], {"book-chapter": 14, "conference-paper": -6, "article-journal": -4}), (e["chapter_doi"] & e["publisher"] & ~venue, {"book-chapter": 6, "article-journal": -4}),
        (e["publisher_as_journal"] & (e["year_as_volume"] | ~numbers) & ~venue, {"book": 12, "article-journal": -14}), (e["journal"] & ~e["publisher_as_journal"] & (~venue | e["journal_in_raw"]), {"article-journal": 10}), (~e["journal"] & e["doi"] & numbers & plain, {"article-journal": 10}), (~e["journal"] & ~e["doi"] & numbers & plain, {"article-journal": 7}),
        (e["publisher"] & ~numbers & plain & e["institutional_publisher"] & e["doi"] & ~e["isbn"], {"report": 11, "book": -6}), (e["publisher"] & ~numbers & plain & ~(e["institutional_publisher"] & e["doi"] & ~e["isbn"]), {"book": 7}), (e["publisher"] & e["isbn"] & ~numbers & ~venue, {"book": 10, "article-journal": -8}),
        (owner & ~venue & ~e["journal"] & e["report"], {"report": 8}), (owner & ~venue & ~e["journal"] & ~e["report"] & ~e["bookish"], {"report": 6}), (e["institution_field"] & ~venue & ~e["journal"], {"report": 5}), (e["report_doi"] & ~venue & ~numbers, {"report": 14, "article-journal": -12, "conference-paper": -8, "webpage": -4}),
        (e["web_form"] & ~venue, {"webpage": 16, "report": -8, "book": -6, "book-chapter": -8, "conference-paper": -6}), (e["site"] & e["url"] & plain & ~numbers, {"webpage": 11, "book": -4, "report": -3}), (e["url"] & ~e["doi"] & ~numbers & plain & ~e["publisher"] & ~e["institution"] & ~e["thesis"], {"webpage": 7}), (e["site"] & ~numbers & ~venue, {"webpage": 7}),
    ]


def type_evidence(df: DataFrame, raw_col: str, fields: dict[str, str]) -> DataFrame:
    """df with _e, a struct of evidence. fields: columns by field name; blank values count as none, other fields as absent."""
    names = {k: F.nullif(F.trim(F.col(f"`{fields[k]}`").cast("string")), F.lit("")) if k in fields else F.lit(None).cast("string") for k in FIELDS}
    plain = F.trim(F.regexp_replace(F.regexp_replace(fold_marks(compatible(F.coalesce(F.col(f"`{raw_col}`"), F.lit("")))), "[“”„‟«»]", '"'), r"\s+", " "))
    df = df.withColumns({"_raw": plain, "_f": F.struct(*(c.alias(k) for k, c in names.items()))})
    return df.select("*", F.struct(*(c.alias(k) for k, c in evidence(F.col("_raw"), {k: F.col("_f")[k] for k in FIELDS}).items())).alias("_e")).drop("_raw", "_f")


def classify_types(df: DataFrame, raw_col: str, fields: dict[str, str]) -> DataFrame:
    """df with route (type, confidence, reasons), scored (type and score by points; unknown
    where no type has any) and type, type_confidence, type_unknown: the route where it is
    sure enough for its type, else what the points say. Null raw texts are empty."""
    df, e = type_evidence(df, raw_col, fields), F.col("_e")
    made = lambda t, c, reasons: F.struct(F.lit(t).alias("type"), F.lit(c).alias("confidence"), F.array(*map(F.lit, reasons)).alias("reasons"))
    total = {t: reduce(add, [F.when(c, float(p[t])).otherwise(0.0) for c, p in points(e) if t in p], F.lit(0.0)) for t in TYPES}
    best = F.array_max(F.array(*(F.struct(total[t].alias("score"), F.lit(-k).alias("order"), F.lit(t).alias("type")) for k, t in enumerate(TYPES))))
    df = df.withColumn("_best", best).withColumn("scored", F.struct(F.when(F.col("_best.score") > 0, F.col("_best.type")).otherwise("unknown").alias("type"), F.col("_best.score").alias("score")))
    sure = F.create_map(*(F.lit(v) for kv in SURE.items() for v in kv))
    last = F.struct(F.col("scored.type").alias("type"), sure[F.col("scored.type")].alias("confidence"), F.array(F.lit("heuristic_fallback")).alias("reasons"))
    route = reduce(lambda rest, r: F.when(r[2], made(r[0], r[1], r[3])).otherwise(rest), reversed(routes(e)), last)
    df = df.withColumn("route", route).drop("_best", "_e")
    promoted = F.coalesce(F.col("route.confidence") >= F.create_map(*(F.lit(v) for kv in PROMOTE.items() for v in kv))[F.col("route.type")], F.lit(False)) & (F.element_at("route.reasons", 1) != "heuristic_fallback")
    df = df.select("*", F.when(promoted, F.col("route.type")).otherwise(F.col("scored.type")).alias("type"), F.when(promoted, F.col("route.confidence")).otherwise(sure[F.col("scored.type")]).alias("type_confidence"))
    return df.withColumn("type_unknown", (F.col("type") == "unknown") | (F.col("type_confidence") < UNKNOWN_BELOW))
