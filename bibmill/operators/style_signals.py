"""Which citation style a reference is written in: a bank of signals read in one pass,
weighted sums by family and by style, and the rules that commit to one of them.

A reference is prepared once (quotes and accents folded, number and identifiers cut
off, lead, title and container guessed), each signal is one yes or no about these
parts, and the scores are sums over signals. Nothing is shuffled.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.text import compatible, fold_marks
from .styles import COMMIT_FAMILY, COMMIT_STYLE, FAMILY_COMMIT, GROUPS, STYLE_MARGIN, tier

# The families, their styles, and what each signal counts for them.
STYLES = {"author_date": ["apa7", "harvard-ctr", "chicago-author-date"], "numeric": ["vancouver", "ieee", "ama", "acs"], "notes_bibliography": ["mla9", "chicago-notes-bib"], "web_accessed": []}
FAMILY_WEIGHTS = {
    "author_date": {"year_parenthesized_after_authors": 3.2, "year_bare_after_authors": 2.8, "ieee_incompatible_author_date_year_placement": 1.2, "year_early_position": 1.3, "author_year_lead": 1.4, "author_initials_surname": 1.2, "author_separator_ampersand": 0.7, "title_sentence_case": 0.9, "cue_journal": 0.5, "cue_book_publisher": 0.5, "marker_edition": 0.4, "identifier_doi": 0.3, "punctuation_period_dense": 0.4},
    "numeric": {
        "bracketed_enumerator": 3.0, "numeric_dot_enumerator": 0.15, "numeric_paren_enumerator": 0.75, "parenthesized_enumerator": 0.5, "author_initials_surname": 1.1, "author_surname_initials": 1.5, "author_separator_semicolon": 1.5, "author_bucket_many": 0.6, "year_repeated_conference": 0.5, "year_late_position": 0.6, "cue_conference": 0.5, "cue_journal": 0.6, "cue_journal_abbrev": 0.9, "locator_vol": 0.8,
        "locator_no": 0.6, "locator_pp": 0.8, "locator_ieee_signature": 2.4, "locator_semicolon_volume_issue_pages": 2.4, "locator_volume_issue_pages": 1.6, "locator_year_comma_volume_colon_pages": 2.1, "locator_year_comma_volume_colon_identifier": 2.0, "locator_page_range_only": 0.5, "identifier_doi": 0.6, "identifier_at_end": 0.8, "identifier_doi_tail_numeric": 1.0, "capitalization_numeric_minimal": 0.8, "punctuation_comma_dense": 0.4,
    },
    "notes_bibliography": {"quoted_title": 2.2, "title_title_case": 1.0, "title_followed_by_period": 0.5, "title_followed_by_comma": 0.7, "year_late_position": 1.8, "author_initials_surname": 0.7, "cue_book_publisher": 0.7, "marker_editor": 0.6, "marker_translator": 0.4, "marker_edition": 0.4, "locator_vol": 0.5, "locator_no": 0.4, "locator_pp": 0.5, "punctuation_period_dense": 0.4, "punctuation_comma_dense": 0.4},
    "web_accessed": {"identifier_accessed_retrieved": 3.0, "identifier_url": 2.2, "identifier_at_end": 1.1, "cue_web_access": 2.2, "web_url_without_scholarly_locators": 2.5, "web_host_like_container": 1.1, "year_late_position": 0.4},
}
STYLE_WEIGHTS = {
    "apa7": {"year_parenthesized_after_authors": 3.0, "year_bare_after_authors": 0.9, "ieee_incompatible_author_date_year_placement": 0.65, "author_initials_surname": 0.8, "author_separator_ampersand": 0.5, "author_separator_and": 0.4, "cue_journal": 0.35, "title_sentence_case": 0.8, "title_followed_by_period": 0.4, "punctuation_period_dense": 0.4},
    "harvard-ctr": {"year_bare_after_authors": 3.2, "ieee_incompatible_author_date_year_placement": 0.15, "author_initials_surname": 0.8, "title_sentence_case": 0.7, "punctuation_comma_dense": 0.3},
    "chicago-author-date": {"year_bare_after_authors": 1.5, "year_early_position": 0.8, "title_title_case": 0.9, "title_followed_by_period": 0.5, "cue_book_publisher": 0.4},
    "vancouver": {"author_surname_initials": 1.6, "locator_semicolon_volume_issue_pages": 2.6, "locator_year_comma_volume_colon_pages": 2.5, "locator_year_comma_volume_colon_identifier": 2.4, "identifier_at_end": 0.6, "identifier_doi_tail_numeric": 1.1, "cue_journal_abbrev": 0.8, "capitalization_numeric_minimal": 0.5, "year_repeated_conference": 0.3},
    "ieee": {"bracketed_enumerator": 0.8, "author_initials_surname": 0.9, "quoted_title": 1.8, "locator_vol": 0.9, "locator_no": 0.9, "locator_pp": 1.1, "locator_ieee_signature": 3.0, "ieee_incompatible_author_date_year_placement": -4.5, "punctuation_comma_dense": 0.5},
    "ama": {"author_surname_initials": 0.9, "locator_vol": 0.8, "locator_no": 0.6, "year_late_position": 0.4, "capitalization_numeric_minimal": 0.3},
    "acs": {"author_surname_initials": 0.7, "title_sentence_case": 0.4, "identifier_doi": 0.5, "locator_vol": 0.5, "locator_page_range_only": 0.3},
    "mla9": {"quoted_title": 1.8, "year_late_position": 1.6, "locator_vol": 0.7, "locator_no": 0.6, "locator_pp": 0.7, "punctuation_comma_dense": 0.5, "title_title_case": 0.4},
    "chicago-notes-bib": {"quoted_title": 1.0, "year_late_position": 0.9, "title_followed_by_period": 0.6, "cue_book_publisher": 0.6, "marker_editor": 0.5, "punctuation_period_dense": 0.4},
}
STRONG = {
    "author_date": ["year_parenthesized_after_authors", "year_bare_after_authors", "year_early_position", "author_year_lead"],
    "numeric": ["bracketed_enumerator", "numeric_dot_enumerator", "numeric_paren_enumerator", "locator_semicolon_volume_issue_pages", "locator_year_comma_volume_colon_pages", "locator_year_comma_volume_colon_identifier"],
    "notes_bibliography": ["quoted_title", "year_late_position"],
    "web_accessed": ["identifier_accessed_retrieved", "web_url_without_scholarly_locators"],
}
DAMPED, FAMILY_FULL, STYLE_FULL, FAMILY_MARGIN, TAIL_SIGNAL, TAIL_CUT = 0.8, 4.5, 3.2, 0.1, 0.8, 0.68
JOURNALS = ["Journal", "Review", "Bulletin", "Transactions", "Quarterly", "Annals"]
CONFERENCES = ["conference", "symposium", "simposio", "workshop", "congress", "congreso", "congresso", "meeting", "proceedings", "proc", "anais", "prosiding", "jornadas", "seminar", "seminario", "abstracts publication", "abstracts"]
PUBLISHERS = ["press", "publisher", "publishing", "university", "routledge", "springer", "wiley", "elsevier", "gruyter", "verlag", "editora", "editorial", "dialetica", "hanser", "birkhauser", "apress", "palgrave", "peter lang", "british standards"]
# End of the fixed values.

#: Parts of which the patterns are put together.
YEAR, NUMBER, PAGE = r"(?:1[6-9]|20)\d{2}[a-z]?", r"(?:\d+|\?)", r"[A-Za-z]?\d[\w–-]*"
# A word's edge is told by ASCII letters, digits and _ alone, in every Java version: \b of some takes ß for one.
BARE_DOI = r"""10\.\d{4,9}/[^\s"'<>]+"""
QUOTED, DOI, URL = '"[^"]{4,}"', rf"(?<!\w){BARE_DOI}", r"""(?i)(?<!\w)https?://[^\s"'<>]+"""
NEW_YEAR, VOLUME, ISSUE, PAGES = r"(?:19|20)\d{2}", rf"vol\.?\s*{NUMBER}", r"no\.?\s*[^,]+", rf"pp?\.?\s*{PAGE}"
MARK, NAME, BRACKETED = r"^\s*(?:\[\d+\]|\d+[.)]|\(\d+\))", r"\p{Lu}[\p{L}'-]+", r"(?:\([^)]+\))?"
SIGNATURE = rf"(?i){QUOTED}\s*,?\s*.+?,\s*{VOLUME},\s*(?:{ISSUE},\s*)?{PAGES},\s*{NEW_YEAR}\.?$"
#: Layouts that tell a style by themselves, read in the text without its identifiers.
LAYOUTS = {
    "mla_journal": rf'^[^"]+"[^"]+[.?!]"\s+[^,]+,\s*{VOLUME},\s*(?:{ISSUE},\s*)?(?:\w+\.?\s+)?{NEW_YEAR},\s*{PAGES}\.?$',
    "chicago_journal": rf'^[^"]+"[^"]+[.?!]"\s+.+?\s\d+,\s*no\.\s*\d+\s*\((?:\w+\s+)?{NEW_YEAR}\):\s*{PAGE}\.?$',
    "nlm_journal": rf"\.\s+{NEW_YEAR}(?:\s+[A-Z][a-z]{{2}}(?:\s+\d{{1,2}})?)?;\s*{NUMBER}\([^)]+\):\s*{PAGE}\.?$",
    "nlm_sparse": rf"\.\s+{NEW_YEAR};\s*{NUMBER}:\s*{PAGE}\.?$",
    "nlm_comma": rf"\.\s+{NEW_YEAR},\s*{NUMBER}:\s*(?:{PAGE}|10\.\d{{4,9}}/\S+)\.?$",
    "apa_journal": rf"\({YEAR}\)\.\s+.+?[.?!]\s+.+?,\s*{NUMBER}{BRACKETED},\s*(?:pp?\.?\s*)?{PAGE}\.?$",
    "dated_journal": rf"\({YEAR}\)\.\s+.+?[.?!]\s+.+?,\s*{NUMBER}{BRACKETED},\s*(?:pp?\.?\s*)?{PAGE}\.?$",
    "bare_journal": rf",\s*{YEAR}\.\s+.+?\.\s+.+?,\s*{NUMBER}{BRACKETED},\s*(?:pp?\.?\s*)?{PAGE}\.?$",
    "conference_pages": rf"(?<!\w)In\s+{NEW_YEAR}.+?\s{NEW_YEAR}(?!\w).*?\({PAGES}\)",
}
#: What a layout or pair of signals adds to a family's or a style's sum.
FAMILY_BOOSTS = {
    "mla_journal": {"notes_bibliography": 4.4, "numeric": -3.6},
    "chicago_journal": {"notes_bibliography": 4.1, "numeric": -2.6},
    "nlm_journal": {"numeric": 3.9, "author_date": -2.4},
    "nlm_comma": {"numeric": 3.9, "author_date": -2.4},
    "conference_pages": {"numeric": 3.5, "web_accessed": -1.7, "author_date": -1.4},
    "apa_journal": {"author_date": 4.6, "web_accessed": -3.1},
    "bare_journal": {"author_date": 4.6, "web_accessed": -3.1},
}
STYLE_BOOSTS = {"mla_journal": {"mla9": 2.6}, "chicago_journal": {"chicago-notes-bib": 4.2}, "nlm_journal": {"vancouver": 1.6}, "nlm_comma": {"vancouver": 1.2}, "conference_pages": {"ama": 3.4}, "apa_journal": {"apa7": 1.4}, "bare_journal": {"apa7": 3.4}}
COMMITS = {"apa7": ["apa_journal", "bare_journal"], "vancouver": ["nlm_journal", "nlm_comma"], "ama": ["conference_pages"], "mla9": ["mla_journal"], "chicago-notes-bib": ["chicago_journal"]}


def words_of(words: list[str]) -> str:
    return rf"(?i)(?<!\w)(?:{'|'.join(words)})(?!\w)"


def normalized(text: Column) -> Column:
    """Compatibility forms, straight quotes, single spaces, no accents."""
    c = F.regexp_replace(F.regexp_replace(compatible(text), "[“”„‟«»]", '"'), "[‘’‚‛]", "'")
    return F.trim(F.regexp_replace(fold_marks(F.regexp_replace(c, "(?i)&amp;", "&")), r"\s+", " "))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"[.,;:\s]+$", "")


def without_tail(text: Column) -> Column:
    """Cut at the first DOI or address, if that stands in the last third."""
    at = F.array_min(F.filter(F.array(F.regexp_instr(text, F.lit(f"(?i){DOI}")), F.regexp_instr(text, F.lit(URL))), lambda x: x > 0)) - 1
    return F.when(at >= F.length(text) * TAIL_CUT, trimmed(F.substring(text, F.lit(1), at))).otherwise(text)


def lead_of(cite: Column) -> Column:
    """What stands before the title in quotes, else before the year, else the first sentence."""
    quote, year, stop = F.instr(cite, '"') - 1, F.regexp_instr(cite, F.lit(rf"(?<!\w){YEAR}(?!\w)")) - 1, F.instr(cite, ".")
    head = lambda n: F.trim(F.substring(cite, F.lit(1), n))
    return F.when(quote > 0, F.regexp_replace(head(quote), r"[,\s]+$", "")).when(year > 0, head(year)).when(stop > 1, head(stop)).otherwise(head(F.lit(90)))


def title_of(cite: Column) -> Column:
    # in quotes, else the first sentence after a year in brackets, a year, or the first sentence
    sentence, four = r"\s+([^.;]{4,160})", r"\d{4}[a-z]?"
    heads = [rf"\({four}\)\.?", rf"(?<!\w){four}\.", r"^[^.]+\."]
    found = [let(F.regexp_extract(cite, p, 1), lambda x: F.when(x != "", x)) for p in ('"([^"]{4,})"', *(h + sentence for h in heads))]
    return F.trim(F.coalesce(*found, F.substring(cite, 1, 80)))


def cased(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: w.rlike("^[A-Z][a-z]")))


def share(part: Column, whole: Column) -> Column:
    return part / F.greatest(F.lit(1), whole)


def prepared(df: DataFrame, text_col: str) -> DataFrame:
    """df with _p: the parts of a reference that signals are read from. Each stage is a
    projection of its own, so that no part is worked out twice."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    df = df.withColumn("_norm", normalized(text))
    df = df.withColumn("_cite", F.ltrim(F.regexp_replace("_norm", MARK, "")))
    df = df.withColumn("_plain", trimmed(F.regexp_replace("_cite", r"(?i)\s+(?<!\w)(?:Accessed|Retrieved)(?!\w)[^.]*\.?$", "")))
    df = df.withColumn("_plain", F.trim(F.regexp_replace(F.regexp_replace("_plain", URL, ""), r"\s+", " ")))
    df = df.withColumn("_year", F.regexp_instr("_plain", F.lit(rf"(?<!\w){YEAR}(?!\w)")) - 1)
    df = df.withColumn("_before", F.when(F.col("_year") > 0, F.element_at(F.filter(F.transform(F.split(F.substring("_plain", F.lit(1), F.col("_year")), r"\."), lambda x: F.trim(x)), lambda x: x != ""), -1)))
    return df.select("*", F.struct(
        F.col("_norm").alias("norm"), F.col("_cite").alias("cite"), F.col("_plain").alias("plain"), F.col("_year").alias("year"), without_tail(F.col("_plain")).alias("spine"), without_tail(F.col("_cite")).alias("backbone"), lead_of(F.col("_cite")).alias("lead"),
        F.regexp_extract_all(title_of(F.col("_cite")), F.lit(r"\b[\p{L}\p{N}'-]+\b"), F.lit(0)).alias("title"), F.regexp_extract_all(F.coalesce("_before", F.lit("")), F.lit(r"\b[\p{L}\p{M}.'’-]+\b"), F.lit(0)).alias("container"),
    ).alias("_p")).drop("_norm", "_cite", "_plain", "_year", "_before")


def separator(lead: Column) -> Column:
    return F.when(lead.contains(";"), "semicolon").when(lead.contains("&"), "ampersand").when(lead.rlike(r"(?i)(?<!\w)and(?!\w)"), "and").when(lead.contains(","), "comma").otherwise("none")


def author_count(lead: Column, kind: Column) -> Column:
    pieces = lambda p: F.size(F.filter(F.split(lead, p), lambda x: x != ""))
    return F.when(kind == "semicolon", pieces(";")).when(kind == "ampersand", pieces("&")).when(kind == "and", pieces(r"(?i)(?<!\w)and(?!\w)")).when(kind == "comma", F.greatest(F.lit(1), pieces(",") - 1)).otherwise(1)


def signals(p: Column) -> dict[str, dict[str, Column]]:
    """Each signal by its group, over the parts of prepared()."""
    norm, cite, plain, year, spine, lead, title = (p[c] for c in ("norm", "cite", "plain", "year", "spine", "lead", "title"))
    numbered, n = norm.rlike(r"^(?:\[\d+\]|\d+\.\s+|\d+\)\s+|\(\d+\)\s+)"), F.length(plain)
    near = ~numbered & (year >= 0) & ((year <= 90) | (year <= n * 0.42))
    bracketed = near & plain.rlike(rf'^[^"]{{0,120}}\({YEAR}\)')
    bare = near & plain.rlike(rf'^[^"]{{0,120}},?\s*{YEAR}\.') & ~bracketed
    leading = near & plain.rlike(rf'^[^"]{{0,90}}(?:\({YEAR}\)|,\s*{YEAR}\.)')
    ended = plain.rlike(rf"(?<!\w){YEAR}(?!\w)\.?$")
    signature = cite.rlike(SIGNATURE)
    initials_first, surname_first = lead.rlike(rf"^(?:\p{{Lu}}\.\s*){{1,3}}{NAME}"), lead.rlike(rf"^{NAME}(?:\s+(?:da|de|del|di|la|le|van|von|der))?(?:\s+{NAME})?\s+\p{{Lu}}{{1,3}}\b")
    vague = ~cite.startswith('"') & (F.regexp_count(lead, F.lit(r"\b[\p{L}\p{N}'-]+\b")) >= 2) & ~initials_first & ~surname_first & ~lead.rlike(rf"^(?:[A-Z][\p{{L}}&' -]{{3,}}|[A-Z][\p{{L}}'-]+,\s+[A-Z][\p{{L}}'-]+)")
    et_al, kind = cite.rlike(r"(?i)(?<!\w)et al\.?"), separator(lead)
    many = F.when(et_al, 4).otherwise(author_count(lead, kind))
    years = F.regexp_extract_all(cite, F.lit(rf"(?<!\w)({YEAR[:-6]})(?!\w)"), F.lit(1))
    conference, quoted = cite.rlike(words_of(CONFERENCES)), cite.rlike(QUOTED)
    doi, url = F.regexp_instr(cite, F.lit(f"(?i){DOI}")), F.regexp_instr(cite, F.lit(URL))
    at_end = let(F.when(doi > 0, doi).otherwise(url) - 1, lambda x: (x >= 0) & (x >= F.length(cite) * TAIL_SIGNAL))
    long_words = F.filter(title, lambda w: F.length(w) > 2)
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    dots, commas, long = count(cite, "."), count(cite, ","), F.length(cite) > 60
    short = F.size(F.filter(p["container"], lambda w: (F.length(w) <= 3) | w.endswith(".") | w.rlike("^[A-Z][a-z]{0,12}$")))
    abbreviated = F.size(p["container"]).between(2, 6) & (share(short, F.size(p["container"])) >= 0.75) & F.exists(p["container"], lambda w: F.length(w) <= 4)
    rest = F.slice(title, 2, F.greatest(F.lit(0), F.size(title) - 1))
    first_cased = F.coalesce(F.get(title, F.lit(0)).rlike("^[A-Z][a-z]"), F.lit(False))
    sentence = first_cased & (share(cased(F.slice(long_words, 2, F.greatest(F.lit(0), F.size(long_words) - 1))), F.size(long_words) - 1) <= 0.35)
    titled = (F.size(long_words) >= 2) & (share(cased(long_words), F.size(long_words)) >= 0.6)
    host = F.lower(F.regexp_extract(F.regexp_extract(cite, URL, 0), r"^[^:]+://([^/?#]+)", 1))
    scholarly = plain.rlike(r"(?i)(?<!\w)(?:vol|no|pp?)(?!\w)") | spine.rlike(rf";{NUMBER}{BRACKETED}:")
    return {
        "enumerator": {"bracketed_enumerator": norm.rlike(r"^\[\d+\]"), "numeric_dot_enumerator": norm.rlike(r"^\d+\.\s"), "numeric_paren_enumerator": norm.rlike(r"^\d+\)\s"), "parenthesized_enumerator": norm.rlike(r"^\(\d+\)\s")},
        "author_lead": {"quoted_title_lead": cite.startswith('"'), "author_initials_surname": initials_first, "author_surname_initials": surname_first, "author_lead_ambiguous": vague, "author_year_lead": leading},
        "author_count": {"has_et_al": et_al, "author_bucket_single": many < 2, "author_bucket_few": many.between(2, 3), "author_bucket_many": many >= 4},
        "author_separator": {f"author_separator_{k}": kind == k for k in ("comma", "semicolon", "and", "ampersand")},
        "year": {
            "year_parenthesized_after_authors": bracketed, "year_bare_after_authors": bare, "year_repeated_conference": (F.size(years) >= 2) & ((F.size(F.array_distinct(years)) < F.size(years)) | conference), "year_end_position": ended,
            "ieee_incompatible_author_date_year_placement": ~signature & ~ended & (bare | bracketed | leading), "year_early_position": (year >= 0) & (year <= n * 0.25), "year_late_position": (year >= 0) & (year >= n * 0.75),
        },
        "title": {"quoted_title": quoted, "title_followed_by_period": cite.rlike(rf"{QUOTED}\.|\)\.?\s+[^.]{{4,120}}\."), "title_followed_by_comma": cite.rlike(rf"{QUOTED},|\)\.?\s+[^,]{{4,120}},\s+(?:In(?!\w)|[A-Z])"), "title_sentence_case": sentence, "title_title_case": titled},
        "container": {"cue_in_container": cite.rlike(r"(?<!\w)In(?!\w)"), "cue_conference": conference, "cue_journal": cite.rlike(words_of(JOURNALS)), "cue_journal_abbrev": abbreviated, "cue_book_publisher": cite.rlike(words_of(PUBLISHERS)), "cue_web_access": cite.rlike(words_of(["Accessed", "Retrieved", "Available at"]))},
        "editor_translator": {"marker_editor": cite.rlike(r"(?<!\w)Eds?(?!\w)"), "marker_translator": cite.rlike(r"(?<!\w)Trans(?!\w)")},
        "edition": {"marker_edition": cite.rlike(r"(?i)(?<!\w)(?:\d+(?:st|nd|rd|th)\s+ed\.|Rev\.\s+ed\.|Version\s+\d+)")},
        "locator": {
            "locator_vol": plain.rlike(rf"(?i)(?:^|[;,\s]){VOLUME}"), "locator_no": plain.rlike(rf"(?i)(?:^|[;,\s])no\.?\s*{NUMBER}"), "locator_pp": plain.rlike(rf"(?i)(?:^|[;,\s]){PAGES}"), "locator_ieee_signature": signature,
            "locator_semicolon_volume_issue_pages": spine.rlike(rf";{NUMBER}{BRACKETED}:{PAGE}"), "locator_volume_issue_pages": spine.rlike(rf"(?<![\w?]){NUMBER}{BRACKETED},\s*(?:pp?\.?\s*)?{PAGE}"), "locator_year_comma_volume_colon_pages": spine.rlike(rf"(?<!\w){NEW_YEAR}[a-z]?,\s*{NUMBER}\s*:\s*{PAGE}(?:\s*[–-]\s*\d+)?\.?$"),
            "locator_year_comma_volume_colon_identifier": cite.rlike(rf"(?i)(?<!\w){NEW_YEAR}[a-z]?,\s*{NUMBER}\s*:\s*{BARE_DOI}\.?$"), "locator_page_range_only": spine.rlike(r"(?<!\w)[A-Za-z]?\d{1,5}\s*[–-]\s*\d{1,5}(?!\w)"),
        },
        "identifier": {"identifier_doi": doi > 0, "identifier_url": url > 0, "identifier_accessed_retrieved": cite.rlike(words_of(["Accessed", "Retrieved"])), "identifier_at_end": at_end, "identifier_doi_tail_numeric": (doi > 0) & at_end & cite.rlike(rf"(?<!\w){NEW_YEAR}[a-z]?,\s*{NUMBER}\s*:")},
        "capitalization": {"capitalization_quoted_title_profile": quoted, "capitalization_heavy_titlecase": titled, "capitalization_numeric_minimal": (F.size(title) > 0) & (share(cased(rest), F.size(title) - 1) <= 0.2)},
        "punctuation": {"punctuation_period_dense": long & (dots >= 3), "punctuation_comma_dense": long & (commas >= 4), "punctuation_mixed_cadence": long & (dots >= 2) & (commas >= 2)},
        "web": {"web_url_without_scholarly_locators": (url > 0) & (doi == 0) & ~scholarly, "web_host_like_container": (url > 0) & (host != "") & ~host.endswith("doi.org")},
    }


def codes() -> dict[str, str]:
    """Each signal's group."""
    return {code: group for group, found in signals(F.col("_p")).items() for code in found}


def layouts(p: Column) -> dict[str, Column]:
    """Layouts, of texts without a number before them; the comma layout needs a lead of
    surnames and initials, and its identifier may be its locator."""
    unnumbered = ~p["norm"].rlike(MARK)
    spine = {k: p["spine"].rlike(x) for k, x in LAYOUTS.items()}
    spine["nlm_comma"] = p["backbone"].rlike(LAYOUTS["nlm_comma"]) | p["cite"].rlike(LAYOUTS["nlm_comma"])
    return {k: c if k.startswith(("nlm", "conference", "dated")) else c & unnumbered for k, c in spine.items()}


def style_signals(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with signals (the codes that hold, in the bank's order), signal_groups (how many
    groups speak), _s (a struct of all codes) and _l (of layouts). A null text has the
    signals of an empty one; equal rows give equal rows; an empty table stays empty."""
    df = prepared(df, text_col)
    bank = {c: x for found in signals(F.col("_p")).values() for c, x in found.items()}
    df = df.select("*", F.struct(*(F.coalesce(x, F.lit(False)).alias(c) for c, x in bank.items())).alias("_s"), F.struct(*(F.coalesce(x, F.lit(False)).alias(k) for k, x in layouts(F.col("_p")).items())).alias("_l")).drop("_p")
    groups = {}
    for code, group in codes().items():
        groups.setdefault(group, []).append(F.col("_s")[code])
    spoken = reduce(add, [reduce(or_, found).cast("int") for found in groups.values()])
    return df.select("*", F.array_compact(F.array(*(F.when(F.col("_s")[c], F.lit(c)) for c in bank))).alias("signals"), spoken.alias("signal_groups"))


def weighed(weights: dict[str, float]) -> Column:
    return reduce(add, [F.when(F.col("_s")[c], w).otherwise(0.0) for c, w in weights.items()], F.lit(0.0))


def boosted(boosts: dict[str, dict[str, float]], name: str) -> Column:
    return reduce(add, [F.when(F.col("_l")[k], b[name]).otherwise(0.0) for k, b in boosts.items() if name in b], F.lit(0.0))


def normalized_scores(raw: Column, full: float) -> Column:
    """Structs of name and score, best first: the place between least and most, times how
    near the raw sum comes to a full one. Equal scores stay in the table's order."""
    def scale(x: Column, low: Column, high: Column) -> Column:
        place = F.when(high == low, (x["raw"] > 0).cast("double")).otherwise((x["raw"] - low) / (high - low))
        return F.struct((place * F.greatest(F.lit(0.0), F.least(F.lit(1.0), x["raw"] / full))).alias("score"), (-x["at"]).alias("at"), x["name"].alias("name"))

    scaled = let(F.transform(raw, lambda x: x["raw"]), lambda values: F.transform(raw, lambda x: scale(x, F.array_min(values), F.array_max(values))))
    return F.transform(F.reverse(F.array_sort(scaled)), lambda x: F.struct(x["name"].alias("name"), x["score"].alias("score")))


def raw_scores(names: list[str], value) -> Column:
    return F.array(*(F.struct(F.lit(n).alias("name"), value(n).alias("raw"), F.lit(k).alias("at")) for k, n in enumerate(names)))


def family_sums() -> dict[str, Column]:
    s, v = F.col("_s"), F.col("_l")
    any_of = lambda names: reduce(or_, [s[n] for n in names])
    sums = {f: weighed(w) + boosted(FAMILY_BOOSTS, f) for f, w in FAMILY_WEIGHTS.items()}
    ieee = ~s["ieee_incompatible_author_date_year_placement"] & ~v["mla_journal"] & (s["locator_ieee_signature"] | reduce(and_, [s[x] for x in ("locator_vol", "locator_no", "locator_pp")]) & any_of(["year_end_position", "year_late_position"]))
    listed = ieee & s["locator_ieee_signature"] & any_of(["bracketed_enumerator", "numeric_dot_enumerator", "numeric_paren_enumerator"])
    sums["numeric"] += F.when(ieee, 2.35).otherwise(0.0) + F.when(listed, 1.9).otherwise(0.0)
    sums["notes_bibliography"] -= F.when(listed, 1.1).otherwise(0.0)
    web = s["web_url_without_scholarly_locators"] & ~any_of(["locator_ieee_signature", "locator_semicolon_volume_issue_pages", "locator_year_comma_volume_colon_pages", "locator_year_comma_volume_colon_identifier", "cue_journal_abbrev", "quoted_title"])
    sums["author_date"] -= F.when(web, 1.6).otherwise(0.0)
    sums["web_accessed"] += F.when(web, 2.8).otherwise(0.0)
    return sums


def score_families(df: DataFrame) -> DataFrame:
    """style_signals()' rows with families (name and score, best first) and dampened: where
    signals speak strongly for several families and no layout settles it, the best
    one's sum counts four fifths. _mixed tells numbered references dated as by authors."""
    s, v = F.col("_s"), F.col("_l")
    numbered = reduce(or_, [s[c] for c in ("bracketed_enumerator", "numeric_dot_enumerator", "numeric_paren_enumerator", "parenthesized_enumerator")])
    mixed = numbered & v["dated_journal"] & reduce(and_, [s[c] for c in ("author_separator_comma", "year_early_position", "cue_journal")]) & (s["locator_volume_issue_pages"] | s["locator_page_range_only"]) & ~s["quoted_title"] & ~s["locator_ieee_signature"] & ~s["locator_semicolon_volume_issue_pages"]
    settled = reduce(or_, [v[k] for k in ("mla_journal", "chicago_journal", "nlm_journal")]) | s["locator_ieee_signature"] | (~numbered & (s["year_parenthesized_after_authors"] | s["year_bare_after_authors"]))
    strong = reduce(add, [reduce(or_, [s[c] for c in found]).cast("int") for found in STRONG.values()])
    sums = family_sums()
    df = df.select("*", mixed.alias("_mixed"), (mixed | ~settled & (strong >= 2)).alias("dampened"), raw_scores(list(sums), lambda f: sums[f]).alias("_raw"))
    best = F.array_max(F.transform("_raw", lambda x: F.struct(x["raw"], -x["at"])))
    damped = let(best, lambda b: F.transform("_raw", lambda x: F.struct(x["name"].alias("name"), F.when(F.col("dampened") & (-x["at"] == b["col2"]), x["raw"] * DAMPED).otherwise(x["raw"]).alias("raw"), x["at"].alias("at"))))
    return df.withColumn("_raw", damped).withColumn("families", normalized_scores(F.col("_raw"), FAMILY_FULL)).drop("_raw")


def style_sums() -> dict[str, Column]:
    sums = {x: weighed(w) + boosted(STYLE_BOOSTS, x) for x, w in STYLE_WEIGHTS.items()}
    sums["chicago-author-date"] -= F.when(F.col("_s")["year_parenthesized_after_authors"], 0.8).otherwise(0.0)
    return sums


def may_commit(style: Column) -> Column:
    """Whether a style's own marks are there, besides a high score."""
    s, v = F.col("_s"), F.col("_l")
    own = {x: reduce(or_, [v[k] for k in found]) for x, found in COMMITS.items()}
    own["ieee"] = s["locator_ieee_signature"] | s["quoted_title"] & s["locator_vol"] & s["locator_pp"] & s["year_end_position"] & ~s["ieee_incompatible_author_date_year_placement"]
    own["harvard-ctr"] = s["year_bare_after_authors"] & s["cue_web_access"]
    own["chicago-author-date"] = s["year_bare_after_authors"] & s["title_title_case"] & s["cue_book_publisher"]
    own["acs"] = s["author_separator_semicolon"] & s["author_surname_initials"]
    own["mla9"] = own["mla9"] | s["quoted_title"] & s["year_late_position"] & s["cue_book_publisher"]
    return reduce(lambda rest, kv: F.when(style == kv[0], kv[1]).otherwise(rest), own.items(), F.lit(False))


def capped(score: Column, margin: Column, groups: Column) -> Column:
    """The confidence of a family that isn't committed to: below the threshold, and less
    for a small margin or few groups."""
    return F.greatest(F.lit(0.0), F.least(score, F.lit(FAMILY_COMMIT - 0.01), F.least(F.lit(1.0), margin / FAMILY_MARGIN), F.least(F.lit(1.0), groups / GROUPS)))


def detect_styles(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with signals, signal_groups, families, styles (of the family, best first),
    family, family_confidence, family_margin, style, style_confidence, style_margin, tier
    and dampened. A family is committed to by score, margin and groups of signals, a
    style by its own marks besides; else both are unknown. Rows stay as they are
    otherwise: nulls as in style_signals()."""
    df = score_families(style_signals(df, text_col))
    score = lambda c, k: F.coalesce(F.get(c, F.lit(k))["score"], F.lit(0.0))
    margin = lambda c: F.greatest(F.lit(0.0), score(c, 0) - score(c, 1))
    top = F.get("families", F.lit(0))
    sure = (top["score"] >= FAMILY_COMMIT) & (margin(F.col("families")) >= FAMILY_MARGIN) & (F.col("signal_groups") >= GROUPS) & ~F.col("_mixed")
    df = df.select("*", F.when(sure, top["name"]).otherwise("unknown").alias("family"), margin(F.col("families")).alias("family_margin"))
    df = df.withColumn("family_confidence", F.when(F.col("family") != "unknown", top["score"]).otherwise(capped(top["score"], F.col("family_margin"), F.col("signal_groups"))))
    sums, none = style_sums(), F.array().cast("array<struct<name:string,raw:double,at:int>>")
    scored = reduce(lambda rest, kv: F.when(F.col("family") == kv[0], raw_scores(kv[1], lambda x: sums[x])).otherwise(rest), [(f, x) for f, x in STYLES.items() if x], none)
    df = df.withColumn("_raw", scored).withColumn("styles", normalized_scores(F.col("_raw"), STYLE_FULL)).drop("_raw")
    best = F.get("styles", F.lit(0))
    df = df.select("*", best["name"].alias("_style"), score(F.col("styles"), 0).alias("_score"), margin(F.col("styles")).alias("_margin"))
    strict = (F.col("family_confidence") >= COMMIT_FAMILY) & (F.col("_score") >= COMMIT_STYLE) & (F.col("_margin") >= STYLE_MARGIN)
    commit = F.coalesce(may_commit(F.col("_style")) & strict, F.lit(False))
    df = df.select("*", F.when(commit, F.col("_style")).otherwise("unknown").alias("style"), F.when(commit, F.col("_score")).otherwise(0.0).alias("style_confidence"), F.when(commit, F.col("_margin")).otherwise(0.0).alias("style_margin"))
    return df.withColumn("tier", tier(F.col("family_confidence"), F.col("style_margin"), F.col("style"))).drop("_style", "_score", "_margin", "_s", "_l", "_mixed")
