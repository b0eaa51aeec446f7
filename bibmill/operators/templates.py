"""Citations by style and type from a table of templates, and what became of each field.

A plan is a list of segments. In a segment {field} stands for a value and <...> for a
part that is left out where a value in it is missing; a segment whose other values are
missing gives way to the next one after |, or is left out. Plans are compiled into
column expressions that return the text and the fields that went into it.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers, validation
from ..functions.bind import let
from ..functions.text import cases
from .render import joined, parsed
from .schemas import SCHEMAS

# The segments of each style, by type; * is any other type.
ARTICLE, BOOK, CHAPTER, THESIS, PAPER, WEB, REPORT, PATENT, DATA, PREPRINT = "article-journal", "book", "book-chapter", "thesis", "conference-paper", "webpage", "report", "patent", "dataset", "preprint"
PLANS = {
    "apa7": {
        "*": ["{authors} ({year}).", "{title}.", "{link}"],
        ARTICLE: ["{authors} ({year}).", "{title}.", "*{journal}*<, *{volume}*<({issue})>><, {pages}>.", "{link}"],
        BOOK: ["{authors} ({year}).", "*{title}*< ({edition})>.", "{publisher}.", "{link}"],
        CHAPTER: ["{authors} ({year}).", "{title}.", "In <{editors}, >*{book_title}* ({edition}, pp. {pages}).|In <{editors}, >*{book_title}* (pp. {pages}).|In <{editors}, >*{book_title}*< ({edition})>.", "{publisher}.", "{link}"],
        THESIS: ["{authors} ({year}).", "*{title}* [{thesis_type}<, {institution}>].|*{title}* [{institution}].|*{title}*.", "{repository}.", "{link}"],
        PAPER: ["{authors} ({year}).", "{title}.", "In *{conference_title}*< (pp. {pages})>.", "{publisher}.", "{link}"],
        WEB: ["{authors} ({year}).", "{title}.", "{site_name}.", "Retrieved {accessed_date}, from {url}|{link}"],
        REPORT: ["{authors} ({year}).", "*{title}*< ({report_number})>.", "{owner}.", "{link}"],
        PATENT: ["{authors} ({year}).", "{title}.", "{institution}.", "{patent}.", "{link}"],
        DATA: ["{authors} ({year}).", "*{title}*.", "{repository}.", "{link}"],
        PREPRINT: ["{authors} ({year}).", "*{title}*.", "{repository}.", "{link}"],
    },
    "mla9": {
        "*": ["{authors}.", "*{title}*.", "{publisher},", "{edition},", "{year},", "pp. {pages}.", "{link}"],
        ARTICLE: ["{authors}.", '"{title}."', "*{journal}*,", "{edition},", "vol. {volume}<, no. {issue}>,|no. {issue},", "{year},", "pp. {pages}.", "{link}"],
        CHAPTER: ["{authors}.", '"{title}."', "*{book_title}*,", "edited by {editors},", "{publisher},", "{edition},", "{year},", "{link}"],
        PAPER: ["{authors}.", '"{title}."', "*{conference_title}*,", "{publisher},", "{edition},", "{year},", "pp. {pages}.", "{link}"],
        THESIS: ["{authors}.", "*{title}*.", "{publisher},", "{year},", "pp. {pages}.", "{thesis_type}.", "{institution},", "{link}"],
        WEB: ["{authors}.", "*{title}*.", "*{site_name}*,", "{publisher},", "{year},", "{link}", "Accessed {accessed_date}."],
        REPORT: ["{authors}.", "*{title}*.", "{owner},", "{year},", "pp. {pages}.", "{report_number},", "{link}"],
        PATENT: ["{authors}.", "*{title}*.", "{institution},", "{patent},", "{publisher},", "{year},", "{link}"],
        DATA: ["{authors}.", "*{title}*.", "{publisher},", "{year},", "{repository},", "{link}"],
        PREPRINT: ["{authors}.", "*{title}*.", "{publisher},", "{year},", "{repository},", "{link}"],
    },
    "chicago-author-date": {
        "*": ["{authors}. {year}.", "*{title}*.", "{edition}.", "{link}"],
        ARTICLE: ["{authors}. {year}.", '"{title}."', "*{journal}*< {volume}<, no. {issue}>><: {pages}>.", "{edition}.", "{link}"],
        BOOK: ["{authors}. {year}.", "*{title}*.", "{edition}.", "<{place}: >{publisher}.", "{link}"],
        CHAPTER: ["{authors}. {year}.", '"{title}."', "In *{book_title}*<, edited by {editors}>.", "{edition}.", "<{place}: >{publisher}.", "{link}"],
        THESIS: ["{authors}. {year}.", "*{title}*.", "{thesis_type},", "{institution}.", "{link}"],
        PAPER: ["{authors}. {year}.", '"{title}."', "In *{conference_title}*.", "{link}"],
        WEB: ["{authors}. {year}.", "*{title}*.", "{site_name}.", "Accessed {accessed_date}.", "{link}"],
        REPORT: ["{authors}. {year}.", "*{title}*.", "{owner}.", "{report_number}.", "{link}"],
        PATENT: ["{authors}. {year}.", "*{title}*.", "{institution}.", "{patent}.", "{link}"],
        DATA: ["{authors}. {year}.", "*{title}*.", "{repository}.", "{link}"],
        PREPRINT: ["{authors}. {year}.", "*{title}*.", "{repository}.", "{link}"],
    },
    "vancouver": {
        "*": ["{authors}.", "{title}.", "{edition}.", "{year}.", "{link}"],
        ARTICLE: ["{authors}.", "{title}.", "{journal}.", "{year};{volume}<({issue})><:{pages}>.|{year};({issue})<:{pages}>.|{year};:{pages}.|{year}.", "{link}"],
        BOOK: ["{authors}.", "{title}.", "<{place}: >{publisher};", "{edition}.", "{year}.", "{link}"],
        CHAPTER: ["{authors}.", "{title}.", "In: {editors}, editors. {book_title}.|In: {book_title}.", "<{place}: >{publisher};", "{edition}.", "{year};:{pages}.|{year}.", "{link}"],
        THESIS: ["{authors}.", "{title}.", "[{thesis_type}].", "{institution};", "{year}.", "{link}"],
        PAPER: ["{authors}.", "{title}.", "In: {conference_title}.", "{year};:{pages}.|{year}.", "{link}"],
        WEB: ["{authors}.", "{title}.", "{year}.", "{site_name}.", "[cited {accessed_date}].", "{link}"],
        REPORT: ["{authors}.", "{title}.", "{owner};", "{year}.", "Report No.: {report_number}.", "{link}"],
        PATENT: ["{authors}.", "{title}.", "{institution}.", "{patent}.", "{year}.", "{link}"],
        DATA: ["{authors}.", "{title}.", "{year}.", "{repository}.", "{link}"],
        PREPRINT: ["{authors}.", "{title}.", "{year}.", "{repository}.", "{link}"],
    },
    "ieee": {
        "*": ["{authors},", '"{title},"', "{year}.", "{link}"],
        ARTICLE: ["{authors},", '"{title},"', "*{journal}*,", "vol. {volume},", "no. {issue},", "pp. {pages},", "{year}.", "{link}"],
        BOOK: ["{authors},", '"{title},"', "{edition},", "<{place}: >{publisher},", "{year}.", "{link}"],
        CHAPTER: ["{authors},", '"{title},"', "in *{book_title}*,", "edited by {editors},", "pp. {pages},", "{year}.", "{link}"],
        THESIS: ["{authors},", '"{title},"', "{thesis_type},", "{institution},", "{year}.", "{link}"],
        PAPER: ["{authors},", '"{title},"', "in *{conference_title}*,", "pp. {pages},", "{year}.", "{link}"],
        WEB: ["{authors},", '"{title},"', "{site_name},", "{year}.", "{link}", "Accessed: {accessed_date}."],
        REPORT: ["{authors},", '"{title},"', "{owner},", "Report {report_number},", "{year}.", "{link}"],
        PATENT: ["{authors},", '"{title},"', "{institution},", "{patent},", "{year}.", "{link}"],
        DATA: ["{authors},", '"{title},"', "{repository},", "{year}.", "{link}"],
        PREPRINT: ["{authors},", '"{title},"', "{repository},", "{year}.", "{link}"],
    },
    "harvard": {
        "*": ["{authors} ({year})", "'{title}',", "Available at: {link}."],
        ARTICLE: ["{authors} ({year})", "'{title}',", "*{journal}*,", "vol. {volume},", "no. {issue},", "pp. {pages}.", "Available at: {link}."],
        BOOK: ["{authors} ({year})", "'{title}',", "{edition},", "<{place}: >{publisher}.", "Available at: {link}."],
        CHAPTER: ["{authors} ({year})", "'{title}',", "in {editors} (eds.),", "*{book_title}*,", "{place}: {publisher},", "pp. {pages}.", "Available at: {link}."],
        THESIS: ["{authors} ({year})", "'{title}',", "{thesis_type},", "{institution}.", "Available at: {link}."],
        PAPER: ["{authors} ({year})", "'{title}',", "in *{conference_title}*,", "pp. {pages}.", "Available at: {link}."],
        WEB: ["{authors} ({year})", "'{title}',", "{site_name}.", "Available at: {link}.", "Accessed {accessed_date}."],
        REPORT: ["{authors} ({year})", "'{title}',", "{owner}.", "{report_number}.", "Available at: {link}."],
        PATENT: ["{authors} ({year})", "'{title}',", "{institution}.", "{patent}.", "Available at: {link}."],
        DATA: ["{authors} ({year})", "'{title}',", "{repository}.", "Available at: {link}."],
        PREPRINT: ["{authors} ({year})", "'{title}',", "{repository}.", "Available at: {link}."],
    },
    "ama": {
        "*": ["{authors}.", "{title}.", "{year}.", "{link}"],
        ARTICLE: ["{authors}.", "{title}.", "*{journal}*.", "{year}<;{volume}><({issue})><:{pages}>.", "{link}"],
        BOOK: ["{authors}.", "*{title}*.", "<{place}: >{publisher};", "{year}.", "{link}"],
        CHAPTER: ["{authors}.", "{title}.", "In: {editors}, eds. *{book_title}*.|In: *{book_title}*.", "<{place}: >{publisher};", "{year}.", "{link}"],
        THESIS: ["{authors}.", "*{title}*.", "[{thesis_type}].", "{institution};", "{year}.", "{link}"],
        PAPER: ["{authors}.", "{title}.", "In: *{conference_title}*.", "{year}.", "{link}"],
        WEB: ["{authors}.", "{title}.", "{site_name}.", "{year}.", "Accessed {accessed_date}.", "{link}"],
        REPORT: ["{authors}.", "{title}.", "{owner};", "Report No.: {report_number}.", "{year}.", "{link}"],
        PATENT: ["{authors}.", "{title}.", "{institution}.", "{patent}.", "{year}.", "{link}"],
        DATA: ["{authors}.", "*{title}*.", "{repository}.", "{year}.", "{link}"],
        PREPRINT: ["{authors}.", "*{title}*.", "{repository}.", "{year}.", "{link}"],
    },
    "acs": {
        "*": ["{authors}.", "{title}.", "{year}.", "{link}"],
        ARTICLE: ["{authors}.", "{title}.", "*{journal}*", "{year}, *{volume}*< ({issue})><, {pages}>.|{year}, ({issue})<, {pages}>.|{year}<, {pages}>.", "{link}"],
        BOOK: ["{authors}.", "*{title}*.", "{edition};", "{publisher}<: {place}>, {year}.|{year}.", "{link}"],
        CHAPTER: ["{authors}.", "{title}.", "In *{book_title}*;", "{editors}, Eds.;", "{publisher}<: {place}>, {year}.|{year}.", "{link}"],
        THESIS: ["{authors}.", "*{title}*.", "{thesis_type},", "{institution},", "{year}.", "{link}"],
        PAPER: ["{authors}.", "{title}.", "In *{conference_title}*;", "{year}.", "{link}"],
        WEB: ["{authors}.", "{title}.", "{site_name}.", "{year}.", "{link}"],
        REPORT: ["{authors}.", "{title}.", "{owner};", "{report_number};", "{year}.", "{link}"],
        PATENT: ["{authors}.", "{title}.", "{institution}.", "{patent},", "{year}.", "{link}"],
        DATA: ["{authors}.", "*{title}*.", "{repository},", "{year}.", "{link}"],
        PREPRINT: ["{authors}.", "*{title}*.", "{repository},", "{year}.", "{link}"],
    },
    "chicago-notes-bib": {
        "*": ["{authors}.", "*{title}*.", "{edition}.", "{year}.", "{link}"],
        ARTICLE: ["{authors}.", '"{title}."', "*{journal}*< {volume}><, no. {issue}> ({year})<: {pages}>.", "{link}"],
        BOOK: ["{authors}.", "*{title}*.", "{edition}.", "<{place}: >{publisher}, {year}.|{year}.", "{link}"],
        CHAPTER: ["{authors}.", '"{title}."', "In *{book_title}*<, edited by {editors}><, {pages}>.", "<{place}: >{publisher}, {year}.|{year}.", "{link}"],
        THESIS: ["{authors}.", '"{title}."', "{thesis_type}<, {institution}>, {year}.|{institution}, {year}.|{year}.", "{link}"],
        PAPER: ["{authors}.", '"{title}."', "In *{conference_title}*<, {pages}>.", "{year}.", "{link}"],
        WEB: ["{authors}.", '"{title}."', "{site_name}.", "{year}.", "Accessed {accessed_date}.", "{link}"],
        REPORT: ["{authors}.", "*{title}*.", "{report_number}.", "{owner}, {year}.|{year}.", "{link}"],
        PATENT: ["{authors}.", "{title}.", "{institution}.", "{patent}.", "{year}.", "{link}"],
        DATA: ["{authors}.", "*{title}*.", "{repository}.", "{year}.", "{link}"],
        PREPRINT: ["{authors}.", '"{title}."', "{repository}.", "{year}.", "{link}"],
    },
}
TITLED = ["mla9", "chicago-author-date", "chicago-notes-bib", "acs"]
NAMES = {"bookTitle": "book_title", "conferenceTitle": "conference_title", "placeOfPublication": "place", "thesisType": "thesis_type", "reportNumber": "report_number", "accessedDate": "accessed_date", "siteName": "site_name", "articleNumber": "article_number"}
RANKS = ["ready", "needs_review", "needs_action"]
# End of the fixed values.

FIELDS = ["authors", "title", "year", "journal", "volume", "issue", "pages", "edition", "editors", "book_title", "conference_title", "publisher", "place", "institution", "site_name", "repository", "thesis_type", "report_number", "patent", "accessed_date", "doi", "url"]
#: Which fields stand behind a part that is put together.
BEHIND = {"owner": ["publisher", "institution", "place"], "link": ["doi", "url"]}


def part(text: str, values: dict[str, Column]) -> tuple[Column, list[str]]:
    """A template's expression, null where a value outside <...> is missing, and those values' names."""
    pieces, needed, at = [], [], 0
    while at < len(text):
        if text[at] == "<":
            depth, end = 1, at + 1
            while depth:
                depth += {"<": 1, ">": -1}.get(text[end], 0)
                end += 1
            inner, _ = part(text[at + 1: end - 1], values)
            pieces.append(F.coalesce(inner, F.lit("")))
        elif text[at] == "{":
            end = text.index("}", at) + 1
            needed.append(text[at + 1: end - 1])
            pieces.append(values[needed[-1]])
        else:
            end = min((k for k in (text.find("<", at), text.find("{", at)) if k >= 0), default=len(text))
            pieces.append(F.lit(text[at:end]))
        at = end
    return F.concat(*pieces), needed


def used(text: str, values: dict[str, Column]) -> Column:
    """The fields that a template puts in, those of <...> parts only where the part stands."""
    outer, inner = re.sub(r"<(?:[^<>]|<[^<>]*>)*>", "", text), []
    rest = text
    for found in _optional(rest):
        whole, names = part(found, values)
        inner.append(F.when(whole.isNotNull(), used(found, values)).otherwise(F.array().cast("array<string>")))
    own = [F.when(values[n].isNotNull(), F.lit(n)) for n in re.findall(r"\{(\w+)\}", outer)]
    return F.concat(F.array_compact(F.array(*own)) if own else F.array().cast("array<string>"), *inner)


def _optional(text: str) -> list[str]:
    """The insides of the outermost <...> parts."""
    out, depth, at = [], 0, 0
    for k, c in enumerate(text):
        if c == "<":
            depth += 1
            at = k + 1 if depth == 1 else at
        elif c == ">":
            depth -= 1
            if not depth:
                out.append(text[at:k])
    return out


def segment(text: str, values: dict[str, Column]) -> Column:
    """text and fields of the first alternative whose values are there; null where none is."""
    tries = [(part(t, values)[0], used(t, values)) for t in text.split("|")]
    return reduce(lambda rest, x: F.when(x[0].isNotNull(), F.struct(x[0].alias("text"), x[1].alias("fields"))).otherwise(rest), reversed(tries), F.lit(None).cast("struct<text:string,fields:array<string>>"))


def shared_values(fields: dict[str, Column]) -> dict[str, Column]:
    """What the values of every style are made of. authors and editors are lists of structs."""
    text = lambda k: F.nullif(F.trim(F.regexp_replace(fields[k].cast("string"), r"\s+", " ")), F.lit("")) if k in fields else F.lit(None).cast("string")
    out = {k: text(k) for k in FIELDS if k not in ("authors", "editors")}
    out |= {k: parsed(fields[k]) for k in ("authors", "editors") if k in fields}
    out["year"] = F.coalesce(out["year"], F.lit("n.d."))
    out["title"] = cases(out["title"])
    out["pages"] = F.replace(out["pages"], F.lit("-"), F.lit("–"))
    same = F.lower(out["publisher"]) == F.lower(out["institution"])
    named = F.coalesce(F.when(out["publisher"].isNotNull() & out["institution"].isNotNull() & ~F.coalesce(same, F.lit(False)), F.concat_ws("; ", out["publisher"], out["institution"])), out["publisher"], out["institution"])
    out["owner"] = F.when(named.isNotNull(), F.concat(F.coalesce(F.concat(out["place"], F.lit(": ")), F.lit("")), named))
    out["link"] = F.coalesce(F.concat(F.lit("https://doi.org/"), identifiers.doi(out["doi"])), F.when(~out["url"].rlike(r"(?i)^https?://(?:dx\.)?doi\.org/"), out["url"]))
    return out


def values_of(style: str, shared: dict[str, Column]) -> dict[str, Column]:
    """What stands for each name in a style's templates."""
    out = dict(shared)
    out["authors"] = joined(style, shared["authors"]) if "authors" in shared else F.lit("Unknown author")
    out["authors"] = F.regexp_replace(out["authors"], r"\.$", "") if style not in ("apa7", "ieee", "harvard") else out["authors"]
    out["editors"] = F.when(F.size(shared["editors"]) > 0, joined(style, shared["editors"])) if "editors" in shared else F.lit(None).cast("string")
    out["title"] = F.regexp_replace(F.coalesce(shared["title"]["title" if style in TITLED else "sentence"], F.lit("Untitled reference")), r"[.\s]+$", "")
    return out


def with_shared(fields: dict[str, Column], names: set[str], use) -> Column:
    """use() of the shared values of names, each worked out once."""
    made = {k: c for k, c in shared_values(fields).items() if k in names}
    return let(F.struct(*(c.alias(k) for k, c in made.items())), lambda v: use({k: v[k] for k in made}))


def render(style: str, kind: Column | str, fields: dict[str, Column]) -> Column:
    """text and rendered (fields, in order of their places) of a style's plan for the type;
    a type without a plan of its own has the general one. A missing title and year have
    words for them; a null or empty author list is an unknown author."""
    plans = PLANS[style]

    def told(plan: list[str], values: dict[str, Column]) -> Column:
        return F.array_compact(F.array(*(segment(s, values) for s in plan)))

    def chosen(v: Column) -> Column:
        values = {k: v[k] for k in (*FIELDS, *BEHIND)}
        if isinstance(kind, str):
            return told(plans.get(kind, plans["*"]), values)
        return reduce(lambda rest, k: F.when(kind == k, told(plans[k], values)).otherwise(rest), [k for k in plans if k != "*"], told(plans["*"], values))

    found = with_shared(fields, {*FIELDS, *BEHIND}, lambda shared: let(F.struct(*(c.alias(k) for k, c in values_of(style, shared).items())), chosen))
    return let(found, lambda x: F.struct(F.array_join(F.transform(x, lambda s: s["text"]), " ").alias("text"), F.array_distinct(F.flatten(F.transform(x, lambda s: s["fields"]))).alias("rendered")))


def render_texts(styles: list[str], kind: str, fields: dict[str, Column]) -> Column:
    """render()'s texts alone, for one type, as a struct by style: nothing is told about
    fields, and what styles share is worked out once for all of them."""
    plans = {s: PLANS[s].get(kind, PLANS[s]["*"]) for s in styles}
    names = {s: {n for t in plan for n in re.findall(r"\{(\w+)\}", t)} for s, plan in plans.items()}

    def written(style: str, shared: dict[str, Column]) -> Column:
        def told(v: Column) -> Column:
            values = {n: v[n] for n in names[style]}
            return F.concat_ws(" ", *(F.coalesce(*(part(t, values)[0] for t in s.split("|"))) for s in plans[style]))

        values = values_of(style, shared)
        return let(F.struct(*(c.alias(k) for k, c in values.items() if k in names[style])), told)

    return with_shared(fields, set().union(*names.values()), lambda shared: F.struct(*(written(s, shared).alias(s) for s in styles)))


def render_text(style: str, kind: str, fields: dict[str, Column]) -> Column:
    return render_texts([style], kind, fields)[style]


def checks(fields: dict[str, Column], as_of_year: int) -> dict[str, Column]:
    """Why a value can't be shown, by field; null where it can."""
    bad = lambda ok, why: F.when(~ok, why)
    c = fields
    told = {"year": lambda: bad(validation.valid_year(c["year"].cast("int"), as_of_year), "invalid year"), "doi": lambda: bad(identifiers.doi(c["doi"]).isNotNull(), "invalid DOI"), "url": lambda: bad(validation.valid_url(c["url"]), "invalid URL format"), "pages": lambda: bad(validation.valid_pages(F.regexp_replace(c["pages"], "\\s*[\u2012-\u2015-]+\\s*", "-")), "invalid pages"), "authors": lambda: bad(validation.valid_authors(c["authors"]), "invalid authors")}
    return {k: told[k]() if k in told else bad(~validation.only_placeholders(c[k].cast("string")), "placeholder value") if k != "editors" else F.lit(None).cast("string") for k in c}


def audited(style: str, kind: Column, fields: dict[str, Column], as_of_year: int = 2100) -> Column:
    """text, rendered, available (valid fields that the type's schema asks for), lost (available
    but not rendered), suppressed (key and reason of values that can't be shown). Only
    valid values are rendered."""
    there = {k: (F.size(c) > 0) if k in ("authors", "editors") else F.coalesce(F.trim(c.cast("string")) != "", F.lit(False)) for k, c in fields.items()}
    reasons = checks(fields, as_of_year)
    shown = {k: F.when(F.coalesce(there[k], F.lit(False)) & reasons[k].isNull(), c) for k, c in fields.items()}
    asked = lambda s: {NAMES.get(f, f) for f in (*s.mandatory, *s.preferred, *(f for _, group, _ in s.groups for f in group))}
    of = lambda s: F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(shown[k].isNotNull(), F.lit(k)) for k in fields if k in asked(s))))
    available = reduce(lambda rest, k: F.when(kind == k, of(SCHEMAS[k])).otherwise(rest), [k for k in SCHEMAS if k != "unknown"], of(SCHEMAS["unknown"]))
    suppressed = F.array_compact(F.array(F.lit(None).cast("struct<key:string,reason:string>"), *(F.when(F.coalesce(there[k], F.lit(False)) & reasons[k].isNotNull(), F.struct(F.lit(k).alias("key"), reasons[k].alias("reason"))) for k in fields)))

    def told(r: Column) -> Column:
        behind = F.flatten(F.transform(r["rendered"], lambda n: F.when(n == "owner", F.array(*map(F.lit, BEHIND["owner"]))).when(n == "link", F.array(*map(F.lit, BEHIND["link"]))).otherwise(F.array(n))))
        full = F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(shown[k].isNotNull() & F.array_contains(behind, k), F.lit(k)) for k in fields)))
        return F.struct(r["text"].alias("text"), full.alias("rendered"), available.alias("available"), F.array_except(available, full).alias("lost"), suppressed.alias("suppressed"))

    return let(render(style, kind, shown), told)


def demoted(status: Column, severities: Column) -> Column:
    """A warning of severity action makes needs_action, one of review takes ready away."""
    return F.when(F.array_contains(severities, "action"), "needs_action").when(F.array_contains(severities, "review") & (status == "ready"), "needs_review").otherwise(status)


def unique_warnings(warnings: Column) -> Column:
    """Structs of code and severity: of each code the gravest, in order of first appearance."""
    grave = lambda w: F.when(w["severity"] == "action", 2).when(w["severity"] == "review", 1).otherwise(0)
    first = F.filter(warnings, lambda w, i: ~F.exists(F.slice(warnings, F.lit(1), i), lambda x: x["code"] == w["code"]))

    def worst(w: Column) -> Column:
        top = F.array_max(F.transform(F.filter(warnings, lambda x: x["code"] == w["code"]), grave))
        return F.struct(w["code"].alias("code"), F.when(top == 2, "action").when(top == 1, "review").otherwise("info").alias("severity"))

    return F.transform(first, worst)


def csl_item(kind: Column, fields: dict[str, Column]) -> Column:
    """The record as a CSL item in JSON; missing values are left out."""
    types = {"conference-paper": "paper-conference", "book-chapter": "chapter", "preprint": "article", "unknown": "document"}
    name = reduce(lambda rest, kv: F.when(kind == kv[0], kv[1]).otherwise(rest), types.items(), kind)
    text = lambda *ks: F.coalesce(*(F.nullif(F.trim(fields[k].cast("string")), F.lit("")) for k in ks if k in fields), F.lit(None).cast("string"))
    people = lambda k: F.when(F.size(fields[k]) > 0, F.transform(fields[k], lambda p: F.struct(p["family"].alias("family"), p["given"].alias("given")))) if k in fields else F.lit(None).cast("array<struct<family:string,given:string>>")
    year = text("year").cast("int")
    issued = F.when(year.isNotNull(), F.struct(F.array(F.array(year)).alias("date-parts")))
    return F.to_json(F.struct(
        name.alias("type"), text("title").alias("title"), people("authors").alias("author"), people("editors").alias("editor"), issued.alias("issued"), text("journal", "book_title", "conference_title", "site_name").alias("container-title"), text("volume").alias("volume"), text("issue").alias("issue"), text("pages").alias("page"), text("publisher", "institution", "repository").alias("publisher"),
        text("place").alias("publisher-place"), text("edition").alias("edition"), text("report_number", "patent").alias("number"), text("thesis_type").alias("genre"), identifiers.doi(text("doi")).alias("DOI"), text("url").alias("URL"),
    ))
