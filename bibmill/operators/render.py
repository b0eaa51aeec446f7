"""Citation strings by style. Authors are an array of struct<family, given>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.text import from_letters, initial_letters, sentence_case, title_case

STYLES = ["apa7", "mla9", "chicago-author-date", "chicago-notes-bib", "vancouver", "ama", "ieee", "harvard", "acs"]
#: Each style's name forms (first, others), what joins two, all but the last, and the last of more;
#: the number of authors from which the list is cut, how many stay, and what follows them.
LISTS = {
    "apa7": ("inverted initials", "inverted initials", " & ", ", ", ", & ", 21, 19, ", … "),
    "mla9": ("inverted", "direct", ", and ", ", ", ", and ", 3, 1, ", et al."),
    "chicago-author-date": ("inverted", "direct", ", and ", ", ", ", and ", 4, 1, " et al."),
    "chicago-notes-bib": ("direct", "direct", ", and ", ", ", ", and ", 4, 1, " et al."),
    "vancouver": ("bare initials", "bare initials", ", ", ", ", ", ", 7, 6, ", et al."),
    "ama": ("bare initials", "bare initials", ", ", ", ", ", ", 7, 6, ", et al"),
    "ieee": ("initials first", "initials first", " and ", ", ", ", and ", None, None, None),
    "harvard": ("inverted initials", "inverted initials", " and ", ", ", ", and ", 3, 1, ", et al."),
    "acs": ("inverted initials", "inverted initials", "; ", "; ", "; ", None, None, None),
}


def parsed(people: Column) -> Column:
    """Structs of family, given (null where blank) and the letters of the given names; each
    given name is read once here, however many styles show it."""
    one = lambda p: F.struct(p["family"].alias("family"), F.nullif(F.trim(p["given"]), F.lit("")).alias("given"), initial_letters(p["given"]).alias("letters"))
    return F.transform(F.coalesce(people, F.array().cast("array<struct<family:string,given:string>>")), one)


def _name(form: str, p: Column) -> Column:
    if form == "inverted":
        return F.concat_ws(", ", p["family"], p["given"])
    if form == "direct":
        return F.concat_ws(" ", p["given"], p["family"])
    short = from_letters(p["letters"], form != "bare initials")
    if form == "initials first":
        return F.concat_ws(" ", short, p["family"])
    return F.concat_ws(" " if form == "bare initials" else ", ", p["family"], short)


def joined(style: str, people: Column) -> Column:
    """parsed() people in a style. Of a list that is cut only the names that stay are made."""
    first, rest, pair, between, last, cut, keep, tail = LISTS[style]
    n = F.size(people)
    shown = F.slice(people, F.lit(1), F.when(n >= cut, F.lit(keep)).otherwise(n)) if cut else people
    made = F.transform(shown, lambda p: _name(rest, p)) if first == rest else F.transform(shown, lambda p, i: F.when(i == 0, _name(first, p)).otherwise(_name(rest, p)))

    def told(names: Column) -> Column:
        end = F.element_at(names, -1)
        out = F.when(n == 0, "Unknown author").when(n == 1, F.get(names, F.lit(0))).when(n == 2, F.concat(F.get(names, F.lit(0)), F.lit(pair), end))
        if cut:
            out = out.when(n >= cut, F.concat(F.array_join(names, between), F.lit(tail), _name(rest, F.element_at(people, -1)) if style == "apa7" else F.lit("")))
        return out.otherwise(F.concat(F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(1))), between), F.lit(last), end))

    return let(made, told)


def authors(style: str, people: Column) -> Column:
    """The author list of a style; a null or empty list is an unknown author."""
    return let(parsed(people), lambda x: joined(style, x))


def authors_by_style(people: Column) -> Column:
    """authors() of every style, as a struct; the names are read once for all of them."""
    return let(parsed(people), lambda x: F.struct(*(joined(s, x).alias(s) for s in STYLES)))


def _stopped(c: Column) -> Column:
    """Ends in one full stop."""
    return F.when(c.endswith("."), c).otherwise(F.concat(c, F.lit(".")))


def citation(style: str, people: Column, title: Column, year: Column, container: Column, doi: Column) -> Column:
    who, when = authors(style, people), F.coalesce(year.cast("string"), F.lit("n.d."))
    link = F.when(doi.isNotNull(), F.concat(F.lit("https://doi.org/"), doi))
    if style == "apa7":
        return F.concat_ws(" ", who, F.concat(F.lit("("), when, F.lit(").")), F.concat(sentence_case(title), F.lit(".")), F.concat(container, F.lit(".")), link)
    if style == "mla9":
        return F.concat_ws(" ", _stopped(who), F.concat(F.lit('"'), title_case(title), F.lit('."')), F.concat(F.concat_ws(", ", container, when), F.lit(".")), link)
    if style in ("vancouver", "ama"):
        return F.concat_ws(" ", _stopped(who), F.concat(sentence_case(title), F.lit(".")), F.concat(container, F.lit(".")), F.concat(when, F.lit(".")), link)
    if style == "acs":
        return F.concat_ws(" ", who, _stopped(title_case(title)), F.concat(F.concat_ws(" ", container, when), F.lit(".")), link)
    if style == "chicago-author-date":
        return F.concat_ws(" ", _stopped(who), F.concat(when, F.lit(".")), F.concat(F.lit('"'), title_case(title), F.lit('."')), F.concat(container, F.lit(".")), link)
    if style == "chicago-notes-bib":
        return F.concat(F.concat_ws(", ", who, F.concat(F.lit('"'), title_case(title), F.lit('"')), F.concat_ws(" ", container, F.concat(F.lit("("), when, F.lit(")"))), link), F.lit("."))
    if style == "ieee":
        return F.concat(F.concat_ws(", ", who, F.concat(F.lit('"'), sentence_case(title), F.lit(',"')), container, when, link), F.lit("."))
    return F.concat_ws(" ", who, F.concat(F.lit("("), when, F.lit(")")), F.concat(F.lit("'"), sentence_case(title), F.lit("',")), F.concat(container, F.lit(".")), link)
