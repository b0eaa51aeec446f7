"""Author lists as structs: a fold over the chunks of a list that pairs family names
with given names, and the parts of a single name.

A list is cut at commas, semicolons and conjunctions. The fold holds back a chunk that
may be a family name; the next chunk decides whether it was one (initials, or given
names after a lone family name) or a whole name by itself. Entries are parsed into
structs once, after the fold. All in built-in functions, so nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bind import let

# Words that tell an organization, those that do so alone, and particles of names.
ORGANIZATIONS = [
    "association", "society", "committee", "center", "centre", "department", "ministry", "organization", "organisation", "institute", "institution", "group", "agency", "office", "university", "college", "world health organization", "cdc", "nih", "survey", "standards", "contributors", "task force", "editor", "fund", "foundation", "federation", "bureau", "commission", "consortium", "laboratory", "laboratories",
    "administration", "division", "directorate", "library", "repository", "council", "inc", "incorporated", "ltd", "limited", "corp", "corporation", "company", "gmbh",
]
WEAK = ["center", "centre", "group", "office", "survey", "standards", "contributors", "editor", "fund", "division", "library", "repository"]
PARTICLES = ["da", "das", "de", "del", "della", "den", "der", "di", "do", "dos", "du", "ibn", "la", "le", "van", "von", "y"]
# End of the fixed values.

L = r"\p{Lu}\.?"
#: Up to four initials, with dots or not, one hyphen among them; four capitals with a vowel are a word.
INITIAL = rf"(?:(?!\p{{Lu}}*[AEIOUY]\p{{Lu}}*(?![\p{{L}}.-]))(?:{L}){{4}}|(?:{L}){{1,3}}|{L}-(?:{L}){{1,2}}|(?:{L}){{2}}-{L})(?![\p{{L}}.'-])"
NAME, PARTICLE = r"\p{Lu}[\p{L}'`’-]+(?![\p{L}.])", rf"(?i:{'|'.join(PARTICLES)})(?!\S)"
WORD = rf"(?:{INITIAL}|{PARTICLE}|{NAME})"
HINT = rf"(?i)\b(?:{'|'.join(ORGANIZATIONS)})\b"
STRONG_HINT = rf"(?i)\b(?:{'|'.join(x for x in ORGANIZATIONS if x not in WEAK)})\b"
#: Runs of words of one kind, and what a chunk may be.
INITIALS, NAMES = rf"^{INITIAL}(?:\s+{INITIAL})*$", rf"^{WORD}(?:\s+{WORD})*$"
LONE_FAMILY, FAMILY = rf"^(?:{PARTICLE}\s+)*{NAME}$", rf"^(?:(?:{PARTICLE}|{NAME})\s+){{0,2}}{NAME}$"
GIVEN = rf"^(?:{INITIAL}\s+{NAME}|{NAME}(?:\s+(?:{NAME}|{PARTICLE})){{0,3}}(?:\s+{INITIAL}){{0,2}}|{INITIAL}(?:\s+{INITIAL})*)$"
#: A name that starts with initials, ends with them, or has particles before its last words.
LEADING, TRAILING = rf"^((?:{INITIAL}\s+)+)(\S.*)$", rf"^(\S.*?)\s+({INITIAL}(?:\s+(?:{INITIAL}|{PARTICLE}))*)$"
WITH_PARTICLE = rf"^(\S.*?)\s+((?:{PARTICLE}\s+)+{NAME}(?:\s+{NAME}){{0,2}})$"
AUTHOR = "struct<family:string,given:string,initials:string,literal:string,is_corporate:boolean>"


def cleaned(segment: Column) -> Column:
    """Without a number before it, a date in brackets, et al. or a stop after it; glued initials parted."""
    c = F.regexp_replace(F.regexp_replace(F.coalesce(segment, F.lit("")), "(?i)&amp;", "&"), r"^[\[(]?\d+[\]).]?\s*", "")
    c = F.regexp_replace(F.regexp_replace(c, r"\s*\((?:19|20)\d{2}[^)]*\)\s*$", ""), r"(?i),?\s*\bet al\.?$", "")
    return parted(F.trim(F.regexp_replace(c, r"[.;]\s*$", "")))


def parted(c: Column) -> Column:
    """OliverH. becomes Oliver H., A.Lewis becomes A. Lewis."""
    return F.regexp_replace(F.regexp_replace(c, r"(\p{Lu}\p{Ll}+)(\p{Lu}\.?)(?=$|[\s,;])", "$1 $2"), r"(\p{Lu})\.(\p{Lu}\p{Ll})", "$1. $2")


def words(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


def chunks(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(c, pattern), lambda x: F.trim(x)), lambda x: x != "")


def is_organization(c: Column) -> Column:
    """One organization, whose name may hold commas and conjunctions: no part of it looks like a person."""
    def alike(part: Column) -> Column:
        return part.rlike(HINT) | (~part.rlike(r"\p{Lu}\.") & (part.rlike(r"(?:^|\s)\p{Ll}") | (F.size(words(part)) >= 4)))

    return c.rlike(STRONG_HINT) & ~c.contains(";") & F.forall(chunks(c, ","), alike)


def is_prose(chunk: Column) -> Column:
    """A word in lower case that no name has: where the list ends and a title begins."""
    low = rf"(?:^|\s)(?!(?i:{'|'.join(PARTICLES)}|and)(?:\s|$))\p{{Ll}}[^\s]{{2,}}"
    return chunk.rlike(r"\S\s+\S") & chunk.rlike(low)


def is_no_list(c: Column) -> Column:
    """An address, a phrase with an article, or many words without the marks of names."""
    plain = ~c.contains(",")
    n = F.size(words(c))
    joined = c.rlike(r"(?i)\s(?:and|&)\s") & F.forall(chunks(c, r"(?i)\s+(?:and|&)\s+"), lambda x: F.size(words(x)).between(2, 4) & x.rlike(NAMES))
    return c.rlike("(?i)https?://") | (plain & c.rlike(r"(?i)^(?:a|an|the)\s")) | (plain & (n > 4) & ~c.rlike(r"[A-Z]\.") & ~(n.between(5, 6) & c.rlike(NAMES)) & ~joined)


def person(family: Column, given: Column) -> Column:
    """Initials without other letters stand apart: EP or E. P. becomes E P."""
    tight = F.regexp_replace(given, r"[.\s]", "")
    given = F.when(tight.rlike(r"^\p{Lu}{2,5}$"), F.array_join(F.split(tight, r"(?<=.)(?=.)"), " ")).otherwise(F.nullif(F.trim(given), F.lit("")))

    def made(g: Column) -> Column:
        first = F.array_join(F.transform(words(g), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lit("."))), " ")
        return F.struct(F.trim(family).alias("family"), g.alias("given"), F.when(g.isNotNull(), first).alias("initials"), F.lit(None).cast("string").alias("literal"), F.lit(False).alias("is_corporate"))

    return let(given, made)


def organization(name: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.trim(name).alias("family"), none.alias("given"), none.alias("initials"), F.trim(name).alias("literal"), F.lit(True).alias("is_corporate"))


def single_author(name: Column) -> Column:
    """The struct of one name in direct order, with initials before or after it."""
    part = lambda c, p, k: F.regexp_extract(c, p, k)

    def told(c: Column) -> Column:
        rest, lead = part(c, LEADING, 2), part(c, LEADING, 1)
        compound = (F.size(words(rest)) >= 2) & ((F.size(words(lead)) >= 2) | (F.size(words(rest)) >= 3) | F.exists(words(rest), lambda w: w.rlike(f"^{PARTICLE}$")))
        split_at = lambda p, family, given: person(part(c, p, family), part(c, p, given))
        return (
            F.when(c.rlike(HINT), organization(c)).when(F.size(words(c)) == 1, person(c, F.lit(None).cast("string")))
            .when(c.rlike(LEADING) & compound, person(rest, lead)).when(c.rlike(TRAILING), split_at(TRAILING, 1, 2)).when(c.rlike(WITH_PARTICLE), split_at(WITH_PARTICLE, 2, 1))
            .otherwise(split_at(r"^(.*\S)\s+(\S+)$", 2, 1))
        )

    return let(parted(F.trim(F.regexp_replace(F.regexp_replace(name, r"(?i)^(?:and|&)\s+", ""), r"[,;.\s]+$", ""))), told)


def paired(found: Column) -> Column:
    """Chunks as entries: family and given of a pair, or whole, a name by itself."""
    none = F.lit(None).cast("string")
    pair = lambda family, given: F.array(F.struct(family.alias("family"), given.alias("given"), none.alias("whole")))
    alone = lambda c: F.array(F.struct(none.alias("family"), none.alias("given"), c.alias("whole")))
    zero = F.struct(F.array().cast("array<struct<family:string,given:string,whole:string>>").alias("done"), none.alias("held"))

    def step(s: Column, x: Column) -> Column:
        held = s["held"]

        def told(bare: Column) -> Column:
            joins = F.coalesce(held.isNotNull() & (x.rlike(INITIALS) | (held.rlike(LONE_FAMILY) & bare.rlike(GIVEN) & ~bare.rlike(rf"\s{PARTICLE}"))), F.lit(False))
            return let(F.struct(joins.alias("joins"), bare.alias("bare")), lambda f: let(~f["joins"] & f["bare"].rlike(FAMILY) & ~x.rlike(HINT), lambda waits: entry(f["joins"], waits, f["bare"])))

        before = F.when(held.isNotNull(), F.concat(s["done"], alone(held))).otherwise(s["done"])
        entry = lambda joins, waits, bare: F.struct(F.when(joins, F.concat(s["done"], pair(held, x))).when(waits, before).otherwise(F.concat(before, alone(x))).alias("done"), F.when(waits, bare).alias("held"))
        return let(F.regexp_replace(x, r"[;,.\s]+$", ""), told)

    return F.aggregate(found, zero, step, lambda s: F.when(s["held"].isNotNull(), F.concat(s["done"], alone(s["held"]))).otherwise(s["done"]))


def author_list(segment: Column) -> Column:
    """The authors of a segment of a reference, as structs of family, given, initials,
    literal and is_corporate. Family, Given pairs, names in direct order and initials
    after names may stand side by side. No authors for a null or empty segment, or for
    text that is none. A name of one organization stays whole. The list ends where a
    title begins."""
    def told(c: Column) -> Column:
        cut = let(chunks(c, r"\s*[,;]\s*|(?i:\s+and\s+|\s*&\s*)"), lambda found: let(F.transform(found, lambda x, i: F.when((i > 0) & is_prose(x) & ~x.rlike(HINT), i)), lambda at: F.when(F.array_min(at).isNull(), found).otherwise(F.slice(found, F.lit(1), F.array_min(at)))))
        plain = F.transform(cut, lambda x: F.regexp_replace(x, r"(?i)^(?:and|&)\s+", ""))
        several = F.transform(paired(plain), lambda e: F.when(e["whole"].isNull(), person(e["family"], e["given"])).otherwise(single_author(e["whole"])))
        none = F.array().cast(f"array<{AUTHOR}>")
        hint, joined = c.rlike(HINT), c.rlike(r"(?i)\s(?:and|&)\s")

        # what holds no word for an organization is none, and only persons' names are left
        hinted = let(is_organization(c), lambda whole: F.when(~whole & ~joined & is_no_list(c), none).when(whole | (~c.contains(",") & ~joined), F.array(organization(c))).otherwise(several))
        return F.when(c == "", none).when(hint, hinted).when(is_no_list(c), none).otherwise(several)

    return let(cleaned(segment), told)


def suspect_authors(authors: Column, segment: Column) -> Column:
    """Whether a parsed list doesn't hold up against its segment: no author of it, or
    fewer than two of several, stand there; a lone person of more than four words, or a
    family name of more than three."""
    text = F.lower(F.coalesce(segment, F.lit("")))
    held = F.size(F.filter(authors, lambda a: F.instr(text, F.lower(F.coalesce(a["literal"], a["family"]))) > 0))
    n, one = F.size(authors), F.get(authors, F.lit(0))
    delimited = text.rlike(r",|;|\s+and\s+|&")
    lone = one["is_corporate"] | ~((~text.contains(",") & ~segment.rlike(r"[A-Z]\.") & (F.size(words(text)) > 4)) | (F.size(words(one["family"])) > 3))
    good = F.when(n == 1, (held == 1) & lone).otherwise((held == n) | (delimited & (held >= F.least(n, F.lit(2)))))
    return ~F.coalesce((n > 0) & (held > 0) & good, F.lit(False))


def disambiguated(primary: Column, fallback: Column, segment: Column) -> Column:
    """The authors to keep: the first parse unless it is suspect and the other isn't, or both hold and the other has more people."""
    bad, worse = suspect_authors(primary, segment), suspect_authors(fallback, segment)
    people = lambda c: F.size(F.filter(c, lambda a: ~a["is_corporate"]))
    return F.when((bad & ~worse) | (~bad & ~worse & (people(fallback) > people(primary)) & (people(primary) <= 1)), fallback).otherwise(primary)
