"""The format of a pasted text by a linear score over signals of its lines.

All signals are counts and shares over the lines, read once; each format's score is a
bias and a weighted sum, and the gap to the next one gives the confidence.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bind import let
from .split import BARE_YEAR, IN_BRACKETS, LEAD, OPENERS, opens_reference

# Weights of shares by format, their biases, and bounds.
WEIGHTS = {
    "bibtex": {"bibtex_share": 0.85, "noise_share": -0.10},
    "ris": {"ris_share": 0.85, "noise_share": -0.10},
    "numbered_list": {"numbered_share": 0.55, "footnote_share": 0.10, "block_share": 0.10, "author_share": 0.05, "noise_share": -0.15},
    "blank_line": {"block_share": 0.60, "author_share": 0.10, "numbered_share": -0.10, "noise_share": -0.10},
    "hanging_indent": {"hanging_share": 0.55, "indent": 0.15, "author_share": 0.10, "numbered_share": -0.10, "block_share": -0.05},
    "plain_text": {"author_share": 0.20, "book_share": 0.10, "conference_share": 0.10, "numbered_share": -0.15, "block_share": -0.15, "noise_share": -0.10},
    "unknown": {"noise_share": 0.20, "author_share": -0.10, "numbered_share": -0.10, "block_share": -0.10},
}
BIAS, SCHEMA_BONUS, STEEPNESS, MOST = 0.05, 0.25, 8.0, 0.95
SCHEMA, HARD_SHARE, HARD_SCORE, MIXED, SEMI, NOISY, NOISY_LINES, AUTHORS = 0.20, 0.60, 0.80, 0.15, 0.55, 0.12, 3, 0.25
CONFERENCES = ["conference", "symposium", "workshop", "congress", "meeting", "proceedings", "forum", "summit", "colloquium"]
GROUPS = ["Institute", "Organization", "University", "Association", "Committee", "Department", "Society", "Agency", "Bureau", "Foundation", "Office", "Center", "Centre", "Hospital", "Council", "Commission", "Ministry"]
# End of the fixed values.

DOI = r"10\.\d{4,9}/\S+"
GROUP = rf"^\s*\p{{Lu}}[\p{{L}}\p{{M}}&,'‘’ʼ.\- ]{{4,80}}\b(?:{'|'.join(GROUPS)})\b"
#: A place and a house behind a colon, at the end or before a year.
PLACE, HOUSE = r"[A-Z][\p{L}'’.\-, ]*", r"[A-Z][^.;:]{2,}"
BOOK = rf"(?:^|\.\s+){PLACE}:\s*{HOUSE}(?:[;,]\s*(?:19|20)\d{{2}})?\.?$"
DATED = rf"{IN_BRACKETS}|{BARE_YEAR}|(?i)\b{DOI}\b|https?://\S+|www\.\S+"


def is_noise(line: Column) -> Column:
    """A cut word, a page counter, a few odd marks, or mostly other characters than letters without a date or address."""
    n = F.length(line)
    other = n - F.length(F.regexp_replace(line, r"[^\p{L}\p{M}]", ""))
    return line.rlike(r"\b\p{L}{3,}-\s+\p{L}{2,}\b") | line.rlike(r"^(?:Page\s+)?\d+\s+(?:of|/)\s+\d+$") | ((n < 3) & (F.length(F.regexp_replace(line, "[0-9A-Za-z]", "")) >= 2)) | ((other > n * 0.60) & ~line.rlike(DATED))


def is_author_line(line: Column) -> Column:
    return opens_reference(line) | line.rlike(GROUP)


def detection_signals(text: Column) -> Column:
    """lines, counts, shares and marks of a text as one struct; a null text has no lines."""
    raw = F.coalesce(text, F.lit(""))

    def told(lines: Column) -> Column:
        full = F.filter(lines, lambda x: F.trim(x) != "")

        def of(held: Column) -> Column:
            n = F.size(held)
            count = lambda f: F.size(F.filter(held, f))
            share = lambda c: F.when(n > 0, c / n).otherwise(0.0)
            indent = F.transform(held, lambda x: F.length(x) - F.length(F.ltrim(x)))
            steps = let(indent, lambda ind: F.filter(F.transform(held, lambda x, i: F.when((i > 0) & (F.get(ind, i) >= F.get(ind, i - 1) + 2) & ~F.get(held, i - 1).rlike(LEAD), F.get(ind, i) - F.get(ind, i - 1))), lambda d: d.isNotNull()))
            blocks = F.size(F.filter(F.transform(F.split(F.array_join(F.transform(lines, lambda x: F.trim(x)), "\n"), r"\n\n+"), lambda b: F.trim(b)), lambda b: F.regexp_replace(b, r"\n", "") != ""))
            counts = F.struct(
                n.alias("lines"), count(lambda x: x.rlike(LEAD)).alias("numbered"), F.when(blocks >= 2, blocks).otherwise(0).alias("blocks"), count(is_author_line).alias("authors"), count(lambda x: x.rlike(r"[¹²³⁴⁵⁶⁷⁸⁹]|\^\d+")).alias("footnotes"), F.regexp_count(raw, F.lit(rf"(?i)\b{DOI}\b")).alias("dois"), count(lambda x: F.trim(x).rlike(BOOK)).alias("books"),
                count(lambda x: x.rlike(rf"(?i)\b(?:{'|'.join(CONFERENCES)})\b") | (x.rlike(r"(?i)\bIEEE\b") & x.rlike(r"(?i)\bpp?\.?\s*\d+"))).alias("conferences"), count(lambda x: is_noise(F.trim(x))).alias("noise"), F.size(steps).alias("hanging"), F.when(F.size(steps) > 0, F.aggregate(steps, F.lit(0.0), lambda s, d: s + d) / F.size(steps)).otherwise(0.0).alias("indent_delta"),
                share(count(lambda x: F.trim(F.regexp_replace(F.trim(x), r"(?i)^doi:\s*|^https?://doi\.org/", "")).rlike(rf"(?i)^{DOI}$"))).alias("doi_share"), share(count(lambda x: x.rlike(r"^\s*@\w+\s*\{[^,]+,|^\s*[A-Za-z][\w-]*\s*=\s*.+,?\s*$"))).alias("bibtex_share"), share(count(lambda x: x.rlike(r"^[A-Z]{2}\s+-\s+"))).alias("ris_share"),
            )

            def shares(c: Column) -> Column:
                part = lambda k: share(c[k])
                mixed = ((part("numbered") >= MIXED) & (part("authors") >= MIXED)) | ((c["books"] > 0) & (c["conferences"] > 0)) | ((c["footnotes"] > 0) & (c["numbered"] > 0))
                schema = F.when(c["bibtex_share"] > SCHEMA, "bibtex").when(c["ris_share"] > SCHEMA, "ris").when(c["doi_share"] > 0.5, "doi_list")
                profile = F.when((c["bibtex_share"] >= HARD_SHARE) | (c["ris_share"] >= HARD_SHARE) | (c["doi_share"] >= 0.80), "CLEAN_STRUCTURED").when((part("noise") >= NOISY) | (c["noise"] >= NOISY_LINES), "OCR_HEAVY").when(mixed, "AMBIGUOUS_MIXED").when(part("authors") >= AUTHORS, "BIBLIOGRAPHIC_PLAIN").otherwise("WEAK_NON_BIBLIOGRAPHIC")
                named = {"numbered_share": "numbered", "block_share": "blocks", "author_share": "authors", "footnote_share": "footnotes", "doi_density": "dois", "book_share": "books", "conference_share": "conferences", "noise_share": "noise", "hanging_share": "hanging"}
                kept = ["lines", "numbered", "blocks", "authors", "footnotes", "dois", "books", "conferences", "noise", "hanging", "indent_delta", "doi_share", "bibtex_share", "ris_share"]
                return F.struct(*(c[k].alias(k) for k in kept), *(part(v).alias(k) for k, v in named.items()), F.least(F.lit(1.0), c["indent_delta"] / 4).alias("indent"), mixed.alias("mixed"), schema.alias("schema"), profile.alias("profile"))

            return let(counts, shares)

        return let(full, of)

    return let(F.split(raw, r"\r?\n"), told)


def scored_format(signals: Column) -> Column:
    """format, score, second (the next one's score), confidence (of the gap), format_confidence
    and structure. Texts of DOIs alone are a list of them for sure; no lines are unknown."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))

    def told(s: Column) -> Column:
        plain = {f: (0.0 if f == "unknown" else BIAS) + reduce(add, [s[k] * w for k, w in weights.items()]) for f, weights in WEIGHTS.items()}
        score = dict(plain)
        for f in ("bibtex", "ris"):
            hard = (s[f"{f}_share"] >= HARD_SHARE) & (clamp(plain[f]) >= HARD_SCORE)
            score[f] = plain[f] + F.when((s["schema"] == f) & ~hard, SCHEMA_BONUS).otherwise(0.0)
        ranked = F.array_sort(F.array(*(F.struct((-clamp(c)).alias("low"), F.lit(k).alias("at"), F.lit(f).alias("format")) for k, (f, c) in enumerate(score.items()))))

        def of(r: Column) -> Column:
            best, second = -F.get(r, F.lit(0))["low"], -F.get(r, F.lit(1))["low"]
            penalty = F.when((s["numbered_share"] >= MIXED) & (s["author_share"] >= MIXED), 0.30 * F.least(s["numbered_share"], s["author_share"])).otherwise(0.0)
            sure, kind = clamp(best * (1 - penalty)), F.get(r, F.lit(0))["format"]
            structured = lambda f: F.when((s[f"{f}_share"] >= HARD_SHARE) & (best >= HARD_SCORE), "structured").otherwise("semi_structured")
            structure = F.when(kind == "bibtex", structured("bibtex")).when(kind == "ris", structured("ris")).when(kind.isin("numbered_list", "blank_line", "hanging_indent"), F.when(sure >= SEMI, "semi_structured").otherwise("unstructured")).when((kind == "unknown") & (sure < 0.35), "unknown").otherwise("unstructured")
            made = lambda *x: F.struct(*(c.alias(n) for c, n in zip(x, ("format", "score", "second", "confidence", "format_confidence", "structure"))))
            none = [F.lit(x) for x in ("unknown", 1.0, 0.0, 1.0, 0.0, "unknown")]
            forced = [F.lit(x) for x in ("doi_list", 1.0, 0.0, 1.0, 1.0, "structured")]
            return F.when(s["lines"] == 0, made(*none)).when(s["doi_share"] == 1, made(*forced)).otherwise(made(kind, best, second, F.least(F.lit(MOST), 1 / (1 + F.exp(-STEEPNESS * (best - second)))), sure, structure))

        return let(ranked, of)

    return let(signals, told)


OPENER_PATTERN = "|".join(f"(?:{p})" for p in OPENERS) + f"|(?:{GROUP})"
