"""Folds over a text's lines: wrapped addresses and soft breaks joined, references split
by indents or by how their first lines look, addresses on a line of their own given
back to the reference above, and blocks that are too long cut once more.

Each fold goes through the lines once; its state says what the next line does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.ingest import clean_pdf, is_furniture, looks_like_pdf
from .detect import detect_format
from .split import BARE_YEAR, CONTINUES, IN_BRACKETS, LATIN, LEAD, NUMBERED, OPENS, TOO_LONG, TOO_SHORT, blank_line_blocks, complete_reference, numbered_blocks, opener_score, opens_reference, split_quality

# Headings, lengths, how sure each way to split is, and how much better a cleaned text must split.
HEADINGS = ["reference", "references", "bibliography", "works cited"]
RECOVER, TAIL, HEADING = 500, 120, 20
CONFIDENCE = {"doi_list": 1.0, "bibtex": 1.0, "ris": 1.0, "numbered": 0.95, "blank_line": 0.8, "hanging": 0.7, "whole": 0.72, "uncertain": 0.4}
STRONG_NUMBERS, BETTER = 3, 0.05
# End of the fixed values.

URI, URL, CODE = r"(?i)(?:https?://\S+|www\.\S+|\b10\.\d{4,9}/\S+\b)", r"(?i)https?://\S+", r"(?i)10\.\d{4,9}/\S*"
ENDS_OPEN, CODE_CHARS = r"[./#?=&%-]$", r"^[A-Za-z0-9._;():/%+-]+$"
COUNTER = r"(?i)\b\d+\s+(?:of|/)\s+\d+\s*(?:references?)?$"
CAPITAL = r"\p{Lu}[\p{L}\p{M}'‘’ʼ.-]+"
#: Where a second reference begins within a block: after a sentence, authors with a year.
WHO = "[A-Z][A-Za-z'’.-]+"
BOUNDARY = rf"(?<=[.!?])\s+(?={WHO}(?:,\s+[A-Z][^()]{{0,40}}|(?: et al\.?| & {WHO})?\s*){IN_BRACKETS})"
BLOCK = "struct<text:string,reason:string,uris:boolean>"


def physical(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def folded(lines: Column, joins) -> Column:
    """Lines with those joined that joins(line before, line) gives a joined form for."""
    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        return let(F.when(F.size(done) > 0, joins(last, x)), lambda made: F.when(made.isNotNull(), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(made))).otherwise(F.concat(done, F.array(x))))

    return F.aggregate(lines, F.array().cast("array<string>"), step)


def wrapped(kind: str):
    """A line that ends in a DOI or address goes on with a line of one token; a number alone only where the end is open."""
    pattern, token = (CODE, CODE_CHARS) if kind == "doi" else (URL, r"^\S+$")

    def joins(line: Column, following: Column) -> Column:
        head, tail = F.rtrim(line), F.trim(following)
        end = F.regexp_extract(head, pattern + "$", 0)
        kept = tail.rlike(LEAD) | F.lower(tail).isin(HEADINGS) | tail.rlike(COUNTER)
        ok = (end != "") & (tail != "") & tail.rlike(token) & ~kept & (~tail.rlike(r"^\d+$") | end.rlike(ENDS_OPEN))
        return F.when(ok, F.concat(head, tail))

    return joins


def join_wrapped(text: Column) -> Column:
    """DOIs and addresses that a line's end cut, whole again."""
    return F.array_join(folded(folded(physical(text), wrapped("doi")), wrapped("url")), "\n")


def begins(line: Column) -> Column:
    """A line that soft breaks never join to the one before: a number, an author, a name with a year, or an entry's mark."""
    return line.rlike(NUMBERED) | opens_reference(line) | line.rlike(rf"^{LATIN}[^,]{{0,80}},\s*\d{{4}}\.") | line.rlike(r"^(?:@\w+\s*\{|(?:TY|ER)  - )")


def merge_soft_breaks(text: Column) -> Column:
    """Lines joined by a space, but for empty ones, page furniture and lines that begin a reference."""
    def joins(line: Column, following: Column) -> Column:
        head, tail = F.trim(line), F.trim(following)
        return F.when((head != "") & (tail != "") & ~is_furniture(tail) & ~begins(tail), F.concat(F.rtrim(line), F.lit(" "), F.ltrim(following)))

    return F.array_join(folded(F.split(text, "\n"), joins), "\n")


def starts(line: Column) -> Column:
    return line.rlike(LEAD) | opens_reference(line)


def hanging_blocks(text: Column) -> Column:
    """A line indented no deeper than the block's first one that starts a reference opens
    a block; so does any line after an empty one."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("held"), F.lit(0).alias("base"))
    flushed = lambda s: F.when(s["held"].isNotNull(), F.concat(s["done"], F.array(s["held"]))).otherwise(s["done"])

    def step(s: Column, line: Column) -> Column:
        bare, indent = F.trim(line), F.length(line) - F.length(F.ltrim(line))
        opens = s["held"].isNull() | ((indent <= s["base"]) & starts(bare))
        return F.when(bare == "", F.struct(flushed(s).alias("done"), F.lit(None).cast("string").alias("held"), F.lit(0).alias("base"))).when(opens, F.struct(flushed(s).alias("done"), bare.alias("held"), indent.alias("base"))).otherwise(F.struct(s["done"].alias("done"), F.concat(s["held"], F.lit(" "), bare).alias("held"), s["base"].alias("base")))

    return F.aggregate(physical(text), zero, step, flushed)


def is_uri_tail(line: Column) -> Column:
    """An address or DOI on a line of its own, with little else."""
    return line.rlike(URI) & ~line.rlike(r"(?i)^(?:accessed|viewed|retrieved)\b") & ~line.rlike(LEAD) & ~line.rlike(IN_BRACKETS) & ((F.length(line) <= TAIL) | line.rlike(r"(?i)^(?:doi:|https?://|www\.)"))


def told_lines(text: Column) -> Column:
    """Structs of line, kind (content, artifact or uri) and the two neighbours' marks that
    the opener score asks for. Headings and page counters are artifacts; so are running
    titles within two lines of one or of each other."""
    def kinds(lines: Column) -> Column:
        dated = lambda x: x.rlike(IN_BRACKETS) | x.rlike(BARE_YEAR) | x.rlike(URI)
        plain = F.transform(lines, lambda x: (F.lower(x).isin(HEADINGS) & (F.length(x) <= HEADING) & ~dated(x)) | x.rlike(COUNTER))
        running = F.transform(lines, lambda x: x.rlike(rf"^{CAPITAL}(?:\s+{CAPITAL}){{1,8}}$") & ~x.contains(".") & ~dated(x))
        marks = F.zip_with(plain, running, lambda p, r: F.struct(p.alias("p"), r.alias("r")))

        def artifact(m: Column, i: Column, marks: Column) -> Column:
            around = F.concat(F.slice(marks, F.greatest(F.lit(1), i - 1), F.least(i, F.lit(2))), F.slice(marks, i + 2, F.lit(2)))
            return m["p"] | (m["r"] & F.exists(around, lambda x: x["p"] | x["r"]))

        flags = let(marks, lambda ms: F.transform(ms, lambda m, i: artifact(m, i, ms)))
        rows = F.zip_with(lines, flags, lambda x, a: F.struct(x.alias("line"), F.when(a, "artifact").when(is_uri_tail(x), "uri").otherwise("content").alias("kind")))
        return F.filter(rows, lambda r: r["line"] != "")

    def neighbours(rows: Column) -> Column:
        return F.transform(rows, lambda r, i: F.struct(r["line"].alias("line"), r["kind"].alias("kind"), F.when(F.get(rows, i + 1)["kind"] == "content", F.get(rows, i + 1)["line"]).alias("following"), F.coalesce(F.get(rows, i - 1)["kind"] == "artifact", F.lit(False)).alias("after")))

    return let(let(F.transform(physical(text), lambda x: F.trim(x)), kinds), neighbours)


def opener_blocks(text: Column) -> Column:
    """Structs of text, reason and uris (nothing but addresses): a line opens a block if it
    looks like a reference's start, artifacts go, an address on a line of its own joins
    the block above unless that is addresses alone."""
    none = F.lit(None).cast(BLOCK)
    zero = F.struct(F.array().cast(f"array<{BLOCK}>").alias("done"), none.alias("held"))
    flushed = lambda s: F.when(s["held"].isNotNull(), F.concat(s["done"], F.array(s["held"]))).otherwise(s["done"])
    block = lambda text, reason, uris: F.struct(text.alias("text"), reason.alias("reason"), uris.alias("uris"))
    joined = lambda b, line: F.concat(b["text"], F.lit(" "), line)

    def step(s: Column, x: Column) -> Column:
        line, held = x["line"], s["held"]
        score = opener_score(line, x["following"], x["after"])
        opens = line.rlike(LEAD) | (~line.rlike(CONTINUES) & (score >= OPENS))
        reason = F.when(line.rlike(LEAD), "number_marker").when(opens, "opener_score").otherwise("uncertain")
        above = F.coalesce(held, F.element_at(F.when(F.size(s["done"]) > 0, s["done"]), -1))
        tailed = block(joined(above, line), F.when(above["reason"] == "uncertain", "uri_tail_attach_previous").otherwise(above["reason"]), above["uris"])
        attach = F.coalesce(~above["uris"], F.lit(False))
        uri = (
            F.when(attach & held.isNotNull(), F.struct(s["done"].alias("done"), tailed.alias("held")))
            .when(attach, F.struct(F.concat(F.slice(s["done"], F.lit(1), F.size(s["done"]) - 1), F.array(tailed)).alias("done"), none.alias("held")))
            .otherwise(F.struct(F.concat(flushed(s), F.array(block(line, F.lit("uncertain"), F.lit(True)))).alias("done"), none.alias("held")))
        )
        content = F.when(held.isNull() | opens, F.struct(flushed(s).alias("done"), block(line, reason, F.lit(False)).alias("held"))).otherwise(F.struct(s["done"].alias("done"), block(joined(held, line), held["reason"], F.lit(False)).alias("held")))
        return F.when(x["kind"] == "artifact", s).when(x["kind"] == "uri", uri).otherwise(content)

    return F.aggregate(told_lines(text), zero, step, flushed)


def recover_long(blocks: Column) -> Column:
    """Where one block is too long, or a lone one is long, long blocks are cut before
    authors with a year that follow a sentence."""
    size = lambda b: F.length(b["text"])
    needed = ((F.size(blocks) == 1) & (size(F.get(blocks, F.lit(0))) > RECOVER)) | F.exists(blocks, lambda b: size(b) > TOO_LONG)

    def pieces(b: Column) -> Column:
        cut = F.filter(F.transform(F.split(b["text"], BOUNDARY), lambda x: F.trim(x)), lambda x: x != "")
        return F.when((size(b) > RECOVER) & (F.size(cut) > 1), F.transform(cut, lambda x: F.struct(x.alias("text"), F.lit("secondary_author_year_boundary").alias("reason"), F.lit(False).alias("uris")))).otherwise(F.array(b))

    return F.when(needed, F.flatten(F.transform(blocks, pieces))).otherwise(blocks)


def fallback_blocks(text: Column) -> Column:
    """opener_blocks() with long ones recovered: what a text without any structure is split by."""
    return let(opener_blocks(text), recover_long)


def without_counters(text: Column) -> Column:
    return F.array_join(F.filter(physical(text), lambda x: ~(F.lower(F.trim(x)).isin(HEADINGS) | F.trim(x).rlike(COUNTER))), "\n")


def way_of(text: Column) -> Column:
    """numbered where three lines have numbers, else the format of the rules."""
    marked = F.size(F.filter(physical(text), lambda x: x.rlike(LEAD)))
    found = detect_format(text)
    return F.when(found.isin("doi_list", "bibtex", "ris"), found).when(marked >= STRONG_NUMBERS, "numbered").when(found.isin("plain", "unknown"), "uncertain").otherwise(found)


def split_blocks(text: Column) -> Column:
    """way and blocks (text and reason) of a text whose wrapped addresses are joined first,
    unless it is a list of DOIs."""
    def told(both: Column) -> Column:
        x, way = both["joined"], both["way"]
        as_blocks = lambda c, reason: F.transform(c, lambda b: F.struct(F.trim(F.regexp_replace(b, r"\s+", " ")).alias("text"), F.lit(reason).alias("reason")))
        entry = lambda mark: F.filter(F.split(x, rf"(?m)(?={mark})"), lambda b: b.rlike(rf"^{mark}"))
        blocks = (
            F.when(way == "numbered", as_blocks(numbered_blocks(without_counters(x)), "number_marker")).when(way == "blank_line", as_blocks(blank_line_blocks(x), "blank_line")).when(way == "hanging", as_blocks(hanging_blocks(x), "hanging_indent"))
            .when(way == "doi_list", as_blocks(F.filter(F.transform(physical(both["raw"]), lambda b: F.trim(b)), lambda b: b != ""), "doi_line")).when(way == "bibtex", as_blocks(entry(r"@\w+\s*\{"), "bibtex_entry")).when(way == "ris", as_blocks(entry(r"TY\s+-\s"), "ris_entry"))
            .otherwise(F.transform(fallback_blocks(x), lambda b: F.struct(F.trim(F.regexp_replace(b["text"], r"\s+", " ")).alias("text"), b["reason"].alias("reason"))))
        )
        return F.struct(way.alias("way"), blocks.alias("blocks"))

    raw = F.coalesce(text, F.lit(""))
    return let(F.struct(raw.alias("raw"), join_wrapped(raw).alias("joined"), way_of(raw).alias("way")), told)


def materialized(split: Column) -> Column:
    """Blocks with idx, text, reason, method, confidence and flags (too_short, too_long,
    uncertain); a block of no sure way that is a whole reference by itself is told so."""
    def one(b: Column, i: Column) -> Column:
        whole = (split["way"] == "uncertain") & complete_reference(b["text"])
        method = F.when(whole, "whole").when(b["reason"] == "number_marker", "numbered").otherwise(split["way"])
        sure = F.element_at(F.create_map(*(F.lit(v) for kv in CONFIDENCE.items() for v in kv)), method)
        flags = F.array_compact(F.array(F.when(F.length(b["text"]) < TOO_SHORT, "too_short"), F.when(F.length(b["text"]) > TOO_LONG, "too_long"), F.when(sure < 0.5, "uncertain")))
        return F.struct(i.alias("idx"), b["text"].alias("text"), b["reason"].alias("reason"), method.alias("method"), sure.alias("confidence"), flags.alias("flags"))

    return F.transform(split["blocks"], one)


def estimated_count(text: Column, way: Column) -> Column:
    """How many references a text should have: its marks by format, else years but no more than lines."""
    n = lambda p: F.regexp_count(text, F.lit(p))
    full = F.size(F.filter(physical(text), lambda x: F.trim(x) != ""))
    years = n(rf"{IN_BRACKETS}|{BARE_YEAR}")
    told = F.when(way == "doi_list", full).when(way == "bibtex", n(r"@\w+\s*\{")).when(way == "ris", n("(?m)^TY  - ")).when(way == "numbered", n("(?m)" + NUMBERED)).when(way == "blank_line", F.size(blank_line_blocks(text))).when(way == "hanging", F.size(hanging_blocks(text)))
    return F.greatest(F.lit(1), F.coalesce(told, F.least(full, F.when(years > 0, years).otherwise(1))))


def count_audit(text: Column, split: Column) -> Column:
    """estimate, split_count, delta, needs_action (blocks with flags), dropped (never any) and
    drifted: whether the split is off by more than a twentieth."""
    estimate, n = estimated_count(F.coalesce(text, F.lit("")), split["way"]), F.size(split["blocks"])
    return F.struct(estimate.alias("estimate"), n.alias("split_count"), (n - estimate).alias("delta"), F.size(F.filter(materialized(split), lambda b: F.size(b["flags"]) > 0)).alias("needs_action"), F.lit(0).alias("dropped"), (F.abs(n - estimate) / estimate > 0.05).alias("drifted"))


def best_split(text: Column) -> Column:
    """split_blocks() of the text, or of its cleaned form where it looks like a copy from a
    PDF and splits better by BETTER. Adds used (baseline or cleaned) and quality."""
    quality = lambda s: split_quality(F.transform(s["blocks"], lambda b: b["text"]))
    made = lambda s, used: F.struct(s["way"].alias("way"), s["blocks"].alias("blocks"), F.lit(used).alias("used"), quality(s).alias("quality"))
    base = split_blocks(text)
    cleaned = F.when(looks_like_pdf(text), made(split_blocks(merge_soft_breaks(clean_pdf(text))), "cleaned"))
    return let(F.struct(made(base, "baseline").alias("base"), cleaned.alias("cleaned")), lambda x: F.when(F.coalesce(x["cleaned"]["quality"] >= x["base"]["quality"] + BETTER, F.lit(False)), x["cleaned"]).otherwise(x["base"]))
