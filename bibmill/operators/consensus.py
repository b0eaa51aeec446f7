"""Spans of fields on raw references: agreement between sources, tags for tokens, and
fields found again in the text.

A span is a struct of label, start and end (characters, end excluded). All of it
happens within a reference's row, on arrays as long as the reference has fields.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.text import comparable
from .citation_features import places

#: How much two spans share to be one, to agree on their bounds, and how much agreement makes gold.
OVERLAP, BOUNDARY, GOLD = 0.5, 0.8, 1.0
#: What is one token: an address, a DOI, a number or range, a word, a mark.
TOKEN = r"https?://\S+|10\.\d{4,9}/\S+|[A-Za-z]?\d+(?:-\d+)?|[A-Za-z]+(?:'[A-Za-z]+)?|[^\w\s]"
#: How alike a window of words must be to a field's value to be it.
FUZZY = 0.75
SPAN, CONFLICT = "struct<label:string,start:int,end:int>", "struct<kind:string,label:string,start:int,end:int>"


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two spans."""
    both = F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))
    return F.when(both > 0, both / (a["end"] - a["start"] + b["end"] - b["start"] - both)).otherwise(0.0)


def paired(mine: Column, theirs: Column) -> Column:
    """pairs (a, b, share) and only_a and only_b: each of mine, in order, takes the one of
    theirs with its label that it shares most with and that none before took; the first of equals."""
    pair = f"struct<a:{SPAN},b:{SPAN},share:double>"
    zero = F.struct(F.array().cast(f"array<{pair}>").alias("pairs"), F.array().cast(f"array<{SPAN}>").alias("only_a"), F.array().cast("array<int>").alias("used"))

    def step(s: Column, a: Column) -> Column:
        tried = F.transform(theirs, lambda b, i: F.struct(F.when((b["label"] == a["label"]) & ~F.array_contains(s["used"], i), overlap(a, b)).otherwise(0.0).alias("share"), (-i).alias("order"), b.alias("b")))

        def told(best: Column) -> Column:
            met = F.coalesce(best["share"] >= OVERLAP, F.lit(False))
            new = F.array(F.struct(a.alias("a"), best["b"].alias("b"), best["share"].alias("share")))
            return F.when(met, F.struct(F.concat(s["pairs"], new).alias("pairs"), s["only_a"].alias("only_a"), F.concat(s["used"], F.array(-best["order"])).alias("used"))).otherwise(F.struct(s["pairs"].alias("pairs"), F.concat(s["only_a"], F.array(a)).alias("only_a"), s["used"].alias("used")))

        return let(F.array_max(tried), told)

    left = lambda s: F.filter(theirs, lambda b, i: ~F.array_contains(s["used"], i))
    return F.aggregate(mine, zero, step, lambda s: F.struct(s["pairs"].alias("pairs"), s["only_a"].alias("only_a"), left(s).alias("only_b")))


def conflict(kind: str, span: Column, label: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (span["label"] if label is None else label).alias("label"), span["start"].cast("int").alias("start"), span["end"].cast("int").alias("end"))


def around(a: Column, b: Column) -> Column:
    return F.struct(a["label"].alias("label"), F.least(a["start"], b["start"]).alias("start"), F.greatest(a["end"], b["end"]).alias("end"))


def label_conflicts(mine: Column, theirs: Column) -> Column:
    met = F.flatten(F.transform(mine, lambda a: F.transform(F.filter(theirs, lambda b: (a["label"] != b["label"]) & (overlap(a, b) >= OVERLAP)), lambda b: conflict("label_mismatch", around(a, b), F.concat(a["label"], F.lit("≠"), b["label"])))))
    return met


def span_consensus(first: Column, second: Column, truth: Column | None = None) -> Column:
    """decision (auto_gold or needs_review), agreement, agreed and conflicts of two sources'
    spans, and with a truth (null where a row has none) of what they agree on and it.
    Spans agree that share OVERLAP, with bounds that share BOUNDARY; two labels on one
    place are never gold. Null spans are none."""
    spans = lambda c: F.coalesce(c.cast(f"array<{SPAN}>"), F.array().cast(f"array<{SPAN}>"))
    a, b = spans(first), spans(second)
    of = lambda kind: lambda x: conflict(kind, x)

    def against(p: Column) -> Column:
        agreed = F.transform(F.filter(p["pairs"], lambda x: x["share"] >= BOUNDARY), lambda x: x["a"])
        drift = F.transform(F.filter(p["pairs"], lambda x: x["share"] < BOUNDARY), lambda x: conflict("boundary_mismatch", around(x["a"], x["b"])))
        return F.struct(agreed.alias("agreed"), F.concat(label_conflicts(a, b), F.transform(p["only_a"], of("missing_in_second")), F.transform(p["only_b"], of("missing_in_first")), drift).alias("conflicts"))

    def backed(s: Column) -> Column:
        if truth is None:
            return s
        held = let(paired(s["agreed"], spans(truth)), lambda p: F.struct(
            F.transform(F.filter(p["pairs"], lambda x: x["share"] >= BOUNDARY), lambda x: x["a"]).alias("agreed"),
            F.concat(s["conflicts"], F.transform(p["only_a"], of("missing_in_truth")), F.transform(p["only_b"], of("extra_span"))).alias("conflicts")))
        return F.when(truth.isNotNull(), held).otherwise(s)

    def decided(s: Column) -> Column:
        most = F.greatest(F.size(a), F.size(b), F.size(spans(truth)) if truth is not None else F.lit(0), F.size(s["agreed"]))
        share = F.when(most == 0, 1.0).otherwise(F.size(s["agreed"]) / most)
        gold = ~F.exists(s["conflicts"], lambda x: x["kind"] == "label_mismatch") & (share >= GOLD)
        return F.struct(F.when(gold, "auto_gold").otherwise("needs_review").alias("decision"), F.round(share, 4).alias("agreement"), s["agreed"].alias("agreed"), s["conflicts"].alias("conflicts"))

    return let(let(let(paired(a, b), against), backed), decided)


def span_problem(text: Column, spans: Column) -> Column:
    """Why spans can't be used: out of the text, empty, or one inside another; null if they can."""
    sorted_ = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    out = F.exists(spans, lambda s: (s["start"] < 0) | (s["end"] <= s["start"]) | (s["end"] > F.length(text)))
    crossed = let(sorted_, lambda x: F.exists(F.transform(x, lambda s, i: (i > 0) & F.coalesce(s["start"] < F.get(x, i - 1)["end"], F.lit(False))), lambda c: c))
    return F.when(F.coalesce(out, F.lit(True)), "invalid span range").when(crossed, "overlapping spans")


def bio_tokens(text: Column, spans: Column) -> Column:
    """Structs of token, start, end and tag. A token within a span has its field's tag: B-
    unless the token before has the same field, then I-; others have O."""
    told = F.transform(places(text, TOKEN), lambda t: F.struct(t["hit"].alias("token"), t["at"].alias("start"), (t["at"] + F.length(t["hit"])).alias("end")))
    with_field = F.transform(told, lambda t: F.struct(t["token"].alias("token"), t["start"].alias("start"), t["end"].alias("end"), F.get(F.filter(spans, lambda s: (t["start"] >= s["start"]) & (t["end"] <= s["end"])), F.lit(0))["label"].alias("field")))

    def tagged(x: Column) -> Column:
        def tag(t: Column, i: Column) -> Column:
            same = F.coalesce(F.get(x, i - 1)["field"] == t["field"], F.lit(False)) & (i > 0)
            return F.struct(t["token"].alias("token"), t["start"].alias("start"), t["end"].alias("end"), F.when(t["field"].isNull(), "O").otherwise(F.concat(F.when(same, "I-").otherwise("B-"), t["field"])).alias("tag"))

        return F.transform(x, tag)

    return let(with_field, tagged)


def project_fields(text: Column, fields: Column) -> Column:
    """Structs of label, start, end, method and score for structs of label and value, each
    outside what those before it took: where the value stands as it is (exact), without
    regard to case and marks between words (normalized), or the run of as many words
    that shares FUZZY of its words (fuzzy); else unmatched, from 0 to 0."""
    made = "struct<label:string,start:int,end:int,method:string,score:double>"
    found = lambda label, start, end, method, score: F.struct(label.alias("label"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(method).alias("method"), score.alias("score"))

    def with_words(words: Column) -> Column:
        def step(done: Column, f: Column) -> Column:
            free = lambda start, end: ~F.exists(done, lambda d: (d["method"] != "unmatched") & (start < d["end"]) & (d["start"] < end))
            n = F.length(f["value"])
            value = F.filter(F.split(comparable(f["value"]), " "), lambda w: w != "")

            def windows(v: Column) -> Column:
                k = F.size(v)
                spans = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), lambda i: (k > 0) & (i + k <= F.size(words))), lambda i: F.struct(F.get(words, i)["at"].alias("start"), (F.get(words, i + k - 1)["at"] + F.length(F.get(words, i + k - 1)["hit"])).alias("end"), F.transform(F.slice(words, i + 1, k), lambda w: F.lower(w["hit"])).alias("w")))
                open_ = F.filter(spans, lambda s: free(s["start"], s["end"]))

                def scored(s: Column) -> Column:
                    same = s["w"] == v
                    share = F.size(F.array_intersect(s["w"], v)) / F.greatest(F.size(F.array_distinct(v)), F.size(F.array_distinct(s["w"])))
                    as_is = F.substring(text, s["start"] + 1, s["end"] - s["start"])
                    whole = same & F.coalesce(F.instr(f["value"], as_is) > 0, F.lit(False))
                    # marks before or after the words of a value belong to it
                    lead = F.when(whole, F.instr(f["value"], as_is) - 1).otherwise(0)
                    start, end = F.greatest(F.lit(0), s["start"] - lead), F.when(whole, s["start"] - lead + n).otherwise(s["end"])
                    is_exact = F.substring(text, start + 1, end - start) == f["value"]
                    return F.struct(F.when(is_exact, 3).when(same, 2).when(share >= FUZZY, 1).otherwise(0).alias("grade"), share.alias("score"), (-s["start"]).alias("order"), F.when(is_exact, start).otherwise(s["start"]).alias("start"), F.when(is_exact, end).otherwise(s["end"]).alias("end"))

                return F.array_max(F.transform(open_, scored))

            def told(b: Column) -> Column:
                return F.when(b["grade"] == 3, found(f["label"], b["start"], b["end"], "exact", F.lit(1.0))).when(b["grade"] == 2, found(f["label"], b["start"], b["end"], "normalized", F.lit(1.0))).when(b["grade"] == 1, found(f["label"], b["start"], b["end"], "fuzzy", b["score"])).otherwise(found(f["label"], F.lit(0), F.lit(0), "unmatched", F.lit(0.0)))

            return F.concat(done, F.array(let(let(value, windows), told)))

        return F.aggregate(fields, F.array().cast(f"array<{made}>"), step)

    return let(places(text, r"[\p{L}\p{N}]+"), with_words)
