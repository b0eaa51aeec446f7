"""Upkeep of processed citations: authority flags and rechecks, health rollups, summaries of
batches, recovery of those that need action, retention, and frozen selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identifiers
from ..functions.bind import let

# What flags cost, words that tell them in a text, days until a recheck, and limits of lookups and selections.
PENALTIES = {"retracted": -45, "expression_of_concern": -25, "author_conflict": -10, "metadata_mismatch": -10}
TOLD = {"retracted": "retracted", "expression_of_concern": "expression of concern"}
RECHECK_DAYS, LOOKUPS, KEEP_HOURS = 30, 100, 24
# End of the fixed values.


def told_flags(raw: Column, title: Column) -> Column:
    """Flags that a citation's own words tell."""
    text = F.lower(F.concat_ws(" ", raw, title))
    return F.array_compact(F.array(*(F.when(text.contains(words), flag) for flag, words in TOLD.items())))


def authority_flags(citations: DataFrame, doi_col: str, raw_col: str, title_col: str, notices: DataFrame, conflicts: Column, at: Column) -> DataFrame:
    """citations with flags (structs of type, source and date), adjustment and next_recheck.
    notices: doi (normal), retracted, expression_of_concern, date; of several of a DOI the
    flags add up and the latest date holds. conflicts: an array of further flag types."""
    known = notices.groupBy("doi").agg(F.max("retracted").alias("_r"), F.max("expression_of_concern").alias("_e"), F.max("date").alias("_d"))
    out = citations.withColumn("_doi", identifiers.doi(F.col(doi_col))).join(known.withColumnRenamed("doi", "_doi"), "_doi", "left")
    none = F.lit(None).cast("date")
    flag = lambda kind, source, date: F.struct(F.lit(kind).alias("type"), F.lit(source).alias("source"), date.cast("date").alias("date"))
    told = told_flags(F.col(raw_col), F.col(title_col))
    one = lambda kind, c: F.when(F.coalesce(F.col(c), F.lit(False)), flag(kind, "notice", F.col("_d"))).when(F.array_contains(told, kind), flag(kind, "heuristic", none))
    more = F.transform(F.coalesce(conflicts, F.array().cast("array<string>")), lambda c: F.struct(c.alias("type"), F.lit("provider").alias("source"), none.alias("date")))
    flags = F.concat(F.array_compact(F.array(one("retracted", "_r"), one("expression_of_concern", "_e"))), more)
    cost = F.create_map(*(F.lit(x) for kv in PENALTIES.items() for x in kv))
    out = out.withColumn("flags", flags)
    return out.select(*citations.columns, "flags", F.aggregate("flags", F.lit(0), lambda n, f: n + F.coalesce(cost[f["type"]], F.lit(0))).alias("adjustment"), F.date_add(at.cast("date"), RECHECK_DAYS).alias("next_recheck"))


def recheck_counts(citations: DataFrame, flags: Column, raw: Column, title: Column) -> DataFrame:
    """reviewed and flagged: all citations, and those with flags or words that tell them."""
    seen = (F.coalesce(F.size(flags), F.lit(0)) > 0) | (F.size(told_flags(raw, title)) > 0)
    return citations.agg(F.count("*").alias("reviewed"), F.coalesce(F.sum(seen.cast("int")), F.lit(0)).alias("flagged"))


def health_rollup(df: DataFrame, style: str, kind: str, status: str, scores: list[str]) -> DataFrame:
    """grouped_by (style, type, status or all), value, n and the mean of each score: all groupings in one pass."""
    sets = df.select(F.col(style).alias("_s"), F.col(kind).alias("_k"), F.col(status).alias("_t"), *scores)
    grouped = sets.groupingSets([["_s"], ["_k"], ["_t"], []], "_s", "_k", "_t").agg(F.grouping("_s").alias("gs"), F.grouping("_k").alias("gk"), F.grouping("_t").alias("gt"), F.count("*").alias("n"), *(F.avg(c).alias(c) for c in scores))
    by = F.when(F.col("gs") == 0, "style").when(F.col("gk") == 0, "type").when(F.col("gt") == 0, "status").otherwise("all")
    value = F.when(F.col("gs") == 0, F.col("_s")).when(F.col("gk") == 0, F.col("_k")).when(F.col("gt") == 0, F.col("_t"))
    return grouped.select(by.alias("grouped_by"), value.alias("value"), "n", *scores)


def reason_counts(df: DataFrame, arrays: dict[str, str]) -> DataFrame:
    """kind, code and n over arrays of codes, by kind: missing and invalid fields, reasons."""
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("codes")) for k, c in arrays.items()))
    rows = df.select(F.explode(each).alias("x")).select("x.kind", F.explode("x.codes").alias("code"))
    return rows.groupBy("kind", "code").agg(F.count("*").alias("n"))


def batch_summaries(citations: DataFrame, reports: DataFrame, batch: str, citation: str, status: str, at: str) -> DataFrame:
    """A row a batch: counts by status and of open reports (pending, proposed), flagged
    citations (not ready or with an open report), latest_actionable, label, source of the
    queue and in_queue. reports: citation, report_status and reported_at; they are added
    up by citation before the join."""
    open_ = reports.where(F.col("report_status").isin("pending", "proposed")).groupBy(citation).agg(F.sum((F.col("report_status") == "pending").cast("int")).alias("_pending"), F.sum((F.col("report_status") == "proposed").cast("int")).alias("_proposed"), F.max("reported_at").alias("_at"))
    rows = citations.join(open_, citation, "left")
    ready, n = F.coalesce(F.col(status) == "ready", F.lit(False)), lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = rows.groupBy(batch).agg(
        F.count("*").alias("citations"), n(ready).alias("ready"), n(F.col(status) == "needs_review").alias("needs_review"), n(F.col(status) == "needs_action").alias("needs_action"), n(~ready | F.col("_at").isNotNull()).alias("flagged"), zero("_pending").alias("pending"), zero("_proposed").alias("proposed"),
        F.greatest(F.max(F.when(~ready, F.col(at))), F.max("_at")).alias("latest_actionable"),
    )
    told, flags = F.col("pending") + F.col("proposed") > 0, (F.col("needs_action") > 0) | (F.col("needs_review") > 0)
    label = F.when(F.col("needs_action") > 0, "Action Needed").when((F.col("needs_review") > 0) | told, "Review").otherwise("Ready")
    source = F.when(flags & told, "both").when(told, "reports_only").when(flags, "pipeline_only").otherwise("none")
    return out.select("*", label.alias("label"), source.alias("queue_source"), (F.col("flagged") > 0).alias("in_queue"))


def recovered(citations: DataFrame, key: str, order: str, status: str, records: DataFrame, complete: Column) -> DataFrame:
    """citations with looked_up and status: of those that need action the LOOKUPS first by order
    are looked up among records (by key, one row each), and become ready where the record
    is there and complete holds. The first are found by a top-k, not by sorting all."""
    first = citations.where((F.col(status) == "needs_action") & F.col(key).isNotNull()).select(F.col(order)).orderBy(order).limit(LOOKUPS).withColumn("looked_up", F.lit(True))
    out = citations.join(F.broadcast(first), order, "left").join(records.withColumn("_hit", F.lit(True)), key, "left")
    good = F.coalesce(F.col("looked_up") & F.col("_hit") & complete, F.lit(False))
    return out.select(*(c for c in citations.columns if c != status), F.coalesce("looked_up", F.lit(False)).alias("looked_up"), F.when(good, "ready").otherwise(F.col(status)).alias(status))


def without_expired(jobs: DataFrame, completed: str, exports: str, now: Column) -> DataFrame:
    """jobs whose exports are emptied KEEP_HOURS after they were done, with removed, how many went; open jobs keep theirs."""
    old = F.coalesce(F.col(completed) <= now - F.expr(f"INTERVAL {KEEP_HOURS} HOURS"), F.lit(False))
    empty = F.array().cast("array<string>")
    return jobs.select(*(c for c in jobs.columns if c != exports), F.when(old, empty).otherwise(F.col(exports)).alias(exports), F.when(old, F.coalesce(F.size(exports), F.lit(0))).otherwise(0).alias("removed"))


def frozen(df: DataFrame, style: str, role: str, id_col: str, targets: dict[str, int]) -> DataFrame:
    """The rows of the least ids, as many of each style and role as the role's target says."""
    rows = df.where(F.col(role).isin(*targets))
    limit = F.create_map(*(F.lit(x) for kv in targets.items() for x in kv))[F.col(role)]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(style, role).orderBy(id_col))).where(F.col("_n") <= limit).drop("_n")


def freeze_gates(selected: DataFrame, style: str, role: str, kind: str, source: str, targets: dict[str, int], min_kinds: int, max_share: float) -> DataFrame:
    """code, subject, required and found of what a frozen selection lacks: rows of a style and
    role, different types of a style's, or too large a share of one source."""
    by = selected.groupBy(style, role).agg(F.count("*").alias("n"), F.countDistinct(kind).alias("kinds"))
    need = F.create_map(*(F.lit(x) for kv in targets.items() for x in kv))[F.col(role)]
    told = lambda code, subject, required, found: F.struct(F.lit(code).alias("code"), subject.alias("subject"), required.cast("double").alias("required"), found.cast("double").alias("found"))
    name = F.concat_ws(":", style, role)
    each = by.select(F.explode(F.array_compact(F.array(F.when(F.col("n") < need, told("TOO_FEW_ROWS", name, need, F.col("n"))), F.when(F.col("kinds") < min_kinds, told("TYPE_DIVERSITY", name, F.lit(min_kinds), F.col("kinds")))))).alias("x")).select("x.*")
    total = selected.agg(F.count("*").alias("_all"))
    share = selected.groupBy(source).agg(F.count("*").alias("n")).join(F.broadcast(total), F.lit(True)).withColumn("share", F.col("n") / F.col("_all"))  # one row
    return each.unionByName(share.where(F.col("share") > max_share).select(told("SOURCE_BALANCE", F.col(source).cast("string"), F.lit(max_share), F.col("share")).alias("x")).select("x.*"))


def candidate_slots(values: dict[str, tuple[str, Column, Column, Column]], most: int = 3) -> Column:
    """Structs of slot and candidates (text, score and source, best first, most of each, no
    text twice). values: by field its slot, text, score and source; blank texts are none."""
    slots: dict[str, list[Column]] = {}
    for slot, text, score, source in values.values():
        plain = F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))
        slots.setdefault(slot, []).append(F.when(plain.isNotNull(), F.struct((-score).alias("low"), plain.alias("text"), source.alias("source"))))

    def ranked(cs: list[Column]) -> Column:
        def once(x: Column) -> Column:
            return F.filter(x, lambda c, i: ~F.exists(F.slice(x, F.lit(1), i), lambda o: F.lower(o["text"]) == F.lower(c["text"])))

        return F.transform(F.slice(let(F.array_sort(F.array_compact(F.array(*cs))), once), 1, most), lambda c: F.struct(c["text"].alias("text"), (-c["low"]).alias("score"), c["source"].alias("source")))

    return F.array(*(F.struct(F.lit(k).alias("slot"), ranked(cs).alias("candidates")) for k, cs in slots.items()))


def provider_key(provider: Column, lookup: Column) -> Column:
    """The key under which a lookup is made once."""
    return F.concat(F.lit("provider:"), F.substring(F.sha2(F.concat_ws("|", provider, lookup), 256), 1, 32))


def italic_segments(text: Column) -> Column:
    """Structs of text and italic: what stands between two stars or two underscores is."""
    parts = F.regexp_extract_all(text, F.lit(r"(\*[^*]+\*|_[^_]+_|[^*_]+|[*_])"), F.lit(1))
    marked = lambda p: p.rlike(r"^(?:\*[^*]+\*|_[^_]+_)$")

    def step(done: Column, p: Column) -> Column:
        last = F.element_at(done, -1)
        new = F.when(marked(p), F.struct(F.substring(p, F.lit(2), F.length(p) - 2).alias("text"), F.lit(True).alias("italic"))).otherwise(F.struct(p.alias("text"), F.lit(False).alias("italic")))
        glue = (F.size(done) > 0) & ~F.coalesce(last["italic"], F.lit(True)) & ~marked(p)
        return F.when(glue, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(F.concat(last["text"], p).alias("text"), F.lit(False).alias("italic"))))).otherwise(F.concat(done, F.array(new)))

    made = F.aggregate(parts, F.array().cast("array<struct<text:string,italic:boolean>>"), step)
    return F.when(F.size(parts) > 0, made).otherwise(F.array(F.struct(text.alias("text"), F.lit(False).alias("italic"))))
