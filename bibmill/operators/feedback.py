"""What is known from elsewhere applied to citations: corrections in a fixed order, reviewed
truth by DOI, provider records under guard, and rows for training taken by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identifiers
from ..functions.validation import OVERWRITE_FLOOR
from .reference_types import CHAPTER_DOI, REPORT_DOI

# Fields whose change asks for a new text, who may correct in which order, and how sure hints from a DOI's form are.
RENDERED = ["authors", "title", "journal", "bookTitle", "conferenceTitle", "year", "volume", "issue", "pages", "articleNumber", "publisher", "doi", "url", "edition", "editors"]
ORDER = ["correction", "approved_truth", "insight", "consensus"]
CONFERENCE_DOI = r"10\.(?:14209/sbrt\.|21009/03\.|14293/s2199-ssp-|2991/assehr\.|37702/2175-957x\.cobenge\.|1049/cp\.|1109/[a-z][a-z0-9-]{2,}\d{4,}\.\d{4}\.)"
HINTS = [("conference-paper", CONFERENCE_DOI, 0.96, "authority_pack_conference_family"), ("book-chapter", CHAPTER_DOI, 0.93, "authority_pack_book_chapter_family"), ("report", REPORT_DOI, 0.95, "authority_pack_report_family"), ("report", r"10\.2172/", 0.92, "authority_pack_report_family")]
CALLS = 50
# End of the fixed values.


def by_key(rows: DataFrame, key: str) -> DataFrame:
    """key and corrections (structs of field and value, by field): of a key's corrections of
    one field the last by seq holds."""
    last = rows.where(F.col(key).isNotNull()).groupBy(key, "field").agg(F.max_by("value", "seq").alias("value"))
    return last.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("field", "value"))).alias("corrections"))


def correct(citations: DataFrame, sources: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """citations with applied_from, corrections, and rescore (none, health or render: whether a
    corrected field shows in the text). sources: name, key column and rows of that key,
    field, value and seq, in the order in which they are asked; the first that has
    something for a citation is used alone. A key's corrections are one row, made before
    the join, so that a hot key of citations is joined without gathering them."""
    out = citations
    for k, (name, key, rows) in enumerate(sources):
        out = out.join(by_key(rows, key).withColumnRenamed("corrections", f"_c{k}"), key, "left")
    found = F.coalesce(*(F.when(F.col(f"_c{k}").isNotNull(), F.struct(F.lit(name).alias("name"), F.col(f"_c{k}").alias("corrections"))) for k, (name, _, _) in enumerate(sources)))
    out = out.withColumn("_found", found).drop(*(f"_c{k}" for k in range(len(sources))))
    shown = F.exists("corrections", lambda c: c["field"].isin(RENDERED))
    out = out.select(*citations.columns, F.col("_found.name").alias("applied_from"), F.col("_found.corrections").alias("corrections"))
    return out.withColumn("rescore", F.when(F.col("corrections").isNull(), "none").when(shown, "render").otherwise("health"))


def doi_hint(doi: Column) -> Column:
    """type, confidence and reason of a DOI's form; null for one that tells nothing."""
    out = F.lit(None).cast("struct<type:string,confidence:double,reason:string>")
    for kind, pattern, sure, reason in reversed(HINTS):
        out = F.when(doi.rlike(pattern), F.struct(F.lit(kind).alias("type"), F.lit(sure).alias("confidence"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def authority_pack(rows: DataFrame, key: str, trust: str, seq: str, keep: list[str]) -> DataFrame:
    """Of each key the columns to keep of the row of the highest trust, the later one of equals."""
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*keep), F.struct(trust, seq)).alias("best"))
    return best.select(key, "best.*")


def doi_fast_path(dois: DataFrame, doi_col: str, truth: DataFrame) -> DataFrame:
    """dois with doi (normal, else lower case), status (verified by a reviewed record or absent),
    type, type_confidence, reasons, outcome. truth: doi (normal) and expected_type, one row a DOI."""
    raw = F.col(f"`{doi_col}`")
    rows = dois.withColumn("doi", F.coalesce(identifiers.doi(raw), F.lower(F.trim(raw))))
    known = truth.select("doi", F.col("expected_type").alias("_type"), F.lit(True).alias("_known"))
    out = rows.join(known, "doi", "left").withColumn("_hint", doi_hint(F.col("doi")))
    hit = F.coalesce("_known", F.lit(False))
    reasons = F.when(hit, F.array(F.lit("approved_truth_cache"))).otherwise(F.array_compact(F.array(F.lit("approved_truth_cache_miss"), F.col("_hint.reason"))))
    return out.select(
        *dois.columns, *([] if "doi" in dois.columns else ["doi"]), F.when(hit, "verified").otherwise("absent").alias("status"), F.when(hit, F.col("_type")).otherwise(F.col("_hint.type")).alias("type"), F.when(hit & F.col("_type").isNotNull(), 1.0).when(~hit, F.col("_hint.confidence")).alias("type_confidence"),
        reasons.alias("reasons"), F.when(hit, "high_confidence_parse").otherwise("partial_parse_with_abstentions").alias("outcome"),
    )


def enrich(citations: DataFrame, job: str, key: str, order: str, records: DataFrame, fields: list[str], agrees: Column) -> DataFrame:
    """citations joined with a provider's records by key (records has it, a confidence, and a
    column new_<field> for each field): filled and overwritten fields, blocked ones of
    records that don't agree, and asked. A job asks for CALLS different keys at most, those
    of the least order; a key counts once however many rows ask for it, and is ranked
    after that, so that a job of very many rows is no large group."""
    wanted = citations.where(F.col(key).isNotNull()).groupBy(job, key).agg(F.min(order).alias("_first"))
    allowed = wanted.withColumn("_rank", F.row_number().over(Window.partitionBy(job).orderBy("_first", key))).where(F.col("_rank") <= CALLS).select(job, key, F.lit(True).alias("asked"))
    out = citations.join(allowed, [job, key], "left").join(records.withColumn("_hit", F.lit(True)), key, "left")
    hit = F.coalesce(F.col("asked") & F.col("_hit"), F.lit(False))
    ok, sure = hit & F.coalesce(agrees, F.lit(False)), F.col("confidence") >= OVERWRITE_FLOOR
    filled = lambda f: ok & F.col(f).isNull() & F.col(f"new_{f}").isNotNull()
    changed = lambda f: ok & sure & F.col(f).isNotNull() & F.col(f"new_{f}").isNotNull() & (F.col(f) != F.col(f"new_{f}"))
    listed = lambda on: F.array_compact(F.array(*(F.when(F.coalesce(on(f), F.lit(False)), F.lit(f)) for f in fields)))
    others = [c for c in citations.columns if c not in fields]
    return out.select(
        *others, *(F.when(F.coalesce(filled(f) | changed(f), F.lit(False)), F.col(f"new_{f}")).otherwise(F.col(f)).alias(f) for f in fields), F.coalesce("asked", F.lit(False)).alias("asked"), hit.alias("hit"), listed(filled).alias("filled"), listed(changed).alias("overwritten"),
        F.when(hit & ~F.coalesce(agrees, F.lit(False)), listed(lambda f: F.col(f"new_{f}").isNotNull())).otherwise(F.array().cast("array<string>")).alias("blocked"),
    )


def balanced(df: DataFrame, kinds: list[str], kind: str, id_col: str, good: Column, target: int) -> DataFrame:
    """target rows, of each kind as many, the first kinds one more for the remainder, by id;
    what kinds without enough rows leave free goes to others' next rows, in the order of
    kinds. Only good rows count. Counts decide how far each kind is filled up, so that
    ranking within a kind is the only window."""
    quota = {k: target // len(kinds) + (i < target % len(kinds)) for i, k in enumerate(kinds)}
    rows = df.where(good & F.col(kind).isin(kinds))
    counts = {r[kind]: r["n"] for r in rows.groupBy(kind).agg(F.count("*").alias("n")).collect()}  # one a kind
    take = {k: min(quota[k], counts.get(k, 0)) for k in kinds}
    free = target - sum(take.values())
    for k in kinds:
        more = min(free, counts.get(k, 0) - take[k])
        take[k], free = take[k] + more, free - more
    limit = F.create_map(*(F.lit(v) for kv in take.items() for v in kv))[F.col(kind)]
    most = max([*take.values(), 0])
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(kind).orderBy(id_col)))
    return ranked.where((F.col("_rank") <= limit) & (F.col("_rank") <= most)).drop("_rank")


def group_split(df: DataFrame, group: str, seed: str, shares: dict[str, float]) -> DataFrame:
    """df with split: groups in the order of their hashes, cut by exact shares of the number of
    groups. Ranks come from counts of hash buckets, so no window holds all groups."""
    groups = df.select(group).distinct().withColumn("_h", F.sha2(F.concat_ws("|", F.col(group).cast("string"), F.lit(seed)), 256)).withColumn("_b", F.substring("_h", 1, 3))
    sizes = {r["_b"]: r["n"] for r in groups.groupBy("_b").agg(F.count("*").alias("n")).collect()}  # 4096 at most
    total, before, at = sum(sizes.values()), {}, 0
    for b in sorted(sizes):
        before[b], at = at, at + sizes[b]
    if not total:
        return df.withColumn("split", F.lit(None).cast("string"))
    start = groups.sparkSession.createDataFrame(list(before.items()), "_b string, _start long")
    ranked = groups.join(F.broadcast(start), "_b").withColumn("_rank", F.row_number().over(Window.partitionBy("_b").orderBy("_h", group)) - 1 + F.col("_start"))
    names, edge, cut = list(shares), 0.0, None
    for name in names:
        edge += shares[name]
        here = F.lit(name)
        cut = F.when(F.col("_rank") < round(edge * total), here) if cut is None else cut.when(F.col("_rank") < round(edge * total), here)
    return df.join(ranked.select(group, cut.otherwise(F.lit(names[-1])).alias("split")), group)


def staged_pack(df: DataFrame, id_col: str, target: Column, path: str) -> dict:
    """Writes the rows that target takes as JSON lines in the order of their ids, and returns a
    manifest: rows and a hash over the rows' own hashes, which doesn't hang on how files
    are cut; each task adds up its rows, and nothing but the sums comes to the driver."""
    rows = df.where(target)
    line = F.to_json(F.struct(*sorted(rows.columns)))
    rows.orderBy(id_col).select(line.alias("value")).write.text(path)
    told = rows.select(F.sha2(line, 256).alias("h")).agg(F.count("*").alias("rows"), *(F.coalesce(F.sum(F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")), F.lit(0)).alias(f"h{k}") for k in range(8))).first()
    digest = "".join(f"{int(told[f'h{k}']) % (1 << 32):08x}" for k in range(8))
    return {"row_count": told["rows"], "sha256_sum": digest, "path": path}
