"""Identity of works and clusters of duplicates over several keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers
from ..functions.text import key
from ..shared import cut
from .dedup import components, record_pairs


def work_key(doi: Column, url: Column, title: Column, year: Column, family: Column) -> Column:
    """doi:, else work: from title, year and first author (na where absent), else url:, else null."""
    digest = lambda c: F.substring(F.sha2(c, 256), 1, 24)
    known = F.coalesce(identifiers.doi(doi), identifiers.doi(url))
    when = F.coalesce(F.nullif(F.regexp_extract(year.cast("string"), r"\b((?:19|20)\d{2})\b", 1), F.lit("")), F.lit("na"))
    named = F.nullif(key(title), F.lit(""))
    by = F.coalesce(F.nullif(key(family), F.lit("")), F.lit("na"))
    work = F.when(named.isNotNull(), F.concat(F.lit("work:"), digest(F.concat_ws("|", named, when, by))))
    return F.coalesce(F.concat(F.lit("doi:"), known), work, F.concat(F.lit("url:"), digest(identifiers.url_key(url))))


def hints(doi: Column, url: Column, work: Column, raw: Column) -> Column:
    """Which keys can find a record's duplicates."""
    known = F.coalesce(identifiers.doi(doi), identifiers.doi(url))
    return F.array_compact(F.array(F.when(known.isNotNull(), "doi"), F.when(identifiers.url_key(url).isNotNull(), "url"), F.when(work.startswith("work:"), "title_author_year"), F.when(raw.isNotNull(), "raw_text")))


def key_links(df: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """(a, b): each record with the least id of every key that it has; so a key that any
    number of records share costs one row each."""
    each = df.select(F.col(id_col).alias("id"), F.explode(F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}\x1f"), F.col(k))) for k in keys]))).alias("k"))
    first = cut(each.groupBy("k").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").select("k", "a"), "first")
    return each.join(first, "k").where("id <> a").select("a", F.col("id").alias("b")).distinct()


#: The score told for each reason, whatever was measured.
NOMINAL = {"normalized_hash": 1.0, "doi_exact": 1.0, "canonical_work_key": 0.98, "minhash_lsh": 0.95}


def duplicate_clusters(df: DataFrame, id_col: str, score_col: str, keys: dict[str, str], text_col: str | None = None) -> DataFrame:
    """df's rows with cluster (the least id that shared keys reach), n_members, primary_id
    (of the highest score, the least id of equals) and reason: of the keys, in their order,
    the first that the row shares with its primary; minhash_lsh for none, null for the
    primary and for rows alone; and nominal_score, the reason's. With a text column
    near-equal texts link too. A cluster's members are its rows; they are never gathered."""
    links = key_links(df, id_col, list(keys))
    if text_col:
        links = links.unionByName(record_pairs(df, id_col, text_col).select("a", "b"))
    roots = components(links)
    rows = cut(df.join(roots.select(F.col("node").alias(id_col), F.col("root").alias("cluster")), id_col, "left").withColumn("cluster", F.coalesce("cluster", id_col)), "rows")
    best = cut(rows.groupBy("cluster").agg(F.count("*").alias("n_members"), F.max(F.struct(F.col(score_col).alias("s"), (-F.col(id_col)).alias("i"), *[F.col(k).alias(f"p_{k}") for k in keys])).alias("p")), "best")
    same = reduce(lambda out, k: F.when(F.col(k) == F.col(f"p.p_{k}"), keys[k]).otherwise(out), reversed(list(keys)), F.lit("minhash_lsh"))
    primary = -F.col("p.i")
    out = rows.join(best, "cluster").select(*df.columns, "cluster", "n_members", primary.alias("primary_id"), F.when(F.col(id_col) != primary, same).alias("reason"))
    return out.withColumn("nominal_score", F.create_map(*(F.lit(x) for kv in NOMINAL.items() for x in kv))[F.col("reason")])


def cluster_id(member_keys: Column) -> Column:
    """From the keys of all members, in order."""
    return F.concat(F.lit("near:"), F.substring(F.sha2(F.array_join(F.array_sort(member_keys), "|"), 256), 1, 24))


def promote_best(df: DataFrame, by: str, value: str, score: str, order: str, floor: float = 0.78) -> DataFrame:
    """Adds best (the value of the highest score among rows of a key, the first of equals)
    and its confidence, max(floor, score - 0.02). Rows without a key keep their own."""
    top = cut(df.where(F.col(by).isNotNull()).groupBy(by).agg(F.max_by(F.struct(F.col(value).alias("v"), F.col(score).alias("s")), F.struct(F.col(score), -F.col(order))).alias("t")), "top")
    out = df.join(top, by, "left")
    return out.select(*df.columns, F.coalesce("t.v", value).alias("best"), F.when(F.col("t").isNull(), F.col(score)).otherwise(F.greatest(F.lit(floor), F.col("t.s") - 0.02)).alias("best_confidence"))

