"""The best member of each cluster: vetoes first, then quality, then what the record holds.

Each veto takes members out only where others are left, so it is a rank of its own in
one struct; the winner is the largest struct of its cluster, which is one aggregation
with partial results before the shuffle.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts for and against a member.
CORE, YEAR, NO_YEAR, FIELD, FIELDS_MOST, DETAIL, DETAIL_MOST, VENUE, AUTHORITY = 25, 8, -40, 2, 15, 4, 30, 6, 5
FULL_JOURNAL, SHORT_JOURNAL, JOURNAL_WORD, LOCATED, UNLOCATED = 6, -6, 8, 8, -6
NO_AUTHORS, AUTHORS_MOST, RICH, POOR, ET_AL, FAILED, ERROR, WARNING = -10, 6, 8, -8, -25, -20, -8, -3
# End of the fixed values.

ET_AL_NAME, ABBREVIATION = r"(?i)\bet\.?\s+al\b", r"^(?:\p{Lu}[\p{L}]{0,6}\.?)(?:\s+\p{Lu}[\p{L}]{0,6}\.?)+$"


def has_et_al(authors: Column) -> Column:
    return F.coalesce(F.exists(authors, lambda a: a.rlike(ET_AL_NAME)), F.lit(False))


def author_detail(authors: Column) -> Column:
    """Parts of the given names of all authors, initials counting one each."""
    return F.coalesce(F.aggregate(authors, F.lit(0), lambda n, a: n + F.greatest(F.lit(1), F.regexp_count(F.regexp_replace(a, r"^[^,]*,", ""), F.lit(r"\p{Lu}")))), F.lit(0))


def member_quality(m: dict[str, Column]) -> Column:
    """Points of a member. m: score, title, year, authors (array of Family, Given strings),
    journal, container, pages, volume, fields (how many are filled), warnings (array of
    error: and warning: strings), style_failed and authority (booleans)."""
    has = lambda k: F.coalesce(F.trim(m[k].cast("string")) != "", F.lit(False))
    n, detail = F.coalesce(F.size(m["authors"]), F.lit(0)), author_detail(m["authors"])
    journal, located = F.coalesce(m["journal"], F.lit("")), has("pages")
    on = lambda c, points, other=0: F.when(F.coalesce(c, F.lit(False)), points).otherwise(other)
    core = reduce(add, [c.cast("int") for c in (has("title"), has("year"), n > 0, has("journal") | has("container"), has("pages") | has("volume"))])
    told = lambda kind: F.coalesce(F.size(F.filter(m["warnings"], lambda w: w.startswith(kind))), F.lit(0))
    return (
        F.coalesce(m["score"], F.lit(0)) + F.round(core / 5 * CORE) + on(has("year"), YEAR, NO_YEAR) + F.least(F.lit(FIELDS_MOST), m["fields"] * FIELD) + F.least(F.lit(DETAIL_MOST), detail * DETAIL) + on(has("container") & ~has("journal"), VENUE)
        + on(has("journal"), on(journal.rlike(ABBREVIATION), SHORT_JOURNAL, FULL_JOURNAL)) + on(journal.rlike(r"(?i)\bjournal\b"), JOURNAL_WORD) + on(has("journal") & has("volume"), on(located, LOCATED, UNLOCATED))
        + on(n == 0, NO_AUTHORS, F.least(F.lit(AUTHORS_MOST), n)) + on((n > 0) & (detail / F.greatest(n, F.lit(1)) >= 1.8), RICH) + on((n > 0) & (detail / F.greatest(n, F.lit(1)) <= 1.05), POOR) + on(has_et_al(m["authors"]), ET_AL)
        + on(m["style_failed"], FAILED) + told("error:") * ERROR + told("warning:") * WARNING + on(m["authority"], AUTHORITY)
    ).cast("double")


def cluster_winners(df: DataFrame, cluster: str, id_col: str, m: dict[str, Column], conference: Column) -> DataFrame:
    """cluster, winner (an id), quality, n and reasons: what an authority confirmed comes
    first, then what has a detected style, a year, all authors, a conference's type; then
    quality, score, filled fields, and the least id. A reason stands where it told
    members apart, that of an authority wherever the winner has one. Null clusters are left out."""
    c = lambda x: F.coalesce(x, F.lit(False))
    vetoes = {"authority-validated override": c(m["authority"]), "excluded styleDetectionFailed records": ~c(m["style_failed"]), "prefer records with year": F.coalesce(F.trim(m["year"].cast("string")) != "", F.lit(False)), "prefer full author list over et al.": ~has_et_al(m["authors"]), "prefer conference-typed records": c(conference)}
    quality = member_quality(m)
    rank = F.struct(*(v.alias(f"v{k}") for k, v in enumerate(vetoes.values())), quality.alias("quality"), F.coalesce(m["score"].cast("double"), F.lit(0.0)).alias("score"), m["fields"].alias("fields"), (-F.col(f"`{id_col}`")).alias("order"))
    rows = df.where(F.col(f"`{cluster}`").isNotNull()).select(F.col(f"`{cluster}`").alias("cluster"), rank.alias("rank"))
    path = F.concat(*(F.when(F.col(f"rank.v{k}"), "1").otherwise("0") for k in range(len(vetoes))))
    # at most 2^5 paths a cluster
    best = rows.groupBy("cluster").agg(F.max("rank").alias("best"), F.count("*").alias("n"), F.collect_set(path).alias("paths"), F.max_by(path, "rank").alias("path"))

    def told_apart(k: int) -> Column:
        other = F.exists("paths", lambda p: (F.left(p, F.lit(k)) == F.left(F.col("path"), F.lit(k))) & (F.substring(p, k + 1, 1) == "0"))
        return (F.substring("path", k + 1, 1) == "1") & (other if k else F.lit(True))

    return best.select("cluster", (-F.col("best.order")).alias("winner"), F.col("best.quality").alias("quality"), "n", F.array_compact(F.array(*(F.when(told_apart(k), F.lit(label)) for k, label in enumerate(vetoes)))).alias("reasons"))
