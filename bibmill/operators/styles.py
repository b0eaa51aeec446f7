"""Which style a citation is rendered in, and smoothing of detected styles over a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .detect import dominant

#: Thresholds of style decisions.
FAMILY_COMMIT, GROUPS, MIN_BATCH = 0.67, 3, 5
FAMILY_SHARE, FAMILY_BOOST, FAMILY_CAP = 0.7, 0.05, 0.85
STYLE_SHARE, LEAD, FLOOR, STYLE_MARGIN = 0.8, 0.03, 0.58, 0.12
HIGH_FAMILY, HIGH_MARGIN, COMMIT_FAMILY, COMMIT_STYLE = 0.85, 0.18, 0.75, 0.6
SURE, UNSURE, DEFAULT = 0.9, 0.65, "apa7"
#: Weights of a rendered text's parts.
PARTS = {"title": 0.28, "authors": 0.22, "year": 0.12, "container": 0.14, "volume": 0.08, "issue": 0.06, "locator": 0.06, "identifier": 0.04}


def known(style: Column) -> Column:
    return F.coalesce(~style.isin("auto", "unknown"), F.lit(False))


def resolve_style(requested: Column, detected: Column, confidence: Column, uncertain: Column, by_doi: Column) -> Column:
    """style, source, confidence and uncertain: a requested style comes first, then the
    detected one. A lookup by DOI changes the source's name alone."""
    raw = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.0))))
    style = F.when(known(requested), requested).when(known(detected), detected).otherwise(DEFAULT)
    source = F.when(by_doi, "doi_fast_path").when(known(requested), "requested").when(known(detected), "detected").otherwise("default")
    unsure = uncertain | F.coalesce(detected == "unknown", F.lit(True)) | (raw < UNSURE)
    return F.struct(style.alias("style"), source.alias("source"), F.greatest(raw, F.lit(SURE)).alias("confidence"), unsure.alias("uncertain"))


def tier(family_confidence: Column, margin: Column, style: Column) -> Column:
    return F.when((style != "unknown") & (family_confidence >= HIGH_FAMILY) & (margin >= HIGH_MARGIN), "high").when((style != "unknown") & (family_confidence >= COMMIT_FAMILY) & (margin >= STYLE_MARGIN), "medium").otherwise("low")


def leader(rows: DataFrame, batch: str, value: str, order: str, share: float) -> DataFrame:
    """batch and _top, its commonest value where it has that share. Values are counted
    before the shuffle, so a large batch is no large group."""
    totals = rows.groupBy(batch).agg(F.count("*").alias("_all"))
    return dominant(rows, batch, value, order).join(totals, batch).where(F.col("n") >= share * F.col("_all")).select(batch, F.col("dominant").alias("_top"))


def large_batches(rows: DataFrame, batch: str) -> DataFrame:
    return rows.groupBy(batch).agg(F.count("*").alias("_size")).where(F.col("_size") >= MIN_BATCH).select(batch)


def smooth_families(rows: DataFrame, batch: str, order: str) -> DataFrame:
    """family_confidence raised a little, up to a cap, for citations of the batch's ruling
    family that are not sure yet. rows: family, family_confidence, groups (of signals that
    speak) and tier beside batch and order. Small batches stay as they are."""
    sure = (F.col("family_confidence") >= FAMILY_COMMIT) & (F.col("groups") >= GROUPS)
    top = leader(rows.where((F.col("family") != "unknown") & sure), batch, "family", order, FAMILY_SHARE).join(large_batches(rows, batch), batch)
    meant = (F.col("family") == F.col("_top")) & (F.col("tier") != "high") & sure
    return rows.join(top, batch, "left").withColumn("family_confidence", F.when(meant, F.least(F.lit(FAMILY_CAP), F.col("family_confidence") + FAMILY_BOOST)).otherwise(F.col("family_confidence"))).drop("_top")


def smooth_styles(rows: DataFrame, batch: str, order: str, families: dict[str, str]) -> DataFrame:
    """Unknown styles filled with the batch's ruling one where the citation's own candidates
    (structs of style and score, best first) hold it within reach of the first. Adds margin."""
    top = leader(rows.where(known(F.col("style"))), batch, "style", order, STYLE_SHARE).join(large_batches(rows, batch), batch)
    family = F.create_map(*[F.lit(x) for kv in families.items() for x in kv])
    score = lambda keep: F.array_max(F.transform(F.filter("candidates", keep), lambda c: c["score"]))
    mine, other = score(lambda c: c["style"] == F.col("_top")), score(lambda c: c["style"] != F.col("_top"))
    meant = (F.col("tier") != "high") & (F.col("style") == "unknown") & (F.col("family") == family[F.col("_top")]) & (F.col("family_confidence") >= FAMILY_COMMIT) & (F.col("groups") >= GROUPS)
    fill = F.coalesce(meant & (F.get("candidates", F.lit(0))["score"] - mine <= LEAD) & (mine >= FLOOR), F.lit(False))
    out = rows.join(top, batch, "left").select(*rows.columns, fill.alias("_fill"), "_top", mine.alias("_mine"), F.greatest(F.lit(STYLE_MARGIN), mine - F.coalesce(other, F.lit(0.0))).alias("_margin"))
    return out.select(
        *[c for c in rows.columns if c not in ("style", "tier")], F.when(F.col("_fill"), F.col("_top")).otherwise(F.col("style")).alias("style"),
        F.when(F.col("_fill"), tier(F.col("family_confidence"), F.col("_margin"), F.col("_top"))).otherwise(F.col("tier")).alias("tier"), F.when(F.col("_fill"), F.col("_margin")).alias("margin"),
    )


def content_correctness(scores: dict[str, Column]) -> Column:
    """Mean of the parts' scores by weight over those that are not null; 1 if none is."""
    total = sum((F.when(c.isNotNull(), PARTS[k]).otherwise(0.0) for k, c in scores.items()), F.lit(0.0))
    held = sum((F.coalesce(c * PARTS[k], F.lit(0.0)) for k, c in scores.items()), F.lit(0.0))
    return F.when(total > 0, held / total).otherwise(1.0)
