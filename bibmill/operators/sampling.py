"""Samples, splits and noise that depend on ids alone, so that any run gives the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper ends of the noise bands.
NOISE = [(0.3, "bare_identifier"), (0.5, "alternate_identifier_format"), (0.7, "odd_punctuation"), (0.85, "non_ascii"), (0.95, "style_specific_quirk"), (1.0, "fake_plausible_id")]


def share(c: Column) -> Column:
    """0 to 1 from the first 32 bits of sha256."""
    return F.conv(F.substring(F.sha2(c.cast("string"), 256), 1, 8), 16, 10).cast("double") / 4294967295


def noise_kind(record: Column, style: Column) -> Column:
    """By the hash of record and style."""
    at = share(F.concat_ws(":", record.cast("string"), style))
    out = F.lit(NOISE[-1][1])
    for top, name in reversed(NOISE[:-1]):
        out = F.when(at < top, name).otherwise(out)
    return out


def apply_noise(kind: Column, text: Column, doi: Column, arxiv: Column) -> Column:
    """What each kind makes of a formatted reference; no field of it is taken away."""
    other = F.when(doi.isNotNull(), F.regexp_replace(text, r"(?i)https?://doi\.org/", "doi:")).when(arxiv.isNotNull(), F.concat(text, F.lit(" arXiv:"), arxiv)).otherwise(text)
    fake = F.when(arxiv.isNotNull(), F.replace(text, arxiv, F.lit("9999.99999"))).when(doi.isNotNull(), F.concat(text, F.lit(" doi:10.9999/fake-doi"))).otherwise(F.concat(text, F.lit(" PMID:99999999")))
    return (
        F.when(kind == "bare_identifier", F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)https?://(dx\.)?doi\.org/", ""), r"\s{2,}", " ")))
        .when(kind == "alternate_identifier_format", other)
        .when(kind == "odd_punctuation", F.trim(F.regexp_replace(text, r"([.,;:])\s", "$1  ")))
        .when(kind == "non_ascii", F.translate(text, "ea", "éà"))
        .when(kind == "style_specific_quirk", F.regexp_replace(text, r"(?i)\bpp?\.\s*", ""))
        .otherwise(fake)
    )


def stratified(df: DataFrame, stratum: str, order: str, quota: int) -> DataFrame:
    """The first quota rows of each stratum. Spark keeps only that many of each before the shuffle."""
    w = Window.partitionBy(stratum).orderBy(order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= quota)


def grouped_split(df: DataFrame, group: str, seed: str = "7", train: float = 0.8, val: float = 0.9) -> DataFrame:
    """Adds split; a group's rows go to one split, by a hash of the group, so nothing is shuffled."""
    s = share(F.concat(F.col(group).cast("string"), F.lit(seed)))
    return df.withColumn("split", F.when(s < train, "train").when(s < val, "val").otherwise("test"))
