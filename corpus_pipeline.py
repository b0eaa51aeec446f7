"""The training-data pipeline: quality, line dedup, near dedup, suffix dedup, packing.

Each stage takes all that the one before kept, and its decisions take effect:
rejected documents and all but one of each group go, boilerplate lines and
repeated passages are cut from the texts. A document whose text is used up stays,
empty, so that no clean document is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibmill.llm import line_dedup, minhash_dedup, packing, quality_classifier, suffix_dedup
from bibmill.llm.common import Scratch, documents
from bibmill.llm.queries import WORD_BPE

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def with_text(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now (0 for a null one)."""
    return df.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more stay, unchanged. A null text is scored as an empty
    one and stays null if it stays; equal rows share a fate; an empty table stays empty."""
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.score(docs, model, COLUMNS).where("score >= 0.5").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, without the boilerplate lines of their source. Copies count
    as one page: near_copies comes later, and the body of a large group of copies must
    not count as boilerplate. A null text stays null; a null source is one source."""
    return with_text(line_dedup.drop_boilerplate_lines(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the row of the least row number stays, unchanged. Equal texts are
    one class, null and empty ones together."""
    return minhash_dedup.near_duplicates(docs.select(*COLUMNS)).where("dup_row = dup_class").select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, without the bytes of passages that repeat; a character that
    loses a byte goes whole. A null text becomes an empty one."""
    return with_text(suffix_dedup.remove_repeats(docs.select(*COLUMNS), characters=True).withColumnRenamed("kept", "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences; a null or empty text is
    one piece, its end id; an empty table gives no pieces."""
    return packing.best_fit_pack(docs, WORD_BPE)


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("passages", passages), ("packing", pack)]
#: The classifier, the hashes and the tokenizer can't be said in SQL; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over documents, each written and read again."""
    scratch, docs = Scratch(spark), documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
