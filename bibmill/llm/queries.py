"""The queries of the numbered operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, centroid_clustering, embedding_dedup, fill_in_middle, forced_bpe, gif, license_scan, line_dedup, minhash_dedup, packing, quality_classifier, simple8b_output, suffix_dedup
from .common import Scratch, documents

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
MERGES_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; a null text is empty."""
    out = suffix_dedup.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes stored as a GIF, read back, with hashes and colour features."""
    return gif.payloads(documents(spark, sf_dir))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, places of license phrases, labels and score of every document."""
    return license_scan.scan_licenses(documents(spark, sf_dir))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    return embedding_dedup.embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without its source's boilerplate lines, n_lines, n_dropped of every document."""
    return line_dedup.drop_boilerplate_lines(documents(spark, sf_dir).select("doc_id", "source", "text")).select("doc_id", "text", "n_lines", "n_dropped")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = documents(spark, sf_dir)
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = quality_classifier.score(docs.select("doc_id", "text"), model, ["doc_id"])
    return out.select("doc_id", quality_classifier.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_simple8b_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the written files."""
    return simple8b_output.token_files(documents(spark, sf_dir), WORD_BPE)


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), kept. Null ids stay null; a
    class of null ids alone has a null class_id."""
    scratch = Scratch(spark)
    # both sides of the join are written, so that Spark can split a class of very many rows
    out = scratch.cut(minhash_dedup.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"]).select("doc_id", "dup_class"), "classes")
    least = scratch.cut(out.groupBy("dup_class").agg(F.min("doc_id").alias("class_id")), "least")
    return out.join(least, "dup_class").select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("kept"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, offsets_crc32 of every document."""
    return byte_bpe.round_trip(documents(spark, sf_dir), BYTE_BPE, public_tokenizers.PATTERN)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return packing.best_fit_pack(documents(spark, sf_dir), WORD_BPE)


def op11_forced_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return forced_bpe.round_trip(documents(spark, sf_dir), MERGES_BPE)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every whole vector."""
    return centroid_clustering.centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every document."""
    return fill_in_middle.digests(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_gif_media, op3_license_scan, op4_embedding_dedup, op5_line_dedup, op6_quality_classifier, op7_simple8b_output, op8_minhash_dedup, op9_byte_bpe, op10_best_fit_packing, op11_forced_bpe, op12_centroid_clustering, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": line_dedup.ORACLE, "op12_centroid_clustering": centroid_clustering.oracle(), "op13_fill_in_middle": fill_in_middle.ORACLE}
