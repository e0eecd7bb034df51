"""Registered queries of the subpackage: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaklens.llm import (
    chat, decontamination, embedding_dedup, fill_in_middle, html_text, mixing, near_dup, quality, spelling,
    substring_dedup, token_files, toxicity, url_filter)
from leaklens.session import scratch_path

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken from every document at weights 5, 2, 1 and 150 % of all words."""
    docs = table(spark, sf_dir, "documents")
    taken = mixing.mix(docs).select(
        F.col("source").alias("__source"), F.col("doc_id").alias("__id"), "source_size", "target", "copies")
    rows = docs.select("doc_id", "source", mixing.text_size(F.col("text")).alias("size"))
    both = rows["source"].eqNullSafe(taken["__source"]) & rows["doc_id"].eqNullSafe(taken["__id"])
    return rows.join(taken, both).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of every document under a model of the good ones."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document under five-word shingles and similarity 0.8."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item."""
    return decontamination.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated passage with its place and the document that keeps it."""
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered conversations that no longer one contains as a prefix."""
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.98 within a label."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's token ids, read from the
    files that hold them."""
    import public_tokenizers

    with open(public_tokenizers.path(TOKENIZER), encoding="utf-8") as file:
        tokenizer = file.read()
    folder = scratch_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), folder, tokenizer)
    return token_files.read(spark, folder, token_files.id_type(tokenizer)).drop("ids")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its near words' number, its form and root."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document's example and of the text rebuilt from it."""
    made = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_source_mixing, op2_quality_classifier, op3_minhash_near_dedup, op4_benchmark_decontamination, op5_toxicity, op6_substring_dedup,
        op7_html_extraction, op8_chat_formatting, op9_embedding_near_dedup, op10_url_filter, op11_token_files,
        op12_spelling_variants, op13_fill_in_middle)
}

ORACLE_SQL: dict[str, str] = {
    "op8_chat_formatting": chat.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
    "op13_fill_in_middle": fill_in_middle.ORACLE,
}
