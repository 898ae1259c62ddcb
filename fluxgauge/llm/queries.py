"""The registered queries of the subpackage: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgauge.llm import (
    bpe,
    exact_dedup,
    jaccard_join,
    line_dedup,
    link_trust,
    merkle,
    mixing,
    quality_model,
    quality_rules,
    substring_dedup,
    toxicity,
    vector_code,
    warc_zip,
)
from fluxgauge.llm.tables import documents, read

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def held_out(parts: int, fold: int) -> Column:
    """Rows whose CRC-32 of the id as text falls into the fold."""
    return F.crc32(F.col("doc_id").cast("string")) % parts == fold


def op1_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to WARC packages and read back by ranges."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc_zip.round_trip(spark, pages, least_bytes=0).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, by a model of four fifths of the labels."""
    labels = read(spark, sf_dir, "labels")
    return toxicity.toxicity_report(documents(spark, sf_dir), labels, held_out(5, 0))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, by a model of two thirds of the labels."""
    labels = read(spark, sf_dir, "labels")
    return quality_model.quality_report(documents(spark, sf_dir), labels, held_out(3, 1))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text they decode to, as digests."""
    path = tokenizer_path()
    docs = documents(spark, sf_dir).select("doc_id", "text")
    coded = bpe.encoded(docs, path).select("doc_id", "ids")
    return bpe.decoded(coded, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated passages of 13 words."""
    left = substring_dedup.without_repeats(documents(spark, sf_dir), window=13)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    return quality_rules.judged(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its equal texts."""
    return exact_dedup.deduplicated(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return mixing.mix_report(documents(spark, sf_dir))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict for every page's url."""
    return link_trust.judged(read(spark, sf_dir, "pages"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents with three-word shingle sets that are 90 % alike."""
    return jaccard_join.component_report(documents(spark, sf_dir), shingle=3, similarity=(90, 100))


def op11_vector_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every vector: 16 parts, 64 entries each, two rounds of fitting."""
    return vector_code.compressed(read(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256"
    )


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without lines of ten letters that an earlier one holds."""
    left = line_dedup.without_repeated_lines(documents(spark, sf_dir), least=10)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of every document, checked against texts of which some lost their line ends."""
    odd = F.crc32(F.col("doc_id").cast("string")) % 2 != 0
    text = F.col("text")
    later = F.when(F.coalesce(odd, F.lit(True)), text).otherwise(F.replace(text, F.lit("\n"), F.lit("")))
    return merkle.manifest(documents(spark, sf_dir), later, arity=3)


QUERIES = {
    "op1_warc_zip": op1_warc_zip,
    "op2_toxicity": op2_toxicity,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_bpe": op4_bpe,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_mixing": op8_mixing,
    "op9_url_filter": op9_url_filter,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_vector_code": op11_vector_code,
    "op12_line_dedup": op12_line_dedup,
    "op13_merkle": op13_merkle,
}
