"""The thin opN_ queries with their DuckDB SQL: digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bytespans, decontam, jaccard, langid, lines, merkle, neighbours, passages, perplexity, pieces, quality, toxicity
from ._common import read


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def piece_digests(coded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what pieces.encode returns."""
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(pieces.encode(read(spark, sf_dir, "documents"), piece_model()))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_common(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passages.remove_repeats(read(spark, sf_dir, "documents"))
    removed = F.when(F.col("removed").isNull(), 0).otherwise(F.size(F.filter("removed", lambda x: x)))
    return out.select("doc_id", "n_words", removed.cast("long").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bytespans.remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = perplexity.judge(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity", "log_perplexity_long")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def vocabularies() -> alignment.Vocabularies:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(piece_model(), "rb") as b:
        return alignment.Vocabularies(a.read(), b.read())


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.judge(read(spark, sf_dir, "documents"), vocabularies())


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merkle.manifest(read(spark, sf_dir, "documents"), merkle.tampered_text(F.col("doc_id"), F.col("text")))
    return out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


OPERATORS = (
    op1_toxicity,
    op2_sentencepiece,
    op3_line_dedup,
    op4_ngram_jaccard,
    op5_language_id,
    op6_substring_dedup,
    op7_suffix_array,
    op8_quality,
    op9_perplexity,
    op10_decontamination,
    op11_token_alignment,
    op12_nearest_neighbours,
    op13_merkle_manifest,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in OPERATORS}
#: The learnt operators, the tokenizer, the byte-wise windows and the model's verdicts are beyond SQL; tests hold them.
ORACLES: dict[str, str] = {
    "op3_line_dedup": lines.ORACLE,
    "op4_ngram_jaccard": jaccard.ORACLE,
    "op6_substring_dedup": passages.ORACLE,
    "op10_decontamination": decontam.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}
