"""Registered queries of the text operators: whole driver tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitrine.llm import oracle
from vitrine.llm.conversation_repair import repair_damaged
from vitrine.llm.decontaminate import benchmark_overlaps
from vitrine.llm.imatch import compare_edited
from vitrine.llm.language_id import identify_languages
from vitrine.llm.ngram_join import ngram_join
from vitrine.llm.quality_classifier import classify_quality
from vitrine.llm.quality_rules import judge_quality
from vitrine.llm.secrets import find_secrets
from vitrine.llm.substring_dedup import deduplicate_substrings
from vitrine.llm.suffix_dedup import remove_repeated_bytes
from vitrine.llm.toxicity import classify_toxicity
from vitrine.llm.unigram import read_vocabulary, token_digests
from vitrine.llm.whitening import whiten

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(_table(spark, sf_dir, "documents", "doc_id", "text"),
                            _table(spark, sf_dir, "labels", "doc_id", "quality"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_overlaps(_table(spark, sf_dir, "documents", "doc_id", "text"),
                              _table(spark, sf_dir, "benchmark", "item_id", "text"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(_table(spark, sf_dir, "documents", "doc_id", "text"),
                             _table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_substrings(_table(spark, sf_dir, "documents", "doc_id", "text"),
                                  with_text=False)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return token_digests(_table(spark, sf_dir, "documents", "doc_id", "text"),
                         read_vocabulary(vocabulary))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(_table(spark, sf_dir, "documents", "doc_id", "text"),
                                 with_bytes=False)


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_secret_scan": op2_secret_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_language_id": op7_language_id,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_document_fingerprints": op11_document_fingerprints,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_conversation_repair": op13_conversation_repair,
}

# The others are fitted models, or the tokenizer: tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_secret_scan": oracle.SECRET_SCAN,
    "op4_benchmark_decontamination": oracle.DECONTAMINATION,
    "op6_substring_dedup": oracle.SUBSTRING_DEDUP,
    "op9_ngram_jaccard_join": oracle.NGRAM_JOIN,
    "op10_suffix_array_dedup": oracle.SUFFIX_DEDUP,
}
