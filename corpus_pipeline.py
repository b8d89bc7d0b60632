"""Training-corpus pipeline: an ordered list of stages over the documents table.

Every stage takes ``(spark, docs, sf_dir)`` and returns the documents it keeps with
their columns unchanged; the last one adds the token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitrine.llm.decontaminate import drop_contaminated
from vitrine.llm.language_id import fit_context_tree, fit_limits, keep_identified
from vitrine.llm.ngram_join import one_per_group
from vitrine.llm.queries import VOCABULARY
from vitrine.llm.secrets import redact_secrets
from vitrine.llm.unigram import encode_texts, read_vocabulary
from vitrine.operators.materialize import discard_all, materialize, materialized_paths


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the table; other languages and junk go."""
    tree = fit_context_tree(docs)
    return keep_identified(docs, tree, limits=fit_limits(docs, tree))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group linked by a Jaccard similarity of 0.8."""
    return one_per_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked."""
    return redact_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids."""
    return encode_texts(docs, read_vocabulary(VOCABULARY))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", mask_secrets),
    ("SentencePiece encoding", encode),
]

# The language stage is a fitted model, which SQL cannot state; tests/llm holds the
# pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each stage's rows are written and read again.

    What a stage wrote for itself, and its input, is deleted once its result is there.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = materialized_paths()
    for number, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{number}")
        discard_all(spark, materialized_paths() - before - {docs.materialized_path})
    return docs
