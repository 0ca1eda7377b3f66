"""Corpus preparation: from raw documents to token counts, in five stages.

Each stage takes the documents that its predecessor kept, stored as Parquet, and
returns the documents it keeps with the same columns; the last returns tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import block_naming, bpe, hyperminhash, line_frequency, poisson_mix
from docspark.llm.common import stored, table


def _as_given(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns in the order of `docs`, whatever they are called."""
    return kept.select(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that their host repeats too often."""
    kept = line_frequency.cleaned(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return _as_given(block_naming.deduplicated(docs), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 of their sets of five words."""
    return _as_given(hyperminhash.deduplicated(docs), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources have their target shares, shuffled."""
    return poisson_mix.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of every copy."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.token_digests(docs.select("doc_id", "source", "text"), path, public_tokenizers.PATTERN).drop("text")


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("tokenize", tokenize),
]

# Token ids and near-duplicate components are beyond SQL; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
