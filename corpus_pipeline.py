"""From raw documents to token ids: five stages, each one operator over all that the one before kept.

Every stage is a function of (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
in the shared folder and read again as the next one's `docs`, so a lost executor costs one stage's
tasks and no stage is computed twice. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from truegrain.functions.session import materialised
from truegrain.llm import bpe, minhash, mixing, pii, quality
from truegrain.llm.common import read

#: The tokenizer file; a parameter, not part of the repository.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels of these documents, doesn't reject."""
    return quality.accepted(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.deduplicated(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data and credentials replaced by their kind."""
    return pii.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources at their target sizes: a row per document and pass, with the words taken."""
    return mixing.mixed_documents(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every row of the mix."""
    return bpe.token_ids(docs, TOKENIZER)


STAGES = [
    ("quality classifier", classify),
    ("minhash near-dedup", near_dedup),
    ("pii", mask_pii),
    ("source mix", mix_sources),
    ("bpe", tokenise),
]

#: A trained classifier and signatures of hashes have no SQL form; tests/llm compares the stages with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialised(stage(spark, docs, sf_dir))
    return docs
