"""The stages from documents to token ids; each works on all that the one before kept.

Defined cases, for every stage: nulls in any column are allowed, and so are repeated rows,
repeated or missing doc_ids, texts of any length and columns beyond those of documents,
whatever their names; an empty table gives no rows. All but the last return the columns
that they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, dedup, mixing, quality_rules, secrets
from .common import named

#: Words in a shingle of the near-duplicate stage.
SHINGLE_WORDS = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed limits and are no outliers in their language and source. Documents without text, null or empty, fail; equal rows share their verdict."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id. Documents without words are no duplicates and stay; of rows that are equal in all columns one stays."""
    return dedup.keep_one(docs, SHINGLE_WORDS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind; n_chars, if there, follows the text. Null texts stay null."""
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return clean.select(*[length.alias(c) if c == "n_chars" else named(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for. Documents without words are not taken; null is a source."""
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (little-endian unsigned 32-bit integers), and the digests of ids and decoded text. Null texts have no ids."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"), ("doc_id", "source"))
