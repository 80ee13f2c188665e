"""A training-data pipeline over ``documents``: each stage reads what the one before it
wrote.

Quality rules drop documents, the n-gram Jaccard join leaves one document of each
group of near copies (five-word shingles, similarity 0.8 or more), documents with
a benchmark passage are dropped, secrets are masked (``n_chars`` follows the
text), and what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import decontaminate, ngram_jaccard, quality_rules, secret_scan, word_bpe
from strata.llm.common import read_table
from strata.session import materialize

NEAR = ngram_jaccard.JoinSpec(words=5, percent=80)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy keeps, its list of toxic words learned from ``labels``."""
    listed = quality_rules.toxic_words(docs, read_table(spark, sf_dir, "labels"))
    return quality_rules.keep_good(docs, quality_rules.V3, listed=listed)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near copies."""
    return ngram_jaccard.one_of_each(docs, spec=NEAR)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with every secret masked."""
    masked = secret_scan.mask_secrets(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else masked


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens and the digests of its ids and of the text decoded from them."""
    coded = word_bpe.encode_decode(docs.select("doc_id", "text"), word_bpe.vocabulary_path())
    return word_bpe.digests(coded)


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard", near_copies),
    ("decontaminate", decontaminated),
    ("secret_scan", without_secrets),
    ("word_bpe", encoded),
]

#: No SQL expresses the randomness tests and the merges; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
