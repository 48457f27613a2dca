"""The corpus pipeline: five stages over `documents`, each one of the operators of walflow.llm.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but
the last return the columns of `documents`. SQL can express neither the trained model
nor the tokenizer, so there is no ORACLE_SQL; tests hold the stages against
brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walflow.llm import bpe, decontaminate, jaccard_join, langid, pii
from walflow.llm.common import fresh, read, save

#: Near duplicates share this many percent of their shingles of so many words.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language the classifier rejects (null text, no letter, or too low a score).

    An empty table stays empty; repeated rows are judged alike; columns may have any names."""
    return langid.known_only(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near duplicates (by doc_id, null last, then text digest).

    Null and wordless texts stay; of repeated rows one stays; an empty table stays empty; columns may have any names."""
    return jaccard_join.keep_one(docs, NEAR_WORDS, NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item.

    Null and empty texts hold none; repeated rows are judged alike; without items all stay; columns may have any names."""
    (leaks,) = fresh(docs.columns, "leaks")
    return decontaminate.with_leaks(docs, read(spark, sf_dir, "benchmark"), leaks).where(F.size(leaks) == 0).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind and brings n_chars up to date.

    Null texts stay null (with their n_chars); repeated rows are treated alike; columns may have any names."""
    clean = pii.redact(docs, pii.extract(docs))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return clean.select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each document; a null text has no tokens."""
    return bpe.encode(docs, with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("bpe_encoding", encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
