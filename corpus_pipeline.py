"""From raw documents to tokens: five stages, each written as Parquet and read again as the next one's documents.

Each stage works on all that its predecessor kept. All but the last return the columns of `documents`. Rows without an id
and rows that repeat one are rows like any other; an empty table of documents gives an empty result, and an empty benchmark
or a corpus without labels drops nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vectide.llm import bpe, decontam, langid, pii, simhash
from vectide.llm.scratch import Scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language, null texts and texts without a letter; `lang` becomes the predicted one, if any can be learned."""
    return langid.keep_known(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that with the smallest doc_id."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; each row is decided by its own text."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a placeholder in place of personal data; keeps every document."""
    return pii.redact(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens of each document, and the text that the ids decode to."""
    return bpe.encode_table(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("pii", mask_personal_data),
    ("bpe", tokenise),
]

#: The stages parse by automata, hash with XXH64 and tokenise: none of that is SQL. tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = kept.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
