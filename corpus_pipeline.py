"""A corpus from raw documents: language, toxicity, exact and near duplicates, packed windows.

Every stage but the last returns the columns of its input. A stage's output is written as Parquet to the shared
folder and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestor.llm.common import small_batches, stored, table
from attestor.llm.exact_dedup import without_exact_duplicates
from attestor.llm.language_id import with_known_language
from attestor.llm.near_dedup import without_near_duplicates
from attestor.llm.packing import pack
from attestor.llm.toxicity import without_toxic


#: Words in the caches of packing: workers go on to other stages and keep them.
WORDS = 60_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: null texts and texts without letters."""
    small_batches(spark)
    return with_known_language(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents predicted toxic. Null and empty texts count as texts without any sign and stay; repeated rows share one fate."""
    small_batches(spark)
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, null counting as empty, the row with the largest doc_id stays; of a repeated row one."""
    return without_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (shingles of five words, similarity 0.8) the row with the smallest doc_id stays.
    Null and empty texts and rows without a doc_id stay; of rows with one doc_id one."""
    return without_near_duplicates(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in windows of 1024 tokens. A null or empty text is its end id alone; every row is packed, repeated ones too."""
    small_batches(spark)
    return pack(docs, entries=WORDS)


STAGES = [("language", language), ("toxicity", toxicity), ("exact", exact), ("near", near), ("packing", packing)]

#: Token ids and fitted models are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
