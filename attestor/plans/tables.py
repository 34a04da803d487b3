"""The driver's tables bound to the model: documents, chunks, queries, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators.chunking import Chunking, chunk_whitespace
from attestor.operators.intelligence import annotate_quality
from attestor.sources.scratch import spread, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, source_id, path, text of every row; null text is empty."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    key = F.col("doc_id").cast("string")
    return d.select(F.concat(F.lit("d"), key).alias("document_id"), F.col("source").alias("source_id"), F.concat(F.col("source"), F.lit("/"), key, F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))


def annotated_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate_quality(chunk_whitespace(documents(spark, sf_dir), Chunking(strategy="whitespace")))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotated chunks of all documents, stored: queries read them several times."""
    return stored(annotated_chunks(spark, sf_dir), "chunks")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query: the first sentence of every benchmark passage."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.split_part("text", F.lit("."), F.lit(1)).alias("query"))


def index_state(chunk_rows: DataFrame) -> DataFrame:
    """An embedding index that lacks some chunks and is stale for others, by the checksum's first digits."""
    lead = F.left("checksum", F.lit(1))
    rows = chunk_rows.select("chunk_id", "checksum", "source_id", lead.alias("lead")).where("lead <> '0'")
    return rows.select(
        "chunk_id", F.when(F.col("lead") == "1", F.lit("old")).otherwise(F.col("checksum")).alias("chunk_checksum"), F.lit("local-hash-v1").alias("model"),
        F.lit(384).alias("size"), F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("indexed_at"),
    )
