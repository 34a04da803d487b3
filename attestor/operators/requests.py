"""Requests as rows: every query with its own scope, its own readiness of the index and its own early exit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.operators import answer, embedding, retrieval
from attestor.operators.retrieval import RetrievalConfig
from attestor.sources.scratch import stored


def index_states(chunks: DataFrame, index: DataFrame, dimension: int = embedding.DIMENSION) -> DataFrame:
    """source_id, document_id, state of every chunk. index: chunk_id, chunk_checksum, model, size."""
    rows = chunks.select("chunk_id", "source_id", "document_id", "checksum").join(index.select("chunk_id", "chunk_checksum", "model", "size"), "chunk_id", "left")
    return rows.select("source_id", "document_id", embedding.state(F.col("checksum"), F.col("model"), F.col("size"), F.col("chunk_checksum"), dimension).alias("state"))


def run_requests(chunks: DataFrame, index: DataFrame, queries: DataFrame, mode: str, top_k: int = 0, config: RetrievalConfig = RetrievalConfig(), asked: DataFrame | None = None) -> dict[str, DataFrame]:
    """status (query_id, readiness, total, indexed, missing, stale), hits (assessed) and answers of queries (query_id, query, and source_ids and
    document_ids where they have scopes). index: chunk_id, chunk_checksum, model, size, vector; stale vectors still count for a score.

    A query that needs an index of which its scope has nothing ends early: no hits, and an answer that says so; lexical ones without terms
    have no hits. Blank queries are refused."""
    if queries.where(~F.coalesce(F.col("query").rlike("\\S"), F.lit(False))).take(1):
        raise ValueError("a query is blank")
    status = stored(embedding.query_readiness(index_states(chunks, index), queries, mode), "status")
    vectors = None
    if mode != "lexical":
        vectors = index.where((F.col("model") == embedding.MODEL) & (F.size("vector") == embedding.DIMENSION)).select("chunk_id", "vector")
        asked = stored(asked if asked is not None else queries.select("query_id", embedding.embed(F.col("query")).alias("vector")), "asked")
    ready = queries.join(status.where("readiness = 'missing'"), "query_id", "left_anti")
    hits = answer.assess(retrieval.retrieve(chunks, ready, mode, vectors, asked, top_k, config))
    return {"status": status, "hits": hits, "answers": answer.answers(queries, hits, config.citation_limit, status)}
