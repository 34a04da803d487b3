"""Ranking of chunks for a batch of queries: lexical, vector and hybrid.

Tasks find what can be among a query's first k where the chunks are (reach.py), about k rows a query and task; what follows scores and ranks
those rows exactly. Copies of a hit's text are counted by checksum after ranking, and texts meet only the hits that stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from attestor.functions.hashing import cosine
from attestor.functions.text import best_snippet, normalize_text, normalized_tokens, query_terms
from attestor.operators import reach
from attestor.operators.embedding import embed_normalized
from attestor.operators.reach import in_reach, own_scope, scope_columns
from attestor.sources.scratch import stored


@dataclass(frozen=True)
class RetrievalConfig:
    top_k: int = 5
    max_top_k: int = 25
    min_evidence: float = 0.35
    min_similarity: float = 0.25
    citation_limit: int = 3
    semantic_hybrid: float = 2.0
    semantic_vector: float = 3.0
    lexical: float = 2.4
    frequency: float = 0.6
    phrase: float = 1.2
    section: float = 0.75
    path: float = 0.5
    metadata: float = 1.0


MODES = ("hybrid", "vector", "lexical")


def normalized_top_k(k: Column, config: RetrievalConfig = RetrievalConfig()) -> Column:
    return F.least(F.when(k == 0, config.top_k).otherwise(k), F.lit(config.max_top_k))


def normalized_modes(modes: list[str]) -> list[str]:
    """All modes for none; in the fixed order, each once."""
    unknown = set(modes) - set(MODES)
    if unknown:
        raise ValueError(f"unknown modes {sorted(unknown)}")
    return [m for m in MODES if not modes or m in modes]


def in_scope(sources: list[str] | None, documents: list[str] | None) -> Column:
    """An empty list is no filter."""
    out = F.lit(True)
    if sources:
        out = out & F.col("source_id").isin(*sources)
    if documents:
        out = out & F.col("document_id").isin(*documents)
    return out


def prepare_chunks(chunks: DataFrame) -> DataFrame:
    """chunks with norm, their normalized texts, and vector, the hashed embeddings: made in one pass for runs in several modes."""
    return chunks.withColumn("norm", normalize_text(F.col("text"))).withColumn("vector", embed_normalized(F.col("norm")))


def prepare_queries(queries: DataFrame) -> DataFrame:
    """queries (query_id, query, and source_ids and document_ids where they have scopes) with their sorted terms, their number and the normalized query."""
    return queries.select("query_id", "query", *scope_columns(queries), query_terms(F.col("query")).alias("terms"), F.size(query_terms(F.col("query"))).alias("n_terms"), normalize_text(F.col("query")).alias("normalized"))


def similarities(vectors: DataFrame, queries: DataFrame, least: float, keep: int | None = None) -> DataFrame:
    """query_id, chunk_id, similarity of pairs at or above least. queries (query_id, vector) go to every task, block by
    block; vectors (chunk_id, vector) stay where they are and are multiplied batch by batch. keep: only what can be among
    a query's keep best by the similarity to six digits, then chunk_id; of each batch these are about keep rows a query, however
    many vectors are alike."""
    kinds = dict(queries.dtypes), dict(vectors.dtypes)
    return reach.by_blocks(queries.select("query_id", "vector"), reach.MAX_QUERIES, lambda rows: _similarities(vectors, rows, least, keep, kinds))


def _similarities(vectors: DataFrame, rows: list[Row], least: float, keep: int | None, kinds: tuple[dict, dict]) -> DataFrame:

    by_size: dict[int, tuple[list, np.ndarray]] = {}
    for size in {len(r["vector"]) for r in rows if r["vector"]}:
        some = [r for r in rows if r["vector"] and len(r["vector"]) == size]
        by_size[size] = ([r["query_id"] for r in some], reach.unit(np.array([r["vector"] for r in some], np.float64)))
    shared = vectors.sparkSession.sparkContext.broadcast(by_size)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["vector"].map(lambda v: 0 if v is None else len(v))
            for size, (ids, q) in shared.value.items():
                part = batch[sizes == size]
                step = min(2000, max(1, reach.MAX_CELLS // len(ids)))
                for at in range(0, len(part), step):
                    some = part.iloc[at : at + step]
                    sims = q @ reach.unit(np.stack(some["vector"].to_list()).astype(np.float64)).T
                    i, j = np.nonzero(sims >= least)
                    if keep and sims.shape[1] > keep:
                        low = np.partition(sims, -keep, axis=1)[:, -keep]
                        near = sims[i, j] >= low[i] - 2e-6  # equal to six digits, or better
                        i, j = i[near], j[near]
                        # Of vectors equally near to a query the first by id are enough.
                        order = np.lexsort((some["chunk_id"].to_numpy()[j], np.round(-sims[i, j] * 1e9), i))
                        i, j = i[order], j[order]
                        same = np.r_[False, (i[1:] == i[:-1]) & (np.round(sims[i, j] * 1e9)[1:] == np.round(sims[i, j] * 1e9)[:-1])]
                        begins = np.flatnonzero(~same)
                        nth = np.arange(len(i)) - np.repeat(begins, np.diff(np.r_[begins, len(i)]))
                        i, j = i[nth < keep], j[nth < keep]
                    yield pd.DataFrame({"query_id": np.array(ids, object)[i] if kinds[0]["query_id"] == "string" else np.array(ids)[i], "chunk_id": some["chunk_id"].to_numpy()[j], "similarity": sims[i, j]})

    return vectors.select("chunk_id", "vector").mapInPandas(scored, f"query_id {kinds[0]['query_id']}, chunk_id {kinds[1]['chunk_id']}, similarity double")


def field_share(terms: Column, n_terms: Column, field: Column) -> Column:
    return F.coalesce(F.size(F.array_intersect(terms, normalized_tokens(field))) / F.greatest(n_terms, F.lit(1)), F.lit(0.0))


def metadata(config: RetrievalConfig) -> Column:
    return F.round((F.when(F.col("section_title").isNotNull(), 0.08).otherwise(0.0) + F.when(F.col("token_count") > 0, 0.02).otherwise(0.0)) * config.metadata, 6)


def score(chunks: DataFrame, queries: DataFrame, pairs: DataFrame, mode: str = "lexical", config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """Admitted pairs with their signals and score. queries are prepared; pairs: query_id, chunk_id, matched, frequency, body, phrase, similarity."""
    rows = pairs.withColumns({c: F.col(c).cast("int") for c in ("matched", "frequency", "body")}).join(queries, "query_id").join(chunks if mode == "vector" else chunks.drop("text"), "chunk_id")
    if mode == "vector":  # few pairs: their terms are read from the texts
        rows = with_terms(rows, config)
    n, has = F.greatest("n_terms", F.lit(1)), F.col("matched") > 0
    semantic = F.when(F.col("similarity") >= config.min_similarity, F.col("similarity")).otherwise(0.0)
    rows = rows.withColumns({
        "sem": F.lit(0.0) if mode == "lexical" else semantic,
        "lexical": F.round(F.when(has, F.col("matched") / n * config.lexical + F.col("frequency") / (n * 4.0) * config.frequency).otherwise(0.0), 6),
        "phrase": F.round(F.when(has, F.col("phrase")).otherwise(0.0), 6),
        "section": F.round(field_share(F.col("terms"), F.col("n_terms"), F.col("section_title")) * config.section, 6),
        "path_score": F.round(field_share(F.col("terms"), F.col("n_terms"), F.col("path")) * config.path, 6),
        "metadata": metadata(config),
    })
    weight = {"lexical": 0.0, "vector": config.semantic_vector, "hybrid": config.semantic_hybrid}[mode]
    rows = rows.withColumn("semantic", F.round(F.col("sem") * weight, 6))
    own = F.col("lexical") + F.col("phrase") + F.col("section") + F.col("path_score") + F.col("metadata")
    rows = rows.withColumn("score", F.round(F.col("semantic") if mode == "vector" else own + F.col("semantic"), 6))
    return rows.where((has | (F.col("sem") > 0)) & (F.col("score") > 0))


def with_terms(rows: DataFrame, config: RetrievalConfig) -> DataFrame:
    """rows (terms, n_terms, normalized, text, section_title, path) with matched, frequency, body and phrase from the texts themselves."""
    body = normalized_tokens(F.col("text"))
    rest = F.concat(F.coalesce(normalized_tokens(F.col("section_title")), F.array().cast("array<string>")), normalized_tokens(F.col("path")))
    rows = rows.withColumns({"_body": body, "_all": F.concat(body, rest)}).withColumn("_text", F.array_join("_body", " "))
    counts = F.transform("terms", lambda t: F.least(F.size(F.filter("_all", lambda x: x == t)), F.lit(4)))
    adjacent = F.when(F.col("n_terms") > 1, F.transform(F.sequence(F.lit(0), F.col("n_terms") - 2), lambda i: F.concat_ws(" ", F.get("terms", i), F.get("terms", i + 1)))).otherwise(F.array().cast("array<string>"))
    pairs = F.size(F.filter(adjacent, lambda p: F.contains(F.col("_text"), p)))
    full = (F.col("normalized") != "") & F.contains("_text", F.col("normalized"))
    return rows.withColumns({
        "matched": F.size(F.array_intersect("terms", "_all")), "frequency": F.aggregate(counts, F.lit(0), lambda acc, x: acc + x), "body": F.size(F.array_intersect("terms", "_body")),
        "phrase": F.when(full, config.phrase).otherwise(pairs * (config.phrase / 4)),
    }).drop("_body", "_all", "_text")


def hit_flags() -> Column:
    flags = F.col("quality_flags")
    section_only = (F.col("section") > 0) & (F.col("lexical") == 0) & (F.col("semantic") == 0)
    return F.array_compact(F.array(
        F.when(F.col("is_duplicate"), F.lit("duplicate")), F.when(F.array_contains(flags, "heading_only"), F.lit("heading_only")), F.when(F.array_contains(flags, "too_short"), F.lit("too_short")),
        F.when(F.col("sem") > 0, F.lit("semantic_match")), F.when(F.col("matched") > 0, F.lit("exact_term_match")), F.when(section_only, F.lit("section_only_match")),
        F.when(F.col("evidence_score_hint") < 0.35, F.lit("weak_evidence")),
    ))


def evidence_strength(score: Column, flags: Column, config: RetrievalConfig = RetrievalConfig()) -> Column:
    weak = F.array_contains(flags, "heading_only") | F.array_contains(flags, "section_only_match") | (score < config.min_evidence)
    medium = F.array_contains(flags, "weak_evidence") | F.array_contains(flags, "too_short") | (score < 2 * config.min_evidence)
    return F.when(weak, "weak").when(medium, "medium").otherwise("strong")


def rank_hits(scored: DataFrame, top_k: Column | int = 5, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """Flags, strength, one hit for each checksum (the first in order), then the first top_k. Order: score descending, path, ordinal, chunk_id."""
    rows = scored.withColumn("hit_flags", hit_flags())
    rows = rows.withColumn("strength", evidence_strength(F.col("score"), F.col("hit_flags"), config))
    order = [F.desc("score"), "path", "ordinal", "chunk_id"]
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("query_id", "checksum").orderBy(*order))).where("_nth = 1")
    limit = F.lit(top_k) if isinstance(top_k, int) else top_k
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= limit).drop("_nth")


def with_copies(hits: DataFrame, chunks: DataFrame, mode: str, vectors: DataFrame | None, asked: DataFrame | None, config: RetrievalConfig) -> DataFrame:
    """hits with duplicate_count, the number of admitted chunks of the same text, and the flag that says so.

    Where the text itself holds a term every copy is admitted, so copies are counted by checksum, once for all queries. Otherwise copies count by
    what they share: those of one vector, section and path stand or fall together."""
    keys = hits.select("query_id", "checksum", "terms", "body", *scope_columns(hits))
    scoped = bool(scope_columns(hits))
    held = chunks.join(hits.select("checksum").distinct(), "checksum", "left_semi")
    plain = (F.col("body") > 0) if mode != "vector" and not scoped else F.lit(False)
    by_text = held.groupBy("checksum").agg(F.count(F.lit(1)).alias("n"))
    out = [keys.where(plain).join(by_text, "checksum").select("query_id", "checksum", "n")]
    rest = keys.where(~plain)
    if mode != "lexical" and vectors is not None:
        held = held.join(vectors, "chunk_id", "left")
    if "vector" in held.columns:
        rest = rest.join(asked.withColumnRenamed("vector", "asked"), "query_id", "left")
    scope = ["source_id", "document_id"] if scoped else []
    kinds = ["checksum", "section_title", "path", *scope, *[c for c in ("vector",) if c in held.columns]]
    groups = held.groupBy(*kinds).agg(F.count(F.lit(1)).alias("n"))
    met = own_scope(rest.join(groups, "checksum"))
    near = cosine(F.col("vector"), F.col("asked")) >= config.min_similarity if "vector" in kinds else F.lit(False)
    near = F.coalesce(near, F.lit(False))
    named = F.arrays_overlap("terms", F.concat(F.coalesce(normalized_tokens(F.col("section_title")), F.array().cast("array<string>")), normalized_tokens(F.col("path"))))
    admitted = near if mode == "vector" else (F.col("body") > 0) | near | F.coalesce(named, F.lit(False))
    out.append(met.where(admitted).groupBy("query_id", "checksum").agg(F.sum("n").alias("n")))
    counts = out[0].unionAll(out[1]).withColumnRenamed("n", "duplicate_count")
    rows = hits.join(counts, ["query_id", "checksum"], "left").withColumn("duplicate_count", F.coalesce("duplicate_count", F.lit(1)).cast("long"))
    more = (F.col("duplicate_count") > 1) & ~F.array_contains("hit_flags", "duplicate")
    return rows.withColumn("hit_flags", F.when(more, F.array_append("hit_flags", F.lit("duplicate"))).otherwise(F.col("hit_flags")))


def normalized_breakdown(hits: DataFrame) -> DataFrame:
    names = ("semantic", "lexical", "phrase", "section", "path_score", "metadata")
    most = F.greatest(*names)
    return hits.withColumns({f"norm_{x}": F.round(F.when(most > 1.2e-7, F.col(x) / most).otherwise(0.0), 6) for x in names})


def cite(hits: DataFrame) -> DataFrame:
    return hits.withColumns({"label": F.format_string("[%d]", "rank"), "checksum_prefix": F.left("checksum", F.lit(12)), "snippet": best_snippet(F.col("text"), F.col("terms"))})


def retrieve(chunks: DataFrame, queries: DataFrame, mode: str = "lexical", vectors: DataFrame | None = None, asked: DataFrame | None = None, top_k: int = 5, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """Hits of all queries, ranked. chunks: annotated chunks with path; queries: query_id, query, and arrays source_ids and document_ids where they have
    scopes of their own; vectors (chunk_id, vector) and asked (query_id, vector) for vector and hybrid runs. Chunks that come with vector and norm, as prepare_chunks() gives
    them, are neither joined with vectors nor normalized again."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    k = min(config.top_k if top_k == 0 else top_k, config.max_top_k)
    if mode == "lexical" or vectors is not None:
        chunks = chunks.drop("vector")
    prepared = stored(prepare_queries(queries), "queries")
    pairs = stored(in_reach(chunks, prepared, mode, vectors, asked, k, config, metadata(config)), "pairs")
    ranked = stored(rank_hits(score(chunks.drop("norm", "vector"), prepared, pairs, mode, config).drop("text"), k, config), "ranked")
    hits = with_copies(ranked, chunks, mode, vectors, asked, config)
    # Only the texts of hits that stay are shuffled; where the hits are few, Spark finds them where they are read.
    texts = chunks.select("chunk_id", "text").join(ranked.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return cite(hits.join(texts, "chunk_id"))
