"""Deterministic hashed embeddings and the state of an embedding index."""

from __future__ import annotations

import hashlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.hashing import CONCEPTS, concept, feature_index, feature_sign
from attestor.functions.text import EMBEDDING_STOP_WORDS, embedding_tokens, normalize_text

DIMENSION, MODEL = 384, "local-hash-v1"
TOKEN, NGRAM, CONCEPT, BIGRAM = 1.0, 0.15, 2.2, 0.45
_CONCEPT_OF = {t: name for name, tokens in CONCEPTS.items() for t in tokens}


def features(tokens: Column) -> Column:
    """Features (name, weight) of sorted distinct tokens: tokens, their character trigrams, concepts, alphabetical neighbours."""
    named = lambda prefix, x, w: F.struct(F.concat(F.lit(prefix), x).alias("name"), F.lit(w).alias("weight"))
    n = F.size(tokens)

    def trigrams(t: Column) -> Column:
        size = F.char_length(t)
        return F.when(size >= 3, F.transform(F.sequence(F.lit(1), size - 2), lambda i: named("ngram:", F.substring(t, i, 3), NGRAM)))

    none = F.array().cast("array<struct<name:string,weight:double>>")
    return F.concat(
        F.transform(tokens, lambda t: named("token:", t, TOKEN)),
        F.flatten(F.transform(tokens, lambda t: F.coalesce(trigrams(t), none))),
        F.transform(F.filter(tokens, lambda t: concept(t).isNotNull()), lambda t: named("concept:", concept(t), CONCEPT)),
        F.when(n >= 2, F.transform(F.sequence(F.lit(0), n - 2), lambda i: named("bigram:", F.concat_ws(":", F.get(tokens, i), F.get(tokens, i + 1)), BIGRAM))).otherwise(none),
    )


def embed_sparse(df: DataFrame, key: str, text: str, dimension: int = DIMENSION) -> DataFrame:
    """(key, idx, value): the non-zero entries of the normalized embedding, by built-in functions alone."""
    rows = df.select(key, F.explode(features(embedding_tokens(F.col(text)))).alias("f"))
    rows = rows.select(key, feature_index(F.col("f.name"), dimension).alias("idx"), (F.col("f.weight") * feature_sign(F.col("f.name"))).alias("w"))
    sums = rows.groupBy(key, "idx").agg(F.round(F.sum("w"), 6).alias("w")).where("w <> 0")
    return sums.select(key, "idx", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))).alias("value"))


#: By kind of feature, negative and positive: what a slot gets for each.
WEIGHTS = np.array([sign * weight for weight in (TOKEN, NGRAM, CONCEPT, BIGRAM) for sign in (-1.0, 1.0)])


def _code(kind: int, name: str, dimension: int) -> int:
    """Kind, sign and slot of a feature in one number."""
    digest = hashlib.sha256(name.encode()).digest()
    return (2 * kind + (digest[8] & 1)) * dimension + int.from_bytes(digest[:8], "big") % dimension


class _Kept(dict):
    """What is made of a key, kept for the next time; all is dropped when it is much."""

    def __init__(self, make, most: int = 1 << 17):
        self.make, self.most = make, most

    def __missing__(self, key):
        made = self.make(key)
        if len(key) <= 32:
            if len(self) >= self.most:
                self.clear()
            self[key] = made
        return made


@lru_cache(maxsize=4)
def _codes(dimension: int) -> _Kept:
    """By token, the features that it has alone, as 32-bit numbers: texts share most of their tokens, and rare tokens their trigrams."""
    ngrams = _Kept(lambda x: _code(1, f"ngram:{x}", dimension))

    def alone(token: str) -> bytes:
        codes = [_code(0, f"token:{token}", dimension), *map(ngrams.__getitem__, map("".join, zip(token, token[1:], token[2:], strict=False)))]
        if token in _CONCEPT_OF:
            codes.append(_code(2, f"concept:{_CONCEPT_OF[token]}", dimension))
        return array("i", codes).tobytes()

    return _Kept(alone)


def _dense(tokens, dimension: int) -> np.ndarray:
    alone = np.frombuffer(b"".join(map(_codes(dimension).__getitem__, tokens)), np.int32)
    # Neighbours seldom come again: their digests are made for each text and read as arrays.
    digests = np.frombuffer(b"".join([hashlib.sha256(f"bigram:{a}:{b}".encode()).digest() for a, b in zip(tokens, tokens[1:], strict=False)]), np.uint8).reshape(-1, 32)
    slots = np.ascontiguousarray(digests[:, :8]).view(">u8").ravel() % np.uint64(dimension)
    pairs = (6 + (digests[:, 8] & 1)).astype(np.int64) * dimension + slots.astype(np.int64)
    counts = np.bincount(alone, minlength=8 * dimension) + np.bincount(pairs, minlength=8 * dimension)
    out = np.round(WEIGHTS @ counts.reshape(8, dimension), 6)
    norm = np.sqrt((out * out).sum())
    return out / norm if norm else out


def embed(text: Column, dimension: int = DIMENSION) -> Column:
    """The dense embedding: an Arrow function over the normalized text, equal to embed_sparse()."""
    return embed_normalized(normalize_text(text), dimension)


def embed_normalized(norm: Column, dimension: int = DIMENSION) -> Column:
    """The dense embedding of a text by its normalized form, where that is at hand."""
    drop = frozenset(("", *EMBEDDING_STOP_WORDS))

    @F.pandas_udf("array<double>")
    def dense(norm: pd.Series) -> pd.Series:
        return norm.map(lambda t: _dense([] if t is None else sorted(set(t.split(" ")) - drop), dimension))

    return dense(norm)


def state(chunk_checksum: Column, model: Column, size: Column, stored_checksum: Column, dimension: int = DIMENSION) -> Column:
    """missing, stale or indexed."""
    fresh = (stored_checksum == chunk_checksum) & (model == MODEL) & (size == dimension)
    return F.when(stored_checksum.isNull(), "missing").when(fresh, "indexed").otherwise("stale")


def embedding_status(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """One row: total, indexed, missing, stale, last_indexed_at. index: (chunk_id, chunk_checksum, model, size, indexed_at)."""
    rows = chunks.select("chunk_id", "checksum").join(index, "chunk_id", "left")
    rows = rows.withColumn("state", state(F.col("checksum"), F.col("model"), F.col("size"), F.col("chunk_checksum")))
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") == "indexed").alias("indexed"), F.count_if(F.col("state") == "missing").alias("missing"),
        F.count_if(F.col("state") == "stale").alias("stale"), F.max(F.when(F.col("state") == "indexed", F.col("indexed_at"))).alias("last_indexed_at"),
    )


def readiness(total: Column, indexed: Column, mode: Column) -> Column:
    return F.when(mode == "lexical", "not_required").when((total == 0) | (indexed == total), "ready").when(indexed == 0, "missing").otherwise("partial")


def query_readiness(states: DataFrame, queries: DataFrame, mode: str) -> DataFrame:
    """query_id, readiness, total, indexed, missing, stale of the chunks in each query's scope. states: source_id, document_id, state of
    every chunk; queries: query_id, and source_ids and document_ids where they have scopes, an empty list or null being no filter.

    Chunks are summed by document, by source and over all before any query meets them, so a query meets one row for each entry of its lists."""
    kinds = ("indexed", "missing", "stale")
    counts = [F.sum(c).alias(c) for c in ("total", *kinds)]
    by_document = states.groupBy("source_id", "document_id").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("state") == k).alias(k) for k in kinds])
    by_source = by_document.groupBy("source_id").agg(*counts)
    every = by_source.agg(*counts)
    none = F.array().cast("array<string>")
    asked = queries.select("query_id", *[(F.coalesce(F.array_distinct(c), none) if c in queries.columns else none).alias(c) for c in ("source_ids", "document_ids")])
    by_list = F.size("document_ids") > 0
    whole = asked.where(~by_list & (F.size("source_ids") == 0)).select("query_id").join(F.broadcast(every))  # one row
    some = asked.where(~by_list & (F.size("source_ids") > 0)).select("query_id", F.explode("source_ids").alias("source_id")).join(by_source, "source_id")
    named = asked.where(by_list).select("query_id", "source_ids", F.explode("document_ids").alias("document_id")).join(by_document, "document_id")
    named = named.where((F.size("source_ids") == 0) | F.array_contains("source_ids", F.col("source_id")))
    columns = ["query_id", "total", *kinds]
    sums = whole.select(*columns).unionAll(some.select(*columns)).unionAll(named.select(*columns)).groupBy("query_id").agg(*counts)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = queries.select("query_id").join(sums, "query_id", "left").select("query_id", *map(zero, columns[1:]))
    if mode == "lexical":
        rows = rows.withColumns({k: F.lit(0).cast("long") for k in kinds})
    return rows.select("query_id", readiness(F.col("total"), F.col("indexed"), F.lit(mode)).alias("readiness"), *columns[1:])


class HashProvider:
    """Hashed embeddings of a chosen size. Any object with model, dimension and vectors(text column) can stand in its place."""

    def __init__(self, dimension: int = DIMENSION, model: str = MODEL):
        self.dimension, self.model = dimension, model

    def vectors(self, text: Column) -> Column:
        return embed(text, self.dimension)


def embed_with(provider, rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, model, size, vector of every row by a provider; one without dimensions is refused."""
    if provider.dimension <= 0:
        raise ValueError("an embedding needs dimensions")
    return rows.select(key, F.lit(provider.model).alias("model"), F.lit(provider.dimension).alias("size"), provider.vectors(F.col(text)).alias("vector"))
