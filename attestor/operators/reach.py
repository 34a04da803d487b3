"""Which chunks can be among a query's first k, found where the chunks are.

A block of queries goes to every task: its terms, the phrases to look for, and vectors where the mode has any. A task reads its chunks once, scores the
pairs that share a term or are near enough, and keeps of every query a heap of the k best different texts. A pair below the
k-th best of its query's heap is dropped at once. What is shuffled is what the heaps hold at the end, about k rows a query and task,
however many chunks share a frequent term or are copies of one text; postings, pairs and texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from attestor.functions.text import normalize_text

MAX_QUERIES = 20_000  # of a block; more queries make more blocks, each of which reads all chunks once
MAX_CELLS = 4_000_000  # of one matrix of similarities in a task
STEP = 1000  # chunks that are scored together
SLACK = 2e-5  # more than what rounding each signal to six digits can move a score

FOUND = ("matched", "frequency", "body", "phrase", "similarity")
SCOPES = {"source_ids": "source_id", "document_ids": "document_id"}


def blocks(rows: DataFrame, most: int) -> Iterator[list[Row]]:
    """All rows in lists of at most so many; one empty list where there are none. Beyond one list they arrive partition by
    partition, so the driver holds no more than a list and a partition."""
    held = rows.limit(most + 1).collect()
    if len(held) <= most:
        yield held
        return
    held = []
    for r in rows.toLocalIterator():
        held.append(r)
        if len(held) == most:
            yield held
            held = []
    if held:
        yield held


def by_blocks(rows: DataFrame, most: int, found: Callable[[list[Row]], DataFrame]) -> DataFrame:
    """The union of what is found for each block."""
    return reduce(DataFrame.unionAll, map(found, blocks(rows, most)))


def scope_columns(rows: DataFrame) -> list[str]:
    return [c for c in SCOPES if c in rows.columns]


def own_scope(pairs: DataFrame) -> DataFrame:
    """Pairs whose chunk is in the scope of their query: source_ids and document_ids, where given, name its source and its document; an
    empty list or null is no filter."""
    out = pairs
    for ids in scope_columns(pairs):
        out = out.where((F.coalesce(F.size(ids), F.lit(0)) <= 0) | F.array_contains(ids, F.col(SCOPES[ids])))
    return out


def unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


class Lists:
    """Lists of numbers by key, one after the other in one array."""

    def __init__(self, pairs: list[tuple[int, int]], keys: int):
        self.of = np.array([v for _, v in sorted(pairs)], np.int64)
        self.size = np.bincount([k for k, _ in pairs], minlength=keys) if keys else np.zeros(0, np.int64)
        self.start = np.r_[0, np.cumsum(self.size)[:-1]] if keys else self.size

    def of_all(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The positions of keys, each as often as its list is long, and the numbers of the lists."""
        size = self.size[keys]
        at = np.repeat(np.arange(len(keys)), size)
        return at, self.of[np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size) + self.start[keys][at]]


class Asked:
    """A block of queries as tasks read it."""

    def __init__(self, rows: list[Row], mode: str):
        self.ids = [r["query_id"] for r in rows]
        self.n_terms = np.array([max(1, r["n_terms"]) for r in rows], float)
        words = enumerate(r["terms"] if mode != "vector" else [] for r in rows)
        named = [(t, at) for at, terms in words for t in terms]
        self.term = {t: i for i, t in enumerate(dict.fromkeys(t for t, _ in named))}
        self.of_term = Lists([(self.term[t], at) for t, at in named], len(self.term))
        spoken = [(r["normalized"], 2 * at) for at, r in enumerate(rows) if r["normalized"] and mode != "vector"]  # even: the whole phrase
        spoken += [(f"{a} {b}", 2 * at + 1) for at, r in enumerate(rows) if mode != "vector" for a, b in zip(r["terms"], r["terms"][1:], strict=False)]
        self.phrase = {p: i for i, p in enumerate(dict.fromkeys(p for p, _ in spoken))}
        self.of_phrase = Lists([(self.phrase[p], v) for p, v in spoken], len(self.phrase))
        self.scopes = {at: s for at, r in enumerate(rows) if (s := {own: set(r[ids]) for ids, own in SCOPES.items() if ids in r and r[ids]})}
        self.vectors: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        sizes = [len(r["vector"]) if mode != "lexical" and r["vector"] else 0 for r in rows]
        for size in set(sizes) - {0}:
            at = np.flatnonzero(np.array(sizes) == size)
            self.vectors[size] = (at, unit(np.array([rows[i]["vector"] for i in at], np.float64)))


def sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys in order and, for each, the number of its rows and the sums of values."""
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, *[np.bincount(at, v, len(distinct)) for v in (None, *values)]


def looked_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each key that is known, else 0. known is sorted."""
    at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
    return np.where(known[at] == keys, values[at], 0) if len(known) else np.zeros(len(keys))


def lexical_signals(asked: Asked, chunks: pd.DataFrame, automaton, config) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Keys (chunk * queries + query) of all pairs that share a term, with their signals and what they sum to."""
    q, t = len(asked.ids), max(1, len(asked.term))
    held = []
    for column in ("norm", "section_norm", "path_norm"):
        terms = [[asked.term[w] for w in text.split(" ") if w in asked.term] if text else [] for text in chunks[column]]
        held.append(np.repeat(np.arange(len(terms)), [len(x) for x in terms]) * t + np.fromiter((i for x in terms for i in x), np.int64))
    met, count = sums(np.concatenate(held))
    at, query = asked.of_term.of_all(met % t)
    inside = [np.isin(met, np.unique(h))[at].astype(float) for h in held]
    keys, matched, frequency, body, section, path = sums((met // t)[at] * q + query, np.minimum(count, 4)[at], *inside)

    spoken = []
    for row, text in enumerate(chunks["norm"] if asked.phrase else ()):
        spoken += [(row, p) for p in {p for _, p in automaton.iter(text)}]
    row, phrase = np.array(spoken, np.int64).reshape(-1, 2).T
    at, who = asked.of_phrase.of_all(phrase)
    pair = row[at] * q + who // 2
    neighbours = looked_up(keys, *sums(pair[who % 2 == 1]))
    phrases = np.where(np.isin(keys, pair[who % 2 == 0]), config.phrase, neighbours * (config.phrase / 4))
    share = matched * config.lexical + frequency * (config.frequency / 4) + section * config.section + path * config.path
    own = share / asked.n_terms[keys % q] + phrases + chunks["offset"].to_numpy()[keys // q]
    return keys, {"matched": matched, "frequency": frequency, "body": body, "phrase": phrases, "score": own}


def near_pairs(asked: Asked, chunks: pd.DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of pairs of a similarity of at least least, and their similarities."""
    q = len(asked.ids)
    sizes = chunks["vector"].map(lambda v: 0 if v is None else len(v)).to_numpy()
    keys, found = [np.zeros(0, np.int64)], [np.zeros(0)]
    for size, (who, vectors) in asked.vectors.items():
        own = np.flatnonzero(sizes == size)
        step = max(1, MAX_CELLS // len(who))
        for part in (own[i : i + step] for i in range(0, len(own), step)):
            similar = unit(np.stack(chunks["vector"].iloc[part].to_list()).astype(np.float64)) @ vectors.T
            row, at = np.nonzero(similar >= least)
            keys.append(part[row] * q + who[at])
            found.append(similar[row, at])
    key, value = np.concatenate(keys), np.concatenate(found)
    order = np.argsort(key, kind="stable")
    return key[order], value[order]


def first_texts(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Of rows (at, score, path, ordinal, chunk_id, checksum): for each at the first k different checksums by score falling, path, ordinal, chunk_id, and
    what is within rounding of the k-th. Scores equal to nine digits are ties, of which the first k are enough."""
    rows = rows.assign(key=np.round(rows["score"] * 1e9)).sort_values(["at", "key", "path", "ordinal", "chunk_id"], ascending=[True, False, True, True, True], kind="stable")
    near = rows["key"].diff().abs().le(SLACK * 1e9).to_numpy() & rows["at"].eq(rows["at"].shift()).to_numpy()
    again = rows.duplicated(["at", "checksum"]).to_numpy()
    # A copy within rounding of the one before it may come first in the end.
    rows = rows[~again | (near & ~rows.duplicated(["at", "checksum", "key"]).to_numpy())]
    nth = (~rows.duplicated(["at", "checksum"])).groupby(rows["at"]).cumsum()
    bar = rows["at"].map(rows.assign(nth=nth)[nth <= k].groupby("at")["key"].min())
    full = rows["at"].map(nth.groupby(rows["at"]).max()) >= k
    tied = rows.groupby(["at", "key"]).cumcount()
    return rows[(nth <= k) | (~full) | ((rows["key"] >= bar - SLACK * 1e9) & (tied < k))].drop(columns="key")


def in_reach(chunks: DataFrame, queries: DataFrame, mode: str, vectors: DataFrame | None, asked: DataFrame | None, k: int, config, metadata: Column) -> DataFrame:
    """query_id, chunk_id, matched, frequency, body, phrase, similarity of the pairs that can be among the first k of their query, by score, path, ordinal and
    chunk_id, one a checksum. queries: prepared; vectors: (chunk_id, vector), None where chunks have them; asked: (query_id, vector); metadata: a chunk's own part of the
    score. chunks may have norm, the normalized text."""
    lexical = mode != "vector"
    norm = lambda c: (F.col("norm") if c == "text" and "norm" in chunks.columns else normalize_text(F.col(c))) if lexical else F.lit("")
    rows = chunks.select(
        "chunk_id", "checksum", "path", "ordinal", "source_id", "document_id", norm("text").alias("norm"), F.coalesce(norm("section_title"), F.lit("")).alias("section_norm"),
        F.coalesce(norm("path"), F.lit("")).alias("path_norm"), (metadata if lexical else F.lit(0.0)).alias("offset"),
        *(["vector"] if mode != "lexical" and vectors is None else []),
    )
    if mode != "lexical":
        rows, queries = rows if vectors is None else rows.join(vectors, "chunk_id", "left"), queries.join(asked, "query_id")
    kind = dict(queries.dtypes)["query_id"]
    return by_blocks(queries, MAX_QUERIES, lambda held: _in_reach(rows, held, mode, k, config, kind))


def _in_reach(chunks: DataFrame, queries: list[Row], mode: str, k: int, config, kind: str) -> DataFrame:
    shared = chunks.sparkSession.sparkContext.broadcast(Asked(queries, mode))
    weight = {"lexical": 0.0, "vector": config.semantic_vector, "hybrid": config.semantic_hybrid}[mode]

    def scored(asked: Asked, some: pd.DataFrame, automaton) -> pd.DataFrame:
        q = len(asked.ids)
        keys, signals = lexical_signals(asked, some, automaton, config) if mode != "vector" else (np.zeros(0, np.int64), {c: np.zeros(0) for c in (*FOUND[:4], "score")})
        near, similar = near_pairs(asked, some, config.min_similarity) if mode != "lexical" else (np.zeros(0, np.int64), np.zeros(0))
        every = np.union1d(keys, near)
        out = pd.DataFrame({"at": every % q, "row": every // q} | {c: looked_up(every, keys, v) for c, v in signals.items()} | {"similarity": looked_up(every, near, similar)})
        alone = np.zeros(len(out)) if mode == "vector" else some["offset"].to_numpy()[out["row"]]
        out["score"] = np.where(out["matched"] > 0, out["score"], alone) + out["similarity"] * weight
        for at, scope in asked.scopes.items():
            outside = np.zeros(len(some), bool)
            for own, allowed in scope.items():
                outside |= ~some[own].isin(allowed).to_numpy()
            out = out[(out["at"] != at) | ~outside[out["row"]]]
        return out[out["score"] > 0]

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        asked, automaton = shared.value, ahocorasick.Automaton()
        for phrase, at in asked.phrase.items():
            automaton.add_word(phrase, at)
        if asked.phrase:
            automaton.make_automaton()
        best, bar = None, np.full(len(asked.ids), -np.inf)
        for batch in batches:
            for begin in range(0, len(batch) if asked.ids else 0, STEP):
                some = batch.iloc[begin : begin + STEP].reset_index(drop=True)
                rows = scored(asked, some, automaton)
                rows = rows[rows["score"] >= bar[rows["at"]] - SLACK]
                rows = pd.concat([rows.drop(columns="row").reset_index(drop=True), some.loc[rows["row"], ["chunk_id", "checksum", "path", "ordinal"]].reset_index(drop=True)], axis=1)
                best = first_texts(rows if best is None else pd.concat([best, rows], ignore_index=True), k)
                nth = best.drop_duplicates(["at", "checksum"])
                nth = nth[nth.groupby("at").cumcount() == k - 1]
                bar[nth["at"]] = nth["score"]
        if best is not None and len(best):
            yield pd.DataFrame({"query_id": [asked.ids[i] for i in best["at"]], "chunk_id": best["chunk_id"].to_numpy()} | {c: best[c].to_numpy() for c in FOUND})

    return chunks.mapInPandas(found, f"query_id {kind}, chunk_id string, matched double, frequency double, body double, phrase double, similarity double")
