"""Heaps in tasks against plain scoring of all pairs."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from attestor.functions.text import normalize_text, normalized_tokens, query_terms
from attestor.operators import reach, retrieval
from attestor.operators.intelligence import annotate_quality

WORDS = "ab abc b ba cab c d da dab e the of x1 y2 zz z".split()


def corpus(spark, n=240, copies=60, seed=1):
    """Chunks of few words, a third of them copies of three texts, in two sources."""
    r = random.Random(seed)
    texts = [" ".join(r.choices(WORDS, k=r.randint(1, 14))) for _ in range(n)]
    for i in r.sample(range(n), copies):
        texts[i] = texts[i % 3]
    rows = [(f"c{i}", f"d{i // 4}", f"s{i % 3}", f"s{i % 3}/{r.choice(WORDS)}{i // 40}.txt", i % 4, t, len(t.split()), r.choice([None, None, "Ab zz"])) for i, t in enumerate(texts)]
    return annotate_quality(spark.createDataFrame(rows, "chunk_id string, document_id string, source_id string, path string, ordinal int, text string, token_count int, section_title string"))


def questions(spark, n=40, seed=2, scoped=False):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choices(WORDS, k=r.randint(1, 6))), r.choice([[], ["s0"], ["s1", "s2"], ["nowhere"]]), r.choice([None, [f"d{r.randint(0, 59)}" for _ in range(20)]])) for i in range(n)] + [(900, "the of", [], None), (901, "", [], None)]
    df = spark.createDataFrame(rows, "query_id long, query string, source_ids array<string>, document_ids array<string>")
    return df if scoped else df.select("query_id", "query")


def vectors(spark, ids, size=6, seed=3):
    r = np.random.default_rng(seed)
    return [(i, [float(v) for v in r.normal(0, 1, size)]) for i in ids]


def plain(chunks, queries, mode, vecs, asked, k):
    """Every pair scored one by one; the first k different texts of each query with the number of their copies."""
    c = chunks.select("*", normalized_tokens(F.col("text")).alias("tokens"), normalize_text(F.col("text")).alias("norm"), normalized_tokens(F.col("path")).alias("p"), normalized_tokens(F.col("section_title")).alias("s")).collect()
    q = queries.select("*", query_terms(F.col("query")).alias("terms"), normalize_text(F.col("query")).alias("normalized")).collect()
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    out = {}
    for x in q:
        rows = []
        for y in c:
            if "source_ids" in x and ((x["source_ids"] and y["source_id"] not in x["source_ids"]) or (x["document_ids"] and y["document_id"] not in x["document_ids"])):
                continue
            terms, n = x["terms"], max(1, len(x["terms"]))
            section = y["s"] or []
            every = y["tokens"] + y["p"] + section
            matched = [t for t in terms if t in every]
            sim = cos(asked[x["query_id"]], vecs[y["chunk_id"]]) if mode != "lexical" else 0.0
            sem = round((sim if sim >= 0.25 else 0.0) * {"lexical": 0, "vector": 3.0, "hybrid": 2.0}[mode], 6)
            lexical = round(len(matched) / n * 2.4 + sum(min(4, every.count(t)) for t in matched) / (n * 4) * 0.6, 6) if matched else 0.0
            pairs = sum(f"{a} {b}" in y["norm"] for a, b in zip(terms, terms[1:], strict=False))
            phrase = (1.2 if x["normalized"] and x["normalized"] in y["norm"] else round(pairs * 0.3, 6)) if matched else 0.0
            share = lambda f: len([t for t in terms if t in f]) / n  # noqa: B023, E731
            own = lexical + phrase + round(share(section) * 0.75, 6) + round(share(y["p"]) * 0.5, 6) + round((0.08 if y["section_title"] is not None else 0) + 0.02, 6)
            score = round(sem if mode == "vector" else own + sem, 6)
            if (matched or sem > 0) and score > 0:
                rows.append((-score, y["path"], y["ordinal"], y["chunk_id"], y["checksum"]))
        seen, hits = {}, []
        for r in sorted(rows):
            if r[4] not in seen:
                hits.append(r)
            seen[r[4]] = seen.get(r[4], 0) + 1
        out[x["query_id"]] = [(r[3], -r[0], seen[r[4]]) for r in hits[:k]]
    return out


@pytest.mark.parametrize("mode", ["lexical", "vector", "hybrid"])
@pytest.mark.parametrize("scoped", [False, True])
def test_hits_equal_plain_scoring_of_all_pairs(spark, mode, scoped):
    chunks, queries, k = corpus(spark).cache(), questions(spark, scoped=scoped), 4
    sums = {}  # copies of a text have one vector, as in an index without stale rows
    vecs = {r["chunk_id"]: sums.setdefault(r["checksum"], v) for (_, v), r in zip(vectors(spark, range(240)), chunks.collect(), strict=True)}
    asked = dict(vectors(spark, [r["query_id"] for r in queries.collect()], seed=5))
    want = plain(chunks, queries, mode, vecs, asked, k)
    args = () if mode == "lexical" else (spark.createDataFrame(list(vecs.items()), "chunk_id string, vector array<double>"), spark.createDataFrame(list(asked.items()), "query_id long, vector array<double>"))
    got: dict = {i: [] for i in want}
    for r in retrieval.retrieve(chunks, queries, mode, *args, top_k=k).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["chunk_id"], r["score"], r["duplicate_count"]))
    assert got == want and any(want.values())


def test_tasks_hand_on_about_k_rows_a_query(spark):
    """1,500 chunks hold the frequent word; of their pairs with 30 queries each of 4 tasks hands on what can still be first."""
    r = random.Random(0)
    rows = [(f"c{i}", "d", "s", f"p{i}", 0, "frequent " + " ".join(r.choices(WORDS, k=8)), 9, None) for i in range(1500)]
    chunks = annotate_quality(spark.createDataFrame(rows, "chunk_id string, document_id string, source_id string, path string, ordinal int, text string, token_count int, section_title string").repartition(4)).repartition(4)
    queries = retrieval.prepare_queries(spark.createDataFrame([(i, "frequent " + " ".join(r.choices(WORDS, k=3))) for i in range(30)], "query_id long, query string"))
    config = retrieval.RetrievalConfig()
    joined = reach.in_reach(chunks, queries, "lexical", None, None, 5, config, retrieval.metadata(config)).count()
    assert 30 * 5 <= joined <= 30 * 5 * 4 * 2 < 30 * 1500 / 10


def test_first_texts_keep_every_possible_first():
    r = np.random.default_rng(0)
    for _ in range(30):
        n = 200
        rows = pd.DataFrame({"at": r.integers(0, 4, n), "score": np.round(r.integers(0, 12, n) / 3, 6), "path": r.integers(0, 5, n).astype(str), "ordinal": r.integers(0, 3, n), "chunk_id": [f"c{i:03}" for i in r.permutation(n)], "checksum": r.integers(0, 40, n).astype(str)})
        got = reach.first_texts(rows, 3)
        for at, own in rows.groupby("at"):
            best = own.sort_values(["score", "path", "ordinal", "chunk_id"], ascending=[False, True, True, True]).drop_duplicates("checksum").head(3)
            assert set(best["chunk_id"]) <= set(got[got["at"] == at]["chunk_id"]) and len(got[got["at"] == at]) <= 9


def test_chunks_prepared_once_give_the_hits_of_all_modes(spark):
    from attestor.operators.embedding import embed
    from attestor.sources.scratch import stored

    c, q = corpus(spark), questions(spark)
    held, asked = stored(retrieval.prepare_chunks(c), "chunks"), stored(q.select("query_id", embed(F.col("query")).alias("vector")), "asked")
    apart = stored(c.select("chunk_id", embed(F.col("text")).alias("vector")), "vectors")
    for mode in retrieval.MODES:
        got, want = (retrieval.retrieve(x, q, mode, v, asked).drop("source_ids", "document_ids") for x, v in ((held, None), (c, apart)))
        assert got.columns == want.columns and want.count() > 0
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_embeddings_count_features_whatever_is_kept_of_tokens(spark, monkeypatch):
    import hashlib

    from attestor.functions.hashing import CONCEPTS
    from attestor.operators import embedding

    def plain_vector(tokens, dimension):
        names = [(f"token:{t}", 1.0) for t in tokens] + [(f"ngram:{t[i : i + 3]}", 0.15) for t in tokens for i in range(len(t) - 2)]
        names += [(f"concept:{c}", 2.2) for t in tokens for c, held in CONCEPTS.items() if t in held] + [(f"bigram:{a}:{b}", 0.45) for a, b in zip(tokens, tokens[1:], strict=False)]
        out = np.zeros(dimension)
        for name, weight in names:
            digest = hashlib.sha256(name.encode()).digest()
            out[int.from_bytes(digest[:8], "big") % dimension] += weight if digest[8] & 1 else -weight
        out = np.round(out, 6)
        return out / (np.linalg.norm(out) or 1.0)

    r = random.Random(5)
    texts = [sorted({"".join(r.choices("abcé1", k=r.randint(1, 50))) for _ in range(r.randint(0, 60))} | set(r.sample(["gpu", "skill", "vector", "vectors"], 2))) for _ in range(40)] + [[]]
    for most in (1 << 17, 3):
        embedding._codes.cache_clear()
        monkeypatch.setattr(embedding._Kept.__init__, "__defaults__", (most,))
        for size in (384, 7):
            assert all(np.allclose(embedding._dense(t, size), plain_vector(t, size), atol=1e-12) for t in texts)
    embedding._codes.cache_clear()
