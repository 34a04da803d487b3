"""One query for each operator of the inventory over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators import answer, retrieval
from attestor.plans import oracle as o
from attestor.plans.tables import chunks, documents, questions, table
from attestor.sources.scratch import stored

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def joined(c) -> Column:
    return F.array_join(c, ",")


# Chunks


@query("op_c1_whitespace_windows", "WITH " + o.DOCS + "," + o.windows() + """
SELECT chunk_id, ordinal, token_count, byte_start, byte_end, split_reason, sha256(text) AS checksum FROM windows""")
def whitespace_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.operators.chunking import Chunking, chunk_whitespace

    rows = chunk_whitespace(documents(spark, sf_dir), Chunking(strategy="whitespace"))
    return rows.select("chunk_id", "ordinal", "token_count", "byte_start", "byte_end", "split_reason", F.sha2("text", 256).alias("checksum"))


@query("op_a21_chunk_quality", "WITH " + o.CHUNKS + """
SELECT chunk_id, checksum, text_density, is_duplicate, array_to_string(quality_flags, ',') AS flags, evidence_score_hint FROM chunks""")
def chunk_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_id", "checksum", "text_density", "is_duplicate", joined("quality_flags").alias("flags"), "evidence_score_hint")


# Retrieval


def lexical_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked hits of all questions, stored: what is built on them reads them several times."""
    return stored(retrieval.retrieve(chunks(spark, sf_dir), questions(spark, sf_dir)), "hits")


@query("op_r_lexical_retrieval", "WITH " + o.RETRIEVED + """
SELECT query_id, rank, chunk_id, score, lexical, phrase, path_score, metadata, strength, array_to_string(hit_flags, ',') AS flags, duplicate_count FROM hits""")
def lexical_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_hits(spark, sf_dir).select("query_id", "rank", "chunk_id", "score", "lexical", "phrase", "path_score", "metadata", "strength", joined("hit_flags").alias("flags"), "duplicate_count")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.assess(lexical_hits(spark, sf_dir))


@query("op_an4_answer_support", "WITH " + o.JUDGED + """
SELECT query_id, rank, chunk_id, matched_body, coverage, support_status, support_reason FROM judged""")
def answer_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("query_id", "rank", "chunk_id", "matched_body", "coverage", "support_status", "support_reason")


@query("op_an7_extractive_answer", "WITH " + o.JUDGED + f""",
cited AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM judged WHERE support_status = 'supported'),
texts AS (
  SELECT query_id, string_agg(CASE WHEN length({o.trim('sentence')}) > 280 THEN left({o.trim('sentence')}, 280) || '...' ELSE {o.trim('sentence')} END || ' [' || rank || ']', chr(10) ORDER BY rank) AS t,
    string_agg(chunk_id, ',' ORDER BY rank) AS citations FROM cited WHERE place <= 3 GROUP BY query_id
), n AS (SELECT query_id, count(*) AS hits FROM judged GROUP BY query_id)
SELECT query_id, CASE WHEN t IS NOT NULL THEN 'answered' ELSE 'insufficient_evidence' END AS status,
  CASE WHEN t IS NOT NULL THEN t WHEN coalesce(hits, 0) > 0 THEN '{answer.UNSUPPORTED}' ELSE '{answer.NO_EVIDENCE}' END AS answer,
  coalesce(citations, '') AS citations, coalesce(hits, 0) AS hits
FROM questions LEFT JOIN n USING (query_id) LEFT JOIN texts USING (query_id)""")
def extractive_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.answers(questions(spark, sf_dir), judged(spark, sf_dir)).select("query_id", "status", "answer", joined("citations").alias("citations"), "hits")


@query("op_r9_normalized_breakdown", "WITH " + o.RETRIEVED + """,
m AS (SELECT *, greatest(lexical, phrase, section, path_score, metadata) AS most FROM hits)
SELECT query_id, rank, CASE WHEN most > 1.2e-7 THEN round(lexical / most, 6) ELSE 0.0 END AS norm_lexical, CASE WHEN most > 1.2e-7 THEN round(phrase / most, 6) ELSE 0.0 END AS norm_phrase,
  CASE WHEN most > 1.2e-7 THEN round(path_score / most, 6) ELSE 0.0 END AS norm_path FROM m""")
def normalized_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.normalized_breakdown(lexical_hits(spark, sf_dir)).select("query_id", "rank", "norm_lexical", "norm_phrase", F.col("norm_path_score").alias("norm_path"))


@query("op_r12_citations", "WITH " + o.RETRIEVED + rf""",
c AS (
  SELECT *, list_transform({o.sentences('text')}, lambda s, i: struct_pack(n := {o.MET}, s := s)) AS ss FROM hits
), b AS (SELECT *, coalesce(list_max(list_transform(ss, lambda x: x.n)), 0) AS most FROM c),
p AS (SELECT *, {o.trim("CASE WHEN most > 0 THEN list_filter(ss, lambda x: x.n = most)[1].s ELSE text END")} AS snip FROM b)
SELECT query_id, '[' || rank || ']' AS label, chunk_id, left(checksum, 12) AS checksum_prefix, CASE WHEN length(snip) > 280 THEN left(snip, 280) || '...' ELSE snip END AS snippet FROM p""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_hits(spark, sf_dir).select("query_id", "label", "chunk_id", "checksum_prefix", "snippet")


@query("op_g5_matched_terms", "WITH " + o.CHUNKS + "," + o.QUERIES + rf""",
idx AS (SELECT chunk_id, term, count(*) AS n FROM (SELECT chunk_id, unnest(list_concat({o.tokens('text')}, {o.tokens('path')})) AS term FROM chunks) GROUP BY ALL)
SELECT query_id, count(*) AS pairs, count(DISTINCT chunk_id) AS chunks, sum(n)::BIGINT AS occurrences, sum(least(n, 4))::BIGINT AS frequency
FROM idx JOIN (SELECT query_id, unnest(terms) AS term FROM q) USING (term) GROUP BY query_id""")
def matched_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.functions.text import normalized_tokens

    rows = chunks(spark, sf_dir).select("chunk_id", F.explode(F.concat(normalized_tokens(F.col("text")), normalized_tokens(F.col("path")))).alias("term")).groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("n"))
    wanted = retrieval.prepare_queries(questions(spark, sf_dir)).select("query_id", F.explode("terms").alias("term"))
    return rows.join(wanted, "term").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_distinct("chunk_id").alias("chunks"), F.sum("n").alias("occurrences"), F.sum(F.least("n", F.lit(4))).alias("frequency")
    )


# Vector search


@query("op_j8_vector_search", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (
  SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.25
)
SELECT query_id, chunk_id, similarity, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM p) WHERE rank <= 5""")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 20, against all others: five each, and themselves."""
    from pyspark.sql import Window

    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    wanted = v.where(F.col("chunk_id") % 20 == 0).select(F.col("chunk_id").alias("query_id"), "vector")
    near = retrieval.similarities(v, wanted, 0.25, keep=6).where("query_id <> chunk_id").withColumn("similarity", F.round("similarity", 6))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id"))
    return near.withColumn("rank", rank).where("rank <= 5")


EMBEDDED = "WITH " + o.DOCS + rf""",
items AS (SELECT item_id AS id, text FROM benchmark),
t AS (SELECT id, {o.terms('text', o.EMBEDDING_STOP_WORDS)} AS t FROM items),
f AS (
  SELECT id, 'token:' || unnest(t) AS name, 1.0 AS w FROM t
  UNION ALL SELECT id, 'ngram:' || unnest(flatten(list_transform(t, lambda x: list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3))))), 0.15 FROM t
  UNION ALL SELECT id, 'bigram:' || unnest(list_transform(range(1, len(t)), lambda i: t[i] || ':' || t[i + 1])), 0.45 FROM t
  UNION ALL SELECT id, 'concept:' || c, 2.2 FROM (SELECT id, unnest(t) AS tok FROM t) JOIN (VALUES {", ".join(f"('{t}', '{c}')" for c, ts in o.CONCEPTS.items() for t in ts)}) AS m(tok, c) USING (tok)
),
s AS (
  SELECT id, (('0x' || substr(sha256(name), 1, 16))::UBIGINT % 384)::INT AS idx, w * CASE WHEN ('0x' || substr(sha256(name), 17, 2))::INT & 1 = 1 THEN 1 ELSE -1 END AS w FROM f
),
g AS (SELECT id, idx, round(sum(w), 6)::DOUBLE AS w FROM s GROUP BY ALL HAVING round(sum(w), 6) <> 0),
e AS (SELECT id, idx, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS value FROM g)"""


@query("op_e1_hash_embedding", EMBEDDED + " SELECT id AS item_id, idx, round(value, 6) AS value FROM e")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.operators.embedding import embed_sparse

    return embed_sparse(table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", "text").select("item_id", "idx", F.round("value", 6).alias("value"))


@query("op_e1_dense_embedding", EMBEDDED + " SELECT id AS item_id, idx, round(value, 6) AS value FROM e")
def dense_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the Arrow function."""
    from attestor.operators.embedding import embed

    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(embed(F.col("text"))).alias("idx", "value"))
    return rows.where("value <> 0").select("item_id", "idx", F.round("value", 6).alias("value"))


def vectors_of(rows: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The embeddings of chunks and of questions, stored: retrieval reads them several times."""
    from attestor.operators.embedding import embed

    return stored(rows.select("chunk_id", embed(F.col("text")).alias("vector")), "vectors"), stored(asked.select("query_id", embed(F.col("query")).alias("vector")), "asked")


def retrieved(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    rows, asked = chunks(spark, sf_dir), questions(spark, sf_dir)
    return retrieval.retrieve(rows, asked, mode, *vectors_of(rows, asked))


def retrieved_with_vectors(mode: str) -> str:
    """The SQL of ranked hits in vector or hybrid mode, with every similarity summed over the dimensions."""
    items = ", items AS (SELECT chunk_id AS id, text FROM chunks UNION ALL SELECT 'q' || query_id, query FROM q)," + EMBEDDED.split("FROM benchmark),")[1].replace("\ne AS (", "\nemb AS (")
    similar = """,
sim AS (
  SELECT q.query_id, b.id AS chunk_id, sum(a.value * b.value) AS similarity FROM q JOIN emb a ON a.id = 'q' || q.query_id JOIN emb b ON a.idx = b.idx AND b.id LIKE 'd%' GROUP BY ALL HAVING sum(a.value * b.value) >= 0.25
),
pairs AS (SELECT query_id, chunk_id, coalesce(matched, 0) AS matched, coalesce(frequency, 0) AS frequency, coalesce(similarity, 0.0) AS similarity FROM shared FULL JOIN sim USING (query_id, chunk_id)),"""
    idx, rest = o.SCORED.split("norm AS (", 1)
    weight = {"vector": 3.0, "hybrid": 2.0}[mode]
    rest = rest.replace("0.0 AS semantic", f"round(similarity * {weight}, 6) AS semantic").replace("round(matched /", "round(CASE WHEN matched > 0 THEN matched /").replace("* 0.6, 6)", "* 0.6 ELSE 0 END, 6)")
    rest = rest.replace("CASE WHEN normalized <> ''", "CASE WHEN matched = 0 THEN 0 WHEN normalized <> ''")
    rest = rest.replace("round(lexical + phrase + section + path_score + metadata, 6)", "semantic" if mode == "vector" else "round(lexical + phrase + section + path_score + metadata + semantic, 6)")
    hits = o.HITS.replace("CASE WHEN matched > 0 THEN 'exact_term_match' END", "CASE WHEN semantic > 0 THEN 'semantic_match' END, CASE WHEN matched > 0 THEN 'exact_term_match' END")
    return o.CHUNKS + "," + o.QUERIES + items + "," + idx.replace("pairs AS (", "shared AS (").rstrip().rstrip(",") + similar + "norm AS (" + rest + "," + hits


@query("op_r3_vector_retrieval", "WITH " + retrieved_with_vectors("vector") + " SELECT query_id, rank, chunk_id, round(score, 4) AS score, strength FROM hits")
def vector_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieved(spark, sf_dir, "vector").select("query_id", "rank", "chunk_id", F.round("score", 4).alias("score"), "strength")


@query("op_r8_hybrid_retrieval", "WITH " + retrieved_with_vectors("hybrid") + " SELECT query_id, rank, chunk_id, round(score, 4) AS score, semantic, lexical, phrase, strength, array_to_string(hit_flags, ',') AS flags FROM hits")
def hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieved(spark, sf_dir, "hybrid").select("query_id", "rank", "chunk_id", F.round("score", 4).alias("score"), "semantic", "lexical", "phrase", "strength", joined("hit_flags").alias("flags"))


INDEX = """,
state AS (
  SELECT chunk_id, source_id, CASE left(checksum, 1) WHEN '0' THEN 'missing' WHEN '1' THEN 'stale' ELSE 'indexed' END AS state FROM chunks
)"""


@query("op_g1_embedding_status", "WITH " + o.CHUNKS + INDEX + """
SELECT count(*) AS total, count(*) FILTER (state = 'indexed') AS indexed, count(*) FILTER (state = 'missing') AS missing, count(*) FILTER (state = 'stale') AS stale,
  max(CASE WHEN state = 'indexed' THEN TIMESTAMP '2024-01-01 00:00:00' END) AS last_indexed_at FROM state""")
def embedding_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.operators import embedding
    from attestor.plans.tables import index_state

    rows = chunks(spark, sf_dir)
    return embedding.embedding_status(rows, index_state(rows))


@query("op_g2_readiness", "WITH " + o.CHUNKS + INDEX + """
SELECT source_id, mode, CASE WHEN mode = 'lexical' THEN 'not_required' WHEN total = indexed THEN 'ready' WHEN indexed = 0 THEN 'missing' ELSE 'partial' END AS readiness, total, indexed
FROM (SELECT source_id, count(*) AS total, count(*) FILTER (state = 'indexed') AS indexed FROM state GROUP BY source_id), (VALUES ('hybrid'), ('vector'), ('lexical')) AS m(mode)""")
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.operators.embedding import readiness as ready
    from attestor.operators.embedding import state
    from attestor.plans.tables import index_state

    rows = chunks(spark, sf_dir)
    index = index_state(rows).drop("source_id")
    rows = rows.select("chunk_id", "source_id", "checksum").join(index, "chunk_id", "left").withColumn("state", state(F.col("checksum"), F.col("model"), F.col("size"), F.col("chunk_checksum")))
    sums = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") == "indexed").alias("indexed"))
    sums = sums.withColumn("mode", F.explode(F.array(*map(F.lit, retrieval.MODES))))
    return sums.select("source_id", "mode", ready(F.col("total"), F.col("indexed"), F.col("mode")).alias("readiness"), "total", "indexed")


# Diagnosis

DIAGNOSED = "WITH " + o.JUDGED + r""",
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM judged WHERE support_status = 'supported'),
a AS (
  SELECT query_id, count(*) AS n, count(*) FILTER (support_status = 'supported') AS supported, list_sort(list(rank)) AS all_ranks,
    coalesce(list_sort(list(rank) FILTER (support_reason = 'semantic_only_match')), []) AS semantic_ranks,
    coalesce(list_sort(list(rank) FILTER (support_reason IN ('metadata_only_match', 'path_only_match', 'section_only_match'))), []) AS metadata_ranks,
    coalesce(list_sort(list(rank) FILTER (strength = 'weak')), []) AS weak_ranks, max(strength) FILTER (rank = 1) AS top_strength,
    coalesce(list_sort(list(rank) FILTER (duplicate_count > 1 OR list_contains(hit_flags, 'duplicate'))), []) AS duplicate_ranks,
    coalesce(list_sort(list(rank) FILTER (list_contains(hit_flags, 'heading_only'))), []) AS heading_ranks,
    max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 2) AS s2
  FROM judged GROUP BY query_id
),
f AS (
  SELECT query_id, coalesce(n, 0) AS hits, top_strength, list_sort(list_filter([
    CASE WHEN n IS NULL THEN {'s': 0, 'o': 0, 'c': 'missing_document', 'r': []::INT[]} END,
    CASE WHEN n > 0 AND supported = 0 THEN {'s': 0, 'o': 3, 'c': 'answerability_gap', 'r': all_ranks} END,
    CASE WHEN len(weak_ranks) > 0 THEN {'s': CASE WHEN top_strength = 'weak' THEN 0 ELSE 1 END, 'o': 5, 'c': 'weak_evidence', 'r': weak_ranks} END,
    CASE WHEN len(semantic_ranks) > 0 THEN {'s': 1, 'o': 7, 'c': 'semantic_only_match', 'r': semantic_ranks} END,
    CASE WHEN len(metadata_ranks) > 0 THEN {'s': 1, 'o': 8, 'c': 'metadata_only_match', 'r': metadata_ranks} END,
    CASE WHEN len(duplicate_ranks) > 0 THEN {'s': 1, 'o': 9, 'c': 'duplicate_evidence', 'r': duplicate_ranks} END,
    CASE WHEN len(heading_ranks) > 0 THEN {'s': 1, 'o': 10, 'c': 'heading_only_evidence', 'r': heading_ranks} END,
    CASE WHEN s2 IS NOT NULL AND s1 > 1.2e-7 AND greatest(0.0, round((s1 - s2) / s1, 9)) <= 0.1 THEN {'s': 1, 'o': 11, 'c': 'low_score_margin', 'r': [1, 2]::INT[]} END
  ], lambda x: x IS NOT NULL)) AS failures
  FROM questions LEFT JOIN a USING (query_id)
),
d AS (
  SELECT *, list_transform(failures, lambda x: x.c) AS codes,
    CASE WHEN len(list_filter(failures, lambda x: x.s = 0 AND x.c IN ('missing_document', 'answerability_gap'))) > 0 THEN 'failing'
      WHEN len(list_filter(failures, lambda x: x.s = 0 AND x.c = 'weak_evidence')) > 0 THEN 'weak'
      WHEN len(failures) > 0 OR coalesce(top_strength, 'strong') <> 'strong' THEN 'mixed' ELSE 'strong' END AS outcome FROM f
)"""


def diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.operators.diagnosis import diagnose

    asked, support = questions(spark, sf_dir), judged(spark, sf_dir)
    return diagnose(asked, support, answer.answers(asked, support), "lexical")


@query("op_dx_diagnosis", DIAGNOSED + """
SELECT query_id, hits, outcome, coalesce(array_to_string(codes, ','), '') AS codes, codes[1] AS primary_issue,
  coalesce(array_to_string(list_transform(failures, lambda x: x.c || ':' || x.s || ':' || array_to_string(list_transform(x.r, lambda r: 'E' || r), '+')), ','), '') AS failures FROM d""")
def diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.transform("failures", lambda f: F.concat_ws(":", f["code"], f["severity"].cast("string"), F.array_join(f["refs"], "+")))
    return diagnosed(spark, sf_dir).select("query_id", "hits", "outcome", joined("codes").alias("codes"), "primary_issue", joined(shown).alias("failures"))


@query("op_dx8_recommendations", DIAGNOSED + """,
advice(c, p, r) AS (VALUES ('missing_document', 0, 'restore_corpus_coverage'), ('answerability_gap', 0, 'restore_direct_answer_support'), ('weak_evidence', 1, 'broaden_candidate_pool'),
  ('semantic_only_match', 1, 'tighten_semantic_candidates'), ('metadata_only_match', 1, 'separate_metadata_from_answer_evidence'), ('duplicate_evidence', 1, 'improve_chunk_boundaries'),
  ('heading_only_evidence', 1, 'improve_chunk_boundaries'), ('low_score_margin', 2, 'add_reranking')),
u AS (SELECT query_id, unnest(codes) AS c FROM d), r AS (SELECT query_id, r, min(p) AS p FROM u JOIN advice USING (c) GROUP BY ALL)
SELECT d.query_id, coalesce(x.recommendations, '') AS recommendations FROM d LEFT JOIN (SELECT query_id, string_agg(r, ',' ORDER BY p, r) AS recommendations FROM r GROUP BY query_id) x USING (query_id)""")
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosed(spark, sf_dir).select("query_id", joined("recommendations").alias("recommendations"))


@query("op_dx9_legacy_labels", DIAGNOSED + """,
l(c, o, x) AS (VALUES ('missing_document', 0, 'missing_document'), ('answerability_gap', 0, 'unsupported_question'), ('weak_evidence', 0, 'weak_evidence'), ('weak_evidence', 1, 'bad_ranking'),
  ('semantic_only_match', 0, 'bad_ranking'), ('metadata_only_match', 0, 'bad_ranking'), ('duplicate_evidence', 0, 'duplicate_evidence'), ('duplicate_evidence', 1, 'bad_chunking'),
  ('heading_only_evidence', 0, 'heading_only_evidence'), ('heading_only_evidence', 1, 'bad_chunking'), ('low_score_margin', 0, 'bad_ranking')),
u AS (SELECT query_id, unnest(codes) AS c, generate_subscripts(codes, 1) AS k FROM d), w AS (SELECT query_id, x, min(k * 10 + o) AS k FROM u JOIN l USING (c) GROUP BY ALL)
SELECT d.query_id, coalesce(y.labels, '') AS labels FROM d LEFT JOIN (SELECT query_id, string_agg(x, ',' ORDER BY k) AS labels FROM w GROUP BY query_id) y USING (query_id)""")
def legacy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosed(spark, sf_dir).select("query_id", joined("labels").alias("labels"))


@query("op_dx7_score_explanations", "WITH " + o.RETRIEVED + """
SELECT query_id, rank, 'E' || rank AS evidence_ref, round(lag(score) OVER w - score, 6) AS from_previous, round(score - lead(score) OVER w, 6) AS to_next,
  CASE greatest(lexical, phrase, section, path_score, metadata) WHEN 0 THEN 'none' WHEN lexical THEN 'lexical' WHEN phrase THEN 'phrase' WHEN section THEN 'section' WHEN path_score THEN 'path' ELSE 'metadata' END AS dominant_signal
FROM hits WINDOW w AS (PARTITION BY query_id ORDER BY rank)""")
def score_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.operators.diagnosis import score_explanations as explain

    return explain(lexical_hits(spark, sf_dir)).select("query_id", "rank", "evidence_ref", "from_previous", "to_next", "dominant_signal")


@query("op_g14_strongest_evidence", "WITH " + o.RETRIEVED + """
SELECT query_id, CASE min(CASE strength WHEN 'strong' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) WHEN 0 THEN 'strong' WHEN 1 THEN 'medium' ELSE 'weak' END AS strongest
FROM questions LEFT JOIN hits USING (query_id) GROUP BY query_id""")
def strongest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.operators.diagnosis import strongest_evidence

    return strongest_evidence(lexical_hits(spark, sf_dir), questions(spark, sf_dir))


RERUN = "WITH " + o.RETRIEVED.replace("WHERE rank <= 5", "WHERE rank <= 10") + """,
before AS (SELECT * FROM hits WHERE rank <= 5), after AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, chunk_id)::INT AS rank2 FROM hits
), x AS (SELECT query_id, b.chunk_id AS old_id, a.chunk_id AS new_id, b.rank AS old_rank, a.rank2 AS new_rank, b.score AS old_score, a.lexical AS new_score
  FROM before b FULL JOIN (SELECT * FROM after WHERE rank2 <= 3) a USING (query_id, chunk_id))"""


@query("op_g13_rerun_comparison", RERUN + """
SELECT query_id, round(coalesce(max(new_score), 0) - coalesce(max(old_score), 0), 6) AS score_delta, count(*) FILTER (old_rank IS NOT NULL AND new_rank IS NOT NULL) AS overlap,
  count(*) FILTER (old_rank <> new_rank) AS changed_rank, coalesce(string_agg(new_id, ',' ORDER BY new_id) FILTER (old_rank IS NULL), '') AS gained,
  coalesce(string_agg(old_id, ',' ORDER BY old_id) FILTER (new_rank IS NULL), '') AS lost FROM x GROUP BY query_id""")
def rerun_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run against one that keeps three of the first ten hits, ranked by their lexical signal."""
    from pyspark.sql import Window

    from attestor.operators.diagnosis import compare_reruns

    ten = retrieval.retrieve(chunks(spark, sf_dir), questions(spark, sf_dir), top_k=10)
    again = ten.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lexical"), "chunk_id"))).where("rank <= 3").withColumn("score", F.col("lexical"))
    return compare_reruns(ten.where("rank <= 5"), again).withColumns({"gained": joined("gained"), "lost": joined("lost")})


# Evaluation

CASES = """,
cases AS (
  SELECT b.item_id AS query_id, list_sort(list('d' || d.doc_id)) AS docs_wanted FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id
)"""


def eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage with a document that holds it: automata of the passages run over each text."""
    from attestor.operators.cases import passage_documents

    return passage_documents(table(spark, sf_dir, "benchmark"), documents(spark, sf_dir))


@query("op_j10_expected_documents", "WITH " + CASES[2:] + " SELECT query_id, array_to_string(docs_wanted, ',') AS expected FROM cases")
def expected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_cases(spark, sf_dir).select("query_id", joined("document_ids").alias("expected"))


EVALUATED = "WITH " + o.JUDGED + CASES + """,
e AS (
  SELECT query_id, any_value(docs_wanted) AS want, count(rank) AS n, count(DISTINCT document_id) FILTER (list_contains(docs_wanted, document_id)) AS met,
    count(*) FILTER (rank IS NOT NULL AND list_contains(docs_wanted, document_id)) AS good, min(rank) FILTER (list_contains(docs_wanted, document_id)) AS top_hit_rank, count(*) FILTER (strength = 'weak') AS weak_count,
    coalesce(bool_or(list_contains(hit_flags, 'heading_only')), false) AS heading, coalesce(bool_or(duplicate_count > 1 OR list_contains(hit_flags, 'duplicate')), false) AS dup,
    least(3, count(*) FILTER (support_status = 'supported')) AS cited
  FROM cases LEFT JOIN judged USING (query_id) GROUP BY query_id
),
r AS (
  SELECT *, round(met / len(want)::DOUBLE, 6) AS recall, round(coalesce(good / nullif(n, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(1.0 / top_hit_rank, 0), 6)::DOUBLE AS mrr,
    round(coalesce(cited / nullif(n, 0)::DOUBLE, 0), 6) AS citation_coverage FROM e
),
results AS (
  SELECT *, list_filter([CASE WHEN recall = 0 THEN 'expected_evidence_missing' END, CASE WHEN n > 0 AND precision < 0.5 THEN 'low_precision' END, CASE WHEN weak_count > 0 THEN 'weak_evidence' END,
    CASE WHEN heading THEN 'heading_only_evidence' END, CASE WHEN dup THEN 'duplicate_evidence' END], lambda x: x IS NOT NULL) AS failures, recall > 0 AS passed FROM r
)"""


def case_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.operators.evals import evaluate

    support = judged(spark, sf_dir)
    return evaluate(eval_cases(spark, sf_dir), support, answer.answers(questions(spark, sf_dir), support))


@query("op_ev1_case_evaluation", EVALUATED + " SELECT query_id, recall, precision, mrr, top_hit_rank, citation_coverage, weak_count, array_to_string(failures, ',') AS failures, passed FROM results")
def case_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_results(spark, sf_dir).withColumn("failures", joined("failures"))


MODES = EVALUATED + """,
moded AS (
  SELECT 'lexical' AS mode, * EXCLUDE (recall), recall, query_id % 17 + 3 AS latency_ms FROM results UNION ALL BY NAME
  SELECT 'vector' AS mode, * EXCLUDE (recall), CASE WHEN query_id % 3 = 0 THEN 0.0 ELSE recall END AS recall, query_id % 23 + 5 AS latency_ms FROM results
),
summary AS (
  SELECT mode, count(*) AS cases, count(*) FILTER (passed) AS passed, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(mrr), 6) AS mrr,
    round(avg(citation_coverage), 6) AS citation_coverage, sum(weak_count)::BIGINT AS weak_count, sum(len(list_filter(failures, lambda f: f = 'expected_evidence_missing')))::BIGINT AS critical,
    list_sort(list(latency_ms))[ceil((count(*) - 1) * 0.5)::INT + 1] AS p50, list_sort(list(latency_ms))[ceil((count(*) - 1) * 0.95)::INT + 1] AS p95 FROM moded GROUP BY mode
)"""


def mode_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case results of a lexical run and of one that loses the evidence of every third case; latencies by case number."""
    rows = case_results(spark, sf_dir)
    lexical = rows.withColumns({"mode": F.lit("lexical"), "latency_ms": F.col("query_id") % 17 + 3})
    worse = rows.withColumns({"mode": F.lit("vector"), "latency_ms": F.col("query_id") % 23 + 5, "recall": F.when(F.col("query_id") % 3 == 0, 0.0).otherwise(F.col("recall"))})
    return lexical.unionByName(worse)


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.operators.evals import summarize_modes

    return summarize_modes(mode_results(spark, sf_dir))


@query("op_g8_mode_summary", MODES + " SELECT * FROM summary")
def mode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(spark, sf_dir)


@query("op_g9_mode_comparison", MODES + """
SELECT arg_max(mode, row(recall, precision, -p50, CASE mode WHEN 'hybrid' THEN 0 WHEN 'vector' THEN 1 ELSE 2 END)) AS best_mode, count(*) AS modes, round(max(recall) - min(recall), 6) AS recall_delta,
  round(arg_max(precision, row(recall, precision, -p50, CASE mode WHEN 'hybrid' THEN 0 WHEN 'vector' THEN 1 ELSE 2 END)) - min(precision), 6) AS precision_delta, max(p50) - min(p50) AS latency_delta FROM summary""")
def mode_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.operators.evals import compare_modes

    return compare_modes(summaries(spark, sf_dir))


@query("op_g10_gate", MODES + """,
g AS (SELECT coalesce(max(recall), 0) AS recall, round(coalesce(sum(weak_count) / greatest(sum(cases), 1)::DOUBLE, 0), 6) AS weak_rate, coalesce(sum(critical), 0)::BIGINT AS critical FROM summary)
SELECT recall, weak_rate, critical, array_to_string(list_filter([CASE WHEN recall < 0.8 THEN 'recall' END, CASE WHEN critical > 0 THEN 'critical' END, CASE WHEN weak_rate > 0.2 THEN 'weak_evidence' END], lambda x: x IS NOT NULL), ',') AS reasons,
  CASE WHEN recall < 0.8 OR critical > 0 OR weak_rate > 0.2 THEN 'failed' ELSE 'passed' END AS status FROM g""")
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.operators.evals import gate as evaluate_gate

    return evaluate_gate(summaries(spark, sf_dir)).withColumn("reasons", joined("reasons"))


@query("op_g12_regression", MODES + """
SELECT round(c.recall - b.recall, 6) AS recall_delta, round(c.precision - b.precision, 6) AS precision_delta, round(c.mrr - b.mrr, 6) AS mrr_delta, c.p95 - b.p95 AS latency_delta
FROM (SELECT * FROM summary WHERE mode = 'vector') b, (SELECT * FROM summary WHERE mode = 'lexical') c""")
def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.operators.evals import regression as compare

    rows = summaries(spark, sf_dir)
    return compare(rows.where("mode = 'vector'"), rows.where("mode = 'lexical'"))


@query("op_j12_newly_failed", EVALUATED + " SELECT query_id FROM results WHERE len(failures) > 0 AND query_id % 4 = 0")
def newly_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against a baseline in which the cases with a number divisible by 4 had no failure."""
    from attestor.operators.evals import newly_failed as lost

    now = case_results(spark, sf_dir)
    before = now.withColumn("failures", F.when(F.col("query_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.col("failures")))
    return lost(before, now)
