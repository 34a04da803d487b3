"""Queries of runs, reports, evaluation runs and workspaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions.text import normalized_tokens
from attestor.operators import answer, embedding, evals, overview, reports, retrieval, traces
from attestor.plans import oracle as o
from attestor.plans.queries import DIAGNOSED, EMBEDDED, EVALUATED, MODES, case_results, diagnosed, eval_cases, judged, lexical_hits, mode_results, query, retrieved_with_vectors, summaries
from attestor.plans.tables import annotated_chunks, questions, table
from attestor.sources.scratch import stored
from attestor.sources.store import decode_terms, encode_terms


@query("op_an8_reassessment", "WITH " + o.JUDGED + " SELECT query_id, rank, matched_body, support_status, support_reason FROM judged")
def reassessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hits of every other query come without their assessment; whoever lacks one gets all of them again."""
    rows = judged(spark, sf_dir)
    lost = (F.col("rank") == 1) & (F.col("query_id") % 2 == 0)
    old = rows.withColumns({c: F.when(~lost, F.col(c)) for c in ("matched_body", "coverage", "support_status", "support_reason")})
    return answer.ensure_assessed(old).select("query_id", "rank", "matched_body", "support_status", "support_reason")


@query("op_ev4_single_mode_run", EVALUATED.replace("FROM cases LEFT JOIN judged USING (query_id) GROUP BY query_id", "FROM cases LEFT JOIN judged ON judged.query_id = cases.query_id AND rank <= cases.query_id % 5 + 1 WHERE cases.query_id % 2 = 0 GROUP BY cases.query_id")
    .replace("SELECT query_id, any_value(docs_wanted) AS want", "SELECT cases.query_id, any_value(docs_wanted) AS want") + " SELECT query_id, recall, precision, mrr, citation_coverage, weak_count, passed FROM results")
def single_mode_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen cases, those with an even number, each with its own top_k."""
    chosen = eval_cases(spark, sf_dir).where("query_id % 2 = 0").withColumn("top_k", (F.col("query_id") % 5 + 1).cast("int"))
    rows = evals.single_mode_run(chosen, judged(spark, sf_dir), questions(spark, sf_dir))
    return rows.select("query_id", "recall", "precision", "mrr", "citation_coverage", "weak_count", "passed")


@query("op_e3_embedding_provider", EMBEDDED.replace("% 384", "% 64") + " SELECT id AS item_id, idx, round(value, 6) AS value FROM e")
def embedding_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embedding.embed_with(embedding.HashProvider(64), table(spark, sf_dir, "benchmark"), "item_id", "text")
    return rows.select("item_id", F.posexplode("vector").alias("idx", "value")).where("value <> 0").select("item_id", "idx", F.round("value", 6).alias("value"))


@query("op_p6_workspace", "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey = 2")
def workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions stand for workspaces."""
    rows = table(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "workspace_id")
    return overview.in_workspace(rows, 2).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


@query("op_j6_marked_sources", "SELECT s_suppkey AS source_id, n_nationkey AS project_id, n_name AS project FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1 AND starts_with(n_name, (SELECT left(min(n_name), 1) FROM nation WHERE n_regionkey = 1))")
def marked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers stand for sources, nations for projects, regions for workspaces; the marker is the first letter of the first project."""
    projects = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_regionkey").alias("workspace_id"), F.col("n_name").alias("name"))
    marker = overview.in_workspace(projects, 1).agg(F.left(F.min("name"), F.lit(1))).first()[0]
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_nationkey").alias("project_id"))
    return overview.marked_sources(sources, projects, 1, marker).select("source_id", "project_id", "project")


@query("op_j14_report_of_latest_trace", """WITH t AS (SELECT event_id, user_id FROM events WHERE event_id % 2 = 0 ORDER BY ts DESC, event_id DESC LIMIT 1)
SELECT t.event_id AS trace_id, e.event_id AS report_id FROM t JOIN events e ON e.user_id = t.user_id AND e.event_id % 2 = 1 ORDER BY e.ts, e.event_id LIMIT 1""")
def report_of_latest_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with even numbers stand for traces, the others for reports, users for sources."""
    e = table(spark, sf_dir, "events")
    of = lambda odd, name: e.where(F.col("event_id") % 2 == odd).select(F.col("event_id").alias(name), F.col("user_id").alias("source_id"), F.col("ts").alias("at"))
    return overview.report_of_latest_trace(of(0, "trace_id"), of(1, "report_id"))


@query("op_s21_get_or_create", """SELECT 'AUTOMOBILE' AS segment, (SELECT min(c_custkey) FROM customer WHERE c_mktsegment = 'AUTOMOBILE') AS project_id
UNION ALL SELECT 'none', -1""")
def get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest customer of a segment, and of a segment that nobody is in the default."""
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("project_id"))
    out = [overview.oldest_or(c.where(F.col("segment") == name), ["project_id"], spark.range(1).select(F.lit(name).alias("segment"), F.lit(-1).cast("long").alias("project_id"))) for name in ("AUTOMOBILE", "none")]
    return out[0].unionByName(out[1])


@query("op_s12_run_rows", "WITH " + o.RETRIEVED + """, n AS (SELECT query_id, count(*) AS hits, string_agg(chunk_id || ':' || strength, ',' ORDER BY rank) AS ranked FROM hits GROUP BY query_id)
SELECT query_id, 'lexical' AS mode, 5 AS top_k, coalesce(hits, 0) AS hits, coalesce(ranked, '') AS ranked FROM questions LEFT JOIN n USING (query_id)""")
def run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept of a run, and its hits read back from the snapshot."""
    rows = traces.run_rows(questions(spark, sf_dir), lexical_hits(spark, sf_dir), "lexical", 5)
    held = F.from_json("snapshot", "array<struct<rank:int,chunk_id:string,score:double,strength:string>>")
    return rows.select("query_id", "mode", "top_k", "hits", F.array_join(F.transform(held, lambda h: F.concat_ws(":", h["chunk_id"], h["strength"])), ",").alias("ranked"))


@query("op_tr2_completed_traces", DIAGNOSED + " SELECT query_id, CASE outcome WHEN 'failing' THEN 'failed' WHEN 'strong' THEN 'passed' ELSE 'attention' END AS status, hits FROM d")
def completed_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces that lost their labels and status, completed from the diagnosis."""
    found = diagnosed(spark, sf_dir)
    old = traces.traces(found, judged(spark, sf_dir), "lexical").withColumns({"status": F.lit("passed"), "labels": F.array().cast("array<string>")})
    return traces.completed(old, found).join(found.select("query_id", "hits"), "query_id").select("query_id", "status", "hits")


FALLBACK = "(VALUES " + ", ".join(f"('{label}', '{code}', {priority}, '{title}')" for code, priority, _, title, labels in reports.FALLBACKS for label in labels) + ") AS a(label, code, priority, title)"


@query("op_rep5_fallback_recommendations", EVALUATED + f""", u AS (SELECT DISTINCT query_id, unnest(failures) AS label FROM results)
SELECT query_id, code, priority, string_agg(label, ',' ORDER BY label) AS labels FROM u JOIN {FALLBACK} USING (label) GROUP BY ALL""")
def fallback_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.fallback_recommendations(case_results(spark, sf_dir).select("query_id", F.explode("failures").alias("label")), "query_id")
    return rows.select("query_id", "code", "priority", F.array_join("finding_codes", ",").alias("labels"))


@query("op_rep2_experiment_report", MODES + f""", un AS (SELECT mode, query_id, unnest(failures) AS label FROM moded),
fi AS (SELECT 'findings' AS section, label AS code, 'first in ' || arg_min(mode, row(mode, query_id)) || ', case ' || arg_min(query_id, row(mode, query_id)) AS detail, count(*) AS cases, 1 AS priority FROM un GROUP BY label),
re AS (SELECT 'recommendations' AS section, code, title AS detail, count(*) AS cases, priority FROM (SELECT DISTINCT label FROM un) JOIN {FALLBACK} USING (label) GROUP BY code, title, priority),
mo AS (SELECT 'recommendations', 'use_best_retrieval_mode', 'Validate ' || arg_max(mode, row(recall, precision, -p50, CASE mode WHEN 'hybrid' THEN 0 WHEN 'vector' THEN 1 ELSE 2 END)) || ' as the preferred retrieval mode', 1, 2 FROM summary HAVING max(recall) > min(recall)),
xs AS (SELECT * FROM fi UNION ALL SELECT * FROM re UNION ALL SELECT * FROM mo)
SELECT section, row_number() OVER (PARTITION BY section ORDER BY priority, code)::INT AS ordinal, code, detail, cases FROM xs""")
def experiment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(mode_results(spark, sf_dir), "mode-results")
    return reports.experiment_report(rows, evals.summarize_modes(rows))


@query("op_ev3_mode_subset", MODES + " SELECT 'lexical' AS best_mode, count(*) AS modes, 0.0 AS recall_delta, 0.0 AS precision_delta, 0 AS latency_delta FROM summary WHERE mode = 'lexical'")
def mode_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.compare_modes(summaries(spark, sf_dir).where("mode = 'lexical'"))


@query("op_g19_pass_rates", MODES + " SELECT mode, CASE WHEN cases = 0 THEN 0.0 ELSE round(passed / cases::DOUBLE, 6) END AS pass_rate FROM summary")
def pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.pass_rates(mode_results(spark, sf_dir))


def _results(mode: str) -> str:
    sql = EVALUATED if mode == "lexical" else EVALUATED.replace(o.RETRIEVED, retrieved_with_vectors(mode))
    return f"SELECT '{mode}' AS mode, * FROM ({sql} SELECT query_id, recall, precision, mrr, citation_coverage, weak_count, failures, passed FROM results)"


@query("op_ev2_experiment", "WITH moded AS (" + " UNION ALL ".join(map(_results, ("hybrid", "vector", "lexical"))) + """)
SELECT mode, count(*) AS cases, count(*) FILTER (passed) AS passed, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(mrr), 6) AS mrr,
  round(avg(citation_coverage), 6) AS citation_coverage, sum(weak_count)::BIGINT AS weak_count, sum(len(list_filter(failures, lambda f: f = 'expected_evidence_missing')))::BIGINT AS critical FROM moded GROUP BY mode""")
def experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases in all modes, summarized; latencies differ from run to run and are left out."""
    cases, asked, results = stored(eval_cases(spark, sf_dir), "cases"), questions(spark, sf_dir), None
    rows = stored(retrieval.prepare_chunks(annotated_chunks(spark, sf_dir)), "chunks")
    vectors = stored(asked.select("query_id", embedding.embed(F.col("query")).alias("vector")), "asked")
    for mode in retrieval.MODES:
        hits = stored(answer.assess(retrieval.retrieve(rows, asked, mode, asked=vectors)), "hits")
        found = evals.evaluate(cases, hits, answer.answers(asked, hits)).withColumns({"mode": F.lit(mode), "latency_ms": F.lit(None).cast("long")})
        results = found if results is None else results.unionByName(found)
    return evals.summarize_modes(results).drop("p50", "p95")


#: Counts of a corpus for each user, made of their events so that every state of the overview occurs.
CORPORA = """WITH e AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'click') AS k, count(*) FILTER (event_type = 'signup') AS s,
  count(*) FILTER (event_type = 'error') AS x, count(*) FILTER (event_type = 'purchase') AS p FROM events GROUP BY user_id),
c AS (SELECT user_id, 1 AS sources, n % 5 AS documents, n % 5 * 3 AS chunks, greatest(n % 5 * 3 - v % 2 - k % 2, 0) AS indexed, v % 2 AS missing, k % 2 AS stale, p % 4 AS traces, x % 3 AS weak, p % 2 AS failed,
  n % 3 AS cases, 1 AS datasets, s % 3 AS warnings, CASE n % 4 WHEN 0 THEN 'failed' WHEN 1 THEN NULL ELSE 'passed' END AS gate, CASE WHEN n % 4 <> 1 THEN n % 5 * 0.25 END AS recall,
  CASE WHEN user_id % 2 = 0 THEN n % 5 * 0.25 END AS pass_rate, x AS failures FROM e)"""
_UNINDEXED = "missing > 0 OR stale > 0"


def corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"v": "view", "k": "click", "s": "signup", "x": "error", "p": "purchase"}
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("event_type") == kind).alias(name) for name, kind in kinds.items()])
    n = F.col("n")
    return e.select(
        "user_id", F.lit(1).alias("sources"), (n % 5).alias("documents"), (n % 5 * 3).alias("chunks"), F.greatest(n % 5 * 3 - F.col("v") % 2 - F.col("k") % 2, F.lit(0)).alias("indexed"),
        (F.col("v") % 2).alias("missing"), (F.col("k") % 2).alias("stale"), (F.col("p") % 4).alias("traces"), (F.col("x") % 3).alias("weak"), (F.col("p") % 2).alias("failed"), (n % 3).alias("cases"),
        F.lit(1).alias("datasets"), (F.col("s") % 3).alias("warnings"), F.when(n % 4 == 0, "failed").when(n % 4 != 1, "passed").alias("gate"), F.when(n % 4 != 1, n % 5 * 0.25).alias("recall"),
        F.when(F.col("user_id") % 2 == 0, n % 5 * 0.25).alias("pass_rate"), F.col("x").alias("failures"),
    )


@query("op_g18_metrics", CORPORA + f""" SELECT user_id, 1 AS ordinal, 'sources' AS id, sources::VARCHAR AS value, 'connected corpora' AS detail, 'neutral' AS tone FROM c
UNION ALL SELECT user_id, 2, 'documents', documents::VARCHAR, 'indexed files', 'neutral' FROM c UNION ALL SELECT user_id, 3, 'chunks', chunks::VARCHAR, 'retrieval units', 'neutral' FROM c
UNION ALL SELECT user_id, 4, 'embeddings', indexed || '/' || chunks, missing || ' missing · ' || stale || ' stale', CASE WHEN {_UNINDEXED} THEN 'warning' ELSE 'good' END FROM c
UNION ALL SELECT user_id, 5, 'traces', traces::VARCHAR, weak || ' weak · ' || failed || ' failed', CASE WHEN weak + failed > 0 THEN 'warning' ELSE 'good' END FROM c
UNION ALL SELECT user_id, 6, 'evals', cases::VARCHAR, CASE WHEN gate = 'failed' THEN '1 datasets · Failed gate · ' || (recall * 100)::INT || '% recall' WHEN gate = 'passed' THEN '1 datasets · Passed gate · ' || (recall * 100)::INT || '% recall'
  WHEN pass_rate IS NOT NULL THEN 'latest pass rate ' || (pass_rate * 100)::INT || '%' ELSE '1 datasets · no experiment yet' END, CASE WHEN cases = 0 THEN 'warning' WHEN gate = 'failed' THEN 'critical' ELSE 'good' END FROM c
UNION ALL SELECT user_id, 7, 'warnings', warnings::VARCHAR, 'extraction and corpus quality', CASE WHEN warnings > 0 THEN 'warning' ELSE 'good' END FROM c""")
def overview_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.metrics(corpora(spark, sf_dir), ["user_id"])


@query("op_g18_pipeline", CORPORA + f""", t AS (SELECT *, CASE WHEN traces = 0 THEN 'pending' ELSE 'complete' END AS ran FROM c)
SELECT user_id, 1 AS ordinal, 'ingest' AS id, CASE WHEN documents = 0 THEN 'blocked' ELSE 'complete' END AS status, documents AS count, '/app/sources' AS route FROM t
UNION ALL SELECT user_id, 2, 'chunk', CASE WHEN chunks = 0 THEN 'blocked' ELSE 'complete' END, chunks, '/app/sources' FROM t
UNION ALL SELECT user_id, 3, 'embed', CASE WHEN chunks = 0 THEN 'pending' WHEN {_UNINDEXED} THEN 'warning' ELSE 'complete' END, indexed, '/app/retrieval' FROM t
UNION ALL SELECT user_id, 4, 'retrieve', CASE WHEN chunks = 0 THEN 'blocked' ELSE ran END, traces, '/app/retrieval' FROM t UNION ALL SELECT user_id, 5, 'trace', ran, traces, '/app/traces' FROM t
UNION ALL SELECT user_id, 6, 'eval', CASE WHEN cases = 0 THEN 'warning' ELSE 'complete' END, cases, '/app/evals' FROM t UNION ALL SELECT user_id, 7, 'report', ran, traces, '/app/reports' FROM t""")
def overview_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.pipeline(corpora(spark, sf_dir), ["user_id"])


ISSUES = CORPORA + """, i AS (SELECT user_id, 1 AS place, 'no_documents' AS id, 'critical' AS severity, 0::BIGINT AS amount, '/app/sources' AS route FROM c WHERE documents = 0
UNION ALL SELECT user_id, 2, 'missing_embeddings', 'warning', missing, '/app/retrieval' FROM c WHERE missing > 0 UNION ALL SELECT user_id, 3, 'stale_embeddings', 'warning', stale, '/app/retrieval' FROM c WHERE stale > 0
UNION ALL SELECT user_id, 4, 'extraction_warnings', 'warning', warnings, '/app/sources' FROM c WHERE warnings > 0 UNION ALL SELECT user_id, 5, 'weak_traces', 'warning', weak, '/app/traces' FROM c WHERE weak > 0 OR failed > 0
UNION ALL SELECT user_id, 6, 'missing_eval_coverage', 'warning', 0, '/app/evals' FROM c WHERE cases = 0 UNION ALL SELECT user_id, 7, 'failed_eval_gate', 'critical', failures, '/app/evals' FROM c WHERE gate = 'failed'),
issues AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY place))::INT AS ordinal, id, severity, amount, route FROM i)"""


@query("op_g18_issues", ISSUES + " SELECT * FROM issues")
def overview_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.issues(corpora(spark, sf_dir), ["user_id"])


@query("op_g18_actions", ISSUES + f""", a AS (SELECT user_id, 1 AS place, 'primary' AS priority, unnest(CASE WHEN documents = 0 THEN ['ingest_documents', '/app/sources'] WHEN {_UNINDEXED} THEN ['index_embeddings', '/app/retrieval']
  WHEN cases = 0 THEN ['create_eval_coverage', '/app/evals'] WHEN weak > 0 THEN ['review_weak_traces', '/app/traces'] WHEN warnings > 0 THEN ['inspect_sources', '/app/sources'] ELSE ['run_retrieval', '/app/retrieval'] END) AS x, generate_subscripts([1, 2], 1) AS nth FROM c),
p AS (SELECT user_id, place, priority, max(x) FILTER (nth = 1) AS id, max(x) FILTER (nth = 2) AS route FROM a GROUP BY ALL),
u AS (SELECT * FROM p UNION ALL SELECT user_id, ordinal + 1, 'secondary', id, route FROM issues WHERE ordinal <= 3 UNION ALL SELECT user_id, 5, 'secondary', 'generate_report', '/app/reports' FROM c WHERE traces > 0),
d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY user_id, route ORDER BY place) = 1)
SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY place))::INT AS ordinal, id, route, priority FROM d QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY place) <= 4""")
def overview_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.actions(corpora(spark, sf_dir), ["user_id"])


_RECENT = {"view": 2, "click": 2, "purchase": 3, "signup": 1}


@query("op_g18_activity", "WITH u AS (" + " UNION ALL ".join(f"(SELECT event_type AS kind, event_id AS id, ts AS t FROM events WHERE event_type = '{kind}' ORDER BY ts DESC, event_id LIMIT {n})" for kind, n in _RECENT.items()) + ") SELECT kind, id FROM u ORDER BY t DESC, kind, id LIMIT 7")
def recent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events stand for sources, traces, reports and evaluation runs."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return overview.activity(*[(e.where(F.col("kind") == kind), n) for kind, n in _RECENT.items()]).select("kind", "id")


@query("op_s20_terms_codec", f"""WITH t AS (SELECT item_id, unnest({o.tokens('text')}) AS term FROM benchmark), n AS (SELECT item_id, term, count(*)::INT AS count FROM t GROUP BY ALL)
SELECT item_id, string_agg(term || ':' || count, ',' ORDER BY term) AS encoded, len(list(term))::INT AS terms, sum(count)::BIGINT AS total FROM n GROUP BY item_id""")
def terms_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of each passage with their counts, written as text and read back."""
    t = table(spark, sf_dir, "benchmark").select("item_id", F.explode(normalized_tokens(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).cast("int").alias("count"))
    rows = t.groupBy("item_id").agg(encode_terms(F.array_sort(F.collect_list(F.struct("term", "count")))).alias("encoded"))
    back = decode_terms(F.col("encoded"))
    return rows.select("item_id", "encoded", F.size(back).alias("terms"), F.aggregate(back, F.lit(0).cast("long"), lambda a, t: a + t["count"]).alias("total"))


@query("op_g27_progress", CORPORA + f""", d AS (SELECT user_id, [documents = 3, documents = 3 AND failures % 2 = 0, documents = 3 AND failures % 2 = 0 AND chunks > 0 AND NOT ({_UNINDEXED}), cases > 0, traces > 0, weak > 0] AS done FROM c)
SELECT user_id, len(list_filter(done, lambda x: x))::INT AS steps, coalesce(list_position(done, false), 0)::BIGINT AS next_step FROM d""")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases stand for runs, weak runs for reports."""
    counts = corpora(spark, sf_dir).select("user_id", "documents", (F.col("failures") % 2).alias("unchunked"), "chunks", "missing", "stale", F.col("cases").alias("runs"), "traces", F.col("weak").alias("reports"))
    return overview.progress(counts, ["user_id"], 3)
