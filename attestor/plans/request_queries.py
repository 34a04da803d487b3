"""Queries of requests with scopes of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators import answer, diagnosis, embedding, evals, reports, requests
from attestor.plans import oracle as o
from attestor.plans.queries import DIAGNOSED, INDEX, MODES, diagnosed, joined, mode_results, query
from attestor.plans.tables import chunks, index_state, questions
from attestor.sources.scratch import stored

#: A fourth of the questions has no scope, a fourth one source, a fourth two, a fourth a list of documents.
IN_SCOPE = """((query_id % 4 <> 1 OR source_id = 'src' || query_id % 20) AND (query_id % 4 <> 2 OR source_id IN ('src' || query_id % 20, 'src' || (query_id + 7) % 20))
  AND (query_id % 4 <> 3 OR substr(document_id, 2)::BIGINT BETWEEN query_id AND query_id + 200))"""


def scoped_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("query_id")
    source = lambda n: F.concat(F.lit("src"), (n % 20).cast("string"))
    none = F.array().cast("array<string>")
    sources = F.when(i % 4 == 1, F.array(source(i))).when(i % 4 == 2, F.array(source(i), source(i + 7))).otherwise(none)
    documents = F.when(i % 4 == 3, F.transform(F.sequence(i, i + 200), lambda n: F.concat(F.lit("d"), n.cast("string"))))
    return questions(spark, sf_dir).withColumns({"source_ids": sources, "document_ids": documents}).where(F.col("query").rlike("\\S"))


@query("op_r1_scoped_requests", "WITH " + o.RETRIEVED.replace("FROM pairs JOIN q USING (query_id) JOIN norm USING (chunk_id)", f"FROM pairs JOIN q USING (query_id) JOIN norm USING (chunk_id) WHERE {IN_SCOPE}") + """,
n AS (SELECT query_id, count(*) AS total FROM questions JOIN chunks ON """ + IN_SCOPE + """ GROUP BY query_id)
SELECT query_id, 'not_required' AS readiness, coalesce(total, 0) AS total, rank, chunk_id, score, strength, duplicate_count
FROM (SELECT * FROM questions WHERE regexp_matches(query, '\\S')) LEFT JOIN n USING (query_id) LEFT JOIN (SELECT query_id, rank, chunk_id, score, strength, duplicate_count FROM hits) USING (query_id)""")
def scoped_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions in one batch, each over its own sources or documents; a row for each hit, and one for a question without any."""
    rows, asked = chunks(spark, sf_dir), scoped_questions(spark, sf_dir)
    index = index_state(rows).withColumn("vector", F.lit(None).cast("array<double>"))
    found = requests.run_requests(rows, index, asked, "lexical")
    return found["status"].join(found["hits"], "query_id", "left").select("query_id", "readiness", "total", "rank", "chunk_id", "score", "strength", "duplicate_count")


@query("op_r1_early_exits", "WITH " + o.CHUNKS + INDEX + f""",
questions AS (SELECT item_id AS query_id, split_part(text, '.', 1) AS query FROM benchmark),
own AS (SELECT state.*, chunks.document_id FROM state JOIN chunks USING (chunk_id)),
s AS (SELECT query_id, CASE WHEN source_id IN ('src1', 'src5') THEN 'missing' ELSE state END AS state FROM questions JOIN own ON {IN_SCOPE}),
n AS (SELECT query_id, count(*) AS total, count(*) FILTER (state = 'indexed') AS indexed, count(*) FILTER (state = 'missing') AS missing, count(*) FILTER (state = 'stale') AS stale FROM s GROUP BY query_id),
r AS (SELECT query_id, coalesce(total, 0) AS total, coalesce(indexed, 0) AS indexed, coalesce(missing, 0) AS missing, coalesce(stale, 0) AS stale FROM questions LEFT JOIN n USING (query_id) WHERE regexp_matches(query, '\\S'))
SELECT *, CASE WHEN total = indexed THEN 'ready' WHEN indexed = 0 THEN 'missing' ELSE 'partial' END AS readiness, CASE WHEN total <> indexed AND indexed = 0 THEN '{answer.NOT_INDEXED}' END AS message FROM r""")
def early_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of the index in each question's scope, two sources having none, and what is said where nothing is indexed."""
    rows, asked = chunks(spark, sf_dir), scoped_questions(spark, sf_dir)
    index = index_state(rows).where(~F.col("source_id").isin("src1", "src5"))
    status = embedding.query_readiness(requests.index_states(rows, index), asked, "vector")
    nothing = answer.answers(asked, spark.createDataFrame([], "query_id long, rank int, chunk_id string, snippet string, label string, support_status string"), readiness=status)
    said = nothing.where(F.col("answer") == answer.NOT_INDEXED).select("query_id", F.col("answer").alias("message"))
    return status.join(said, "query_id", "left")


def _quoted(*values) -> str:
    return ", ".join(str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in values)


#: The catalogue in SQL: failure code, title of the failure, then the recommendation with priority, area, title, reason and action.
CATALOGUE = "VALUES " + ", ".join(
    f"({_quoted(code, title, advice, *diagnosis.RECOMMENDATIONS[advice], *diagnosis.REASONS[advice])})" for code, title, advice, _ in diagnosis.FAILURES
)


@query("op_g22_merged_recommendations", DIAGNOSED + f""",
cat(c, failure_title, code, priority, area, title, rationale, action) AS ({CATALOGUE}),
u AS (SELECT query_id, unnest(failures) AS f, generate_subscripts(failures, 1) AS k FROM d),
m AS (SELECT u.query_id, u.k, u.f.c AS c, u.f.r AS r, cat.* EXCLUDE (c) FROM u JOIN cat ON cat.c = u.f.c),
g AS (SELECT query_id, code, arg_min(priority, k) AS priority, any_value(area) AS area, any_value(title) AS title, any_value(rationale) AS rationale, any_value(action) AS action, string_agg(c, ',' ORDER BY k) AS failure_codes FROM m GROUP BY query_id, code),
e AS (SELECT query_id, code, ref, min(k * 1000 + i) AS seen FROM (SELECT query_id, code, k, unnest(r) AS ref, generate_subscripts(r, 1) AS i FROM m) GROUP BY ALL),
x AS (SELECT query_id, code, string_agg('E' || ref, ',' ORDER BY seen) AS evidence_refs FROM e GROUP BY ALL)
SELECT query_id, code, priority, area, title, rationale, action, failure_codes, coalesce(evidence_refs, '') AS evidence_refs, (row_number() OVER (PARTITION BY query_id ORDER BY priority, code))::INT AS place
FROM g LEFT JOIN x USING (query_id, code)""")
def merged_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diagnosis.recommendations(diagnosed(spark, sf_dir))
    return rows.withColumns({"failure_codes": joined("failure_codes"), "evidence_refs": joined("evidence_refs")})


@query("op_dx6_summaries", DIAGNOSED + f""",
cat(c, failure_title, code, priority, area, title, rationale, action) AS ({CATALOGUE})
SELECT query_id, outcome, CASE WHEN len(codes) > 0 THEN 'This run looks ' || outcome || '. Primary issue: ' || failure_title
  ELSE 'This run looks strong. ' || hits || ' ranked evidence item(s) were found without a deterministic failure signal.' END AS summary
FROM d LEFT JOIN cat ON cat.c = codes[1]""")
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosed(spark, sf_dir).select("query_id", "outcome", "summary")


@query("op_rep3_ci_report", MODES + """,
ch AS (SELECT round(c.recall - b.recall, 6) AS re, round(c.precision - b.precision, 6) AS pr, round(c.mrr - b.mrr, 6) AS mr, c.p95 - b.p95 AS la
  FROM (SELECT * FROM summary WHERE mode = 'vector') b, (SELECT * FROM summary WHERE mode = 'lexical') c),
newly AS (SELECT count(*) AS lost FROM results WHERE len(failures) > 0 AND query_id % 4 = 0),
x(section, code, detail) AS (
  SELECT 'context', 'ci_gate_status', CASE WHEN recall < 0.8 OR critical > 0 OR round(weak_count / cases::DOUBLE, 6) > 0.2 THEN 'failed' ELSE 'passed' END FROM summary WHERE mode = 'lexical'
  UNION ALL VALUES ('context', 'ci_config_label', 'main'), ('context', 'ci_branch', 'work')
  UNION ALL SELECT 'context', 'ci_recall_delta', printf('%.3f', re) FROM ch UNION ALL SELECT 'context', 'ci_precision_delta', printf('%.3f', pr) FROM ch UNION ALL SELECT 'context', 'ci_mrr_delta', printf('%.3f', mr) FROM ch
  UNION ALL SELECT 'context', 'ci_latency_delta_ms', la::VARCHAR FROM ch UNION ALL SELECT 'context', 'ci_newly_failed_case_count', lost::VARCHAR FROM newly
  UNION ALL SELECT 'findings', 'ci_regression', printf('Recall %+.2f, precision %+.2f, MRR %+.2f, p95 latency %+d ms.', re, pr, mr, la) FROM ch
  UNION ALL SELECT 'recommendations', 'review_ci_regression', 'Review newly failing CI cases' FROM newly WHERE lost > 0
) SELECT * FROM x""")
def ci_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the report of a lexical run says of itself and of its changes against a vector run in which the cases with a number divisible by 4 had no failure."""
    rows = stored(mode_results(spark, sf_dir), "mode-results")
    now, before = rows.where("mode = 'lexical'"), rows.where("mode = 'vector'")
    earlier = now.withColumn("failures", F.when(F.col("query_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.col("failures")))
    report = reports.ci_report(now, evals.summarize_modes(now), evals.summarize_modes(before), earlier, {"config_label": "main", "branch": "work", "commit_sha": None})
    return report.where("section = 'context' OR code IN ('ci_regression', 'review_ci_regression')").select("section", "code", "detail")
