"""Queries for lookups, joins, summaries and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.functions import hashing, text
from attestor.operators import answer, diagnosis, evals, overview, retrieval, traces
from attestor.operators.intelligence import analyze
from attestor.plans import oracle as o
from attestor.plans.queries import DIAGNOSED, EVALUATED, MODES, case_results, chunks, diagnosed, eval_cases, joined, judged, lexical_hits, mode_results, query, summaries
from attestor.plans.tables import documents, questions, table
from attestor.sources.store import patched


@query("op_p2_embedding_candidates", "WITH " + o.CHUNKS + " SELECT chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY ordinal) AS place FROM chunks")
def embedding_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_id", F.row_number().over(Window.partitionBy("document_id").orderBy("ordinal")).alias("place"))


@query("op_p4_p5_lookups", "SELECT event_id, event_type, value FROM events WHERE event_id IN (3, 1, 4, 159, 26535)")
def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_id").isin(3, 1, 4, 159, 26535)).select("event_id", "event_type", "value")


@query("op_p8_report_candidates", "WITH " + o.DOCS + f""", low AS (SELECT document_id AS id FROM docs WHERE {o.words('text')} < 20 OR contains(text, chr(65533)) ORDER BY document_id LIMIT 6),
gates AS (SELECT o_orderkey::VARCHAR AS id FROM orders WHERE o_orderstatus = 'F' ORDER BY id LIMIT 6), runs AS (SELECT event_id::VARCHAR AS id FROM events WHERE event_type = 'error' ORDER BY id LIMIT 6)
SELECT 'document' AS kind, id FROM low UNION ALL SELECT 'run', id FROM runs UNION ALL SELECT 'gate', id FROM gates""")
def report_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six of each list, as the feature asks. Orders stand for gates, events for runs."""
    gates = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("passed").alias("status"))
    runs = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "failing").alias("outcome"))
    found = analyze(documents(spark, sf_dir)).select(F.col("document_id").alias("id"), "extraction_quality", "warnings")
    return overview.report_candidates(gates, runs, found)


@query("op_p9_document_picker", "WITH " + o.DOCS + """ SELECT source_id, (count(DISTINCT document_id) FILTER (document_id IN ('d0', 'd3', 'd4')))::INT AS kept, bool_or(document_id = 'd3') AS has FROM docs GROUP BY source_id""")
def document_picker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.picked(documents(spark, sf_dir), ["d0", "d3", "d4"], "d3")


@query("op_p13_patch_merge", """SELECT a.conv_id, coalesce(CASE WHEN length(b.text) % 2 = 0 THEN b.text END, a.text) AS text, coalesce(b.role, a.role) AS role,
  CASE WHEN b.conv_id IS NOT NULL AND length(b.text) % 3 > 0 THEN CASE WHEN length(b.text) % 3 = 1 THEN b.role END ELSE a.role END AS notes
FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = 1 WHERE a.turn = 0""")
def patch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First turns with what second turns change: a text of even length, the role, and notes that some keep, set or clear."""
    c, n = table(spark, sf_dir, "conversations"), F.length("text")
    new = c.where("turn = 1").select("conv_id", F.when(n % 2 == 0, F.col("text")).alias("text"), "role", F.when(n % 3 == 1, F.col("role")).alias("notes"), (n % 3 > 0).alias("notes_given"))
    return patched(c.where("turn = 0").select("conv_id", "text", "role", F.col("role").alias("notes")), new, "conv_id", ("notes",))


@query("op_p14_key_validity", """SELECT event_id FROM events WHERE event_type <> 'error' AND (value > 90 OR ts + INTERVAL 30 DAY > TIMESTAMP '2024-02-01') AND event_type IN ('click', 'view')""")
def key_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stand for keys: errors are revoked, those above 90 never expire, clicks and views may write."""
    keys = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") == "error", F.col("ts")).alias("revoked_at"), F.when(~F.coalesce(F.col("value") > 90, F.lit(False)), F.col("ts") + F.make_interval(days=F.lit(30))).alias("expires_at"),
        F.when(F.col("event_type").isin("click", "view"), F.array(F.lit("read"), F.lit("write"))).otherwise(F.array(F.lit("read"))).alias("scopes"),
    )
    return overview.valid_keys(keys, F.lit("2024-02-01").cast("timestamp"), "write").select("event_id")


@query("op_j1_searchable", "WITH " + o.CHUNKS + """ SELECT source_id, count(*) AS chunks, count(DISTINCT document_id) AS documents, count(*) FILTER (left(checksum, 1) <> '0') AS embedded FROM chunks GROUP BY source_id""")
def searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with documents, sources and, where there is one, their embedding."""
    from attestor.plans.tables import index_state

    c, d = chunks(spark, sf_dir), documents(spark, sf_dir).select("document_id", F.col("source_id").alias("source"))
    rows = c.join(d, "document_id").join(index_state(c).select("chunk_id", "model"), "chunk_id", "left")
    return rows.groupBy(F.col("source").alias("source_id")).agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("document_id").alias("documents"), F.count("model").alias("embedded"))


@query("op_j4_latest_of_each", """SELECT c_custkey, count(o_orderkey) AS orders, arg_max(o_orderkey, row(o_orderdate, o_orderkey)) AS latest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def latest_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))
    return table(spark, sf_dir, "customer").join(held, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), "latest")


@query("op_j5_latest_with_source", "WITH " + o.RETRIEVED + " SELECT max(query_id) AS query_id FROM questions WHERE EXISTS (SELECT 1 FROM hits WHERE hits.query_id = questions.query_id AND source_id = 'src1')")
def latest_with_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).join(lexical_hits(spark, sf_dir).where("source_id = 'src1'").select("query_id"), "query_id", "left_semi").agg(F.max("query_id").alias("query_id"))


@query("op_j7_memberships", """SELECT c_custkey, n_name, r_name, arg_min(o_orderkey, row(o_orderdate, o_orderkey)) AS first_order
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.join(first, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "n_name", "r_name", "first_order")


@query("op_j9_cases_modes", "SELECT item_id AS query_id, mode FROM benchmark, (VALUES ('hybrid'), ('vector'), ('lexical')) AS m(mode)")
def cases_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array(*map(F.lit, retrieval.normalized_modes([])))).alias("mode"))


@query("op_g11_run_averages", EVALUATED + " SELECT count(*) AS cases, round(avg(recall), 6) AS recall, round(avg(citation_coverage), 6) AS citation_coverage, round(avg(passed::INT::DOUBLE), 6) AS pass_rate FROM results")
def run_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return case_results(spark, sf_dir).agg(F.count(F.lit(1)).alias("cases"), mean("recall", "recall"), mean("citation_coverage", "citation_coverage"), mean(F.col("passed").cast("double"), "pass_rate"))


@query("op_g15_overview_counts", DIAGNOSED + """ SELECT (SELECT count(DISTINCT source_id) FROM docs) AS sources, (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM chunks) AS chunks,
  (SELECT count(*) FROM d WHERE outcome = 'weak') AS weak, (SELECT count(*) FROM d WHERE outcome = 'failing') AS failed""")
def overview_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).agg(F.count_distinct("source_id").alias("sources"), F.count(F.lit(1)).alias("documents"))
    c = chunks(spark, sf_dir).agg(F.count(F.lit(1)).alias("chunks"))
    runs = diagnosed(spark, sf_dir).agg(F.count_if(F.col("outcome") == "weak").alias("weak"), F.count_if(F.col("outcome") == "failing").alias("failed"))
    return d.join(c).join(runs)  # three single rows


@query("op_g20_ingestion_status", """WITH f AS (SELECT page_id // 10 AS request, page_id % 4 IN (2, 3) AS failed FROM pages)
SELECT request, count(*) FILTER (NOT failed) AS documents, count(*) FILTER (failed) AS failures,
  CASE WHEN count(*) FILTER (NOT failed) = 0 THEN 'failed' WHEN count(*) FILTER (failed) = 0 THEN 'completed' ELSE 'partial' END AS status FROM f GROUP BY request""")
def ingestion_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestor.operators.overview import ingestion_status as status

    p = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 10).alias("request"), (F.col("page_id") % 4).isin(2, 3).alias("failed"))
    sums = p.groupBy("request").agg(F.count_if(~F.col("failed")).alias("documents"), F.count_if("failed").alias("failures"))
    return sums.withColumn("status", status(F.col("documents"), F.col("failures")))


@query("op_g23_first_failure_of_each_code", MODES + """, u AS (SELECT mode, query_id, unnest(failures) AS code FROM moded)
SELECT code, arg_min(mode, row(mode, query_id)) AS mode, arg_min(query_id, row(mode, query_id)) AS query_id, count(*) AS cases FROM u GROUP BY code""")
def first_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.first_failures(mode_results(spark, sf_dir))


@query("op_w3_w4_margins_and_leaders", "WITH " + o.RETRIEVED + """, l AS (SELECT *, lexical + phrase + section + path_score + metadata AS family FROM hits)
SELECT query_id, arg_max(chunk_id, row(family, -rank)) AS lexical_leader, round(greatest(0.0, (max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2)) / max(score) FILTER (rank = 1)), 6) AS margin FROM l GROUP BY query_id HAVING count(*) > 1""")
def margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.col("lexical") + F.col("phrase") + F.col("section") + F.col("path_score") + F.col("metadata")
    first, second = F.max(F.when(F.col("rank") == 1, F.col("score"))), F.max(F.when(F.col("rank") == 2, F.col("score")))
    sums = lexical_hits(spark, sf_dir).withColumn("family", family).groupBy("query_id").agg(
        F.max_by("chunk_id", F.struct("family", -F.col("rank"))).alias("lexical_leader"), F.round(F.greatest(F.lit(0.0), (first - second) / first), 6).alias("margin"), F.count(F.lit(1)).alias("n")
    )
    return sums.where("n > 1").drop("n")


@query("op_w8_ngrams", f"""WITH t AS (SELECT DISTINCT unnest({o.terms('text')}) AS t FROM benchmark), g AS (SELECT unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS g FROM t)
SELECT g AS ngram, count(*) AS n FROM g GROUP BY g""")
def ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "benchmark").select(F.explode(text.query_terms(F.col("text"))).alias("t")).distinct().where(F.char_length("t") >= 3)
    grams = F.transform(F.sequence(F.lit(1), F.char_length("t") - 2), lambda i: F.substring("t", i, 3))
    return t.select(F.explode(grams).alias("ngram")).groupBy("ngram").agg(F.count(F.lit(1)).alias("n"))


@query("op_t5_t7_previews", "WITH " + o.CHUNKS + """ SELECT chunk_id, left(text, 64) AS label, left(text, 280) AS preview FROM chunks WHERE ordinal < 8""")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight chunks of each document, as the preview shows them."""
    return chunks(spark, sf_dir).where("ordinal < 8").select("chunk_id", F.left(F.coalesce("section_title", "text"), F.lit(64)).alias("label"), F.left("text", F.lit(280)).alias("preview"))


@query("op_u3_u4_ordered_unique", """WITH s AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS kinds FROM s GROUP BY user_id""")
def ordered_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    kinds = F.array_sort(F.collect_list(F.struct("first", "event_type")))
    return first.groupBy("user_id").agg(joined(F.transform(kinds, lambda k: k["event_type"])).alias("kinds"))


@query("op_a10_heading_only", f"SELECT conv_id, turn, {o.HEADING} AS heading FROM conversations")
def heading_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.is_heading_only(F.col("text"), F.lit(None).cast("string")).alias("heading"))


@query("op_a14_checksums", "SELECT doc_id, left(sha256(coalesce(text, '')), 12) AS prefix FROM documents")
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.left(hashing.checksum(F.coalesce("text", F.lit(""))), F.lit(12)).alias("prefix"))


@query("op_a22_evidence_hints", "WITH " + o.CHUNKS + " SELECT evidence_score_hint AS hint, count(*) AS chunks FROM chunks GROUP BY ALL")
def evidence_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).groupBy(F.col("evidence_score_hint").alias("hint")).agg(F.count(F.lit(1)).alias("chunks"))


@query("op_a27_label_summary", DIAGNOSED + " SELECT query_id, array_to_string(codes[1:3], ', ') AS labels FROM d")
def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosed(spark, sf_dir).select("query_id", F.array_join(F.slice("codes", 1, 3), ", ").alias("labels"))


@query("op_js2_tagged_union", """SELECT event_id, event_type AS kind, CASE WHEN event_type = 'click' THEN (props::JSON ->> '$.k')::INT END AS clicked FROM events""")
def tagged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = F.to_json(F.struct(F.col("event_type").alias("type"), F.from_json("props", "k int").alias("body")))
    e = table(spark, sf_dir, "events").select("event_id", tagged.alias("j"))
    kind = F.get_json_object("j", "$.type")
    return e.select("event_id", kind.alias("kind"), F.when(kind == "click", F.get_json_object("j", "$.body.k").cast("int")).alias("clicked"))


@query("op_m1_context_map", "SELECT event_id, 'event=' || event_id || ',mode=' || event_type || ',user=' || user_id AS context FROM events")
def context_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.map_concat(F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("mode"), F.col("event_type")), F.create_map(F.lit("event"), F.col("event_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", joined(F.transform(F.array_sort(F.map_entries(made)), lambda e: F.concat_ws("=", e["key"], e["value"]))).alias("context"))


BEFORE_AFTER = f"""SELECT b.query_id, b.codes AS old, a.codes AS new, b.outcome AS was, a.outcome AS now FROM ({DIAGNOSED} SELECT query_id, codes, outcome FROM d) b
JOIN ({DIAGNOSED.replace("WHERE rank <= 5", "WHERE rank <= 1")} SELECT query_id, codes, outcome FROM d) a USING (query_id)"""
_PLACE = "CASE {} WHEN 'failing' THEN 0 WHEN 'weak' THEN 1 WHEN 'mixed' THEN 2 ELSE 3 END"


@query("op_dx10_compare_diagnoses", f"""WITH x AS ({BEFORE_AFTER}) SELECT query_id, array_to_string(list_filter(coalesce(old, []), lambda c: NOT list_contains(new, c)), ',') AS resolved,
  array_to_string(list_filter(coalesce(new, []), lambda c: NOT list_contains(old, c)), ',') AS introduced, sign({_PLACE.format("now")} - {_PLACE.format("was")})::INT AS direction FROM x""")
def compare_diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run of five hits against a rerun of one."""
    asked = questions(spark, sf_dir)
    one = answer.assess(retrieval.retrieve(chunks(spark, sf_dir), asked, top_k=1))
    again = diagnosis.diagnose(asked, one, answer.answers(asked, one), "lexical")
    rows = diagnosis.compare_diagnoses(diagnosed(spark, sf_dir), again)
    return rows.select("query_id", joined("resolved").alias("resolved"), joined("introduced").alias("introduced"), "direction")


@query("op_tr1_traces", DIAGNOSED + """, s AS (SELECT query_id, max(score) AS top_score, count(DISTINCT source_id) AS n, min(source_id) AS source, count(*) FILTER (support_status = 'supported') AS supported FROM judged GROUP BY query_id)
SELECT d.query_id, CASE WHEN n = 1 THEN source ELSE 'default' END AS project, CASE outcome WHEN 'failing' THEN 'failed' WHEN 'strong' THEN 'passed' ELSE 'attention' END AS status,
  'query:lexical,retrieval:' || d.hits || ',answer:' || coalesce(supported, 0) || ',diagnosis:' || outcome AS spans, coalesce(top_score, 0.0) AS top_score FROM d LEFT JOIN s USING (query_id)""")
def trace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traces.traces(diagnosed(spark, sf_dir), judged(spark, sf_dir), "lexical")
    return rows.select("query_id", "project", "status", joined(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["detail"]))).alias("spans"), "top_score")


@query("op_g25_case_totals", EVALUATED + " SELECT count(*) AS cases, sum(len(want))::BIGINT AS expected FROM results")
def case_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_cases(spark, sf_dir).agg(F.count(F.lit(1)).alias("cases"), F.sum(F.size("document_ids")).alias("expected"))
