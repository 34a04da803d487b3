"""Queries that write tables in the shared folder and read what became of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.config import Config
from attestor.engine import Engine
from attestor.operators.chunking import Chunking
from attestor.operators.datasets import PARTITIONS, Datasets
from attestor.plans import oracle as o
from attestor.plans.queries import query
from attestor.plans.tables import table
from attestor.sources.scratch import scratch, spread, stored
from attestor.sources.store import Store


def _time(day: int):
    return F.lit(f"2024-01-{day:02} 00:00:00").cast("timestamp")


@query("op_s15_datasets", """WITH c AS (SELECT item_id, item_id % 7 AS d, text FROM benchmark WHERE regexp_matches(text, '\\S')),
s1 AS (SELECT d, item_id, left(text, 40) AS query FROM c WHERE d <> 6),
s2 AS (SELECT d, item_id, CASE WHEN item_id % 3 = 0 THEN 'again ' || query ELSE query END AS query FROM s1 WHERE d > 2 OR item_id % 5 <> 0),
n AS (SELECT d, count(*) AS cases, sha256(string_agg(item_id || ':' || query, ',' ORDER BY item_id)) AS digest FROM s2 GROUP BY d),
e AS (SELECT d, count(*) FILTER (item_id % 3 = 0 AND (d > 2 OR item_id % 5 <> 0)) AS updated, count(*) FILTER (d <= 2 AND item_id % 5 = 0) AS deleted FROM s1 GROUP BY d)
SELECT 'set' || d AS dataset_id, coalesce(cases, 0) AS cases, coalesce(digest, '') AS digest, coalesce(updated, 0) AS updated, coalesce(deleted, 0) AS deleted,
  CASE WHEN d = 1 THEN '2024-01-09' WHEN coalesce(updated, 0) + coalesce(deleted, 0) > 0 THEN '2024-01-05' WHEN coalesce(cases, 0) > 0 THEN '2024-01-02' ELSE '2024-01-01' END AS updated_on,
  CASE WHEN d = 1 THEN 'x2' END AS latest_experiment, CASE WHEN d = 1 THEN 'hybrid' END AS best_mode
FROM range(7) r(d) LEFT JOIN n USING (d) LEFT JOIN e USING (d)""")
def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages as cases of seven datasets: inserted, then updated and deleted in one change set, then two experiments."""
    lab = Datasets(Store(spark, scratch(spark, "datasets"), PARTITIONS))
    lab.create(spark.range(7).select(F.concat(F.lit("set"), F.col("id").cast("string")).alias("dataset_id"), F.lit("a set").alias("name"), _time(1).alias("created_at")))
    i = F.col("item_id")
    rows = table(spark, sf_dir, "benchmark").where(F.col("text").rlike("\\S") & (i % 7 != 6)).select(
        F.concat(F.lit("set"), (i % 7).cast("string")).alias("dataset_id"), i.alias("case_id"), F.left("text", F.lit(40)).alias("query"), F.array().cast("array<string>").alias("chunk_ids"),
        F.array(F.lit("d1")).alias("document_ids"), F.lit(5).alias("top_k"),
    )
    lab.change_cases(rows.withColumn("op", F.lit("insert")), _time(2))
    c, few = F.col("case_id"), F.substring("dataset_id", 4, 1).cast("int") <= 2
    op = F.when(few & (c % 5 == 0), "delete").when(c % 3 == 0, "update")
    changes = rows.withColumns({"op": op, "query": F.concat(F.lit("again "), F.col("query"))}).where("op is not null")
    done = lab.change_cases(changes.unionByName(changes.limit(1).withColumns({"case_id": F.lit(-1).cast("long"), "op": F.lit("delete")})), _time(5))
    runs = [("set1", "x1", "lexical", 8), ("set1", "x2", "hybrid", 9)]
    lab.add_experiments(spark.createDataFrame(runs, "dataset_id string, experiment_id string, best_mode string, day int").select(
        "dataset_id", "experiment_id", "best_mode", F.lit("passed").alias("gate_status"), F.make_timestamp(F.lit(2024), F.lit(1), F.col("day"), F.lit(0), F.lit(0), F.lit(0)).alias("created_at")
    ))
    held = lab.store.read("cases").select("dataset_id", "case_id", F.concat_ws(":", c.cast("string"), "query").alias("line"))
    texts = held.groupBy("dataset_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("case_id", "line"))), lambda x: x["line"]), ","), 256).alias("digest"))
    return lab.summaries().join(texts, "dataset_id", "left").join(done.select("dataset_id", "updated", "deleted"), "dataset_id", "left").select(
        "dataset_id", "cases", F.coalesce("digest", F.lit("")).alias("digest"), F.coalesce("updated", F.lit(0)).alias("updated"), F.coalesce("deleted", F.lit(0)).alias("deleted"),
        F.date_format("updated_at", "yyyy-MM-dd").alias("updated_on"), "latest_experiment", "best_mode",
    )


#: Documents as files: a few of another type, some blank.
FILES = """files AS (SELECT 'd' || doc_id AS document_id, 'src' AS source_id, doc_id || CASE WHEN doc_id % 11 = 0 THEN '.exe' ELSE '.txt' END AS path, CASE WHEN doc_id % 13 = 0 THEN '' ELSE coalesce(text, '') END AS text FROM documents)"""


@query("op_s17_ingestion_run", "WITH " + FILES + f""",
docs AS (SELECT * FROM files WHERE path LIKE '%.txt' AND regexp_matches(text, '[^{o.WHITE}]')),""" + o.windows() + """,
n AS (SELECT (SELECT count(*) FROM files) AS files_received, (SELECT count(*) FROM docs) AS documents_created, (SELECT count(*) FROM windows) AS chunks_created)
SELECT files_received, documents_created, chunks_created, files_received - documents_created AS failed_files, CASE WHEN documents_created = 0 THEN 'failed' WHEN files_received = documents_created THEN 'completed' ELSE 'partial' END AS status,
  documents_created AS documents, files_received - documents_created AS failures FROM n""")
def ingestion_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files of one source, each a request of its own: the completed row of the run."""
    i = F.col("doc_id")
    text = F.when(i % 13 == 0, "").otherwise(F.coalesce("text", F.lit("")))
    files = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.concat(i.cast("string"), F.when(i % 11 == 0, ".exe").otherwise(".txt")).alias("file_name"), F.lit(None).cast("string").alias("content_type"), text.cast("binary").alias("content"),
        F.octet_length(text).cast("long").alias("length"), i.cast("string").alias("request_id"), F.lit(1).alias("position"),
    )
    engine = Engine(spark, scratch(spark, "engine"), Config(chunking=Chunking(strategy="whitespace")))
    return engine.ingest(files, "src").select("files_received", "documents_created", "chunks_created", "failed_files", "status", "documents", "failures")


@query("op_s1_multipart", """SELECT 'page' || page_id || '.html' AS file_name, 'files' AS name, 'text/html; charset=utf-8' AS content_type, strlen(coalesce(html, ''))::BIGINT AS length, sha256(coalesce(html, '')) AS digest FROM pages""")
def multipart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as multipart bodies of up to 64 files, read back by byte ranges that are smaller than most files; fields between the files give no row."""
    from attestor.sources.multipart import Multipart

    head = '--page-boundary-7\r\nContent-Disposition: form-data; name="%s"%s\r\n'
    named = F.format_string(head % ("files", '; filename="C:\\\\dir\\\\page%d.html"') + "Content-Type: text/html; charset=utf-8\r\n\r\n", "page_id")
    part = F.concat(named, F.coalesce("html", F.lit("")), F.lit("\r\n" + head % ("note", "") + "\r\nno file\r\n"))
    pages = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 64).alias("body"), F.struct("page_id", part.alias("part")).alias("p"))
    bodies = pages.groupBy("body").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]), "").alias("parts"))  # 64 pages a group
    path = scratch(spark, "bodies")
    bodies.select(F.concat("parts", F.lit("--page-boundary-7--"))).write.option("maxRecordsPerFile", 1).text(path)
    spark.dataSource.register(Multipart)
    rows = spark.read.format("multipart").option("split", 5000).load(path)
    return rows.select("file_name", "name", "content_type", "length", F.sha2("content", 256).alias("digest"))


@query("op_s18_report_files", "SELECT item_id AS query_id, true AS same FROM benchmark")
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of every question as a file, and whether the file that is read back is the report."""
    from attestor.operators import reports
    from attestor.plans.queries import diagnosed, judged
    from attestor.sources.report_files import ReportFiles

    hits = judged(spark, sf_dir)
    texts = stored(reports.markdown(diagnosed(spark, sf_dir), reports.evidence(hits, "snippets_allowed"), "snippets_allowed"), "reports")
    path = scratch(spark, "report-files")
    spark.dataSource.register(ReportFiles)
    texts.select(F.concat(F.lit("question/"), F.col("query_id").cast("string")).alias("name"), F.col("markdown").alias("text")).write.format("report_files").mode("append").save(path)
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), "question%(?:25)?2F([0-9]+)\\.md$", 1).cast("long").alias("query_id"), "value")
    return texts.join(files, "query_id", "full_outer").select("query_id", F.col("markdown").eqNullSafe(F.col("value")).alias("same"))
