"""Traces of retrieval runs: four spans, a status, a summary; older traces completed, and what is kept of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def traces(diagnosed: DataFrame, hits: DataFrame, mode: str, default_project: str = "default") -> DataFrame:
    """A row for each query: project (that of all hits, else the default), status, spans, labels, top score."""
    sums = hits.groupBy("query_id").agg(F.max("score").alias("top_score"), F.array_distinct(F.collect_list("source_id")).alias("projects"), F.count_if(F.col("support_status") == "supported").alias("supported"))
    rows = diagnosed.join(sums, "query_id", "left")
    project = F.when(F.size("projects") == 1, F.get("projects", F.lit(0))).otherwise(default_project)
    span = lambda name, detail: F.struct(F.lit(name).alias("kind"), detail.cast("string").alias("detail"))
    spans = F.array(span("query", F.lit(mode)), span("retrieval", F.col("hits")), span("answer", F.coalesce("supported", F.lit(0))), span("diagnosis", F.col("outcome")))
    return rows.select("query_id", project.alias("project"), status_of(F.col("outcome")).alias("status"), spans.alias("spans"), "labels", F.coalesce("top_score", F.lit(0.0)).alias("top_score"))


def summary(trace_rows: DataFrame) -> DataFrame:
    """What a list of traces shows, with fallbacks for traces without labels."""
    return trace_rows.select("query_id", "status", F.coalesce(F.get("labels", F.lit(0)), F.lit("none")).alias("first_label"), F.size("labels").alias("label_count"), "top_score")


def status_of(outcome):
    return F.when(outcome == "failing", "failed").when(outcome == "strong", "passed").otherwise("attention")


def completed(trace_rows: DataFrame, diagnosed: DataFrame) -> DataFrame:
    """Traces (query_id, status, labels, top_score, …) with what a diagnosis says of them; those without a retrieval run, hence
    without a diagnosis, stay as they are."""
    found = diagnosed.select("query_id", F.col("outcome").alias("_outcome"), F.col("labels").alias("_labels"), F.col("summary").alias("_summary"))
    rows = trace_rows.join(found, "query_id", "left")
    known = F.col("_outcome").isNotNull()
    kept = [c for c in trace_rows.columns if c not in ("status", "labels", "summary")]
    before = F.col("summary") if "summary" in trace_rows.columns else F.lit(None).cast("string")
    return rows.select(
        *kept, F.when(known, status_of(F.col("_outcome"))).otherwise(F.col("status")).alias("status"), F.when(known, F.col("_labels")).otherwise(F.col("labels")).alias("labels"),
        F.when(known, F.col("_summary")).otherwise(before).alias("summary"),
    )


HIT = ("query_id", "rank", "chunk_id", "document_id", "source_id", "score", "strength", "support_status")


def run_rows(queries: DataFrame, hits: DataFrame, mode: str, top_k: int, latency_ms: int | None = None) -> DataFrame:
    """A row for each query of a run: the request, the number of hits, and the hits as JSON in the order of their ranks."""
    held = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.to_json(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score", "strength")))).alias("snapshot"))
    rows = queries.select("query_id", "query").join(held, "query_id", "left")
    latency = F.lit(latency_ms).cast("long")
    return rows.select("query_id", "query", F.lit(mode).alias("mode"), F.lit(top_k).alias("top_k"), latency.alias("latency_ms"), F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("snapshot", F.lit("[]")).alias("snapshot"))


def search(runs: DataFrame, text: str, which: str = "all") -> DataFrame:
    """Runs (query, labels, strength) whose query holds the text, whatever its case, and that are of a kind: all, attention (with
    labels or weak) or strong."""
    kinds = {"all": F.lit(True), "attention": (F.size("labels") > 0) | (F.col("strength") == "weak"), "strong": F.col("strength") == "strong"}
    if which not in kinds:
        raise ValueError(f"unknown kind of runs {which}")
    return runs.where(F.contains(F.lower("query"), F.lit(text.strip().lower())) & kinds[which])
