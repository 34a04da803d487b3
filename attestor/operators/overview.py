"""Corpus overview: counts, mix, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def document_mix(documents: DataFrame) -> DataFrame:
    """profile, count, share; the most frequent first."""
    counts = documents.groupBy("profile").agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("share", F.round(F.col("count") / F.sum("count").over(Window.partitionBy()), 6))  # a row for each profile


def source_summary(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """source_id, documents, chunks; sources without chunks have none."""
    per = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    return documents.join(per, "document_id", "left").groupBy("source_id").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.coalesce("chunks", F.lit(0))).alias("chunks"))


def health(total: Column, gap: Column, warnings: Column, weak: Column, failed: Column, cases: Column, pass_rate: Column) -> Column:
    """100 less what the index, warnings, runs and evaluations cost, 0 at least."""
    cost = (
        F.round(F.coalesce(F.try_divide(gap.cast("double"), total), F.lit(0.0)) * 30) + F.least(5 * warnings, F.lit(20)) + F.least(5 * weak + 10 * failed, F.lit(25))
        + F.when(cases == 0, 15).otherwise(F.round((1 - pass_rate) * 15))
    )
    return (100 - F.least(F.lit(100), cost)).cast("int")


def ingestion_status(documents: Column, failures: Column) -> Column:
    return F.when(documents == 0, "failed").when(failures == 0, "completed").otherwise("partial")


def activity(*lists: tuple[DataFrame, int], most: int = 7) -> DataFrame:
    """The latest rows (kind, id, at) of each list, so many of each, and of all the latest."""
    parts = [d.orderBy(F.desc("at"), "id").limit(n) for d, n in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.desc("at"), "kind", "id").limit(most)


def pass_rates(results: DataFrame) -> DataFrame:
    """mode, pass_rate of case results."""
    rows = results.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("k"))
    return rows.select("mode", F.round(F.coalesce(F.try_divide("k", "n"), F.lit(0.0)), 6).alias("pass_rate"))


def in_workspace(rows: DataFrame, workspace) -> DataFrame:
    """What belongs to a workspace; rows without one belong to none."""
    return rows.where(F.col("workspace_id") == F.lit(workspace))


def marked_sources(sources: DataFrame, projects: DataFrame, workspace, marker: str) -> DataFrame:
    """Sources (source_id, project_id) of a workspace's projects (project_id, workspace_id, name) whose name begins with marker."""
    wanted = in_workspace(projects, workspace).where(F.col("name").startswith(marker)).select("project_id", F.col("name").alias("project"))
    return sources.join(wanted, "project_id")


def report_of_latest_trace(traces: DataFrame, reports: DataFrame) -> DataFrame:
    """trace_id, report_id: the latest trace (trace_id, source_id, at) and the first report (report_id, source_id, at) on its
    source; no row where there is none."""
    latest = traces.orderBy(F.desc("at"), F.desc("trace_id")).limit(1)
    met = reports.select("report_id", "source_id", F.col("at").alias("made")).join(F.broadcast(latest.select("trace_id", "source_id")), "source_id")  # one row
    return met.orderBy("made", "report_id").limit(1).select("trace_id", "report_id")


def oldest_or(rows: DataFrame, order: list[str], default: DataFrame) -> DataFrame:
    """One row: the oldest, or the default where there is none."""
    both = rows.select(*default.columns).withColumn("_late", F.lit(0)).unionByName(default.withColumn("_late", F.lit(1)))
    return both.orderBy("_late", *order).limit(1).drop("_late")


def corpus_status() -> Column:
    """What a corpus lacks first, of counts (documents, missing, stale, cases)."""
    return F.when(F.col("documents") == 0, "needs_documents").when(_unindexed(), "needs_indexing").when(F.col("cases") == 0, "needs_eval_coverage").otherwise("ready")


def _unindexed() -> Column:
    return (F.col("missing") > 0) | (F.col("stale") > 0)


def _listed(counts: DataFrame, keys: list[str], fields: tuple[str, ...], entries: list[tuple]) -> DataFrame:
    """keys, ordinal and the fields of those entries (condition, fields...) whose condition holds, for each row of counts."""
    made = [F.when(when, F.struct(*[v.cast("string").alias(n) for n, v in zip(fields, values, strict=True)])) for when, *values in entries]
    held = F.filter(F.array(*made), lambda x: x.isNotNull())
    return counts.select(*keys, F.posexplode(held).alias("place", "item")).select(*keys, (F.col("place") + 1).alias("ordinal"), "item.*")


def metrics(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ordinal, id, value, detail, tone of counts (sources, documents, chunks, indexed, missing, stale, traces, weak, failed,
    cases, datasets, warnings, gate, recall, pass_rate). gate and recall are null without an experiment, pass_rate without a run."""
    always, good = F.lit(True), lambda fine: F.when(fine, "good").otherwise("warning")
    percent = lambda c: F.round(F.col(c) * 100).cast("int").cast("string")
    experiment = F.concat("datasets", F.lit(" datasets · "), F.initcap("gate"), F.lit(" gate · "), percent("recall"), F.lit("% recall"))
    run = F.concat(F.lit("latest pass rate "), percent("pass_rate"), F.lit("%"))
    plain = [(always, F.lit(name), F.col(name), F.lit(detail), F.lit("neutral")) for name, detail in (("sources", "connected corpora"), ("documents", "indexed files"), ("chunks", "retrieval units"))]
    return _listed(counts, keys, ("id", "value", "detail", "tone"), [
        *plain,
        (always, F.lit("embeddings"), F.concat("indexed", F.lit("/"), "chunks"), F.concat("missing", F.lit(" missing · "), "stale", F.lit(" stale")), good(~_unindexed())),
        (always, F.lit("traces"), F.col("traces"), F.concat("weak", F.lit(" weak · "), "failed", F.lit(" failed")), good((F.col("weak") == 0) & (F.col("failed") == 0))),
        (always, F.lit("evals"), F.col("cases"), F.coalesce(experiment, run, F.concat("datasets", F.lit(" datasets · no experiment yet"))),
         F.when(F.col("cases") == 0, "warning").when(F.col("gate") == "failed", "critical").otherwise("good")),
        (always, F.lit("warnings"), F.col("warnings"), F.lit("extraction and corpus quality"), good(F.col("warnings") == 0)),
    ])


def pipeline(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ordinal, id, status, count, route: how far a corpus has come, of the counts that metrics reads."""
    always = F.lit(True)
    blocked = lambda c: F.when(F.col(c) == 0, "blocked")
    ran = F.when(F.col("traces") == 0, "pending").otherwise("complete")
    return _listed(counts, keys, ("id", "status", "count", "route"), [
        (always, F.lit("ingest"), blocked("documents").otherwise("complete"), F.col("documents"), F.lit("/app/sources")),
        (always, F.lit("chunk"), blocked("chunks").otherwise("complete"), F.col("chunks"), F.lit("/app/sources")),
        (always, F.lit("embed"), F.when(F.col("chunks") == 0, "pending").when(_unindexed(), "warning").otherwise("complete"), F.col("indexed"), F.lit("/app/retrieval")),
        (always, F.lit("retrieve"), blocked("chunks").otherwise(ran), F.col("traces"), F.lit("/app/retrieval")),
        (always, F.lit("trace"), ran, F.col("traces"), F.lit("/app/traces")),
        (always, F.lit("eval"), F.when(F.col("cases") == 0, "warning").otherwise("complete"), F.col("cases"), F.lit("/app/evals")),
        (always, F.lit("report"), ran, F.col("traces"), F.lit("/app/reports")),
    ]).withColumn("count", F.col("count").cast("long"))


def issues(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ordinal, id, severity, amount, route: what is wrong with a corpus, in a fixed order."""
    found = lambda name, when, severity, amount, route: (when, F.lit(name), F.lit(severity), amount, F.lit(route))
    nothing = F.lit(0)
    return _listed(counts, keys, ("id", "severity", "amount", "route"), [
        found("no_documents", F.col("documents") == 0, "critical", nothing, "/app/sources"),
        found("missing_embeddings", F.col("missing") > 0, "warning", F.col("missing"), "/app/retrieval"),
        found("stale_embeddings", F.col("stale") > 0, "warning", F.col("stale"), "/app/retrieval"),
        found("extraction_warnings", F.col("warnings") > 0, "warning", F.col("warnings"), "/app/sources"),
        found("weak_traces", (F.col("failed") > 0) | (F.col("weak") > 0), "warning", F.col("weak"), "/app/traces"),
        found("missing_eval_coverage", F.col("cases") == 0, "warning", nothing, "/app/evals"),
        found("failed_eval_gate", F.col("gate") == "failed", "critical", F.col("failures"), "/app/evals"),
    ]).withColumn("amount", F.col("amount").cast("long"))


def actions(counts: DataFrame, keys: list[str], most: int = 4) -> DataFrame:
    """keys, ordinal, id, route, priority: the first thing to do, what the first three issues ask for and, once there are traces, a
    report; of those with one route the first, and four at most."""
    state = corpus_status()
    first = (
        F.when(state == "needs_documents", F.lit("ingest_documents /app/sources")).when(state == "needs_indexing", "index_embeddings /app/retrieval").when(state == "needs_eval_coverage", "create_eval_coverage /app/evals")
        .when(F.col("weak") > 0, "review_weak_traces /app/traces").when(F.col("warnings") > 0, "inspect_sources /app/sources").otherwise("run_retrieval /app/retrieval")
    )
    asked = issues(counts, keys).where("ordinal <= 3").select(*keys, (F.col("ordinal") + 1).alias("place"), "id", "route", F.lit("secondary").alias("priority"))
    primary = counts.select(*keys, F.lit(1).alias("place"), F.split_part(first, F.lit(" "), F.lit(1)).alias("id"), F.split_part(first, F.lit(" "), F.lit(2)).alias("route"), F.lit("primary").alias("priority"))
    report = counts.where("traces > 0").select(*keys, F.lit(5).alias("place"), F.lit("generate_report").alias("id"), F.lit("/app/reports").alias("route"), F.lit("secondary").alias("priority"))
    rows = primary.unionByName(asked).unionByName(report)  # five a corpus at most
    once = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "route").orderBy("place"))).where("nth = 1")
    ranked = once.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy("place")))
    return ranked.where(F.col("ordinal") <= most).select(*keys, "ordinal", "id", "route", "priority")


def picked(documents: DataFrame, chosen: list[str], target: str) -> DataFrame:
    """source_id, kept, has: how many of the chosen documents a source has, and whether target is one of its documents."""
    return documents.groupBy("source_id").agg(F.count_distinct(F.when(F.col("document_id").isin(chosen), F.col("document_id"))).cast("int").alias("kept"), F.coalesce(F.bool_or(F.col("document_id") == target), F.lit(False)).alias("has"))


def report_candidates(gates: DataFrame, runs: DataFrame, documents: DataFrame, most: int = 6) -> DataFrame:
    """kind, id: the first failed gates (id, status), diagnosed runs (id, outcome) and documents (id, extraction_quality, warnings)
    of low extraction or with warnings, so many of each."""
    parts = [
        ("gate", gates.where("status = 'failed'")), ("run", runs.where("outcome IS NOT NULL")),
        ("document", documents.where((F.col("extraction_quality") == "low") | (F.size("warnings") > 0))),
    ]
    lists = [rows.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id")).orderBy("id").limit(most) for kind, rows in parts]
    return lists[0].unionByName(lists[1]).unionByName(lists[2])


def progress(counts: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """keys, steps, next_step: how many of the six steps of a sample corpus are done, of counts (documents, unchunked, chunks, missing,
    stale, runs, traces, reports), and the first that is not, or 0. expected is the number of its documents."""
    loaded = F.col("documents") == expected
    chunked = loaded & (F.col("unchunked") == 0)
    done = F.array(loaded, chunked, chunked & (F.col("chunks") > 0) & ~_unindexed(), F.col("runs") > 0, F.col("traces") > 0, F.col("reports") > 0)
    return counts.select(*keys, F.size(F.filter(done, lambda x: x)).alias("steps"), F.array_position(done, False).alias("next_step"))


def valid_keys(keys: DataFrame, now: Column, scope: str) -> DataFrame:
    """Keys (revoked_at, expires_at, scopes) that are not revoked, not expired at a time, and carry the scope; one without an
    expiry does not expire."""
    alive = F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return keys.where(alive & F.array_contains("scopes", scope))
