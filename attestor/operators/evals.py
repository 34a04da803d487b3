"""Expected-evidence evaluation: cases, modes, comparison, gate, regression between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.operators.answer import answers

RECALL_GATE, WEAK_LIMIT = 0.80, 0.20
MODE_ORDER = {"hybrid": 0, "vector": 1, "lexical": 2}


def evaluate(cases: DataFrame, hits: DataFrame, answered: DataFrame, missing_index: Column | None = None) -> DataFrame:
    """A row for each case: recall, precision, reciprocal rank, citation coverage, weak hits, failure labels, passed.

    cases: (query_id, chunk_ids, document_ids), each expected id counting once; hits: assessed hits.
    """
    wanted = cases.select("query_id", F.array_distinct("chunk_ids").alias("want_chunks"), F.array_distinct("document_ids").alias("want_documents"))
    met = hits.join(wanted, "query_id")
    chunk_ok, document_ok = F.array_contains(F.col("want_chunks"), F.col("chunk_id")), F.array_contains(F.col("want_documents"), F.col("document_id"))
    good = chunk_ok | document_ok
    sums = met.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("hits"), F.count_distinct(F.when(chunk_ok, F.col("chunk_id"))).alias("chunks_met"), F.count_distinct(F.when(document_ok, F.col("document_id"))).alias("documents_met"),
        F.count_if(good).alias("good"), F.min(F.when(good, F.col("rank"))).alias("top_hit_rank"), F.count_if(F.col("strength") == "weak").alias("weak_count"),
        F.max(F.array_contains("hit_flags", "heading_only")).alias("heading"), F.max((F.col("duplicate_count") > 1) | F.array_contains("hit_flags", "duplicate")).alias("duplicate"),
    )
    rows = wanted.join(sums, "query_id", "left").join(answered.select("query_id", F.size("citations").alias("cited")), "query_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    expected = F.size("want_chunks") + F.size("want_documents")
    rows = rows.withColumns({
        "recall": F.round(F.coalesce(F.try_divide((zero("chunks_met") + zero("documents_met")).cast("double"), expected), F.lit(0.0)), 6),
        "precision": F.round(F.coalesce(F.try_divide(zero("good").cast("double"), zero("hits")), F.lit(0.0)), 6),
        "mrr": F.round(F.coalesce(F.lit(1.0) / F.col("top_hit_rank"), F.lit(0.0)), 6),
        "citation_coverage": F.round(F.coalesce(F.try_divide(F.least(zero("cited"), zero("hits")).cast("double"), zero("hits")), F.lit(0.0)), 6),
        "weak_count": zero("weak_count"),
    })
    missing = missing_index if missing_index is not None else F.lit(False)
    lost = (F.col("recall") == 0) & (expected > 0)
    label = lambda name, c: F.when(c, F.lit(name))
    failures = F.array_compact(F.array(
        label("missing_embeddings", missing), label("expected_evidence_missing", lost),
        label("correct_document_wrong_chunk", ~lost & (zero("documents_met") > 0) & (F.size("want_chunks") > 0) & (zero("chunks_met") == 0)),
        label("low_precision", (zero("hits") > 0) & (F.col("precision") < 0.5)), label("weak_evidence", F.col("weak_count") > 0),
        label("heading_only_evidence", F.coalesce("heading", F.lit(False))), label("duplicate_evidence", F.coalesce("duplicate", F.lit(False))),
    ))
    return rows.select("query_id", "recall", "precision", "mrr", "top_hit_rank", "citation_coverage", "weak_count", failures.alias("failures"), (F.col("recall") > 0).alias("passed"))


def percentiles(results: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """key and, under each name, sorted[ceil((n - 1) p)] of its values. Equal values are counted first, so a window holds the distinct
    values of a key and not its rows."""
    counts = results.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_k"))
    whole = Window.partitionBy(key)
    rows = counts.withColumns({"_upto": F.sum("_k").over(whole.orderBy(value)), "_n": F.sum("_k").over(whole)})
    return rows.groupBy(key).agg(*[F.min(F.when(F.col("_upto") > F.ceil((F.col("_n") - 1) * p), F.col(value))).alias(name) for name, p in shares.items()])


def summarize_modes(results: DataFrame) -> DataFrame:
    """A row for each mode of case results with mode and latency_ms; without latencies p50 and p95 are 0."""
    sums = results.groupBy("mode").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("passed").alias("passed"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("precision"), 6).alias("precision"),
        F.round(F.avg("mrr"), 6).alias("mrr"), F.round(F.avg("citation_coverage"), 6).alias("citation_coverage"), F.sum("weak_count").alias("weak_count"),
        F.sum(F.size(F.filter("failures", lambda f: f.isin("missing_embeddings", "expected_evidence_missing")))).alias("critical"),
    )
    found = percentiles(results, "mode", "latency_ms", {"p50": 0.5, "p95": 0.95})
    return sums.join(found, "mode", "left").withColumns({p: F.coalesce(p, F.lit(0)) for p in ("p50", "p95")})


def single_mode_run(cases: DataFrame, hits: DataFrame, queries: DataFrame, limit: int = 3) -> DataFrame:
    """Case results of one mode in which each case (query_id, chunk_ids, document_ids, top_k) sees its own first top_k of the hits."""
    held = hits.join(cases.select("query_id", "top_k"), "query_id").where(F.col("rank") <= F.col("top_k")).drop("top_k")
    return evaluate(cases, held, answers(queries.join(cases.select("query_id"), "query_id", "left_semi"), held, limit))


def mode_rank(mode: Column) -> Column:
    return F.when(mode == "hybrid", 0).when(mode == "vector", 1).otherwise(2)


def compare_modes(summaries: DataFrame) -> DataFrame:
    """One row: the best mode by recall, precision, lower p50 and, among equals, the last in order; its leads over the worst."""
    return summaries.agg(
        F.max_by("mode", F.struct("recall", "precision", -F.col("p50"), mode_rank(F.col("mode")))).alias("best_mode"), F.count(F.lit(1)).alias("modes"),
        F.round(F.max("recall") - F.min("recall"), 6).alias("recall_delta"),
        F.round(F.max_by("precision", F.struct("recall", "precision", -F.col("p50"), mode_rank(F.col("mode")))) - F.min("precision"), 6).alias("precision_delta"),
        (F.max("p50") - F.min("p50")).alias("latency_delta"),
    )


def gate(summaries: DataFrame) -> DataFrame:
    """One row: recall of the best mode, weak hits for each case and mode (may exceed 1), critical failures, reasons, status."""
    row = summaries.agg(
        F.coalesce(F.max("recall"), F.lit(0.0)).alias("recall"), F.round(F.coalesce(F.sum("weak_count") / F.greatest(F.sum("cases"), F.lit(1)), F.lit(0.0)), 6).alias("weak_rate"),
        F.coalesce(F.sum("critical"), F.lit(0)).alias("critical"),
    )
    low, bad, weak = F.col("recall") < RECALL_GATE, F.col("critical") > 0, F.col("weak_rate") > WEAK_LIMIT
    reasons = F.array_compact(F.array(F.when(low, F.lit("recall")), F.when(bad, F.lit("critical")), F.when(weak, F.lit("weak_evidence"))))
    return row.select("recall", "weak_rate", "critical", reasons.alias("reasons"), F.when(low | bad | weak, "failed").otherwise("passed").alias("status"))


def regression(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """One row: deltas of the best modes by recall (the last among equals) of two summaries."""
    best = lambda d, p: d.agg(F.max_by(F.struct("recall", "precision", "mrr", "p95"), F.struct("recall", mode_rank(F.col("mode")))).alias(p))
    both = best(baseline, "b").join(best(current, "c"))  # two single rows
    delta = lambda x: F.round(F.col(f"c.{x}") - F.col(f"b.{x}"), 6).alias(f"{x}_delta")
    return both.select(delta("recall"), delta("precision"), delta("mrr"), (F.col("c.p95") - F.col("b.p95")).alias("latency_delta"))


def newly_failed(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Cases that fail now and did not before."""
    failing = lambda d: d.where(F.size("failures") > 0).select("query_id").distinct()
    return failing(current).join(failing(baseline), "query_id", "left_anti")


def first_failures(results: DataFrame) -> DataFrame:
    """code, mode, query_id, cases: each failure of an experiment once, with the first mode and case that show it and how many do."""
    rows = results.select("mode", "query_id", F.explode("failures").alias("code"))
    first = rows.groupBy("code").agg(F.min(F.struct("mode", "query_id")).alias("first"), F.count(F.lit(1)).alias("cases"))
    return first.select("code", "first.mode", "first.query_id", "cases")
