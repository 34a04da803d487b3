"""Deterministic diagnosis of retrieval runs: one row for each query, with its failures in a fixed order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Failure codes in their order, with title, recommendation and legacy labels.
FAILURES = (
    ("missing_document", "No evidence retrieved", "restore_corpus_coverage", ("missing_document",)),
    ("missing_embedding_index", "Embedding index missing", "repair_embedding_index", ("missing_embedding_index", "bad_embedding")),
    ("missing_expected_evidence", "Expected evidence was not retrieved", "review_expected_evidence_filters", ()),
    ("answerability_gap", "Retrieved candidates cannot support an answer", "restore_direct_answer_support", ("unsupported_question",)),
    ("citation_missing", "Answer has no citations", "repair_citation_grounding", ()),
    ("weak_evidence", "Evidence is too weak", "broaden_candidate_pool", ("weak_evidence", "bad_ranking")),
    ("partial_embedding_index", "Embedding index incomplete", "repair_embedding_index", ("bad_embedding",)),
    ("semantic_only_match", "Semantic similarity lacks direct support", "tighten_semantic_candidates", ("bad_ranking",)),
    ("metadata_only_match", "Metadata matched without body support", "separate_metadata_from_answer_evidence", ("bad_ranking",)),
    ("duplicate_evidence", "Duplicate evidence crowded the ranking", "improve_chunk_boundaries", ("duplicate_evidence", "bad_chunking")),
    ("heading_only_evidence", "Heading-only evidence ranked", "improve_chunk_boundaries", ("heading_only_evidence", "bad_chunking")),
    ("low_score_margin", "Top results are difficult to distinguish", "add_reranking", ("bad_ranking",)),
    ("vector_lexical_disagreement", "Vector and lexical signals disagree", "compare_retrieval_modes", ("bad_ranking",)),
    ("top_result_not_cited", "Top-ranked evidence was not cited", "repair_citation_grounding", ()),
)
ORDER = {code: i for i, (code, *_) in enumerate(FAILURES)}
#: Recommendation codes with priority (0 critical, 1 high, 2 medium), area and title.
RECOMMENDATIONS = {
    "restore_corpus_coverage": (0, "corpus_coverage", "Restore corpus coverage"),
    "restore_direct_answer_support": (0, "corpus_coverage", "Restore direct answer support"),
    "tighten_semantic_candidates": (1, "retrieval_mode", "Tighten semantic candidate selection"),
    "separate_metadata_from_answer_evidence": (1, "metadata_filters", "Separate metadata from answer evidence"),
    "review_expected_evidence_filters": (0, "metadata_filters", "Review expected evidence and filters"),
    "repair_embedding_index": (1, "embeddings", "Repair the embedding index"),
    "broaden_candidate_pool": (1, "top_k", "Broaden the candidate pool"),
    "improve_chunk_boundaries": (1, "chunking", "Improve chunk boundaries"),
    "add_reranking": (2, "reranking", "Add a reranking stage"),
    "compare_retrieval_modes": (2, "retrieval_mode", "Compare retrieval modes"),
    "repair_citation_grounding": (0, "citations", "Repair citation grounding"),
}
#: Why each recommendation is given and what it advises.
REASONS = {
    "restore_corpus_coverage": ("No usable evidence was available for the query.", "Confirm the required source is ingested, extracted successfully, and included by the active filters."),
    "restore_direct_answer_support": (
        "Retrieved candidates do not contain body text that directly supports the question.",
        "Add or select source content that explicitly answers the question, then preserve the unsupported query as an eval case.",
    ),
    "tighten_semantic_candidates": (
        "Semantic similarity promoted candidates without direct body-text support.",
        "Compare lexical and hybrid modes, then tune semantic candidate thresholds against an eval case for this question.",
    ),
    "separate_metadata_from_answer_evidence": (
        "Path, section, or metadata relevance was mistaken for answer support.",
        "Keep metadata signals for candidate retrieval, but require matching chunk body evidence before citation.",
    ),
    "review_expected_evidence_filters": (
        "The eval case expected evidence that did not appear in the ranking.", "Verify corpus coverage and metadata filters, then rerun the case with a larger candidate set."
    ),
    "repair_embedding_index": ("Semantic retrieval did not have complete embedding coverage.", "Index missing or stale chunks with the configured model before comparing retrieval modes."),
    "broaden_candidate_pool": ("The current result set does not contain strong enough evidence.", "Increase top_k and inspect whether stronger evidence appears before changing answer generation."),
    "improve_chunk_boundaries": ("Chunk quality reduced evidence diversity or completeness.", "Rechunk the affected documents and prevent heading-only or duplicate chunks from entering the index."),
    "add_reranking": ("The top candidates are too close for the baseline scorer to separate confidently.", "Rerank the candidate set and add an eval case that checks the expected top result."),
    "compare_retrieval_modes": ("Semantic and lexical signals disagree about the strongest evidence.", "Rerun lexical, vector, and hybrid modes and preserve the best behavior in Eval Lab."),
    "repair_citation_grounding": (
        "The evidence summary is not fully grounded in the ranked evidence.", "Require cited evidence for every answer claim and reject summaries without usable citations."
    ),
}
MARGIN = 0.10
SIGNALS = ("semantic", "lexical", "phrase", "section", "path_score", "metadata")


def evidence_ref(rank: Column) -> Column:
    return F.concat(F.lit("E"), rank.cast("string"))


def dominant_signal() -> Column:
    """The first of the largest signals in the fixed order; none where all are 0."""
    most = F.greatest(*SIGNALS)
    out = F.lit("none")
    for name in reversed(SIGNALS):
        out = F.when((F.col(name) == most) & (most > 0), name.removesuffix("_score")).otherwise(out)
    return out


def score_explanations(hits: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("rank")
    return hits.select(
        "query_id", "rank", "chunk_id", evidence_ref(F.col("rank")).alias("evidence_ref"), "score", F.round(F.lag("score").over(w) - F.col("score"), 6).alias("from_previous"),
        F.round(F.col("score") - F.lead("score").over(w), 6).alias("to_next"), dominant_signal().alias("dominant_signal"),
    )


def refs(condition: Column) -> Column:
    """The references of the hits that meet a condition, by rank."""
    ranked = F.array_sort(F.collect_list(F.when(condition, F.col("rank"))))
    return F.transform(ranked, evidence_ref)


def diagnose(queries: DataFrame, assessed: DataFrame, answers: DataFrame, mode: str, readiness: DataFrame | None = None, expected: DataFrame | None = None) -> DataFrame:
    """query_id, outcome, failures (severity, order, code, refs), primary_issue, summary, labels, recommendations.

    readiness: (query_id, readiness) of the index for each query; expected: (query_id, chunk_ids, document_ids). Queries without hits get a row too.
    """
    reason, first = F.col("support_reason"), F.col("rank") == 1
    lexical = F.col("lexical") + F.col("phrase") + F.col("section") + F.col("path_score") + F.col("metadata")
    groups = assessed.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("support_status") == "supported").alias("supported"), refs(F.lit(True)).alias("all_refs"),
        refs(reason == "semantic_only_match").alias("semantic_refs"), refs(reason.isin("metadata_only_match", "path_only_match", "section_only_match")).alias("metadata_refs"),
        refs(F.col("strength") == "weak").alias("weak_refs"), F.max(F.when(first, F.col("strength"))).alias("top_strength"),
        refs((F.col("duplicate_count") > 1) | F.array_contains("hit_flags", "duplicate")).alias("duplicate_refs"), refs(F.array_contains("hit_flags", "heading_only")).alias("heading_refs"),
        F.max(F.when(first, F.col("score"))).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"),
        F.max_by("rank", F.when(F.col("semantic") > 0, F.struct("semantic", -F.col("rank")))).alias("semantic_lead"),
        F.max_by("rank", F.when(lexical > 0, F.struct(lexical.alias("l"), -F.col("rank")))).alias("lexical_lead"),
        F.coalesce(F.min(F.when(F.col("support_status") == "supported", F.col("rank"))), F.lit(1)).alias("answer_rank"),
        F.min_by("chunk_id", F.struct(F.col("support_status") != "supported", F.col("rank"))).alias("answer_chunk"),
        F.collect_set("chunk_id").alias("chunk_ids"), F.collect_set("document_id").alias("document_ids"),
    )
    rows = queries.select("query_id").join(groups, "query_id", "left").join(answers.select("query_id", "status", "citations"), "query_id", "left")
    rows = rows.join(readiness.select("query_id", "readiness"), "query_id", "left") if readiness is not None else rows.withColumn("readiness", F.lit("not_required"))
    if expected is not None:
        rows = rows.join(expected.select("query_id", F.col("chunk_ids").alias("want_chunks"), F.col("document_ids").alias("want_documents")), "query_id", "left")
    none = F.array().cast("array<string>")
    has, state = F.coalesce("n", F.lit(0)) > 0, F.coalesce("readiness", F.lit("not_required"))

    def failure(code: str, condition: Column, severity: Column | int = 1, evidence: Column | None = None) -> Column:
        level = F.lit(severity) if isinstance(severity, int) else severity
        made = F.struct(level.alias("severity"), F.lit(ORDER[code]).alias("order"), F.lit(code).alias("code"), F.coalesce(evidence if evidence is not None else none, none).alias("refs"))
        return F.when(condition, made)

    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    two = F.array(evidence_ref(F.lit(1)), evidence_ref(F.lit(2)))
    answered = (F.col("status") == "answered") & has
    found = [
        failure("missing_document", ~has & (state != "missing"), 0), failure("missing_embedding_index", state == "missing", 0), failure("partial_embedding_index", state == "partial"),
        failure("answerability_gap", has & (F.col("supported") == 0), 0, F.col("all_refs")), failure("semantic_only_match", some("semantic_refs"), 1, F.col("semantic_refs")),
        failure("metadata_only_match", some("metadata_refs"), 1, F.col("metadata_refs")), failure("weak_evidence", some("weak_refs"), F.when(F.col("top_strength") == "weak", 0).otherwise(1), F.col("weak_refs")),
        failure("duplicate_evidence", some("duplicate_refs"), 1, F.col("duplicate_refs")), failure("heading_only_evidence", some("heading_refs"), 1, F.col("heading_refs")),
        failure("low_score_margin", F.col("s2").isNotNull() & (F.col("s1") > 1.2e-7) & (F.greatest(F.lit(0.0), F.round(F.try_divide(F.col("s1") - F.col("s2"), F.col("s1")), 9)) <= MARGIN), 1, two),
        failure("citation_missing", answered & (F.size("citations") == 0), 0, F.array(F.lit("E1"))),
        failure("top_result_not_cited", answered & (F.size("citations") > 0) & ~F.coalesce(F.array_contains(F.col("citations"), F.col("answer_chunk")), F.lit(True)), 1, F.array(evidence_ref(F.col("answer_rank")))),
    ]
    if mode == "hybrid":
        leads = F.array(evidence_ref(F.col("semantic_lead")), evidence_ref(F.col("lexical_lead")))
        found.append(failure("vector_lexical_disagreement", F.col("semantic_lead") != F.col("lexical_lead"), 1, leads))
    if expected is not None:
        lost = F.concat(
            F.transform(F.array_except("want_chunks", F.coalesce("chunk_ids", none)), lambda c: F.concat(F.lit("chunk:"), c)),
            F.transform(F.array_except("want_documents", F.coalesce("document_ids", none)), lambda d: F.concat(F.lit("document:"), d)),
        )
        everything = F.size(lost) == F.size("want_chunks") + F.size("want_documents")
        found.append(failure("missing_expected_evidence", some(lost), F.when(everything, 0).otherwise(1), lost))
    rows = rows.withColumn("failures", F.array_sort(F.array_compact(F.array(*found))))
    critical = lambda *codes: F.exists("failures", lambda f: (f["severity"] == 0) & f["code"].isin(*codes))
    outcome = (
        F.when(critical("missing_document", "missing_embedding_index", "missing_expected_evidence", "answerability_gap"), "failing").when(critical("weak_evidence", "citation_missing"), "weak")
        .when((F.size("failures") > 0) | (F.coalesce("top_strength", F.lit("strong")) != "strong"), "mixed").otherwise("strong")
    )
    codes = F.transform("failures", lambda f: f["code"])
    rows = rows.withColumns({"outcome": outcome, "codes": codes, "primary_issue": F.get("failures", F.lit(0))["code"], "hits": F.coalesce("n", F.lit(0))})
    title = reduce(lambda c, f: F.when(F.col("primary_issue") == f[0], f[1]).otherwise(c), FAILURES, F.lit(None).cast("string"))
    # The sentences of a summary.
    strong = F.format_string("This run looks strong. %d ranked evidence item(s) were found without a deterministic failure signal.", "hits")
    rows = rows.withColumn("summary", F.when(title.isNotNull(), F.concat(F.lit("This run looks "), F.col("outcome"), F.lit(". Primary issue: "), title)).otherwise(strong))
    return rows.select("query_id", "hits", "outcome", "primary_issue", "codes", "failures", "summary", legacy_labels(codes).alias("labels"), recommendation_codes(F.col("failures")).alias("recommendations"))


def legacy_labels(codes: Column) -> Column:
    """Labels of failure codes in their order, each once."""
    lookup = F.create_map(*[x for code, _, _, labels in FAILURES for x in (F.lit(code), F.array(*map(F.lit, labels)) if labels else F.array().cast("array<string>"))])
    return F.array_distinct(F.flatten(F.transform(codes, lambda c: F.element_at(lookup, c))))


def recommendation_codes(failures: Column) -> Column:
    """Recommendation codes by priority and name, those of several failures merged. A missing index raises its repair."""
    lookup = F.create_map(*[x for code, _, advice, _ in FAILURES for x in (F.lit(code), F.struct(F.lit(RECOMMENDATIONS[advice][0]).alias("priority"), F.lit(advice).alias("code")))])
    advice = F.transform(failures, lambda f: F.when(f["code"] == "missing_embedding_index", F.struct(F.lit(0).alias("priority"), F.lit("repair_embedding_index").alias("code"))).otherwise(F.element_at(lookup, f["code"])))
    first = F.aggregate(advice, F.array().cast("array<struct<priority:int,code:string>>"), lambda acc, a: F.when(F.exists(acc, lambda x: x["code"] == a["code"]), acc).otherwise(F.array_append(acc, a)))
    return F.transform(F.array_sort(first), lambda a: a["code"])


def recommendations(diagnosed: DataFrame) -> DataFrame:
    """A row for each recommendation of each diagnosed query: place (from 1, by priority and code), code, priority, area, title, rationale, action, and failure_codes
    and evidence_refs of all failures that lead to it, each once in the order of the failures. The first of them sets the priority.
    The catalogue has a row for each failure code and goes to every task."""
    catalogue = [(code, advice, 0 if code == "missing_embedding_index" else RECOMMENDATIONS[advice][0], *RECOMMENDATIONS[advice][1:], *REASONS[advice]) for code, _, advice, _ in FAILURES]
    named = F.broadcast(diagnosed.sparkSession.createDataFrame(catalogue, "failure string, code string, priority int, area string, title string, rationale string, action string"))
    rows = diagnosed.select("query_id", F.posexplode("failures").alias("at", "f")).select("query_id", "at", F.col("f.code").alias("failure"), F.col("f.refs").alias("refs")).join(named, "failure")
    held = F.sort_array(F.collect_list(F.struct("at", "failure", "refs", "priority")))  # at most one entry for each failure code
    merged = rows.groupBy("query_id", "code", "area", "title", "rationale", "action").agg(held.alias("h"))
    merged = merged.select(
        "query_id", "code", F.get("h", F.lit(0))["priority"].alias("priority"), "area", "title", "rationale", "action", F.array_distinct(F.transform("h", lambda x: x["failure"])).alias("failure_codes"),
        F.array_distinct(F.flatten(F.transform("h", lambda x: x["refs"]))).alias("evidence_refs"),
    )
    return merged.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("priority", "code")))


def compare_diagnoses(before: DataFrame, after: DataFrame) -> DataFrame:
    """query_id, resolved and introduced codes in their order, and whether the outcome improved."""
    rank = lambda c: F.when(c == "failing", 0).when(c == "weak", 1).when(c == "mixed", 2).otherwise(3)
    rows = before.select("query_id", F.col("codes").alias("old"), F.col("outcome").alias("was")).join(after.select("query_id", F.col("codes").alias("new"), F.col("outcome").alias("now")), "query_id")
    return rows.select("query_id", F.array_except("old", "new").alias("resolved"), F.array_except("new", "old").alias("introduced"), F.signum(rank(F.col("now")) - rank(F.col("was"))).cast("int").alias("direction"))


def compare_reruns(before: DataFrame, after: DataFrame) -> DataFrame:
    """query_id, score_delta of the tops, overlap, changed_rank: hits of both runs (query_id, rank, chunk_id, score)."""
    old, new = (d.select("query_id", "chunk_id", F.col("rank").alias(f"{p}_rank"), F.col("score").alias(f"{p}_score")) for d, p in ((before, "old"), (after, "new")))
    both = old.join(new, ["query_id", "chunk_id"], "full_outer")
    return both.groupBy("query_id").agg(
        F.round(F.coalesce(F.max("new_score"), F.lit(0.0)) - F.coalesce(F.max("old_score"), F.lit(0.0)), 6).alias("score_delta"),
        F.count_if(F.col("old_rank").isNotNull() & F.col("new_rank").isNotNull()).alias("overlap"), F.count_if(F.col("old_rank") != F.col("new_rank")).alias("changed_rank"),
        F.array_sort(F.collect_list(F.when(F.col("old_rank").isNull(), F.col("chunk_id")))).alias("gained"), F.array_sort(F.collect_list(F.when(F.col("new_rank").isNull(), F.col("chunk_id")))).alias("lost"),
    )


def strongest_evidence(hits: DataFrame, queries: DataFrame) -> DataFrame:
    rank = F.when(F.col("strength") == "strong", 0).when(F.col("strength") == "medium", 1).otherwise(2)
    best = hits.groupBy("query_id").agg(F.min_by("strength", rank).alias("best"))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("best", F.lit("weak")).alias("strongest"))
