"""Reports: evidence by privacy, experiment evidence labels, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.text import bounded_snippet, escape_markdown, exportable_context, humanize
from attestor.operators.diagnosis import RECOMMENDATIONS
from attestor.operators.evals import compare_modes, gate, newly_failed, regression
from attestor.sources.scratch import stored

PRIVACY = ("metadata_only", "snippets_allowed", "full_local_only")


def private_snippet(text: Column, privacy: str) -> Column:
    """Nothing, at most 280 characters, or the whole text."""
    if privacy not in PRIVACY:
        raise ValueError(f"unknown privacy mode {privacy}")
    if privacy == "metadata_only":
        return F.lit(None).cast("string")
    return bounded_snippet(text) if privacy == "snippets_allowed" else text


def evidence(hits: DataFrame, privacy: str) -> DataFrame:
    return hits.select("query_id", F.concat(F.lit("E"), F.col("rank").cast("string")).alias("label"), "chunk_id", "path", "score", "strength", private_snippet(F.col("text"), privacy).alias("snippet"))


def evidence_catalogue(hits: DataFrame) -> DataFrame:
    """Distinct chunks of an experiment, labelled E1, E2 … by first appearance (mode, case, rank). First appearances are dealt by
    ranges and numbered inside each; a row for each range says how many stand before it."""
    first = hits.groupBy("chunk_id").agg(F.min(F.struct("mode", "query_id", "rank")).alias("first"))
    ranged = stored(first.repartitionByRange("first", "chunk_id").withColumn("part", F.spark_partition_id()), "first-appearances")
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each range
    nth = F.row_number().over(Window.partitionBy("part").orderBy("first", "chunk_id"))
    return ranged.join(F.broadcast(before), "part").select("chunk_id", F.concat(F.lit("E"), (F.col("before") + nth).cast("string")).alias("label"))


#: What a report advises for labels without a diagnosis: code, priority (0 critical to 2 medium), area, title, labels.
FALLBACKS = (
    ("expand_corpus_coverage", 0, "corpus_coverage", "Restore the missing evidence", ("missing_document", "expected_evidence_missing")),
    ("repair_embedding_index", 0, "embeddings", "Repair embedding coverage", ("missing_embedding_index", "missing_embeddings", "bad_embedding")),
    ("improve_chunk_boundaries", 1, "chunking", "Improve chunk boundaries and deduplication", ("bad_chunking", "correct_document_wrong_chunk", "duplicate_evidence", "heading_only_evidence")),
    ("tune_ranking", 1, "reranking", "Tune ranking precision", ("bad_ranking", "low_precision")),
    ("review_top_k_and_coverage", 2, "top_k", "Review top-k and evidence coverage", ("weak_evidence",)),
    ("repair_citation_grounding", 0, "citations", "Repair citation grounding", ("missing_citations", "hallucinated_answer")),
    ("clarify_query_contract", 2, "other", "Clarify the query contract", ("bad_prompt", "unsupported_question")),
)


def fallback_recommendations(labels: DataFrame, key: str) -> DataFrame:
    """key, code, priority, area, title, finding_codes: advice for rows (key, label), one a code, with the labels that led to it.
    Labels without advice give none. The lookup has a row for each label and goes to every task."""
    pairs = [(label, code, priority, area, title) for code, priority, area, title, names in FALLBACKS for label in names]
    advice = F.broadcast(labels.sparkSession.createDataFrame(pairs, "label string, code string, priority int, area string, title string"))
    return labels.select(key, "label").distinct().join(advice, "label").groupBy(key, "code", "priority", "area", "title").agg(F.array_sort(F.collect_list("label")).alias("finding_codes"))


def _items(results: DataFrame, summaries: DataFrame) -> DataFrame:
    """The rows of an experiment's report before they are numbered."""
    failed = results.select("mode", "query_id", F.explode("failures").alias("label"))
    found = failed.groupBy("label").agg(F.count(F.lit(1)).alias("cases"), F.min(F.struct("mode", "query_id")).alias("first"))
    findings = found.select(F.lit("findings").alias("section"), F.col("label").alias("code"), F.format_string("first in %s, case %s", "first.mode", F.col("first.query_id").cast("string")).alias("detail"), F.lit(1).alias("priority"), "cases")
    advice = fallback_recommendations(found.select(F.lit(1).alias("report"), "label"), "report").select(F.lit("recommendations").alias("section"), "code", F.col("title").alias("detail"), "priority", F.size("finding_codes").cast("long").alias("cases"))
    best = compare_modes(summaries).where("modes > 1 AND recall_delta > 0")
    mode = best.select(F.lit("recommendations").alias("section"), F.lit("use_best_retrieval_mode").alias("code"), F.format_string("Validate %s as the preferred retrieval mode", "best_mode").alias("detail"), F.lit(2).alias("priority"), F.lit(1).cast("long").alias("cases"))
    return findings.unionByName(advice).unionByName(mode)


def _numbered(rows: DataFrame) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("section").orderBy("priority", "code"))  # a row for each failure label or piece of advice
    return rows.select("section", nth.alias("ordinal"), "code", "detail", "cases")


def experiment_report(results: DataFrame, summaries: DataFrame) -> DataFrame:
    """section, ordinal, code, detail, cases: an experiment's findings (each failure once, with its number of cases and the first),
    the comparison of its modes, and recommendations by priority."""
    return _numbered(_items(results, summaries))


#: The finding of a comparison with a baseline, and what is advised where cases fail anew.
REGRESSION, REVIEW, REVIEW_TITLE = "ci_regression", "review_ci_regression", "Review newly failing CI cases"


def regression_sentence(deltas: DataFrame) -> Column:
    """What a row of regression() says in one sentence."""
    return F.format_string("Recall %+.2f, precision %+.2f, MRR %+.2f, p95 latency %+d ms.", deltas["recall_delta"], deltas["precision_delta"], deltas["mrr_delta"], deltas["latency_delta"])


def ci_report(results: DataFrame, summaries: DataFrame, baseline: DataFrame | None = None, baseline_results: DataFrame | None = None, run: dict[str, str | None] | None = None) -> DataFrame:
    """The experiment's report with its gate and what is known of the run (config_label, branch, commit_sha, as far as given). With a baseline (summaries, and results with failures for cases
    that fail anew) also the changes of the best mode, the finding that tells of them, and advice where cases fail anew: both stand last in their sections."""
    spark = results.sparkSession
    status = gate(summaries)
    none = F.lit(None).cast("long")
    row = lambda d, section, code, detail, order=1, cases=none: d.select(F.lit(section).alias("section"), F.lit(code).alias("code"), detail.alias("detail"), F.lit(order).alias("priority"), cases.alias("cases"))
    gated = status.select(F.lit("gate").alias("section"), F.col("status").alias("code"), F.array_join("reasons", ",").alias("detail"), F.lit(1).alias("priority"), none.alias("cases"))
    rows = _items(results, summaries).unionByName(gated).unionByName(row(status, "context", "ci_gate_status", F.col("status")))
    known = [(f"ci_{k}", v) for k, v in (run or {}).items() if v is not None]
    if known:
        rows = rows.unionByName(spark.createDataFrame(known, "code string, detail string").select(F.lit("context").alias("section"), "code", "detail", F.lit(1).alias("priority"), none.alias("cases")))
    if baseline is not None:
        before = baseline_results if baseline_results is not None else results.limit(0)
        lost = newly_failed(before, results).agg(F.count(F.lit(1)).alias("lost"))
        change = stored(regression(baseline, summaries).join(lost), "regression")  # two single rows
        for name, value in (("recall", F.format_string("%.3f", "recall_delta")), ("precision", F.format_string("%.3f", "precision_delta")), ("mrr", F.format_string("%.3f", "mrr_delta")), ("latency", F.col("latency_delta").cast("string"))):
            rows = rows.unionByName(row(change, "context", f"ci_{name}_delta" + ("_ms" if name == "latency" else ""), value))
        rows = rows.unionByName(row(change, "context", "ci_newly_failed_case_count", F.col("lost").cast("string")))
        rows = rows.unionByName(row(change, "findings", REGRESSION, regression_sentence(change), 9, F.col("lost")))
        rows = rows.unionByName(row(change.where("lost > 0"), "recommendations", REVIEW, F.lit(REVIEW_TITLE), 9, F.lit(1).cast("long")))
    return _numbered(rows)


def report_context(hits: DataFrame, mode: str) -> DataFrame:
    """query_id and a map of what a report may say of its run; keys that name private content are left out."""
    sums = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"), F.max("query").alias("query"))
    entries = F.create_map(F.lit("retrieval_mode"), F.lit(mode), F.lit("hit_count"), F.col("n").cast("string"), F.lit("top_score"), F.format_string("%.3f", "top"), F.lit("query_text"), F.col("query"))
    return sums.select("query_id", exportable_context(entries).alias("context"))


#: The sections of a report, and what it says of its privacy.
SECTIONS = (
    "Executive Summary", "Deterministic Diagnosis", "Report Source and Privacy Classification", "System and Configuration Snapshot", "Failing Queries or Cases", "Evidence Diagnosis",
    "Failure Labels", "Rerun, Experiment, and Regression Changes", "Prioritized Recommendations", "Privacy and Sharing Note",
)
NOTES = {
    "metadata_only": "This export is classified `metadata_only`. Query text, document paths, section titles, and evidence snippets are omitted. Review identifiers and operational metadata before sharing outside the workspace.",
    "snippets_allowed": "This export is classified `snippets_allowed`. It may contain explicitly approved query or case text, document labels, section titles, and evidence snippets capped at 280 characters. Review every included snippet before sharing.",
}
EXCLUDED = "Original uploaded binaries, complete documents, embedding vectors, credentials, and session data are not included."


def _lines(items: Column, none: str, head: str = "", gap: str = "\n") -> Column:
    """The items below each other under a head, or what stands where there are none."""
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.concat(F.lit(head), F.array_join(items, gap))).otherwise(none)


def _table(first: str, second: str) -> str:
    return f"| {first} | {second} |\n| --- | --- |\n"


def _row(name: Column, value: Column) -> Column:
    return F.concat(F.lit("| "), escape_markdown(name), F.lit(" | "), escape_markdown(value), F.lit(" |"))


def markdown(diagnosed: DataFrame, found: DataFrame, privacy: str, context: DataFrame | None = None, changes: DataFrame | None = None, subjects: DataFrame | None = None) -> DataFrame:
    """query_id, markdown: a report of each diagnosed query. context (query_id, context) is a map of settings, changes (query_id,
    score_delta, overlap, changed_rank) what a rerun changed, subjects (query_id, query) the questions, shown only where snippets
    are. full_local_only is not exported."""
    if privacy == "full_local_only":
        raise ValueError("full_local_only reports are not exported")
    open_text = privacy == "snippets_allowed"
    lines = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.substring("label", 2, 9).cast("int").alias("n"), "label", "path", "score", "strength", "chunk_id", "snippet"))).alias("e"))
    rows = diagnosed.join(lines, "query_id", "left")
    for given, columns in ((context, {"context": "map<string,string>"}), (changes, {"score_delta": "double", "overlap": "long", "changed_rank": "long"}), (subjects, {"query": "string"})):
        if given is None:
            rows = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items()})
        else:
            rows = rows.join(given.select("query_id", *columns), "query_id", "left")
    code = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    settings = F.transform(F.array_sort(F.map_entries("context")), lambda x: _row(humanize(x["key"]), x["value"]))
    failures = F.transform("failures", lambda f, i: F.concat(
        F.lit("### "), (i + 1).cast("string"), F.lit(". "), humanize(f["code"]), F.lit("\n\n- **Finding code:** "), code(f["code"]),
        F.lit("\n- **Severity:** "), F.when(f["severity"] == 0, "critical").otherwise("warning"),
        F.when(F.size(f["refs"]) > 0, F.concat(F.lit("\n- **Evidence references:** "), F.array_join(F.transform(f["refs"], escape_markdown), ", "))).otherwise(""),
    ))
    subject = F.concat(F.lit("**Report subject:** "), escape_markdown(F.coalesce("query", F.lit("")))) if open_text else F.lit("Query and case content is omitted by the `metadata_only` privacy policy.")
    shown = F.transform("e", lambda e: F.concat(
        F.lit("### "), e["label"], F.lit("\n\n" + _table("Evidence field", "Value")), _row(F.lit("Rank"), e["n"].cast("string")), F.lit("\n"), _row(F.lit("Chunk ID"), e["chunk_id"]), F.lit("\n"),
        _row(F.lit("Score"), F.format_string("%.3f", e["score"])), F.lit("\n"), _row(F.lit("Evidence strength"), e["strength"]),
        F.concat(F.lit("\n"), _row(F.lit("Document path"), e["path"])) if open_text else F.lit(""),
        F.when(e["snippet"].isNotNull(), F.concat(F.lit("\n\n**Approved snippet:** "), escape_markdown(e["snippet"]))).otherwise(""),
    ))
    changed = F.when(F.col("overlap").isNotNull(), F.array(
        _row(F.lit("score delta"), F.format_string("%.3f", "score_delta")), _row(F.lit("overlap"), F.col("overlap").cast("string")), _row(F.lit("changed rank"), F.col("changed_rank").cast("string")),
    ))
    advice = {name: F.create_map(*[x for c, values in RECOMMENDATIONS.items() for x in (F.lit(c), F.lit(str(values[at])))]) for at, name in enumerate(("priority", "area", "title"))}
    level = lambda c: F.when(F.element_at(advice["priority"], c) == "0", "critical").when(F.element_at(advice["priority"], c) == "1", "high").otherwise("medium")
    remedies = F.transform("recommendations", lambda c, i: F.concat(
        F.lit("### "), (i + 1).cast("string"), F.lit(". "), F.element_at(advice["title"], c), F.lit("\n\n- **Priority:** "), level(c), F.lit("\n- **Area:** "), humanize(F.element_at(advice["area"], c)),
        F.lit("\n- **Recommendation code:** "), code(c),
    ))
    issue = F.when(F.col("primary_issue").isNotNull(), F.concat(F.lit("\n"), _row(F.lit("Primary issue"), F.col("primary_issue")))).otherwise("")
    name = F.col("query_id").cast("string")
    parts = (
        escape_markdown(F.col("summary")), F.concat(F.lit(_table("Diagnosis field", "Value")), _row(F.lit("Outcome"), F.col("outcome")), issue, F.lit("\n"), _row(F.lit("Hits"), F.col("hits").cast("string"))),
        F.concat(F.lit(_table("Field", "Value")), _row(F.lit("Source type"), F.lit("trace")), F.lit("\n"), _row(F.lit("Source reference"), name), F.lit(f"\n| Privacy mode | `{privacy}` |")),
        _lines(settings, "No configuration metadata was recorded.", _table("Configuration", "Value")),
        F.concat(subject, F.lit("\n\n"), _lines(failures, "No deterministic failure findings were recorded.", gap="\n\n")), _lines(shown, "No evidence references were available for this report.", gap="\n\n"),
        _lines(F.transform("labels", lambda c: F.concat(F.lit("- "), code(c))), "No failure labels were recorded."),
        _lines(changed, "No rerun, mode-comparison, or regression change was recorded.", _table("Change signal", "Value")),
        _lines(remedies, "No remediation recommendation was generated.", gap="\n\n"), F.lit(f"{NOTES[privacy]}\n\n{EXCLUDED}"),
    )
    body = F.concat_ws("\n\n", F.concat(F.lit("# Retrieval report "), name), *[F.concat(F.lit(f"## {title}\n\n"), part) for title, part in zip(SECTIONS, parts, strict=True)])
    return rows.select("query_id", F.concat(body, F.lit("\n")).alias("markdown"))
