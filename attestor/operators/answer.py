"""Whether hits support an answer, and the extractive answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.text import normalized_tokens, split_sentences, trimmed, truncate_chars

MIN_COVERAGE, MIN_MATCHES, CITATIONS = 0.5, 2, 3
#: The messages without an answer.
UNSUPPORTED = "Ranked candidates were found, but no chunk body directly supports this question."
NO_EVIDENCE = "Not enough local evidence was found in the indexed chunks."
NOT_INDEXED = "Embeddings are not indexed yet. Index local embeddings, then run this query again."


def required_matches(n: Column) -> Column:
    return F.when(n <= 1, n).otherwise(F.least(n, F.greatest(F.lit(MIN_MATCHES), F.ceil(n * MIN_COVERAGE).cast("int"))))


def sentence_scores(text: Column, terms: Column) -> Column:
    """Of each sentence: matched terms, whether it holds all terms with digits, its place and itself."""
    digits = F.filter(terms, lambda t: t.rlike("[0-9]"))

    def scored(s: Column, i: Column) -> Column:
        met = F.array_intersect(terms, normalized_tokens(s))
        return F.struct(F.size(met).alias("matched"), (F.size(F.array_except(digits, met)) == 0).alias("digits"), (-i).alias("back"), s.alias("text"))

    return F.transform(split_sentences(text), scored)


def assess(hits: DataFrame) -> DataFrame:
    """hits with matched_body, coverage, support_status, support_reason, and the snippet of supported hits replaced by the
    supporting sentence."""
    rows = hits.withColumn("_s", sentence_scores(F.col("text"), F.col("terms")))
    n = F.col("n_terms")
    best = F.coalesce(F.array_max(F.transform("_s", lambda s: s["matched"])), F.lit(0))
    fits = F.filter("_s", lambda s: (s["matched"] >= required_matches(n)) & (s["matched"] / n >= MIN_COVERAGE) & s["digits"])
    sentence = F.when(n > 0, F.array_max(fits)["text"])
    rows = rows.withColumns({"matched_body": best, "coverage": F.round(F.when(n > 0, best / n).otherwise(0.0), 6), "_sentence": sentence})
    heading = F.array_contains("hit_flags", "heading_only")
    weak = (F.col("strength") == "weak") | F.array_contains("hit_flags", "weak_evidence")
    supported = ~heading & ~weak & F.col("_sentence").isNotNull()
    section, path = F.col("section") > 0, F.col("path_score") > 0
    otherwise = (
        F.when(F.col("matched_body") > 0, "insufficient_body_overlap").when(F.col("semantic") > 0, "semantic_only_match").when(section & ~path, "section_only_match")
        .when(path & ~section, "path_only_match").when((section & path) | (F.col("metadata") > 0), "metadata_only_match").otherwise("insufficient_body_overlap")
    )
    reason = F.when(heading, "heading_only_evidence").when(weak, "weak_evidence").when(supported, "direct_body_support").otherwise(otherwise)
    return rows.withColumns({
        "support_status": F.when(supported, "supported").otherwise("unsupported"), "support_reason": reason,
        "snippet": F.when(supported, truncate_chars(trimmed(F.col("_sentence")), 280)).otherwise(F.col("snippet")),
    }).drop("_s", "_sentence")


def answers(queries: DataFrame, assessed: DataFrame, limit: int = CITATIONS, readiness: DataFrame | None = None) -> DataFrame:
    """query_id, status, answer, citations (chunk ids) of every query, with hits or without. readiness: (query_id, readiness); without an
    index the answer says so."""
    cited = assessed.where("support_status = 'supported'").withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("nth") <= limit)
    found = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "snippet", "label"))).alias("c"))
    counts = assessed.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    rows = queries.select("query_id").join(counts, "query_id", "left").join(found, "query_id", "left")
    rows = rows.join(readiness.select("query_id", "readiness"), "query_id", "left") if readiness is not None else rows.withColumn("readiness", F.lit(None).cast("string"))
    text = F.array_join(F.transform("c", lambda c: F.concat_ws(" ", c["snippet"], c["label"])), "\n")
    return rows.select(
        "query_id", F.when(F.col("c").isNotNull(), "answered").otherwise("insufficient_evidence").alias("status"),
        F.when(F.col("c").isNotNull(), text).when(F.col("readiness") == "missing", NOT_INDEXED).when(F.coalesce("hits", F.lit(0)) > 0, UNSUPPORTED).otherwise(NO_EVIDENCE).alias("answer"),
        F.coalesce(F.transform("c", lambda c: c["chunk_id"]), F.array().cast("array<string>")).alias("citations"), F.coalesce("hits", F.lit(0)).alias("hits"),
    )


def ensure_assessed(hits: DataFrame) -> DataFrame:
    """hits in which some come from older runs: those of a query with any hit not assessed are assessed again, all others
    stay as they are. Assessment columns may be null."""
    made = ("matched_body", "coverage", "support_status", "support_reason")
    old = hits.where(F.col("support_status").isNull()).select("query_id").distinct()
    again = assess(hits.join(old, "query_id", "left_semi").drop(*made))
    return hits.join(old, "query_id", "left_anti").select(*hits.columns).unionByName(again.select(*hits.columns))
