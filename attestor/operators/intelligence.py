"""Quality of documents and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.hashing import checksum
from attestor.functions.text import ascii_lower, detect_profile, document_warnings, extraction_quality, is_heading_only, normalize_for_duplicate, text_density, trimmed, word_count

TOO_SHORT, TOO_LONG, LOW_DENSITY, GOOD_TOKENS, GOOD_DENSITY, HEADING_WORDS = 4, 900, 0.45, 8, 0.55, 6


def analyze(docs: DataFrame) -> DataFrame:
    """docs (document_id, path, text) with checksum, byte_size, profile, extraction_quality and warnings."""
    text, words = F.col("text"), F.col("_words")
    return docs.withColumn("_words", word_count(text)).withColumns({
        "checksum": checksum(text), "byte_size": F.octet_length(text).cast("long"), "profile": detect_profile(text, F.col("path")),
        "extraction_quality": extraction_quality(text, words), "warnings": document_warnings(text, words),
    }).drop("_words")


def evidence_hint(flags: Column) -> Column:
    has = lambda flag, weight: F.when(F.array_contains(flags, flag), weight).otherwise(0.0)
    hint = F.lit(0.5) + has("good_evidence_candidate", 0.35) - has("heading_only", 0.35) - has("duplicate", 0.1) - has("low_text_density", 0.15)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), hint)), 6)


def annotate_quality(chunks: DataFrame) -> DataFrame:
    """chunks with checksum, text_density, is_duplicate (equal normalized text in the same document), quality_flags and
    evidence_score_hint. token_count is the number of the text's words."""
    text, tokens, density, section = F.col("text"), F.col("token_count"), F.col("text_density"), F.col("section_title")
    # Longer chunks can only be headings where they are their section's title.
    heading = F.when(tokens <= HEADING_WORDS, is_heading_only(text, section)).when(section.isNull(), False).otherwise(F.coalesce(ascii_lower(trimmed(text)) == ascii_lower(trimmed(section)), F.lit(False)))
    rows = chunks.withColumns({"checksum": checksum(text), "text_density": F.round(text_density(text), 6), "_heading": heading})
    rows = rows.withColumn("is_duplicate", F.count(F.lit(1)).over(Window.partitionBy("document_id", F.md5(normalize_for_duplicate(text)))) > 1)
    flags = F.array_sort(F.array_compact(F.array(
        F.when(F.col("_heading"), F.lit("heading_only")), F.when(tokens <= TOO_SHORT, F.lit("too_short")), F.when(tokens >= TOO_LONG, F.lit("too_long")),
        F.when(F.col("is_duplicate"), F.lit("duplicate")), F.when(density < LOW_DENSITY, F.lit("low_text_density")),
        F.when((tokens >= GOOD_TOKENS) & ~F.col("_heading") & (density >= GOOD_DENSITY), F.lit("good_evidence_candidate")),
    )))
    rows = rows.withColumn("quality_flags", flags).drop("_heading")
    return rows.withColumn("evidence_score_hint", evidence_hint(F.col("quality_flags")))
