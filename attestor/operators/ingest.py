"""Files to documents: admission, kind, text, failures as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.functions.text import clean_file_name, file_kind, html_to_text, mime_type

MAX_FILES, MAX_BYTES, MAX_TOTAL = 10, 20 * 2**20, 50 * 2**20

#: Failure codes and what they say.
MESSAGES = {
    "unsupported_file_type": "The file type is not supported.", "invalid_utf8": "The file is not valid UTF-8 text.", "pdf_extraction_failed": "No text could be extracted from the PDF.",
    "empty_extracted_text": "The file holds no text.", "file_too_large": "The file is larger than allowed.", "too_many_files": "The request holds too many files.", "request_too_large": "The request is larger than allowed.",
}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """file_name, content_type, content, length of the files under a path."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(clean_file_name(F.col("path")).alias("file_name"), F.lit(None).cast("string").alias("content_type"), "content", "length")


def admit(files: DataFrame, request: str = "request_id", order: str = "position") -> DataFrame:
    """files with a failure code where a request exceeds its limits: number of files, bytes of a file, bytes in all."""
    w = Window.partitionBy(request).orderBy(order)
    total = F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0))
    code = F.when(F.row_number().over(w) > MAX_FILES, "too_many_files").when(F.col("length") > MAX_BYTES, "file_too_large").when(total > MAX_TOTAL, "request_too_large")
    return files.withColumn("failure", code)


def extract(files: DataFrame) -> DataFrame:
    """files (file_name, content_type, content) with kind, mime_type, text and failure; a bad file is a row, not an error."""
    kind = file_kind(F.col("file_name"), F.col("content_type"))
    rows = files.withColumns({"kind": kind, "mime_type": mime_type(F.col("file_name"), F.col("content_type")), "_utf8": F.try_validate_utf8(F.col("content").cast("string"))})
    text = F.when(F.col("kind").isin("text", "markdown"), F.col("_utf8")).when(F.col("kind") == "html", html_to_text(F.col("_utf8")))
    rows = rows.withColumn("text", text)
    failure = (
        F.when(F.col("kind").isNull(), "unsupported_file_type").when(F.col("kind") == "pdf", "pdf_extraction_failed").when(F.col("_utf8").isNull(), "invalid_utf8")
        .when(~F.col("text").rlike("\\S"), "empty_extracted_text")
    )
    if "failure" in files.columns:
        failure = F.coalesce(F.col("failure"), failure)
    return rows.withColumn("failure", failure).withColumn("text", F.when(F.col("failure").isNull(), F.col("text"))).drop("_utf8", "content")


def failure_message(code):
    return F.element_at(F.create_map(*[x for k, v in MESSAGES.items() for x in (F.lit(k), F.lit(v))]), code)
