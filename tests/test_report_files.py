"""One file a report, and nothing of failed attempts."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from attestor.sources.report_files import ReportFiles, file_of


def files(root):
    return {n: open(os.path.join(root, n), newline="").read() for n in sorted(os.listdir(root))}


def test_reports_are_files(spark):
    spark.dataSource.register(ReportFiles)
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/out"
    rows = spark.createDataFrame([("a/b", "one\r\ntwo"), ("..", "é"), ("plain", None)], "name string, text string")
    rows.repartition(3).write.format("report_files").mode("append").save(f"file://{root}")
    want = {file_of("a/b"): "one\r\ntwo", file_of(".."): "é", "plain.md": ""}
    assert files(root) == want
    spark.createDataFrame([("plain", "new"), ("more", "x")], "name string, text string").write.format("report_files").mode("append").save(f"file://{root}")
    assert files(root) == want | {"plain.md": "new", "more.md": "x"}
    spark.createDataFrame([("only", "y")], "name string, text string").write.format("report_files").mode("overwrite").save(f"file://{root}")
    assert files(root) == {"only.md": "y"}


def test_failed_jobs_leave_nothing(spark):
    spark.dataSource.register(ReportFiles)
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = spark.range(20).repartition(4).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") < 19, "fine").otherwise(F.raise_error(F.lit("no"))).alias("text"))
    twice = spark.createDataFrame([("same", "1"), ("same", "2")], "name string, text string").repartition(2)
    for bad in (rows, twice, rows.select("name")):
        with pytest.raises(Exception):  # noqa: B017
            bad.write.format("report_files").mode("append").save(f"file://{root}")
        assert os.listdir(root) == []
