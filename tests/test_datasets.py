"""Datasets, cases and experiments."""

import tempfile

import pytest
from pyspark.sql import functions as F

from attestor.operators.datasets import PARTITIONS, Datasets, NotFound
from attestor.sources.store import Conflict, Store

CASE = "dataset_id string, case_id long, query string, chunk_ids array<string>, document_ids array<string>, top_k int, op string"


@pytest.fixture
def lab(spark):
    made = Datasets(Store(spark, "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"), PARTITIONS))
    made.create(spark.createDataFrame([("a", "first"), ("b", "second")], "dataset_id string, name string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp")))
    return made


def day(n):
    return F.lit(f"2024-01-{n:02}").cast("timestamp")


def state(lab):
    return {r["dataset_id"]: (r["cases"], f"{r['updated_at']:%d}", r["latest_experiment"]) for r in lab.summaries().collect()}


def test_cases_change_and_touch_their_dataset(spark, lab):
    make = lambda *rows: spark.createDataFrame(rows, CASE)
    assert state(lab) == {"a": (0, "01", None), "b": (0, "01", None)}
    lab.change_cases(make(("a", 1, "q", [], ["d"], 5, "insert"), ("a", 2, "q", ["c"], None, 5, "insert")), day(2))
    got = lab.change_cases(make(("a", 1, "better", [], ["d"], 5, "update"), ("a", 9, "q", [], ["d"], 5, "update"), ("a", 2, None, None, None, None, "delete"), ("b", 1, "q", [], ["d"], 5, "delete")), day(3)).collect()
    assert [(r["dataset_id"], r["inserted"], r["updated"], r["deleted"]) for r in got] == [("a", 0, 1, 1)]
    assert state(lab) == {"a": (1, "03", None), "b": (0, "01", None)} and lab.store.read("cases").first()["query"] == "better"
    lab.add_experiments(spark.createDataFrame([("b", "x1", "vector", "failed"), ("b", "x2", "hybrid", "passed")], "dataset_id string, experiment_id string, best_mode string, gate_status string").withColumn("created_at", day(7)))
    assert state(lab)["b"] == (0, "07", "x2")


def test_bad_changes_write_nothing(spark, lab):
    make = lambda *rows: spark.createDataFrame(rows, CASE)
    for wrong, error in ((("a", 1, "q", [], [], 5, "insert"), ValueError), (("a", 1, " ", [], ["d"], 5, "insert"), ValueError), (("nowhere", 1, "q", [], ["d"], 5, "insert"), NotFound)):
        with pytest.raises(error):
            lab.change_cases(make(wrong, ("b", 5, "q", [], ["d"], 5, "insert")))
    with pytest.raises(Conflict):
        lab.change_cases(make(("a", 1, "q", [], ["d"], 5, "insert"), ("a", 1, "q", [], ["d"], 5, "update")))
    with pytest.raises(ValueError):
        lab.create(spark.createDataFrame([("c", " ")], "dataset_id string, name string").withColumn("created_at", day(1)))
    assert state(lab) == {"a": (0, "01", None), "b": (0, "01", None)}
