import tempfile

import pytest
from pyspark.sql import functions as F

from attestor.sources.store import Conflict, Store, decode_enum, decode_terms, patched


@pytest.fixture
def store(spark):
    return Store(spark, "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def frame(spark, *rows):
    return spark.createDataFrame(rows, "id string, at long, v string")


def held(store, name="t"):
    return sorted(tuple(r) for r in store.read(name).collect())


def test_append_and_conflict(spark, store):
    store.append("t", frame(spark, ("a", 1, "x")), key="id")
    with pytest.raises(Conflict):
        store.append("t", frame(spark, ("a", 2, "y")), key="id")
    store.append("t", frame(spark, ("b", 1, "x")), key="id")
    assert held(store) == [("a", 1, "x"), ("b", 1, "x")]


def test_upsert_keeps_the_last_write(spark, store):
    store.upsert("t", frame(spark, ("a", 1, "x"), ("b", 5, "x")), "id", "at")
    store.upsert("t", frame(spark, ("a", 2, "y"), ("b", 4, "late")), "id", "at")
    assert held(store) == [("a", 2, "y"), ("b", 5, "x")]


def test_insert_absent_is_idempotent(spark, store):
    rows = frame(spark, ("a", 1, "x"), ("b", 1, "x"))
    assert store.insert_absent("t", rows, "id") == 2 and store.insert_absent("t", rows, "id") == 0


def test_delete_cascades_and_unsets(spark, store):
    store.replace("t", frame(spark, ("a", 1, "x"), ("b", 1, "x")))
    store.replace("child", spark.createDataFrame([("1", "a"), ("2", "b")], "k string, parent string"))
    store.replace("trace", spark.createDataFrame([("1", "a"), ("2", "b")], "k string, run string"))
    store.delete("t", store.read("t").where(F.col("id") == "a"), "id", cascade={"child": "parent"}, unset={"trace": "run"})
    assert held(store) == [("b", 1, "x")] and held(store, "child") == [("2", "b")]
    assert sorted(map(tuple, store.read("trace").collect())) == [("1", None), ("2", "b")]


def test_patches_keep_set_and_clear(spark):
    held = spark.createDataFrame([(1, "a", "n"), (2, "b", "n"), (3, "c", "n"), (4, "d", "n")], "id int, text string, notes string")
    patch = spark.createDataFrame([(1, None, None, False), (2, "B", None, True), (3, None, "m", True)], "id int, text string, notes string, notes_given boolean")
    assert sorted(map(tuple, patched(held, patch, "id", ("notes",)).collect())) == [(1, "a", "n"), (2, "B", None), (3, "c", "m"), (4, "d", "n")]


def test_term_and_enum_codecs(spark):
    row = spark.createDataFrame([("a:1,b:12", "", "low")], "terms string, none string, level string")
    got = row.select(decode_terms(F.col("terms")).alias("t"), decode_terms(F.col("none")).alias("n"), decode_enum(F.col("level"), ["low", "high"], "level").alias("e")).first()
    assert [tuple(t) for t in got["t"]] == [("a", 1), ("b", 12)] and got["n"] == [] and got["e"] == "low"
    with pytest.raises(Exception, match="unknown level"):
        row.select(decode_enum(F.col("terms"), ["low", "high"], "level")).collect()


def parts(spark, store, name="t"):
    """The data files of each partition."""
    import glob

    return {p.split("_part=")[-1]: sorted(glob.glob(p + "/part-*")) for p in glob.glob(store.root.removeprefix("file://") + f"/{name}/_part=*")}


def test_changes_rewrite_only_the_partitions_they_touch(spark):
    store = Store(spark, "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"), {"t": "d"})
    make = lambda *rows: spark.createDataFrame(rows, "d string, id string, v int, op string")
    store.change("t", make(("x", "1", 1, "insert"), ("x", "2", 1, "insert"), ("y", "1", 1, "insert"), ("z", "1", 1, "insert"), (None, "1", 1, "insert")), "id")
    before = parts(spark, store)
    assert len(before) == 4 and store.read("t").count() == 5
    got = store.change("t", make(("x", "1", 2, "update"), ("x", "9", 2, "update"), ("x", "3", 2, "upsert"), ("z", "1", None, "delete"), ("w", "1", None, "delete")), "id", F.lit("2024-01-02 00:00:00").cast("timestamp"))
    assert sorted((r["d"], r["inserted"], r["updated"], r["deleted"]) for r in got.collect()) == [("x", 1, 1, 0), ("z", 0, 0, 1)]
    assert {str(r["updated_at"]) for r in got.collect()} == {"2024-01-02 00:00:00"}
    after = parts(spark, store)
    assert sorted(str(tuple(r)) for r in store.read("t").collect()) == sorted(map(str, [("x", "1", 2), ("x", "2", 1), ("x", "3", 2), ("y", "1", 1), (None, "1", 1)]))
    same = {p for p in before if before[p] == after.get(p)}
    assert same == {"p-y", "p-"}
    with pytest.raises(Conflict):
        store.change("t", make(("y", "1", 3, "insert"), ("x", "7", 3, "insert")), "id")
    assert store.read("t").count() == 5


def test_two_writers_of_different_partitions(spark):
    from concurrent.futures import ThreadPoolExecutor

    store = Store(spark, "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"), {"t": "d"})
    make = lambda d, n: spark.createDataFrame([(d, str(i), n, "upsert") for i in range(n)], "d string, id string, v int, op string")
    store.change("t", make("start", 1), "id")

    def write(d):
        for n in (3, 5):
            store.change("t", make(d, n), "id")

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, "abcd"))
    assert {(r["d"], r["count"]) for r in store.read("t").groupBy("d").count().collect()} == {("start", 1), *((d, 5) for d in "abcd")} and store.read("t").where("v <> 5 and d <> 'start'").count() == 0


def test_appends_rewrite_nothing(spark):
    store = Store(spark, "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"), {"t": "d"})
    store.append("t", frame(spark, ("a", 1, "x")).withColumnRenamed("id", "d"))
    before = parts(spark, store)["p-a"]
    store.append("t", frame(spark, ("a", 2, "y")).withColumnRenamed("id", "d"))
    assert set(before) < set(parts(spark, store)["p-a"]) and held(store) == [("a", 1, "x"), ("a", 2, "y")]


def test_tables_without_rows_have_columns(spark, store):
    none = frame(spark, ("a", 1, "x")).limit(0)
    store.append("t", none)
    store.change("c", none.withColumn("op", F.lit("insert")), "id")
    store.put("p", none, "x")
    assert all(store.read(t).columns == ["id", "at", "v"] and store.read(t).count() == 0 for t in "tcp")
    store.append("t", frame(spark, ("a", 1, "x")))
    assert held(store) == [("a", 1, "x")]
