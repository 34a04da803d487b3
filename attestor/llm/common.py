"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="attestor-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written once as Parquet to the shared folder and read back: lineage ends there. And its path, for discard."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    return store(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table that no later job reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: A key is hot when more than one row in HOT_SHARE carries it; hence at most HOT_SHARE keys are hot, which bounds what
#: looked_up sends to every task.
HOT_SHARE = 1000


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows joined with table, which has one row a key, however many rows share a key: what table has for hot keys goes
    by broadcast, and rows with other keys meet it in a sort-merge join. Rows without a match are left out. rows are read
    three times, so they should be stored."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("many"))
    limit = max(1, rows.count() // HOT_SHARE)
    hot = F.broadcast(counts.where(F.col("many") > limit).select(key))
    columns = [*rows.columns, *[c for c in table.columns if c != key]]
    often = rows.join(F.broadcast(table.join(hot, key, "left_semi")), key)
    return rows.join(hot, key, "left_anti").join(table.hint("merge"), key).select(*columns).unionByName(often.select(*columns))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to differ from every column of docs."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the third of the documents that no model may learn from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of so many rows go to Python workers while jobs inside run; for rows with long values."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on at most so many rows go to a Python worker at a time: for applications whose stages share workers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
