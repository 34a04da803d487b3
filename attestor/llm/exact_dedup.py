"""Exact deduplication against a persistent digest index.

The index is a folder with a Parquet table bucketed and sorted by SHA-256 digest. A batch is reduced to one row a digest
(map-side partial aggregation, so a hot text never meets in one task). A sort-merge anti-join finds the digests that the
index lacks; they are appended as entries, and what the batch adds to known digests is appended beside them, so that the
entries of all batches give the document that stays and the size of its group. Any session opens an index by its path.
Every batch has an id that stands in its rows, which appear all at once when their write is committed: a batch that is added again, be it
retried or sent twice, changes nothing and gives the same answer. One writer at a time adds to an index.

Defined results: null text counts as the empty text; of equal texts the row with the largest doc_id stays;
a null doc_id is smaller than any other; rows that repeat both doc_id and text are one document and get the
same answer; an empty table gives an empty result; further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import HOT_SHARE, fresh, scratch, stored

#: Documents pass through the index in so many batches, dealt by a hash of their ids.
BATCHES = 2


class DigestIndex:
    """Digests seen so far. The table holds (digest, keep_id, group_size, first, batch): one row with first for each digest, and one without
    for each later batch that met it again. The session's catalog names the table until close."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or scratch(spark, "digest-index")
        self.name = f"digest_index_{hashlib.sha256(self.path.encode()).hexdigest()[:32]}"
        try:
            self.buckets = spark.read.schema("buckets int").parquet(f"{self.path}/layout").first()["buckets"]
        except AnalysisException:  # a new index
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).write.parquet(f"{self.path}/layout")
        self._table()

    def _table(self) -> DataFrame:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, group_size BIGINT, first BOOLEAN, batch STRING) USING parquet"
            f" CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/entries'"
        )
        return self.spark.table(self.name)

    def close(self) -> None:
        """Takes the table out of the session's catalog; the folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def known(self) -> DataFrame:
        """The digests, each once."""
        return self._table().where("first").select("digest")

    def entries(self) -> DataFrame:
        """digest, keep_id, group_size over all batches; the buckets spare the shuffle."""
        return self._table().groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def has(self, batch: str) -> bool:
        """Whether a batch is there; a file holds rows of one batch, so its statistics spare reading it."""
        return bool(self._table().where(F.col("batch") == batch).take(1))

    def add(self, batch: DataFrame, batch_id: str | None = None) -> DataFrame:
        """Takes in batch (digest, doc_id); the entries of digests that were new. Rows are stored before they are appended: a
        table is not read while it is written. Of a batch that is there already nothing is taken in again."""
        batch_id = batch_id or uuid.uuid4().hex
        if self.has(batch_id):
            return self._table().where((F.col("batch") == batch_id) & F.col("first")).select("digest", "keep_id", "group_size")
        reduced = stored(batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "batch")
        new = reduced.join(self.known().hint("merge"), "digest", "left_anti").withColumn("first", F.lit(True))
        met = reduced.join(self.known().hint("merge"), "digest", "left_semi").withColumn("first", F.lit(False))
        rows = stored(new.unionByName(met), "digest-rows")
        rows.select("digest", "keep_id", "group_size", "first", F.lit(batch_id).alias("batch")).repartition(self.buckets, "digest").write.insertInto(self.name)
        return rows.where("first").drop("first")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row."""
    return docs.select(docs["doc_id"].cast("long"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))


def decide(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """rows (doc_id, digest) with keep_id and group_size of their digest.

    Hot digests are at most HOT_SHARE and go by broadcast; all others meet their entry in a sort-merge join
    in which no key has more than one in HOT_SHARE of all rows.
    """
    limit = max(1, (entries.agg(F.sum("group_size")).first()[0] or 0) // HOT_SHARE)
    hot = entries.where(F.col("group_size") > limit)
    tagged = rows.join(
        F.broadcast(hot.select(F.col("digest").alias("_hot_digest"), F.col("keep_id").alias("_hot_id"), F.col("group_size").alias("_hot_size"))),
        F.col("digest") == F.col("_hot_digest"), "left",
    )
    out = ("doc_id", "digest", "keep_id", "group_size")
    common = tagged.where(F.col("_hot_digest").isNull()).select("doc_id", "digest").join(entries.where(F.col("group_size") <= limit).hint("merge"), "digest").select(*out)
    often = tagged.where(F.col("_hot_digest").isNotNull()).select("doc_id", "digest", F.col("_hot_id").alias("keep_id"), F.col("_hot_size").alias("group_size"))
    return common.unionByName(often)


def indexed(docs: DataFrame, index: DigestIndex | None = None, batch_id: str | None = None) -> DataFrame:
    """doc_id, digest, keep_id, group_size of every row of docs after all of them went through the index. With a batch_id, documents that are sent again under
    it are not counted again."""
    own = index or DigestIndex(docs.sparkSession)
    rows = stored(digests(docs), "digests")
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES))
    for k in range(BATCHES):
        own.add(rows.where(batch == k), batch_id and f"{batch_id}/{k}")
    entries = stored(own.entries(), "entries")
    if index is None:
        own.close()
    return decide(rows, entries)


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None, batch_id: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs (doc_id, text). Documents that an index
    passed in holds already count: they are in group_size and may be the one that stays."""
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return indexed(docs, index, batch_id).select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def without_exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the rows that are not kept, all columns as they were; of a repeated row one stays."""
    mark, sha, gone, own = fresh(docs, "mark", "sha", "gone", "own")
    verdict = stored(indexed(docs), "exact-verdict")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    lost = verdict.where(~kept).select("doc_id", "digest").distinct().withColumn(gone, F.lit(True))
    again = verdict.where(kept).groupBy("doc_id", "digest").count().where("count > 1").select("doc_id", "digest").withColumn(gone, F.lit(False))
    marks = lost.unionByName(again).withColumnsRenamed({"doc_id": mark, "digest": sha})
    held = docs.withColumn(own, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    met = held.join(marks, held["doc_id"].eqNullSafe(F.col(mark)) & (F.col(own) == F.col(sha)), "left")
    once = met.where(F.col(gone).isNull()).select(*[held[c] for c in docs.columns])
    if not again.take(1):
        return once
    return once.unionByName(met.where(~F.col(gone)).dropDuplicates([mark, own]).select(*[held[c] for c in docs.columns]))
