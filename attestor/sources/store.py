"""Tables as folders of partitioned Parquet. A change set is applied to the partitions that it touches, which are written anew by Spark's
dynamic partition overwrite; all others stay as they are, whoever writes to them meanwhile. Readers of a partition that is
rewritten read it again afterwards."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from attestor.sources.scratch import stored


class Conflict(ValueError):
    """A row with this id is there already."""


#: The partition of a row, and the mark of a partition that has no row.
PART, EMPTY = "_part", "_empty"
MAX_PARTS = 10_000  # touched partitions that are read by their paths; beyond, the table is read and met with them
INSERT, UPDATE, UPSERT, DELETE = "insert", "update", "upsert", "delete"


class Store:
    """The tables under a root path that Spark can write. partitions names the column by which a table is partitioned; tables without one
    are one partition. A key is unique in its partition. Two writers may change a table at the same time where they touch different partitions."""

    def __init__(self, spark: SparkSession, root: str, partitions: Mapping[str, str] | None = None):
        self.spark, self.root, self.partitions = spark, root.rstrip("/"), dict(partitions or {})

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _part(self, name: str) -> Column:
        """A text that no reader takes for a number or a date."""
        by = self.partitions.get(name)
        return F.concat(F.lit("p-"), F.coalesce(F.col(by).cast("string"), F.lit(""))) if by else F.lit("p-")

    def exists(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _rows(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path(name)).where(F.col(EMPTY).isNull()).drop(EMPTY)

    def _held(self, name: str, touched: DataFrame, columns: DataFrame) -> DataFrame:
        """What the touched partitions hold. No file of another partition is opened, so that its writer may replace it meanwhile. columns: a frame
        with the columns of a table that has no row."""
        parts = [r[PART] for r in touched.limit(MAX_PARTS + 1).collect()]
        if len(parts) > MAX_PARTS and self.exists(name):
            return self._rows(name).join(touched, PART, "left_semi")
        escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        paths = [f"{self._path(name)}/{PART}={escaped(p)}" for p in parts]
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        paths = [p for p in paths if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p))]
        if not paths:
            return self.spark.createDataFrame([], columns.schema)
        return self.spark.read.option("basePath", self._path(name)).parquet(*paths).where(F.col(EMPTY).isNull()).drop(EMPTY)

    def read(self, name: str) -> DataFrame:
        if not self.exists(name):
            raise KeyError(name)
        return self._rows(name).drop(PART)

    def _establish(self, name: str, rows: DataFrame) -> None:
        """A new table begins with a mark that holds its columns, so that it can be read before it has a row."""
        if not self.exists(name):
            none = self.spark.createDataFrame([], rows.schema)
            self._write(name, none.withColumn(PART, self._part(name)), self.spark.createDataFrame([("p-",)], f"{PART} string"))

    def _write(self, name: str, rows: DataFrame, touched: DataFrame | None = None) -> None:
        """rows (with their partitions) in place of what the touched partitions hold; those without rows get an empty mark."""
        out = rows.withColumn(EMPTY, F.lit(None).cast(BooleanType()))
        if touched is not None:
            bare = touched.join(rows.select(PART).distinct(), PART, "left_anti")
            out = out.unionByName(bare.select(PART, F.lit(True).alias(EMPTY)), allowMissingColumns=True)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self._path(name))

    def change(self, name: str, changes: DataFrame, key: str, at: Column | None = None) -> DataFrame:
        """Applies changes: the table's columns and op, which inserts a new key, updates a known one, upserts or deletes by key. A row for each
        partition: its value, inserted, updated, deleted, and updated_at, the latest time at of what took effect. Inserts of
        known keys and keys that are named twice are conflicts, and nothing is written then. Updates and deletes of unknown keys have no effect.

        Partitions that no change touches are neither read nor written."""
        by = self.partitions.get(name)
        columns = [c for c in changes.columns if c != "op"]
        self._establish(name, changes.drop("op"))
        rows = stored(changes.select("*", self._part(name).alias(PART), (at if at is not None else F.current_timestamp()).alias("_at")), "changes")
        touched = rows.select(PART).distinct()
        held = self._held(name, touched, rows.select(*columns, PART))
        met = rows.join(held.select(PART, key, F.lit(True).alias("_there")), [PART, key], "left").withColumn("_there", F.coalesce("_there", F.lit(False)))
        effects = stored(met, "effects")
        twice = effects.groupBy(PART, key).count().where("count > 1")
        if twice.unionAll(effects.where((F.col("op") == INSERT) & F.col("_there")).select(PART, key, F.lit(2).cast("long"))).take(1):
            raise Conflict(name)
        effects = effects.where((F.col("op") == INSERT) | (F.col("op") == UPSERT) | F.col("_there"))
        new = effects.where(F.col("op") != DELETE).select(*columns, PART)
        kept = held.join(effects.select(PART, key), [PART, key], "left_anti").select(*[F.col(c) for c in held.columns])
        self._write(name, kept.unionByName(new, allowMissingColumns=True), touched)
        return effects.groupBy(*([by] if by else [])).agg(
            F.count_if(~F.col("_there")).alias("inserted"), F.count_if(F.col("_there") & (F.col("op") != DELETE)).alias("updated"), F.count_if(F.col("op") == DELETE).alias("deleted"),
            F.max("_at").alias("updated_at"),
        )

    def put(self, name: str, rows: DataFrame, value: str) -> None:
        """rows in place of whatever the partition of a value holds; done again, it gives the same."""
        self._establish(name, rows)
        rows = stored(rows.withColumn(PART, self._part(name)), "rows")
        self._write(name, rows, self.spark.createDataFrame([(f"p-{value}",)], f"{PART} string"))

    def replace(self, name: str, rows: DataFrame) -> None:
        """rows and nothing else."""
        rows = stored(rows.withColumn(PART, self._part(name)), "rows")
        old = self._rows(name).select(PART).distinct() if self.exists(name) else rows.select(PART).limit(0)
        self._write(name, rows, old.unionAll(rows.select(PART).distinct()).distinct())

    def append(self, name: str, rows: DataFrame, key: str | None = None) -> None:
        """New files beside those that are there; nothing is rewritten, and one append to a table goes at a time. With a key, an id that is there already
        is a conflict and nothing is written; its partitions are then rewritten."""
        if key:
            self.change(name, rows.withColumn("op", F.lit(INSERT)), key)
            return
        self._establish(name, rows)
        out = rows.withColumns({PART: self._part(name), EMPTY: F.lit(None).cast(BooleanType())})
        out.write.mode("append").partitionBy(PART).parquet(self._path(name))

    def upsert(self, name: str, rows: DataFrame, key: str, order: str) -> None:
        """The last row of each key by order stays."""
        new = last_by(rows, key, order)
        if self.exists(name):
            old = self._rows(name).select(PART, F.col(key).alias("_key"), F.col(order).alias("_old"))
            met = new.withColumn(PART, self._part(name))
            later = met.join(old, (met[PART] == old[PART]) & (met[key] == F.col("_key")), "left").where(F.col("_old").isNull() | (F.col(order) >= F.col("_old")))
            new = later.select(*[met[c] for c in new.columns])
        self.change(name, new.withColumn("op", F.lit(UPSERT)), key)

    def insert_absent(self, name: str, rows: DataFrame, key: str) -> int:
        """Rows whose key is not there yet are added; their number, counted once, with the change set."""
        if self.exists(name):
            held = self._rows(name).select(PART, key)
            rows = rows.withColumn(PART, self._part(name)).join(held, [PART, key], "left_anti").drop(PART)
        done = self.change(name, rows.dropDuplicates([key]).withColumn("op", F.lit(INSERT)), key)
        return done.agg(F.coalesce(F.sum("inserted"), F.lit(0))).first()[0]

    def _refer(self, name: str, keys: DataFrame, key: str, column: str, unset: bool) -> None:
        """Rows whose column names one of the keys go, or lose the reference."""
        gone = keys.select(F.col(key).alias("_gone")).distinct()
        held = self._rows(name)
        touched = stored(held.join(gone, held[column] == F.col("_gone"), "left_semi").select(PART).distinct(), "touched")
        held = self._held(name, touched, held)
        if unset:
            met = held.join(gone, held[column] == F.col("_gone"), "left")
            rows = met.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(*held.columns)
        else:
            rows = held.join(gone, held[column] == F.col("_gone"), "left_anti").select(*held.columns)
        self._write(name, rows, touched)

    def delete(self, name: str, keys: DataFrame, key: str, cascade: dict[str, str] | None = None, unset: dict[str, str] | None = None) -> None:
        """Rows with these keys go; in cascade (table: column) rows that refer to them go too, in unset they lose the reference."""
        keys = stored(keys.select(key), "keys")
        for columns, clear in ((cascade or {}, False), (unset or {}, True)):
            for table, column in columns.items():
                if self.exists(table):
                    self._refer(table, keys, key, column, clear)
        self._refer(name, keys, key, key, False)


def last_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def encode_warnings(warnings):
    """code:message of each."""
    return F.transform(warnings, lambda w: F.concat_ws(":", w["code"], w["message"]))


def decode_warnings(encoded):
    def parts(x):
        cut = F.instr(x, ":")
        return F.struct(F.when(cut > 0, F.substring(x, F.lit(1), cut - 1)).otherwise(x).alias("code"), F.when(cut > 0, F.substring(x, cut + 1, F.length(x))).otherwise("").alias("message"))

    return F.transform(encoded, parts)


def encode_terms(terms):
    """term:count of each, in one text."""
    return F.array_join(F.transform(terms, lambda t: F.concat_ws(":", t["term"], t["count"].cast("string"))), ",")


def decode_terms(encoded):
    """The terms (term, count) of a text; terms hold no comma, and the count follows the last colon."""
    entries = F.filter(F.split(encoded, ","), lambda x: x != "")
    return F.transform(entries, lambda x: F.struct(F.regexp_extract(x, "^(.*):", 1).alias("term"), F.substring_index(x, ":", -1).cast("int").alias("count")))


def decode_enum(encoded, values: list[str], name: str):
    """The text itself if it is one of the values; any other text is an error, null stays null."""
    return F.when(encoded.isin(values) | encoded.isNull(), encoded).otherwise(F.raise_error(F.concat(F.lit(f"unknown {name} "), encoded)))


def patched(held: DataFrame, patch: DataFrame, key: str, clearable: tuple[str, ...] = ()) -> DataFrame:
    """held with the values of patch, which has one row a key at most: a null leaves the old value. A column of clearable has a
    boolean <column>_given in patch, and where that is true the new value counts even if it is null."""
    columns = [c for c in held.columns if c != key]
    new = patch.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in patch.columns if c != key])
    taken = {c: F.when(F.coalesce(f"_new_{c}_given", F.lit(False)), F.col(f"_new_{c}")).otherwise(F.col(c)) if c in clearable else F.coalesce(f"_new_{c}", c) for c in columns if f"_new_{c}" in new.columns}
    return held.join(new, key, "left").select(*[taken.get(c, F.col(c)).alias(c) for c in held.columns])
