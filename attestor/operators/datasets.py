"""Evaluation datasets, their cases and experiments as tables of a store, each partitioned by dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.sources.scratch import stored
from attestor.sources.store import DELETE, INSERT, UPDATE, Store

PARTITIONS = {"datasets": "dataset_id", "cases": "dataset_id", "experiments": "dataset_id"}


class NotFound(KeyError):
    """A dataset that a change names is not there."""


class Datasets:
    """datasets (dataset_id, name, created_at, updated_at), cases (dataset_id, case_id, query, chunk_ids, document_ids, top_k) and experiments
    (dataset_id, experiment_id, best_mode, gate_status, created_at) in one store. Whatever changes a dataset's cases or adds an experiment moves its updated_at; only partitions
    of datasets that change are written."""

    def __init__(self, store: Store):
        self.store = store

    def create(self, rows: DataFrame) -> None:
        """New datasets (dataset_id, name, created_at). A blank name is refused, a known id is a conflict."""
        if rows.where(~F.coalesce(F.col("name").rlike("\\S"), F.lit(False))).take(1):
            raise ValueError("a dataset has no name")
        self.store.change("datasets", rows.select("dataset_id", "name", "created_at", F.col("created_at").alias("updated_at"), F.lit(INSERT).alias("op")), "dataset_id")

    def _known(self, rows: DataFrame) -> None:
        held = self.store.read("datasets").select("dataset_id") if self.store.exists("datasets") else rows.select("dataset_id").limit(0)
        if rows.join(held, "dataset_id", "left_anti").take(1):
            raise NotFound("a dataset")

    def _touch(self, effects: DataFrame) -> None:
        times = effects.select("dataset_id", F.col("updated_at").alias("_to"))
        rows = self.store.read("datasets").join(times, "dataset_id")
        self.store.change("datasets", rows.withColumn("updated_at", F.greatest("updated_at", "_to")).drop("_to").withColumn("op", F.lit(UPDATE)), "dataset_id")

    def change_cases(self, changes: DataFrame, at: Column | None = None) -> DataFrame:
        """Applies changes (the columns of cases, and op) in one go: inserted, updated, deleted and updated_at of each dataset in which something took effect.
        A case without an expected id or with a blank query is refused, and nothing is written."""
        none = F.array().cast("array<string>")
        changes = stored(changes, "case-changes")
        self._known(changes)
        expected = F.size(F.coalesce("chunk_ids", none)) + F.size(F.coalesce("document_ids", none))
        if changes.where((F.col("op") != DELETE) & ((expected == 0) | ~F.coalesce(F.col("query").rlike("\\S"), F.lit(False)))).take(1):
            raise ValueError("a case expects nothing or asks nothing")
        effects = stored(self.store.change("cases", changes, "case_id", at), "case-effects")
        self._touch(effects)
        return effects

    def add_experiments(self, rows: DataFrame) -> None:
        """Experiments (dataset_id, experiment_id, best_mode, gate_status, created_at); their datasets are as new as they are."""
        rows = stored(rows, "experiments")
        self._known(rows)
        self._touch(self.store.change("experiments", rows.withColumn("op", F.lit(INSERT)), "experiment_id", F.col("created_at")))

    def summaries(self) -> DataFrame:
        """Every dataset with the number of its cases and its latest experiment, of equal times the one with the larger id."""
        rows = self.store.read("datasets")
        cases = self.store.read("cases").groupBy("dataset_id").agg(F.count(F.lit(1)).alias("cases")) if self.store.exists("cases") else None
        rows = rows.join(cases, "dataset_id", "left") if cases is not None else rows.withColumn("cases", F.lit(0))
        if self.store.exists("experiments"):
            order = F.struct("created_at", "experiment_id")
            latest = self.store.read("experiments").groupBy("dataset_id").agg(*[F.max_by(c, order).alias(c) for c in ("experiment_id", "best_mode", "gate_status")])
            rows = rows.join(latest.withColumnRenamed("experiment_id", "latest_experiment"), "dataset_id", "left")
        else:
            rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("latest_experiment", "best_mode", "gate_status")})
        return rows.withColumn("cases", F.coalesce("cases", F.lit(0)).cast("long"))
