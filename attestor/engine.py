"""The engine's functions over one store of tables."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from attestor.config import Config
from attestor.operators import answer, datasets, diagnosis, embedding, evals, overview, reports, requests, retrieval, traces
from attestor.operators.chunking import chunk
from attestor.operators.ingest import admit, extract
from attestor.operators.intelligence import analyze, annotate_quality
from attestor.sources.scratch import stored
from attestor.sources.store import Conflict, Store


PARTITIONS = {
    "sources": "source_id", "ingestion_runs": "source_id", "documents": "source_id", "failures": "source_id", "chunks": "source_id", "embeddings": "source_id", "runs": "run_id", "run_hits": "run_id",
    "traces": "run_id", "reruns": "rerun_id", "ci_runs": "dataset", "ci_failures": "dataset", **datasets.PARTITIONS,
}


class Engine:
    """Tables: sources, ingestion_runs, documents, failures, chunks, embeddings, runs, run_hits, traces, reruns, ci_runs, ci_failures, and those of datasets. Each is partitioned
    by what its changes share: a source, a run, a dataset."""

    def __init__(self, spark: SparkSession, root: str, config: Config = Config()):
        self.spark, self.store, self.config = spark, Store(spark, root, PARTITIONS), config
        self.datasets = datasets.Datasets(self.store)

    def ingest(self, files: DataFrame, source_id: str, run_id: str | None = None) -> DataFrame:
        """files (file_name, content_type, content, length, and request_id and position where they came in requests): a source's documents and
        chunks, failures and the source's row. The row of the run: status, files_received, documents_created, chunks_created, failed_files, documents and failures in the source. Totals are
        counted by the writes themselves; documents that are there already are left as they are."""
        run_id = run_id or uuid.uuid4().hex
        source = F.lit(source_id)
        now, chunking = F.current_timestamp(), self.config.chunking
        self.store.change("sources", self.spark.range(1).select(
            source.alias("source_id"), F.lit(chunking.strategy).alias("strategy"), F.lit(chunking.target).alias("target"), F.lit(chunking.overlap).alias("overlap"), now.alias("created_at"), F.lit("upsert").alias("op"),
        ), "source_id")
        run = self.spark.range(1).select(F.lit(run_id).alias("run_id"), source.alias("source_id"), F.lit("running").alias("status"), now.alias("started_at"))
        totals = ("files_received", "documents_created", "chunks_created", "failed_files")
        zero = {c: F.lit(0).cast("long") for c in totals}
        self.store.change("ingestion_runs", run.withColumns(zero | {"completed_at": F.lit(None).cast("timestamp"), "op": F.lit("insert")}), "run_id")

        given = files.withColumns({c: v for c, v in (("request_id", source), ("position", F.col("file_name"))) if c not in files.columns})
        seen = Observation()
        found = extract(admit(given)).withColumn("document_id", F.sha2(F.concat_ws("/", source, "file_name"), 256))
        found = stored(found.observe(seen, F.count(F.lit(1)).alias("files_received"), F.count_if(F.col("failure").isNotNull()).alias("failed_files")), "extracted")
        docs = found.where("failure is null").dropDuplicates(["document_id"]).select("document_id", source.alias("source_id"), F.col("file_name").alias("path"), "mime_type", "text")
        if self.store.exists("documents"):
            docs = docs.join(self.store.read("documents").where(F.col("source_id") == source_id).select("document_id"), "document_id", "left_anti")
        docs = stored(analyze(docs), "analyzed")
        made, cut = Observation(), Observation()
        self.store.append("documents", docs.observe(made, F.count(F.lit(1)).alias("documents_created")))
        self.store.append("chunks", annotate_quality(chunk(docs.select("document_id", "source_id", "path", "text"), chunking)).observe(cut, F.count(F.lit(1)).alias("chunks_created")))
        self.store.append("failures", found.where("failure is not null").select("file_name", source.alias("source_id"), "failure"))
        counts = {**seen.get, **made.get, **cut.get}
        done = run.withColumns({c: F.lit(counts[c]).cast("long") for c in totals})
        done = done.withColumns({"status": overview.ingestion_status(F.col("documents_created"), F.col("failed_files")), "completed_at": now, "op": F.lit("update")})
        self.store.change("ingestion_runs", done, "run_id")
        held = [self.store.read(t).where(F.col("source_id") == source_id).agg(F.count(F.lit(1)).alias(t)) for t in ("documents", "failures")]
        return self.store.read("ingestion_runs").where(F.col("run_id") == run_id).join(held[0]).join(held[1])  # single rows

    def list_sources(self) -> DataFrame:
        return overview.source_summary(self.store.read("documents"), self.store.read("chunks"))

    def document_chunks(self, document_id: str) -> DataFrame:
        return self.store.read("chunks").where(F.col("document_id") == document_id).orderBy("ordinal")

    def index_embeddings(self, sources: list[str] | None = None) -> DataFrame:
        """Every chunk in scope is embedded anew; the last vector of a chunk stays. The index's status."""
        rows = self.store.read("chunks").where(retrieval.in_scope(sources, None))
        made = rows.select(
            "chunk_id", "source_id", F.col("checksum").alias("chunk_checksum"), F.lit(embedding.MODEL).alias("model"), F.lit(embedding.DIMENSION).alias("size"),
            F.current_timestamp().alias("indexed_at"), embedding.embed(F.col("text")).alias("vector"),
        )
        self.store.upsert("embeddings", made, "chunk_id", "indexed_at")
        return self.embedding_status()

    def embedding_status(self) -> DataFrame:
        if not self.store.exists("embeddings"):
            empty = self.spark.createDataFrame([], "chunk_id string, chunk_checksum string, model string, size int, indexed_at timestamp")
            return embedding.embedding_status(self.store.read("chunks"), empty)
        return embedding.embedding_status(self.store.read("chunks"), self.store.read("embeddings").drop("vector"))

    def retrieve(self, queries: DataFrame, mode: str | None = None, top_k: int = 0, sources: list[str] | None = None, documents: list[str] | None = None) -> dict[str, DataFrame]:
        """status, hits (assessed, by rank), answers, diagnosis. Queries (query_id, query, and source_ids and document_ids where they have scopes of their
        own) must not be blank; sources and documents narrow the whole batch. Queries whose scope holds no indexed chunk have no vector or hybrid hits and say so."""
        mode = mode or self.config.default_mode
        rows = self.store.read("chunks").where(retrieval.in_scope(sources, documents))
        held = self.store.read("embeddings") if self.store.exists("embeddings") else self.spark.createDataFrame([], "chunk_id string, chunk_checksum string, model string, size int, vector array<double>")
        found = requests.run_requests(rows, held, queries, mode, top_k, self.config.retrieval)
        diagnosed = diagnosis.diagnose(queries, found["hits"], found["answers"], mode, found["status"])
        return found | {"hits": found["hits"].orderBy("query_id", "rank"), "diagnosis": diagnosed}

    def run_experiment(self, cases: DataFrame, modes: list[str] | None = None, top_k: int = 0) -> dict[str, DataFrame]:
        """cases (query_id, query, chunk_ids, document_ids) in every mode: case results, mode summaries, comparison, gate, report."""
        if cases.where(F.size("chunk_ids") + F.size("document_ids") == 0).take(1):
            raise ValueError("a case expects nothing")
        results = None
        for mode in retrieval.normalized_modes(modes or []):
            began = time.monotonic()
            run = self.retrieve(cases.select("query_id", "query"), mode, top_k)
            hits = stored(run["hits"], "experiment-hits")
            latency = round((time.monotonic() - began) * 1000 / max(1, cases.count()))  # a batch answers all cases at once: each one's share
            found = answer.answers(cases.select("query_id", "query"), hits, self.config.retrieval.citation_limit)
            rows = evals.evaluate(cases, hits, found).withColumns({"mode": F.lit(mode), "latency_ms": F.lit(latency).cast("long")})
            results = rows if results is None else results.unionByName(rows)
        results = stored(results, "experiment-results")
        summaries = stored(evals.summarize_modes(results), "experiment-modes")
        return {"results": results, "modes": summaries, "report": reports.experiment_report(results, summaries), "comparison": evals.compare_modes(summaries), "gate": evals.gate(summaries)}

    def run_ci(self, cases: DataFrame, dataset: str, label: str, number: int, fail_on_gate: bool = True, branch: str | None = None, commit_sha: str | None = None) -> tuple[int, DataFrame | None]:
        """Status (0, or 422 where the gate fails and counts) and the regression against the latest earlier run of the same
        dataset and label, read before this run is stored. last_report holds the run's report."""
        found = self.run_experiment(cases)
        before = failed_before = None
        if self.store.exists("ci_runs"):
            held = self.store.read("ci_runs").where((F.col("dataset") == dataset) & (F.col("label") == label) & (F.col("number") < number))
            latest = held.agg(F.max("number").alias("n")).first()["n"]
            if latest is not None:
                before = stored(held.where(F.col("number") == latest), "baseline")
                failed_before = stored(self.store.read("ci_failures").where((F.col("dataset") == dataset) & (F.col("label") == label) & (F.col("number") == latest)), "failed-before")
        named = {"dataset": F.lit(dataset), "label": F.lit(label), "number": F.lit(number).cast("long")}
        self.store.append("ci_failures", found["results"].where(F.size("failures") > 0).groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("failures"))).alias("failures")).withColumns(named))
        self.store.append("ci_runs", found["modes"].withColumns(named | {"branch": F.lit(branch).cast("string"), "commit_sha": F.lit(commit_sha).cast("string")}))
        self.last_report = reports.ci_report(found["results"], found["modes"], before, failed_before, {"config_label": label, "branch": branch, "commit_sha": commit_sha})
        failed = found["gate"].first()["status"] == "failed"
        return (422 if failed and fail_on_gate else 0), (evals.regression(before, found["modes"]) if before is not None else None)

    def record(self, run_id: str, queries: DataFrame, mode: str, top_k: int = 0) -> dict[str, DataFrame]:
        """Retrieves, and keeps a row for each query (runs), for each hit (run_hits) and the traces. A run_id is used once."""
        began = time.monotonic()
        found = self.retrieve(queries, mode, top_k)
        hits = stored(found["hits"], "run-hits")
        latency = round((time.monotonic() - began) * 1000)
        name = F.lit(run_id).alias("run_id")
        if self.store.exists("runs") and self.store.read("runs").where(F.col("run_id") == run_id).take(1):
            raise Conflict(run_id)
        # The run's own row comes last: what a crash leaves before it is replaced when the run is recorded again.
        self.store.put("run_hits", hits.select(name, *traces.HIT), run_id)
        rows = traces.traces(found["diagnosis"], hits, mode).select(F.concat_ws("/", name, F.col("query_id").cast("string")).alias("trace_id"), name, "*", F.current_timestamp().alias("at"))
        self.store.put("traces", rows, run_id)
        self.store.put("runs", traces.run_rows(queries, hits, mode, top_k, latency).select(name, "*"), run_id)
        return found | {"hits": hits}

    def rerun(self, run_id: str, again: str, mode: str | None = None, top_k: int | None = None, sources: list[str] | None = None, documents: list[str] | None = None) -> DataFrame:
        """The queries of a recorded run once more: mode and top_k are those of the run where they are not given, filters are only those given
        here. What changed, a row for each query; kept under again, in place of an earlier rerun of that name."""
        held = self.store.read("runs").where(F.col("run_id") == run_id)
        first = held.first()
        if first is None:
            raise KeyError(run_id)
        found = self.retrieve(held.select("query_id", "query"), mode or first["mode"], first["top_k"] if top_k is None else top_k, sources, documents)
        before = self.store.read("run_hits").where(F.col("run_id") == run_id)
        changed = diagnosis.compare_reruns(before, found["hits"]).select(F.lit(run_id).alias("run_id"), F.lit(again).alias("rerun_id"), "*")
        self.store.put("reruns", changed, again)
        return self.store.read("reruns").where(F.col("rerun_id") == again)

    def traces(self, run: dict[str, DataFrame], mode: str) -> DataFrame:
        return traces.traces(run["diagnosis"], run["hits"], mode)

    def report(self, run: dict[str, DataFrame], privacy: str, mode: str | None = None, changes: DataFrame | None = None) -> DataFrame:
        """A report of each query of a run, with its settings where its mode is given and, where a rerun is, what that changed."""
        asked = run["hits"].groupBy("query_id").agg(F.max("query").alias("query"))
        context = reports.report_context(run["hits"], mode) if mode else None
        return reports.markdown(run["diagnosis"], reports.evidence(run["hits"], privacy), privacy, context, changes, asked)

    def delete_source(self, source_id: str) -> None:
        """A source's documents go with their chunks and embeddings."""
        docs = self.store.read("documents").where(F.col("source_id") == source_id).select("document_id")
        held = self.store.read("chunks")
        gone = held.join(docs, "document_id", "left_semi").select("chunk_id")
        self.store.delete("chunks", gone, "chunk_id", cascade={"embeddings": "chunk_id"})
        self.store.delete("documents", docs, "document_id")
