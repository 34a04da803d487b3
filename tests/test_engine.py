"""Files in, answers, evaluation and reports out."""

import tempfile

import pytest

from attestor.config import from_env
from attestor.engine import Engine
from attestor.operators import reports
from attestor.operators.chunking import Chunking
from attestor.operators.embedding import HashProvider, embed_with
from attestor.sources.store import Conflict

BODY = "Projects\n- Built GPU indexing experiments for a local search tool and measured them.\n\nSkills\n- Rust and SQL services for search and retrieval of long documents.\n"


@pytest.fixture(scope="module")
def engine(spark):
    made = Engine(spark, "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"), from_env({"ATTESTOR_TARGET": "64", "ATTESTOR_OVERLAP": "8"}))
    files = spark.createDataFrame([("resume.md", None, BODY.encode(), len(BODY)), ("bad.txt", None, b"\xff\xfe", 2), ("x.exe", None, b"x", 1), ("e.txt", None, b" \n", 2)], "file_name string, content_type string, content binary, length long")
    status = made.ingest(files, "s1").first()
    assert (status["documents"], status["failures"], status["status"]) == (1, 3, "partial")
    return made


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries, 1)), "query_id long, query string")


def test_failures_are_rows(engine):
    assert {r["file_name"]: r["failure"] for r in engine.store.read("failures").collect()} == {"bad.txt": "invalid_utf8", "x.exe": "unsupported_file_type", "e.txt": "empty_extracted_text"}
    assert [(r["documents"], r["chunks"]) for r in engine.list_sources().collect()] == [(1, 2)]


def test_vector_runs_need_an_index_and_lexical_ones_do_not(spark, engine):
    q = asked(spark, "gpu indexing experiments", "zebra crossing")
    run = engine.retrieve(q, "lexical")
    assert {r["query_id"]: r["status"] for r in run["answers"].collect()} == {1: "answered", 2: "insufficient_evidence"}
    early = engine.retrieve(q, "vector")
    assert early["hits"].count() == 0 and {c for r in early["diagnosis"].collect() for c in r["codes"]} == {"missing_embedding_index"}
    assert engine.index_embeddings().first()["indexed"] == 2
    late = engine.retrieve(q, "hybrid")["hits"].where("query_id = 1").first()
    assert late["rank"] == 1 and late["semantic"] > 0 and "semantic_match" in late["hit_flags"]
    with pytest.raises(ValueError):
        engine.retrieve(asked(spark, " "))


def test_runs_repeat(spark, engine):
    q = asked(spark, "search retrieval documents")
    a, b = (sorted((r["chunk_id"], r["score"]) for r in engine.retrieve(q, "lexical")["hits"].collect()) for _ in range(2))
    assert a == b and a


def test_ci_runs_against_the_latest_earlier_run(spark, engine):
    document = engine.store.read("documents").first()["document_id"]
    cases = spark.createDataFrame([(1, "gpu indexing experiments", [], [document])], "query_id long, query string, chunk_ids array<string>, document_ids array<string>")
    engine.index_embeddings()
    status, regression = engine.run_ci(cases, "d", "main", 1)
    assert status in (0, 422) and regression is None
    _, again = engine.run_ci(cases, "d", "main", 2)
    row = again.first()
    assert (row["recall_delta"], row["precision_delta"]) == (0.0, 0.0) and isinstance(row["latency_delta"], int)
    assert {r["section"] for r in engine.last_report.collect()} >= {"gate"}
    with pytest.raises(ValueError):
        engine.run_experiment(cases.limit(0).unionByName(spark.createDataFrame([(1, "x", [], [])], cases.schema)))


def test_reports_keep_private_text(spark, engine):
    run = engine.retrieve(asked(spark, "gpu indexing experiments"), "lexical")
    full = engine.report(run, "snippets_allowed").first()["markdown"]
    bare = engine.report(run, "metadata_only", "lexical").first()["markdown"]
    assert "Built GPU" in full and "Built GPU" not in bare
    assert [line[3:] for line in bare.splitlines() if line.startswith("## ")] == list(reports.SECTIONS)
    assert "| retrieval mode | lexical |" in bare and "gpu indexing" not in bare and "**Report subject:** gpu indexing experiments" in full
    assert "No rerun, mode-comparison" in bare
    with pytest.raises(ValueError):
        engine.report(run, "full_local_only")
    trace = engine.traces(run, "lexical").first()
    assert [s["kind"] for s in trace["spans"]] == ["query", "retrieval", "answer", "diagnosis"]


def test_configuration_is_checked():
    assert from_env({"ATTESTOR_TOP_K": "7"}).retrieval.top_k == 7
    for bad in ({"ATTESTOR_MIN_EVIDENCE": "2"}, {"ATTESTOR_TOP_K": "0"}, {"ATTESTOR_TARGET": "5", "ATTESTOR_OVERLAP": "5"}, {"ATTESTOR_DEFAULT_MODE": "x"}):
        with pytest.raises(ValueError):
            from_env(bad)
    assert Chunking().step == 448


def test_runs_are_kept_and_rerun(spark, engine):
    q = asked(spark, "gpu indexing experiments", "zebra crossing")
    engine.record("r1", q, "lexical", 2)
    with pytest.raises(Conflict):
        engine.record("r1", q, "lexical")
    kept = {r["query_id"]: r for r in engine.store.read("runs").collect()}
    assert kept[1]["hits"] > 0 and kept[2]["hits"] == 0 and kept[1]["latency_ms"] > 0 and kept[1]["top_k"] == 2
    assert engine.store.read("run_hits").count() == kept[1]["hits"] and {r["status"] for r in engine.store.read("traces").collect()} >= {"failed"}
    same = engine.rerun("r1", "again").collect()
    assert [(r["query_id"], r["score_delta"], r["changed_rank"], r["gained"], r["lost"]) for r in same] == [(1, 0.0, 0, [], [])]
    none = engine.rerun("r1", "again", sources=["nowhere"]).first()
    assert none["overlap"] == 0 and len(none["lost"]) == kept[1]["hits"] and engine.store.read("reruns").count() == 1
    with pytest.raises(KeyError):
        engine.rerun("r9", "x")


def test_repeated_ids_in_one_append_are_a_conflict(spark, engine):
    with pytest.raises(Conflict):
        engine.store.append("twice", spark.createDataFrame([(1,), (1,)], "id long"), "id")


def test_providers_need_dimensions(spark):
    with pytest.raises(ValueError):
        embed_with(HashProvider(0), spark.createDataFrame([(1, "a")], "id long, text string"), "id", "text")


def test_an_ingestion_run_is_a_row_with_totals(spark, engine):
    run = engine.store.read("ingestion_runs").where("source_id = 's1'").first()
    assert (run["status"], run["files_received"], run["documents_created"], run["chunks_created"], run["failed_files"]) == ("partial", 4, 1, 2, 3) and run["completed_at"] >= run["started_at"]
    files = spark.createDataFrame([("resume.md", None, BODY.encode(), len(BODY)), ("n.txt", None, b"A note on search.", 17)], "file_name string, content_type string, content binary, length long")
    again = engine.ingest(files, "s2", "r2").first()
    assert (again["documents_created"], again["failed_files"], again["status"]) == (2, 0, "completed")
    more = engine.ingest(files, "s2", "r3").first()
    assert (more["documents_created"], more["documents"], more["status"]) == (0, 2, "failed") and engine.store.read("sources").count() == 2
    with pytest.raises(Conflict):
        engine.ingest(files, "s2", "r3")
    engine.delete_source("s2")
    assert engine.store.read("documents").where("source_id = 's2'").count() == 0 and engine.store.read("chunks").where("source_id = 's2'").count() == 0
