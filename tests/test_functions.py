import hashlib
import uuid

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestor.functions import hashing, text, times
from attestor.operators import answer, retrieval
from attestor.operators.evals import percentiles


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1)]).select(column.alias("x")).first()["x"]


def test_query_terms_are_sorted_and_lose_stop_words(spark):
    assert one(spark, text.query_terms(F.lit("What GPU-indexing skills? GPU"))) == ["gpu", "indexing", "skills"]


def test_only_ascii_is_folded(spark):
    assert one(spark, text.normalized_tokens(F.lit("É Été ABC"))) == ["É", "Été", "abc"]


def test_sentences_split_inside_numbers(spark):
    assert one(spark, text.split_sentences(F.lit("a 2.5 b! c\n"))) == ["a 2", "5 b", " c"]


def test_snippets(spark):
    assert one(spark, text.truncate_chars(F.lit("abcdef"), 3)) == "abc..."
    assert one(spark, text.bounded_snippet(F.lit("x" * 281))) == "x" * 277 + "..."
    assert one(spark, text.best_snippet(F.lit("no. gpu here. gpu index here"), F.array(F.lit("gpu"), F.lit("index")))) == "gpu index here"
    assert one(spark, text.best_snippet(F.lit(" none at all "), F.array(F.lit("gpu")))) == "none at all"


def test_headings(spark):
    heading = lambda s: one(spark, text.section_heading(F.lit(s)))
    assert heading("Technical  Skills:") == "Skills"
    assert heading("HPC, GPU AND RAG") == "HPC, GPU AND RAG"
    assert heading("## Reset a password") is None
    assert heading("Reset Your Password") == "Reset Your Password"
    assert heading("This ends.") is None
    assert heading("- Bullet") is None


def test_heading_only(spark):
    only = lambda s, t=None: one(spark, text.is_heading_only(F.lit(s), F.lit(t).cast("string")))
    assert only("") and only("Projects") and only("projects now are many here too, really", "PROJECTS now are many here too, really")
    assert not only("Built a tool.") and not only("one two three four five six seven")


def test_feature_hash(spark):
    f = lambda s: (one(spark, hashing.feature_index(F.lit(s))), one(spark, hashing.feature_sign(F.lit(s))))
    assert f("token:gpu") == (276, -1) and f("concept:accelerated-compute") == (84, 1) and f("bigram:a:b") == (115, 1)


def test_stable_uuid(spark):
    digest = bytearray(hashlib.sha256(b"k").digest()[:16])
    digest[6], digest[8] = digest[6] & 0x0F | 0x50, digest[8] & 0x3F | 0x80
    assert one(spark, hashing.stable_uuid(F.lit("k"))) == str(uuid.UUID(bytes=bytes(digest)))


def test_cosine(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, hashing.cosine(v(1, 0), v(1, 0))) == 1.0
    assert one(spark, hashing.cosine(v(1, 0), v(1, 0, 0))) == 0.0 and one(spark, hashing.cosine(v(0, 0), v(1, 0))) == 0.0


def test_legacy_time(spark):
    parts = F.array(*[F.lit(x) for x in (2026, 178, 12, 30, 1, 500_000_000, 0, 0, 0)])
    assert str(one(spark, times.legacy_time(parts).cast("string"))) == "2026-06-27 12:30:01.5"


def test_percentiles(spark):
    def of(*values):
        row = percentiles(spark.createDataFrame([("k", v) for v in values], "mode string, v long"), "mode", "v", {"p50": 0.5, "p95": 0.95}).first()
        return row["p50"], row["p95"]

    assert of(4, 1, 3, 2)[0] == 3 and of(0, 1)[0] == 1 and of(*range(5)) == (2, 4) and of(*range(21)) == (10, 19) and of(7, 7, 7, 1) == (7, 7)


def test_required_matches(spark):
    assert [one(spark, answer.required_matches(F.lit(n))) for n in range(7)] == [0, 1, 2, 2, 2, 3, 3]


def test_modes_and_top_k(spark):
    assert retrieval.normalized_modes([]) == ["hybrid", "vector", "lexical"]
    assert retrieval.normalized_modes(["lexical", "hybrid", "lexical"]) == ["hybrid", "lexical"]
    assert [one(spark, retrieval.normalized_top_k(F.lit(k))) for k in (0, 3, 99)] == [5, 3, 25]


def chunk_rows(spark, *items):
    from attestor.operators.intelligence import annotate_quality

    schema = "chunk_id string, document_id string, source_id string, path string, ordinal int, text string, token_count int, section_title string"
    data = [(f"c{i}", f"d{i}", "s", path, 0, body, len(body.split()), section) for i, (path, section, body) in enumerate(items)]
    return annotate_quality(spark.createDataFrame(data, schema))


def hits(spark, query, *items):
    from attestor.operators.retrieval import retrieve

    return retrieve(chunk_rows(spark, *items), spark.createDataFrame([(1, query)], "query_id long, query string")).orderBy("rank").collect()


def test_worked_scores(spark):
    (hit,) = hits(spark, "gpu indexing", ("resume.md", "Projects", "Built GPU indexing experiments."))
    assert (hit["lexical"], hit["phrase"], hit["section"], hit["path_score"], hit["metadata"], hit["score"], hit["strength"]) == (2.55, 1.2, 0.0, 0.0, 0.1, 3.85, "medium")  # four tokens are flagged too short
    (hit,) = hits(spark, "projects resume", ("resume.md", "Projects", "Built a local search tool."))
    assert (hit["lexical"], hit["phrase"], hit["section"], hit["path_score"], hit["score"]) == (2.55, 0.0, 0.375, 0.25, 3.275)


def test_phrases_are_substrings_of_sorted_pairs(spark):
    (hit,) = hits(spark, "debugger rag", ("a.md", None, "this is a RAG debugger for you"))
    assert hit["phrase"] == 0.0
    (hit,) = hits(spark, "rag debugger", ("a.md", None, "cloud storag debugger, rag debugger"))
    assert hit["phrase"] == 1.2


def test_equal_chunks_are_one_hit(spark):
    found = hits(spark, "gpu", ("b.md", None, "gpu once"), ("a.md", None, "gpu once"), ("c.md", None, "gpu twice gpu"))
    assert [(h["path"], h["duplicate_count"]) for h in found] == [("c.md", 1), ("a.md", 2)]
    assert "duplicate" in found[1]["hit_flags"]


def test_numbers_must_stand_in_one_sentence(spark):
    from attestor.operators.retrieval import retrieve

    body = "Retention is 30 days for logs today and always. Backups of the archive stay for ninety more days here."
    rows = retrieve(chunk_rows(spark, ("p.md", None, body)), spark.createDataFrame([(1, "backups archive stored 30")], "query_id long, query string"))
    assert answer.assess(rows).first()["support_status"] == "unsupported"


def test_queries_without_hits_keep_an_answer(spark):
    from attestor.operators.diagnosis import diagnose
    from attestor.operators.retrieval import retrieve

    asked = spark.createDataFrame([(1, "gpu"), (2, "zebra")], "query_id long, query string")
    support = answer.assess(retrieve(chunk_rows(spark, ("a.md", None, "The gpu index is fast and good for search.")), asked))
    answers = answer.answers(asked, support)
    assert {r["query_id"]: r["status"] for r in answers.collect()} == {1: "answered", 2: "insufficient_evidence"}
    found = {r["query_id"]: r for r in diagnose(asked, support, answers, "lexical").collect()}
    assert found[2]["outcome"] == "failing" and found[2]["codes"] == ["missing_document"] and found[1]["outcome"] == "strong"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab .!?\n", max_size=30), min_size=1, max_size=5))
def test_sentences_property(spark, texts):
    import re

    got = spark.createDataFrame([(t,) for t in texts], "t string").select(text.split_sentences(F.col("t")).alias("s")).collect()
    assert [r["s"] for r in got] == [[p for p in re.split(r"[.!?\n]", t) if p] for t in texts]
