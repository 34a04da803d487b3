"""Recommendations merged over failures."""

from attestor.operators.diagnosis import FAILURES, REASONS, RECOMMENDATIONS, recommendations


def test_failures_of_one_remedy_are_merged_in_their_order(spark):
    kind = "query_id long, failures array<struct<severity:int,order:int,code:string,refs:array<string>>>"
    held = [(1, [(1, 9, "duplicate_evidence", ["E2", "E1"]), (1, 10, "heading_only_evidence", ["E3", "E2"]), (2, 11, "low_score_margin", ["E1"])]), (2, [(0, 1, "missing_embedding_index", []), (1, 6, "partial_embedding_index", [])]), (3, [])]
    rows = {(r["query_id"], r["place"]): r for r in recommendations(spark.createDataFrame(held, kind)).collect()}
    assert {k: (r["code"], r["priority"], r["failure_codes"], r["evidence_refs"]) for k, r in rows.items()} == {
        (1, 1): ("improve_chunk_boundaries", 1, ["duplicate_evidence", "heading_only_evidence"], ["E2", "E1", "E3"]), (1, 2): ("add_reranking", 2, ["low_score_margin"], ["E1"]),
        (2, 1): ("repair_embedding_index", 0, ["missing_embedding_index", "partial_embedding_index"], []),
    }
    assert rows[(2, 1)]["action"].startswith("Index missing") and {advice for _, _, advice, _ in FAILURES} == set(REASONS) == set(RECOMMENDATIONS)
