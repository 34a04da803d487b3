"""More queries than one block holds give what one block gives."""

import pytest
from helpers import rows

from attestor.operators import cases, reach
from attestor.plans.queries import QUERIES


@pytest.mark.parametrize("name", ["op_j8_vector_search", "op_r_lexical_retrieval", "op_r8_hybrid_retrieval", "op_j10_expected_documents"])
def test_blocks(spark, small, name, monkeypatch):
    want = rows(QUERIES[name](spark, small).toPandas())
    n = 11 if name == "op_j8_vector_search" else 6
    monkeypatch.setattr(reach, "MAX_QUERIES", n)
    monkeypatch.setattr(cases, "MAX_PASSAGES", n)
    monkeypatch.setattr(reach, "MAX_CELLS", 100)
    assert want and rows(QUERIES[name](spark, small).toPandas()) == want


def test_every_row_is_in_one_block(spark):
    for n in (0, 1, 6, 7, 15):
        found = list(reach.blocks(spark.range(n), 7))
        assert max(map(len, found)) <= 7 and sorted(r["id"] for b in found for r in b) == list(range(n))
