"""Evaluation cases from passages that documents are known to hold."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from attestor.operators.reach import by_blocks

MAX_PASSAGES = 50_000  # of a block; more passages make more blocks


def passage_documents(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, chunk_ids (none), document_ids of every passage (item_id, text) that stands in a document (document_id, text).

    An automaton of each block of passages runs once over each text. A passage stands in one block with all its texts, so
    no document counts for it twice.
    """
    wanted = passages.where("text <> ''").groupBy("item_id").agg(F.collect_set("text").alias("texts"))
    pairs = by_blocks(wanted, MAX_PASSAGES, lambda rows: _holding(docs, rows))
    return pairs.groupBy("query_id").agg(F.array_sort(F.collect_list("document_id")).alias("document_ids")).withColumn("chunk_ids", F.array().cast("array<string>"))


def _holding(docs: DataFrame, rows: list[Row]) -> DataFrame:
    """query_id, document_id of passages (item_id, texts) and the documents that hold them."""
    by_text: dict[str, list[int]] = {}
    for r in rows:
        for text in r["texts"]:
            by_text.setdefault(text, []).append(r["item_id"])
    shared = docs.sparkSession.sparkContext.broadcast(by_text)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for text, ids in shared.value.items():
            automaton.add_word(text, ids)
        if shared.value:
            automaton.make_automaton()
        for batch in batches:
            out = []
            for document_id, text in zip(batch["document_id"], batch["text"], strict=True):
                out += [(i, document_id) for i in {i for _, ids in (automaton.iter(text) if shared.value else ()) for i in ids}]
            yield pd.DataFrame(out, columns=["query_id", "document_id"])

    return docs.select("document_id", "text").mapInPandas(found, "query_id long, document_id string")
