"""Packing of token ids into fixed windows by Karmarkar-Karp multiway differencing.

A document is its ids and a closing id. Whole windows are cut from its front; the rest, shorter than a window,
joins a group. When the rests of a group fill WINDOWS windows, some of them are cut into fragments and the
group is partitioned: every fragment starts as a partial partition of one part, and the two partial partitions
with the largest spread are merged again and again, largest parts against smallest, so that opposing
imbalances cancel. While a part of the result exceeds the capacity, the number of windows rises by one.

A group is filled from the rows of one input partition in their order, so packing needs no shuffle, a task
holds one group at a time, and a task that is run again gives the same rows.

Defined results: null text counts as empty (its one piece is the closing id); repeated rows are packed each for
itself; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import cycle

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from attestor.llm.tokens import default_vocabulary, slices, word_cache

CAPACITY = 1024
#: Windows in a group; tokens a full group leaves free in each, so that a small spread needs no further window.
WINDOWS, SLACK = 32, 2
#: Share of a group's tokens that is cut into fragments, and their lengths, in turn: unequal lengths even out.
FINE_SHARE = 0.25
FRAGMENTS = (128, 90, 61, 43, 29, 17, 11, 7, 5, 3, 2, 1)

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
])


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: the indexes of sizes in k parts of nearly equal sums."""
    import numpy as np

    heap = []
    for i, size in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[-1] = size
        heap.append((-size, i, sums, [None] * (k - 1) + [(i, None, None)]))
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        _, _, a, parts_a = heapq.heappop(heap)
        _, _, b, parts_b = heapq.heappop(heap)
        sums = a + b[::-1]
        by = np.argsort(sums, kind="stable")
        merged = [_join(parts_a[j], parts_b[k - 1 - j]) for j in by.tolist()]
        sums = sums[by]
        heapq.heappush(heap, (int(sums[0] - sums[-1]), order, sums - sums[0], merged))
        order += 1
    return [_leaves(part) for part in heap[0][3]] if heap else [[] for _ in range(k)]


def _join(a, b):
    return a if b is None else b if a is None else (None, a, b)


def _leaves(part) -> list[int]:
    out, stack = [], [part]
    while stack:
        node = stack.pop()
        if node is None:
            continue
        index, a, b = node
        if index is not None:
            out.append(index)
        else:
            stack += (b, a)
    return out


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """As few near-equal windows as differencing fits the sizes (each at most capacity) into."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = difference(sizes, k)
        if max(sum(sizes[i] for i in p) for p in parts) <= capacity:
            return [p for p in parts if p]
        k += 1


def fragments(rests: list[tuple[int, int]], capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """(document, start, length) of the rests (start, length), the shortest of which are cut finely, up to FINE_SHARE of all tokens."""
    fine = FINE_SHARE * sum(n for _, n in rests)
    pieces = []
    for d in sorted(range(len(rests)), key=lambda d: (rests[d][1], d)):
        start, n = rests[d]
        if fine <= 0:
            pieces.append((d, start, n))
            continue
        fine -= n
        stop, turn = start + n, cycle(FRAGMENTS)
        while start < stop:
            size = min(next(turn), stop - start)
            pieces.append((d, start, size))
            start += size
    return pieces


def pack_partition(batches: Iterator, vocabulary: str, end_id: int, capacity: int, entries: int | None = None):
    """pack() of one partition of Arrow batches (doc_id, text)."""
    import pyarrow as pa

    cache, made = word_cache(vocabulary), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
    cache.limit(entries)
    closing = end_id.to_bytes(4, "little")
    rows: list[tuple] = []
    group: list[tuple[int | None, bytes, int, int]] = []  # doc_id, ids of the rest, its start, doc_tokens
    held = 0
    full = WINDOWS * (capacity - SLACK)

    def flush():
        nonlocal made, held
        if not group:
            return
        pieces = fragments([(start, len(raw) // 4) for _, raw, start, _ in group], capacity)
        for window in windows([n for _, _, n in pieces], capacity):
            offset = 0
            for d, start, n in sorted(pieces[i] for i in window):
                doc_id, raw, first, total = group[d]
                at = (start - first) * 4
                rows.append((doc_id, start, n, zlib.crc32(raw[at : at + 4 * n]), total, made, offset))
                offset += n
            made += 1
        group.clear()
        held = 0

    for batch in batches:
        ids_of, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        for a, b in slices(texts, 5 * entries) if entries else slices(texts):
            for doc_id, raw in zip(ids_of[a:b], cache.encode(texts[a:b]), strict=True):
                raw += closing
                n = len(raw) // 4
                whole = n - n % capacity
                for start in range(0, whole, capacity):
                    rows.append((doc_id, start, capacity, zlib.crc32(raw[4 * start : 4 * (start + capacity)]), n, made, 0))
                    made += 1
                while whole < n:
                    take = min(n - whole, full - held)
                    group.append((doc_id, raw[4 * whole : 4 * (whole + take)], whole, n))
                    whole, held = whole + take, held + take
                    if held == full:
                        flush()
            if len(rows) > 20_000:
                yield _batch(pa, rows)
                rows = []
    flush()
    if rows:
        yield _batch(pa, rows)
    if entries:
        cache.limit(1)
        pa.default_memory_pool().release_unused()


def _batch(pa, rows):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=SCHEMA.names)


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, capacity: int = CAPACITY, entries: int | None = None) -> DataFrame:
    """A row for each piece of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    entries: how many words each worker's caches keep, and only while a partition lasts; fewer take less memory and more
    time. By default they keep more, from one partition to the next.
    """
    vocabulary = vocabulary or default_vocabulary()
    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(lambda it: pack_partition(it, vocabulary, end_id, capacity, entries), SCHEMA)
