"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, for every i, the hash of its first i code points as a polynomial modulo a
prime; two entries give the hash of any span, so any two spans are compared in constant time and the longest
common extension of two texts is found by binary search. A fingerprint keeps what a comparison needs: the
number of code points, the whole hash under two primes, and prefix entries at every multiple of a power of two
(32 to 63 of them, all positions for shorter texts) with the hashes of some spans at the end. Multiples of
the larger power are common to two fingerprints, so texts of different lengths compare too. The array of a
text put together from two others is put together from their arrays.

Documents are ordered by descending doc_id through buckets between approximate quantiles of doc_id; the first
document of each bucket is also sent to the bucket before it, so each bucket is read as a stream and no task
holds more than two documents and a batch.

Defined results: null text counts as empty; two empty texts are alike (1), an empty and another are not (0);
equal doc_ids are ordered by text; a single document is its own next; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (prime, base): both primes are below 2**31, so products fit into 64 bits.
FIELDS = ((2147483647, 911382323), (2147483629, 972663749))
BLOCK = 1 << 18
TAIL_STEPS = 6

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
])


@lru_cache(maxsize=4)
def powers(field: int) -> np.ndarray:
    """base**k modulo the prime for k below BLOCK."""
    p, base = FIELDS[field]
    out = np.ones(1, np.int64)
    while len(out) < BLOCK:
        out = np.concatenate([out, out * pow(base, len(out), p) % p])
    return out


class Prefixes:
    """The prefix arrays of a text: entry i is the hash of its first i code points."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        self.n = len(points)
        self.fields = [self._array(points, f) for f in range(len(FIELDS))]

    @staticmethod
    def _array(points: np.ndarray, field: int) -> np.ndarray:
        p, base = FIELDS[field]
        out = np.zeros(len(points) + 1, np.uint32)
        held = 0
        for at in range(0, len(points), BLOCK):
            part = points[at : at + BLOCK].astype(np.int64) + 1
            part *= powers(field)[: len(part)]
            part %= p
            part = np.cumsum(part) % p
            if at:
                part = (part * pow(base, at, p) + held) % p
            out[at + 1 : at + 1 + len(part)] = part
            held = int(part[-1])
        return out

    def at(self, field: int, places: np.ndarray) -> np.ndarray:
        return self.fields[field][places].astype(np.int64)


class Spliced:
    """The prefix arrays of the first ``head`` code points of one text followed by the first ``tail`` of another."""

    def __init__(self, a: Prefixes, head: int, b: Prefixes, tail: int):
        self.a, self.head, self.b, self.n = a, head, b, head + tail

    def at(self, field: int, places: np.ndarray) -> np.ndarray:
        p, base = FIELDS[field]
        own = self.a.at(field, np.minimum(places, self.head))
        more = self.b.at(field, np.maximum(places - self.head, 0)) * pow(base, self.head, p) % p
        return (own + more) % p


def span_hash(prefixes: Prefixes | Spliced, start: int, stop: int, field: int = 0) -> int:
    """The hash of a span as if it began a text."""
    p, base = FIELDS[field]
    a, b = prefixes.at(field, np.array([start, stop])).tolist()
    return (b - a) * pow(base, -start, p) % p


def common_extension(x: Prefixes, i: int, y: Prefixes, j: int) -> int:
    """How many code points from i in x equal those from j in y."""
    low, high = 0, min(x.n - i, y.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if all(span_hash(x, i, i + mid, f) == span_hash(y, j, j + mid, f) for f in range(len(FIELDS))):
            low = mid
        else:
            high = mid - 1
    return low


def fingerprint(prefixes: Prefixes | Spliced) -> str:
    """Length, block exponent, hashes under both primes, prefix entries by blocks, hashes of spans at the end."""
    n = prefixes.n
    shift = max(0, n.bit_length() - 6)
    whole = [int(prefixes.at(f, np.array([n]))[0]) for f in range(len(FIELDS))]
    grid = prefixes.at(0, np.arange(1, (n >> shift) + 1) << shift).astype(">u4").tobytes().hex()
    tails = b"".join(span_hash(prefixes, n - g, n).to_bytes(4, "big") for g in tail_lengths(n, shift)).hex()
    return f"{n:x}-{shift:x}-{whole[0]:08x}{whole[1]:08x}-{grid}-{tails}"


def tail_lengths(n: int, shift: int) -> list[int]:
    return [g for g in (1 << (shift + k) for k in range(TAIL_STEPS)) if g <= n]


def _parsed(text: str) -> tuple[int, int, np.ndarray, dict[int, str]]:
    n, shift, _, grid, tails = text.split("-")
    count, size = int(n, 16), int(shift, 16)
    return count, size, np.frombuffer(bytes.fromhex(grid), ">u4").astype(np.int64), dict(zip(tail_lengths(count, size), (tails[k : k + 8] for k in range(0, len(tails), 8)), strict=True))


def likeness(a: str, b: str) -> float:
    """Share of the longer text that two fingerprints show to be equal: the common beginning (by binary search), then
    the larger of the equal blocks after it and the common end."""
    if a == b:
        return 1.0
    n, shift_a, grid_a, tails_a = _parsed(a)
    m, shift_b, grid_b, tails_b = _parsed(b)
    shift = max(shift_a, shift_b)
    # Entry k of the thinned grids belongs to the first k + 1 blocks of the larger size.
    x, y = grid_a[(1 << (shift - shift_a)) - 1 :: 1 << (shift - shift_a)], grid_b[(1 << (shift - shift_b)) - 1 :: 1 << (shift - shift_b)]
    k = min(len(x), len(y))
    x, y = x[:k], y[:k]
    first = bisect_left(range(k), True, key=lambda i: bool(x[i] != y[i]))
    p = FIELDS[0][0]
    equal = int(((np.diff(x[first:]) - np.diff(y[first:])) % p == 0).sum()) if first < k else 0
    head, common = first << shift, sorted(g for g in tails_a if g in tails_b)
    matched = bisect_left(range(len(common)), True, key=lambda i: tails_a[common[i]] != tails_b[common[i]])
    tail = min(common[matched - 1], min(n, m) - head) if matched else 0
    return min(1.0, (head + max(equal << shift, tail)) / max(n, m))


def boundaries(docs: DataFrame, buckets: int) -> tuple[list[int], list[int | None]]:
    """Ascending cuts between buckets of about equal size, and the largest doc_id of each bucket (None where empty)."""
    at = [k / buckets for k in range(1, buckets)]
    if at:
        cuts = docs.agg(F.percentile_approx("doc_id", at, max(10_000, 20 * buckets)).alias("cuts")).first()["cuts"] or []
    else:
        cuts = []
    cuts = sorted(set(cuts))
    bucket = _bucket_column(cuts)
    top: list[int | None] = [None] * (len(cuts) + 1)
    for r in docs.select("doc_id", bucket(F.col("doc_id")).alias("bucket")).groupBy("bucket").agg(F.max(F.coalesce("doc_id", F.lit(NO_ID))).alias("top")).collect():
        top[r["bucket"]] = r["top"]
    return cuts, top


#: Stands for a null doc_id: the smallest of all.
NO_ID = -(2**63)


def _bucket_column(cuts: list[int]):
    held = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        values = ids.astype("Int64").fillna(NO_ID).to_numpy(np.int64)
        return pd.Series(np.searchsorted(held, values, side="left").astype(np.int32))

    return bucket


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, guard, doc_id, text), ordered by bucket, guard and descending doc_id within partitions: in each bucket
    every row but a guard is followed by the next document, the last one by a guard."""
    docs = docs.select(docs["doc_id"].cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    cuts, top = boundaries(docs, buckets)
    full = [b for b, t in enumerate(top) if t is not None]
    above = {b: full[(k + 1) % len(full)] for k, b in enumerate(full)}  # of the last, the first: there the order closes
    held, tops = np.array(cuts, np.int64), np.array([NO_ID if t is None else t for t in top], np.int64)
    targets = np.array([above.get(b, 0) for b in range(len(top))], np.int32)

    @F.pandas_udf("array<int>")
    def sent_to(ids: pd.Series) -> pd.Series:
        values = ids.astype("Int64").fillna(NO_ID).to_numpy(np.int64)
        own = np.searchsorted(held, values, side="left")
        leads = values == tops[own]
        return pd.Series([[int(b), int(targets[b])] if lead else [int(b)] for b, lead in zip(own, leads, strict=True)])

    sent = docs.select("doc_id", "text", F.posexplode(sent_to(F.col("doc_id"))).alias("guard", "bucket"))
    return sent.select("bucket", "guard", "doc_id", "text").repartition("bucket").sortWithinPartitions("bucket", "guard", F.desc_nulls_last("doc_id"), "text")


def compare_partition(batches: Iterator):
    """The result rows of a stream of with_next()."""
    import pyarrow as pa

    waiting = None  # bucket, doc_id, text, prefixes
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for bucket, guard, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if guard and waiting is None:
                continue  # a further row with the guard's doc_id
            here = Prefixes(text)
            mark = fingerprint(here)
            if waiting is not None:
                rows.append(compared(waiting, text, here, mark))
                held += len(text)
            waiting = None if guard else (doc_id, text, here, mark)
            if held > 4_000_000 or len(rows) >= 5000:
                yield _batch(pa, rows)
                rows, held = [], 0
    if rows:
        yield _batch(pa, rows)


def compared(this: tuple, next_text: str, next_prefixes: Prefixes, next_mark: str) -> tuple:
    doc_id, text, prefixes, mark = this
    n = len(text)
    keep, tail = n - n // 2, min(n // 2, len(next_text))
    edited = text[:keep] + next_text[:tail]
    edited_mark = fingerprint(Spliced(prefixes, keep, next_prefixes, tail))
    return doc_id, n, hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), mark, edited_mark, likeness(mark, edited_mark), likeness(mark, next_mark)


def _batch(pa, rows):
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=SCHEMA.names)


def compare_with_edited_and_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """For each row of docs (doc_id, text): its fingerprint, that of the text with its last half replaced by the beginning
    of the next document in descending doc_id order, and the likeness to both."""
    buckets = buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return with_next(docs, buckets).mapInArrow(compare_partition, SCHEMA)


def fingerprint_column(text):
    """A column of fingerprints."""

    @F.pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(Prefixes(t or "")))

    return made(text)
