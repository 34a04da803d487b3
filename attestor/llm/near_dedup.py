"""Near-duplicate documents: minwise signatures, a multi-index Hamming join and confirmation on full shingle sets.

Documents with equal shingle sets form a class. A signature has 16 chunks of 5 symbols of 16 bits. Of two signatures
that differ in at most 31 of 80 symbols some chunk differs in at most one (pigeonhole), so each chunk is indexed
under the five keys that leave one symbol out, and all pairs under that distance share a key. Two sets of similarity
0.8 share none with a probability of about 5e-10, and less the more similar they are.

No key gives all its pairs. Of the classes under one key the first is the hub, and every other is compared with it
on full sets; the distinct (hub, class) rows of all keys are the wheels. Classes of one wheel that are in the same component
by then need no comparison. While it pays, further members of wheels with several components are taken for hubs. What is left are pairs
of a class outside its wheel's main component with the classes of other components, and only such pairs as
bounds leave open are made: sizes, the triangle inequality of their exact differences from the hub, and parity bitmaps of 2048
bits, whose unequal bits are at most as many as the unequal shingles. Each of these is compared on full sets, so
no pair that shares a key goes unseen. Components are found among the hubs by propagating the smallest id with
pointer jumping over stored tables; the other classes take the label of one hub.

Defined results: null and empty texts and texts without words have no shingles and are linked with nothing; a
row with a null doc_id is linked with nothing, has a null component and is kept; rows with the same doc_id are
one node, whatever their texts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.llm.common import arrow_batches, fresh, looked_up, stored
from attestor.llm.minhash import SYMBOLS, WORDS_OF_BITS, chunk_keys, parity_bitmap, set_digest, shingle_sets, signature
from attestor.llm.tokens import slices

WORDS, PERCENT = 5, 80
#: Bits of the filter of wanted documents; its 8 MB do not grow with the data.
FILTER_BITS = 1 << 26
#: Further hubs are tried while a round joins at least one in so many of the components that it finds mixed.
WORTH = 10

#: Characters hashed at a time and rows in a batch, which bound a worker's memory.
SLICE, BATCH = 300_000, 500

_SIGNATURE = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("symbols", T.BinaryType()),
])
_BITS = [f"bits{k}" for k in range(WORDS_OF_BITS)]
_SET = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("shingles", T.BinaryType())] + [T.StructField(b, T.LongType()) for b in _BITS])


def _texts(batch) -> tuple[list, list[str]]:
    return batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, symbols of every row; digest and symbols are null without shingles."""

    def made(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            ids, texts = _texts(batch)
            for a, b in slices(texts, SLICE):
                sizes, digests, symbols = [], [], []
                for s in shingle_sets(texts[a:b], words):
                    sizes.append(len(s))
                    digests.append(set_digest(s) if len(s) else None)
                    symbols.append(signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(symbols, pa.binary())], names=_SIGNATURE.names)

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(made, _SIGNATURE)


def numbered(classes: DataFrame) -> DataFrame:
    """classes with a number of 64 bits made of the digest; a seed under which two classes share one is passed over."""
    total = classes.count()
    for seed in count():
        made = classes.withColumn("cid", F.xxhash64("digest", F.lit(seed)))
        if made.agg(F.count_distinct("cid")).first()[0] == total:
            return made


def index_keys(classes: DataFrame) -> DataFrame:
    """(key, cid): the SYMBOLS keys of every class."""

    def made(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                symbols = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u2").reshape(-1, SYMBOLS)
                keys = chunk_keys(symbols).astype(np.int64, copy=False).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(part.column(0).to_numpy(), SYMBOLS))], names=["key", "cid"])

    return classes.select("cid", "symbols").mapInArrow(made, "key long, cid long")


def _place() -> Column:
    return F.pmod(F.xxhash64("rep"), F.lit(FILTER_BITS))


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(cid, n, shingles, bitmaps) of the classes in wanted (cid, rep, digest), from the texts of their first documents."""
    wanted_bits = wanted.select(_place().alias("place")).groupBy(F.shiftright("place", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("place").bitwiseAND(32767)).alias("bits"))
    bits = stored(wanted_bits, "filter")  # at most FILTER_BITS / 32768 rows of 4096 bytes

    def made(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            _, texts = _texts(batch)
            for a, b in slices(texts, SLICE):
                found = [s for s in shingle_sets(texts[a:b], words) if len(s)]
                if found:
                    bitmaps = np.stack([parity_bitmap(s) for s in found])
                    columns = [pa.array(map(set_digest, found), pa.binary()), pa.array(map(len, found), pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(bitmaps[:, k]) for k in range(WORDS_OF_BITS)], names=_SET.names)

    rows = docs.select(docs["doc_id"].cast("long").alias("rep"), "text").where(F.col("rep").isNotNull()).withColumn("part", F.shiftright(_place(), 15))
    at = _place().bitwiseAND(32767).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    passed = rows.join(F.broadcast(bits), "part").where(F.call_function("shiftright", byte, at.bitwiseAND(7)).bitwiseAND(1) == 1)
    sets = passed.select("rep", "text").mapInArrow(made, _SET)
    return sets.dropDuplicates(["digest"]).join(wanted.select("cid", "digest"), "digest").drop("digest")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n, m, common) of the pairs (a, b): the sizes of their sets and of what they share."""

    def met(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            out = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                u, v = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                few, many = (u, v) if len(u) <= len(v) else (v, u)
                at = np.minimum(np.searchsorted(many, few), len(many) - 1)
                out.append((len(u), len(v), int((many[at] == few).sum())))
            sizes = np.array(out, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(sizes[:, k]) for k in range(3)]], names=["a", "b", "n", "m", "common"])

    left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(met, "a long, b long, n long, m long, common long")


def linked(pairs: DataFrame, percent: int) -> DataFrame:
    return pairs.where(F.col("common") * 100 >= (F.col("n") + F.col("m") - F.col("common")) * percent).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, label): one label for all nodes that links (a, b) join.

    Of the links of each b the one to its first a stays; its other ends are linked with that first one instead. So nodes that
    are no a are leaves, which take the label of their first a afterwards, and only the rest goes through rounds."""
    some = stored(links.where("a <> b").select("a", "b").distinct(), "links")
    ends = stored(looked_up(some, some.groupBy("b").agg(F.min("a").alias("first")), "b"), "ends")
    hubs = stored(ends.select(F.col("a").alias("b")).distinct(), "hubs")
    tree = ends.select("b", "first").distinct()
    bridges = ends.where("a <> first").select("first", F.col("a").alias("b")).distinct()
    inner = reached(bridges.select(F.col("first").alias("a"), "b").unionByName(tree.join(hubs, "b", "left_semi").select(F.col("first").alias("a"), "b")))
    labels = stored(hubs.join(inner.withColumnRenamed("node", "b"), "b", "left").select(F.col("b").alias("first"), F.coalesce("label", "b").alias("label")), "labels")
    leaves = stored(tree.join(hubs, "b", "left_anti"), "leaves")
    return labels.select(F.col("first").alias("node"), "label").unionByName(looked_up(leaves, labels, "first").select(F.col("b").alias("node"), "label"))


def reached(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each end of a link (a, b) reaches. Each round takes the smallest label among
    neighbours, then the label of the label; tables are stored, so rounds do not pile up lineage."""
    both = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = stored(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "labels")
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        labels = stored(step.join(jump, "label").select("node", "old", F.least("label", "beyond").alias("label")), "labels")
        if not labels.where(F.col("old") != F.col("label")).take(1):
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def placed(wheels: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (hub, cid, label, main) of the wheels in which different components meet; main is the one with most of its rows."""
    named = labels.select(F.col("node").alias("cid"), "label")
    rows = stored(wheels.select("hub", "cid").join(named, "cid", "left").select("hub", "cid", F.coalesce("label", "cid").alias("label")), "placed")
    sizes = rows.groupBy("hub", "label").agg(F.count(F.lit(1)).alias("many"))
    mains = sizes.groupBy("hub").agg(F.max(F.struct("many", "label"))["label"].alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("hub", "main")
    return stored(looked_up(rows, stored(mains, "mains"), "hub"), "mixed")


def further_hubs(mixed: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of each row of mixed with two more hubs of its wheel, one of the main component and one of the others, if
    they are in different components."""
    order = F.struct(F.xxhash64("cid", F.lit(turn)).alias("order"), "cid", "label")
    hubs = mixed.groupBy("hub").agg(F.min(F.when(F.col("label") == F.col("main"), order)).alias("x"), F.min(F.when(F.col("label") != F.col("main"), order)).alias("y"))
    rows = looked_up(mixed, stored(hubs.select("hub", F.array("x", "y").alias("hubs")), "hubs"), "hub")
    pairs = rows.select("cid", "label", F.explode("hubs").alias("h")).where(F.col("h.label") != F.col("label"))
    return pairs.select(F.greatest("cid", "h.cid").alias("a"), F.least("cid", "h.cid").alias("b")).distinct()


def _possible(percent: int) -> Column:
    """Whether the rows x and y of one wheel can have percent of their union in common: what they do not share is at least
    the difference of their sizes, that of their differences from the hub, and the number of their unequal bits."""
    unequal = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"x.{b}").bitwiseXOR(F.col(f"y.{b}"))) for b in _BITS])
    most = (F.col("x.n") + F.col("y.n")) * (100 - percent)
    return reduce(lambda a, b: a & b, [least * (100 + percent) <= most for least in (F.abs(F.col("x.n") - F.col("y.n")), F.abs(F.col("x.apart") - F.col("y.apart")), unequal)])


def open_pairs(wheels: DataFrame, mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) in different components of a wheel that the bounds leave open."""
    rows = stored(mixed.join(wheels, ["hub", "cid"]).join(sets.select("cid", "n", *_BITS), "cid"), "open-rows")
    x, y = rows.where("label <> main").alias("x"), rows.alias("y")
    apart = (F.col("x.label") != F.col("y.label")) & ((F.col("y.label") == F.col("y.main")) | (F.col("x.cid") > F.col("y.cid")))
    met = x.join(y, (F.col("x.hub") == F.col("y.hub")) & apart & _possible(percent))
    return met.select(F.greatest("x.cid", "y.cid").alias("a"), F.least("x.cid", "y.cid").alias("b")).distinct()


def class_links(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """The links (a, b) between classes that decide the components."""
    keys = index_keys(classes)
    hubs = stored(keys.groupBy("key").agg(F.min("cid").alias("hub"), F.max("cid").alias("last")).where("hub < last").select("key", "hub"), "hubs")
    spokes = stored(keys.join(hubs, "key").where("cid <> hub").select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct(), "spokes")
    ends = stored(spokes.select(F.col("a").alias("cid")).union(spokes.select("b")).distinct(), "ends")
    sets = stored(sets_of(docs, stored(classes.join(ends, "cid").select("cid", "rep", "digest"), "wanted"), words), "sets")
    tried = stored(compared(spokes, sets), "compared")
    links = linked(tried, percent)
    apart = tried.select(F.col("a").alias("hub"), F.col("b").alias("cid"), (F.col("n") + F.col("m") - 2 * F.col("common")).alias("apart"))
    wheels = stored(apart.unionByName(tried.select(F.col("a").alias("hub")).distinct().select("hub", F.col("hub").alias("cid"), F.lit(0).cast("long").alias("apart"))), "wheels")
    mixed = placed(wheels, components(links))
    for turn in count():
        before = mixed.agg(F.count_distinct("label")).first()[0]
        if not before:
            return links
        more = linked(stored(compared(stored(further_hubs(mixed, turn), "pairs"), sets), "compared"), percent)
        joined = 0
        if more.take(1):
            links = stored(links.unionByName(more), "links")
            mixed = placed(wheels, components(links))
            joined = before - mixed.agg(F.count_distinct("label")).first()[0]
        if joined * WORTH < before:
            rest = stored(open_pairs(wheels, mixed, sets, percent), "open-pairs")
            return links.unionByName(linked(stored(compared(rest, sets), "compared"), percent))


def same_document(filled: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of one doc_id that has several texts."""
    several = filled.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("doc_id")
    held = filled.select("doc_id", "digest").join(several, "doc_id", "left_semi").distinct().join(classes.select("digest", "cid"), "digest")
    return looked_up(stored(held, "several-texts"), held.groupBy("doc_id").agg(F.min("cid").alias("a")), "doc_id").select("a", F.col("cid").alias("b")).where("a <> b")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text)."""
    with arrow_batches(docs.sparkSession, BATCH):
        marks = stored(signatures(docs, words), "signatures")
        filled = marks.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
        classes = numbered(stored(filled.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by("symbols", "doc_id").alias("symbols")), "classes"))
        labels = components(class_links(docs, classes, words, percent).unionByName(same_document(filled, classes)))
        named = stored(classes.select("cid", "digest", "rep").join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left"), "named")
        linked_ones = named.where(F.col("label").isNotNull())
        firsts = stored(linked_ones.groupBy("label").agg(F.min("rep").alias("component_id")), "firsts")
        settled = looked_up(linked_ones, firsts, "label").select("digest", "component_id").unionByName(named.where(F.col("label").isNull()).select("digest", F.col("rep").alias("component_id")))
        rows = looked_up(filled.select("doc_id", "n_shingles", "digest"), stored(settled, "class-components"), "digest").drop("digest")
    alone = marks.where(F.col("digest").isNull() | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.unionByName(alone).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component, all columns as they were; of rows with one doc_id one stays."""
    mark, gone = fresh(docs, "mark", "gone")
    verdict = stored(near_duplicates(docs, words, percent), "near-verdict")
    lost = verdict.where(~F.col("kept")).select(F.col("doc_id").alias(mark)).distinct()
    again = verdict.where(F.col("kept") & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias(mark)).count().where("count > 1").select(mark)
    marks = stored(lost.withColumn(gone, F.lit(True)).unionByName(again.withColumn(gone, F.lit(False))), "near-marks")
    met = docs.join(marks, docs["doc_id"] == marks[mark], "left")
    once = met.where(F.col(mark).isNull()).select(*[docs[c] for c in docs.columns])
    if not again.take(1):
        return once
    return once.unionByName(met.where(~F.col(gone)).dropDuplicates([mark]).select(*[docs[c] for c in docs.columns]))
