"""Token-id files: independent zstandard frames with a trailing seek table.

A file is a run of zstandard frames, each with its own content checksum, then two skippable frames: an index
of the documents' frames and the seek table of the public zstandard seekable format, which has the compressed size,
the content size and the low 32 bits of the content's XXH64 for every frame before it (the index has no content),
the number of frames and a magic number. The content of a frame is the number of its documents, a bit for each null
doc_id, the doc_ids, the token counts and the ids, little-endian, two bytes an id where the
vocabulary allows. A reader takes the two trailing frames and then decompresses only the frames it needs.

Documents are written in ascending doc_id order (a null id first, repeated rows next to each other): a range
shuffle orders them, each task writes one file under a name of its own attempt and reports one manifest row.
The manifest, a row for each file, is all that reaches the driver. A task that is run again writes another
file; only reported files are read.

Defined results: null text counts as empty, so its ids are the end id alone; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from attestor.llm.common import arrow_batches, scratch
from attestor.llm.tokens import default_vocabulary, slices, word_cache

SEEKABLE_MAGIC, SEEK_TABLE, INDEX = 0x8F92EAB1, 0x184D2A5E, 0x184D2A5D
#: A frame is closed when its documents have this many ids.
FRAME_IDS = 256 * 1024
#: Documents that a worker gets at a time.
BATCH = 1000

MANIFEST = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("docs", T.LongType()), T.StructField("tokens", T.LongType()),
])
DIGEST = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])


def filesystem(uri: str):
    """The pyarrow file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def checksum(content: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


class FrameWriter:
    """Writes documents in the order given to an open binary stream."""

    def __init__(self, out, id_bytes: int, level: int = 1):
        import zstandard

        self.out, self.id_bytes = out, id_bytes
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int, int, int, int]] = []  # compressed, content, checksum, documents, tokens
        self._clear()

    def _clear(self):
        self.ids, self.counts, self.raw, self.held = [], [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit."""
        self.ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.raw.append(ids)
        self.held += len(ids) // 4
        if self.held >= FRAME_IDS:
            self.flush()

    def flush(self) -> None:
        if not self.ids:
            return
        import numpy as np

        n = len(self.ids)
        values = np.frombuffer(b"".join(self.raw), "<u4").astype(f"<u{self.id_bytes}", copy=False)
        nulls, ids = np.packbits([i is None for i in self.ids]).tobytes(), np.array([i or 0 for i in self.ids], "<i8").tobytes()
        content = struct.pack("<I", n) + nulls + ids + np.array(self.counts, "<u4").tobytes() + values.tobytes()
        frame = self.compressor.compress(content)
        self.out.write(frame)
        self.frames.append((len(frame), len(content), checksum(content), n, self.held))
        self._clear()

    def close(self) -> tuple[int, int]:
        """Documents and tokens written."""
        self.flush()
        index = struct.pack("<B", self.id_bytes) + b"".join(struct.pack("<II", n, tokens) for *_, n, tokens in self.frames)
        self.out.write(struct.pack("<II", INDEX, len(index)) + index)
        entries = [f[:3] for f in self.frames] + [(8 + len(index), 0, checksum(b""))]
        table = b"".join(struct.pack("<III", *e) for e in entries) + struct.pack("<IBI", len(entries), 0x80, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SEEK_TABLE, len(table)) + table)
        return sum(f[3] for f in self.frames), sum(f[4] for f in self.frames)


class FrameReader:
    """Reads the frames of a seekable binary stream of a known size."""

    def __init__(self, source, size: int):
        self.source = source
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flags != 0x80:
            raise ValueError("not a file with a seek table")
        table = size - 9 - 12 * count
        *entries, (length, _, _) = struct.iter_unpack("<III", self._at(table, 12 * count))
        body = self._at(table - 8 - length, length)
        if struct.unpack("<II", body[:8]) != (INDEX, length - 8) or length != 9 + 8 * len(entries):
            raise ValueError("no document index before the seek table")
        self.id_bytes = body[8]
        docs = list(struct.iter_unpack("<II", body[9:]))
        self.frames, at, first, start = [], 0, 0, 0
        for (packed, content, digest), (n, tokens) in zip(entries, docs, strict=True):
            self.frames.append({"at": at, "packed": packed, "content": content, "checksum": digest, "first": first, "docs": n, "start": start, "tokens": tokens})
            at, first, start = at + packed, first + n, start + tokens

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, k: int) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, ids before it in the file, its ids as little-endian unsigned 32-bit) of the documents of a frame."""
        import numpy as np
        import zstandard

        f = self.frames[k]
        content = zstandard.ZstdDecompressor().decompress(self._at(f["at"], f["packed"]))
        if len(content) != f["content"] or checksum(content) != f["checksum"]:
            raise ValueError(f"frame {k} is damaged")
        (n,) = struct.unpack_from("<I", content)
        at = 4 + (n + 7) // 8
        null = np.unpackbits(np.frombuffer(content, "u1", at - 4, 4))[:n].tolist()
        ids, counts = np.frombuffer(content, "<i8", n, at), np.frombuffer(content, "<u4", n, at + 8 * n)
        values = np.frombuffer(content, f"<u{self.id_bytes}", -1, at + 12 * n).astype("<u4").tobytes()
        start, at = f["start"], 0
        for doc_id, none, count in zip(ids.tolist(), null, counts.tolist(), strict=True):
            yield (None if none else doc_id), start, values[4 * at : 4 * (at + count)]
            start, at = start + count, at + count

    def documents(self, numbers: Iterable[int]) -> Iterator[tuple[int | None, int, bytes]]:
        """The documents of these places in the file (from 0); frames without one stay compressed."""
        firsts = [f["first"] for f in self.frames]
        wanted: dict[int, set[int]] = {}
        for n in numbers:
            k = bisect_right(firsts, n) - 1
            if n >= 0 and k >= 0 and n < firsts[k] + self.frames[k]["docs"]:
                wanted.setdefault(k, set()).add(n - firsts[k])
        for k in sorted(wanted):
            yield from (d for i, d in enumerate(self.frame(k)) if i in wanted[k])


def write_partition(batches: Iterator, folder: str, vocabulary: str, end_id: int):
    import pyarrow as pa
    from pyspark import TaskContext

    cache, context = word_cache(vocabulary), TaskContext.get()
    cache.limit(None)
    part = context.partitionId() if context else 0
    store, base = filesystem(folder)
    path, writer, closing = f"{base}/part-{part:06d}-{uuid.uuid4().hex}.ids.zst", None, end_id.to_bytes(4, "little")
    for batch in batches:
        ids_of, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        for a, b in slices(texts):
            for doc_id, raw in zip(ids_of[a:b], cache.encode(texts[a:b]), strict=True):
                if writer is None:
                    out = store.open_output_stream(path, compression=None)
                    writer = FrameWriter(out, 2 if max(cache.size - 1, end_id) < 2**16 else 4)
                writer.add(doc_id, raw + closing)
    if writer is not None:
        docs, tokens = writer.close()
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([docs], pa.int64()), pa.array([tokens], pa.int64())], names=MANIFEST.names)


def write_token_files(docs: DataFrame, folder: str | None = None, vocabulary: str | None = None, end_id: int = 2) -> list:
    """Write docs (doc_id, text) in ascending order of doc_id and, of rows with one doc_id, of text, so that files and starts do not depend on how rows
    arrive; the manifest rows in file order."""
    spark = docs.sparkSession
    folder, vocabulary = folder or scratch(spark, "token-files"), vocabulary or default_vocabulary()
    store, base = filesystem(folder)
    store.create_dir(base, recursive=True)
    ordered = docs.select(docs["doc_id"].cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    scheme = folder.split("://")[0] + "://" if "://" in folder else "file://"
    with arrow_batches(spark, BATCH):
        rows = ordered.mapInArrow(lambda it: write_partition(it, folder, vocabulary, end_id), MANIFEST).collect()
    return [r.asDict() | {"path": scheme + r["path"]} for r in sorted(rows, key=lambda r: r["part"])]


def read_partition(batches: Iterator):
    import pyarrow as pa

    for batch in batches:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            store, inside = filesystem(path)
            with store.open_input_file(inside) as source:
                reader = FrameReader(source, source.size())
                for k in range(len(reader.frames)):
                    rows = [(doc_id, base + start, len(raw) // 4, zlib.crc32(raw)) for doc_id, start, raw in reader.frame(k)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=DIGEST.names)


def token_file_digests(spark: SparkSession, manifest: list) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files. start counts the ids of all files before."""
    bases, total = [], 0
    for m in manifest:
        bases.append((m["path"], total))
        total += m["tokens"]
    files = spark.createDataFrame(bases, "path string, base long")
    if bases:
        files = files.repartition(len(bases))
    return files.mapInArrow(read_partition, DIGEST)
