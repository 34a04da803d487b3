"""Packing, token files and SentencePiece against the libraries."""

import hashlib
import io
import random
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
import zstandard
from tokenizers import Tokenizer

from attestor.llm import packing, piece_codec, token_files
from attestor.llm.tokens import default_vocabulary, word_cache


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_cached_ids_equal_the_library(tokenizer):
    rng = random.Random(1)
    alphabet = ["a", "b", " ", " ", "'s", "é", "\n", ",", ".", "12", "ß", "!", "\t", "梦", "_", "²", "\u00a0", "Ll", "'"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(25))) for _ in range(3000)] + ["<|endoftext|>x", " a", "a ", "a\n b", "a,b. C"]
    got = word_cache(default_vocabulary()).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def check_packing(rows, want, capacity=1024):
    total = 0
    for r in rows:
        piece = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(want[r["doc_id"]]) and r["length"] > 0
        total += r["length"]
    windows = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return total, windows


def test_packing_holds_each_id_once_with_little_padding(spark, sample, tokenizer):
    want = {r["doc_id"]: ids_of(tokenizer, r["text"], 0) for r in sample.collect()}
    rows = [r.asDict() for r in packing.pack(sample).collect()]
    total, windows = check_packing(rows, want)
    assert total == sum(map(len, want.values()))
    for d in want:
        spans = sorted((r["start"], r["length"]) for r in rows if r["doc_id"] == d)
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    assert len(windows) * 1024 < 1.05 * total + 8 * 1024


def test_packing_odd_rows(odd, empty, tokenizer):
    rows = packing.pack(odd).collect()
    assert sum(r["length"] for r in rows) == sum(len(ids_of(tokenizer, r["text"], 0)) for r in odd.collect())
    assert packing.pack(empty).count() == 0


def test_differencing_is_near_equal_and_whole():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 200) for _ in range(400)]
    parts = packing.difference(sizes, 13)
    assert sorted(i for p in parts for i in p) == list(range(400))
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert max(sums) - min(sums) <= 3


def test_windows_rise_when_capacity_is_exceeded():
    assert len(packing.windows([600, 600, 600])) == 3
    assert len(packing.windows([512, 512, 500, 500])) == 2
    assert packing.windows([5]) == [[0]]


def test_token_files_round_trip(spark, sample, odd, empty, tokenizer):
    for docs in (sample, odd):
        manifest = token_files.write_token_files(docs)
        got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.token_file_digests(spark, manifest).collect()), key=lambda r: r[1])
        order = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
        assert [g[0] for g in got] == [r["doc_id"] for r in order]
        at = 0
        for g in got:
            assert g[1] == at
            at += g[2]
        want = sorted((str(r["doc_id"]), len(i), zlib.crc32(i.tobytes())) for r in order for i in [ids_of(tokenizer, r["text"], 2)])
        assert sorted((str(d), n, c) for d, _, n, c in got) == want
    assert token_files.token_file_digests(spark, token_files.write_token_files(empty)).count() == 0


def test_readers_take_only_the_frames_they_need(monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 10)
    out = io.BytesIO()
    writer = token_files.FrameWriter(out, 2)
    docs = [(i, np.arange(i, dtype="<u4").tobytes()) for i in range(20)]
    for d, raw in docs:
        writer.add(d, raw)
    assert writer.close() == (20, sum(range(20)))
    reader = token_files.FrameReader(out, len(out.getvalue()))
    opened = []
    frame = reader.frame
    reader.frame = lambda k: opened.append(k) or frame(k)
    assert [(d, raw) for d, _, raw in reader.documents([3, 19])] == [docs[3], docs[19]]
    assert len(opened) == 2 < len(reader.frames)
    damaged = bytearray(out.getvalue())
    damaged[reader.frames[1]["at"] + reader.frames[1]["packed"] - 6] ^= 1
    with pytest.raises(Exception):  # noqa: B017  the library's error or ours
        list(token_files.FrameReader(io.BytesIO(bytes(damaged)), len(damaged)).frame(1))


def test_the_seek_table_is_that_of_the_public_format():
    out = io.BytesIO()
    writer = token_files.FrameWriter(out, 4)
    ids = (None, -(2**63), 0, 5)
    for d in ids:
        writer.add(d, np.arange(3, dtype="<u4").tobytes())
        writer.flush()
    writer.close()
    raw = out.getvalue()
    count, flags, magic = struct.unpack("<IBI", raw[-9:])
    table = len(raw) - 9 - 12 * count
    assert (count, flags, magic) == (5, 0x80, 0x8F92EAB1) and struct.unpack("<II", raw[table - 8 : table]) == (0x184D2A5E, 12 * count + 9)
    at = 0
    for packed, content, digest in struct.iter_unpack("<III", raw[table:-9]):
        frame = raw[at : at + packed]
        whole = b"" if frame[:4] == struct.pack("<I", 0x184D2A5D) else zstandard.ZstdDecompressor().decompress(frame)
        assert len(whole) == content and xxhash.xxh64(whole).intdigest() & 0xFFFFFFFF == digest
        at += packed
    assert at == table - 8
    reader = token_files.FrameReader(out, len(raw))
    assert [d for k in range(4) for d, *_ in reader.frame(k)] == list(ids)


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())


def test_pieces_equal_the_library(pieces):
    codec = piece_codec.piece_codec(piece_codec.default_model())
    rng = random.Random(3)
    alphabet = "ab  thein\n.,éX▁😀'1ßz梦"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["", " ", "  ", "   a", " " * 70 + "x" + " " * 17, "▁", "a▁▁b", "<s> </s> <unk> <0x41>", "\x00\x01", "e\u0301"]
    for t in texts:
        assert codec.encode(t) == pieces.encode(t), t
        assert codec.decode(codec.encode(t)) == pieces.decode(pieces.encode(t)), t
    for _ in range(2000):
        ids = [rng.choice(codec.byte_ids) if rng.random() < 0.5 else rng.randrange(3, 32000) for _ in range(6)]
        assert codec.decode(ids) == pieces.decode(ids)


def test_long_runs_take_time_in_proportion(pieces):
    codec = piece_codec.piece_codec(piece_codec.default_model())
    began = time.time()
    for t in (" " * 200_000, " " * 99_999 + "the end", "x" + " " * 200_001 + "y", "." * 200_000, "a" * 200_000, "é梦" * 50_000, "...!?" * 40_000, "-=" * 100_000):
        want = pieces.encode(t)
        assert codec.encode(t) == want
        assert codec.digests([t]) == [(len(want), sha(",".join(map(str, want))), sha(pieces.decode(want)))]
    assert time.time() - began < 60


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_piece_digests(sample, odd, empty, pieces):
    for docs in (sample, odd):
        want = sorted((str(r["doc_id"]), len(i), sha(",".join(map(str, i))), sha(pieces.decode(i))) for r in docs.collect() for i in [pieces.encode(r["text"] or "")])
        assert sorted((str(r["doc_id"]), *r[1:]) for r in piece_codec.piece_digests(docs).collect()) == want
    assert piece_codec.piece_digests(empty).count() == 0


def test_piece_columns(odd):
    rows = odd.select("text", piece_codec.encode_ids("text").alias("ids")).withColumn("back", piece_codec.decode_ids("ids")).collect()
    assert all(r["back"] == (r["text"] or "").replace("▁", " ") for r in rows)


def test_rows_of_one_id_are_written_by_text(spark):
    rows = [(1, "b"), (1, "a"), (1, None), (0, "z"), (1, "a longer one")]
    make = lambda order: sorted(map(tuple, token_files.token_file_digests(spark, token_files.write_token_files(spark.createDataFrame([rows[i] for i in order], "doc_id long, text string").repartition(5))).collect()))
    assert make(range(5)) == make((4, 2, 0, 3, 1)) == make((1, 3, 4, 0, 2))
