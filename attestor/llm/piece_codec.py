"""SentencePiece encoding and decoding with a merge-type prefix table.

For merges by rank, every prefix of a text has one encoding, and a piece t is the last piece of a prefix
exactly when it ends there and is compatible with the last piece u of the prefix before it: the text of u and
t together encodes to u, t. So an automaton lists the pieces that end at each place, a memo of pair tests picks
the one compatible with the table's entry at its start, and the ids are read off backwards from the end. Each
place is visited once: there is no queue of merges.

A piece has its space marks only in front, so a text can be cut before every space that follows another
character, and the words between are encoded on their own and kept in a bounded cache. Runs of spaces, whose
pieces share one rank, and characters that no single piece covers are encoded by plain merging.

Defined results: null text counts as empty and has no ids; repeated rows get equal answers; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from attestor.llm.tokens import _trim, slices

SPACE = "▁"
MAX_WORDS, MAX_PARTS, MAX_PAIRS = 700_000, 500_000, 4_000_000
#: Longer words than this are not kept.
LONG = 200

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
])

#: Runs of letters, of digits, and other characters one by one.
_RUNS = re.compile(r"[^\W\d_]+|\d+|_|[^\w]", re.DOTALL)
_BOUND = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")


class PieceCodec:
    """The model's vocabulary, its automaton and its memo of pair tests."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)} | set(self.byte_ids)
        self.silent = {i for i in special if i not in self.byte_of}
        self.pieces[model.unk_id()] = " ⁇ "  # as the library shows an unknown piece
        self.silent.discard(model.unk_id())
        self.scores = {p: (model.get_score(i), i) for i, p in enumerate(self.pieces) if i not in special}
        if any(SPACE in p.lstrip(SPACE) for p in self.scores):
            raise ValueError("a piece has a space mark after another character")
        singles = {p for p in self.scores if len(p) == 1}
        #: Characters inside pieces that are no piece themselves need plain merging.
        self.covered = singles
        self.odd = {c for p in self.scores for c in p} - singles
        self.automaton = ahocorasick.Automaton()
        self.texts = {}
        for p, (_, i) in self.scores.items():
            # A piece that its own text does not encode to never occurs.
            if (p.strip(SPACE) or p == SPACE) and self._merge(p) == [i]:
                self.automaton.add_word(p, (i, len(p)))
                self.texts[i] = p
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}  # by u << 20 | t
        self.words: dict[str, tuple[int, str, str]] = {}
        self.parts: dict[str, tuple[int, str, str]] = {}
        self.numbers = [str(i) for i in range(n)]
        #: Neighbours inside some piece. Between others no piece reaches across, so a word can be cut there.
        self.inside = {p[k : k + 2] for p in self.scores for k in range(len(p) - 1)}

    def _merge(self, text: str) -> list[int]:
        """Plain merging: the adjacent pair of the best score, the leftmost among equals, until none is a piece. Pairs wait in a
        heap; one whose parts have grown since is passed over."""
        n, scores = len(text), self.scores
        parts: list[str | None] = list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-found[0], k, 2) for k in range(n - 1) if (found := scores.get(text[k : k + 2]))]
        heapify(heap)
        while heap:
            _, k, size = heappop(heap)
            left, j = parts[k], after[k]
            if left is None or j >= n or len(left) + len(parts[j]) != size:
                continue
            parts[k], parts[j], after[k] = left + parts[j], None, after[j]
            if after[k] < n:
                before[after[k]] = k
            for x in (before[k], k):
                y = after[x] if x >= 0 else n
                if y < n and (found := scores.get(parts[x] + parts[y])):
                    heappush(heap, (-found[0], x, len(parts[x]) + len(parts[y])))
        out: list[int] = []
        for p in parts:
            if p is not None:
                found = scores.get(p)
                out += [found[1]] if found else [self.byte_ids[b] for b in p.encode("utf-8", "replace")]
        return out

    def _compatible(self, u: int, t: int) -> bool:
        if len(self.pairs) > MAX_PAIRS:
            self.pairs.clear()
        ok = self.pairs[u << 20 | t] = self._merge(self.texts[u] + self.texts[t]) == [u, t]
        return ok

    def encode_word(self, word: str) -> list[int]:
        """The ids of a text whose space marks all stand in front."""
        if word[:2] == SPACE * 2 or (self.odd and not self.odd.isdisjoint(word)):
            return self._merge(word)
        n = len(word)
        last, start = [-1] * (n + 1), [0] * (n + 1)
        pairs_get = self.pairs.get
        if not self.covered.issuperset(word):
            return self._encode_around(word)
        for end, (t, size) in self.automaton.iter(word):
            end += 1
            if last[end] >= 0:
                continue
            at = end - size
            if at:
                u = last[at]
                ok = pairs_get(u << 20 | t)
                if ok is None:
                    ok = self._compatible(u, t)
                if not ok:
                    continue
            last[end], start[end] = t, at
        out = []
        while n:
            out.append(last[n])
            n = start[n]
        out.reverse()
        return out

    def _encode_around(self, word: str) -> list[int]:
        """Characters without a piece become their bytes; nothing merges across them."""
        out: list[int] = []
        run = ""
        for c in word:
            if c in self.covered:
                run += c
                continue
            if run:
                out += self.encode_word(run)
                run = ""
            out += [self.byte_ids[b] for b in c.encode("utf-8", "replace")]
        return out + (self.encode_word(run) if run else [])

    def encode(self, text: str) -> list[int]:
        """As the library encodes a text without begin or end ids: a space mark in front, spaces as marks."""
        if not text:
            return []
        return [i for word in _BOUND.split(SPACE + text.replace(" ", SPACE)) for i in self.encode_word(word)]

    def _join(self, ids: list[int]) -> str:
        """Pieces joined, space marks as spaces; bytes that are no UTF-8 become replacement characters one by one."""
        out: list[str] = []
        run = bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run = bytearray()
            if i not in self.silent:
                out.append(self.pieces[i])
        if run:
            out.append(_utf8(bytes(run)))
        return "".join(out).replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        text = self._join(ids)
        return text[1:] if ids and self.pieces[ids[0]].startswith(SPACE) else text

    def _cut(self, word: str) -> list[str]:
        """The word in parts between which no piece reaches across."""
        parts: list[list[str]] = []
        for run in _RUNS.findall(word):
            if parts and parts[-1][-1][-1] + run[0] in self.inside:
                parts[-1].append(run)
            else:
                parts.append([run])
        return ["".join(p) for p in parts]

    def _word(self, word: str) -> tuple[int, str, str]:
        """Number of ids, ids joined by commas and decoded text of a word, space mark included."""
        found = []
        for part in self._cut(word):
            value = self.parts.get(part)
            if value is None:
                ids = self.encode_word(part)
                text = "".join(map(self.pieces.__getitem__, ids))
                # The text of a byte piece begins like this.
                text = self._join(ids) if "<0x" in text else text.replace(SPACE, " ")
                value = len(ids), ",".join(map(self.numbers.__getitem__, ids)), text
                if len(part) <= LONG:
                    self.parts[part] = value
            found.append(value)
        if len(found) == 1:
            return found[0]
        n, ids, text = zip(*found, strict=True)
        return sum(n), ",".join(ids), "".join(text)

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, SHA-256 of the decimal ids joined by commas and of the decoded text, for each text."""
        _trim(self.words, MAX_WORDS)
        _trim(self.parts, MAX_PARTS)
        out: list[tuple[int, str, str]] = [(0, _sha(""), _sha(""))] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if "  " in t or SPACE in t or t[:1] == " ":
                n, ids, decoded = zip(*map(self._word, _BOUND.split(SPACE + t.replace(" ", SPACE))), strict=True)
                out[i] = sum(n), _sha(",".join(ids)), _sha("".join(decoded)[1:])
            elif t:
                plain.append(i)
        if plain:
            for i, found in zip(plain, self._looked_up([texts[i] for i in plain]), strict=True):
                out[i] = found
        return out

    def _looked_up(self, texts: list[str]):
        """digests() of texts in which spaces stand alone: each distinct word is looked up once, and Arrow joins the rest."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = lists.values.dictionary_encode()
        values = []
        for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist():
            found = self.words.get(w)
            if found is None:
                found = self._word(SPACE + w)
                if len(w) <= LONG:
                    self.words[w] = found
            values.append(found)
        n, ids, decoded = zip(*values, strict=True)
        counts = np.add.reduceat(np.array(n)[coded.indices.to_numpy()], lists.offsets.to_numpy()[:-1]).tolist()

        def joined(parts, by: str):
            return pc.binary_join(pa.ListArray.from_arrays(lists.offsets, pa.array(parts, pa.large_string()).take(coded.indices)), pa.scalar(by, pa.large_string()))

        for count, x, y in zip(counts, joined(ids, ","), joined(decoded, ""), strict=True):
            # The first word begins with the mark that encoding put in front.
            yield count, hashlib.sha256(x.as_buffer()).hexdigest(), hashlib.sha256(memoryview(y.as_buffer())[1:]).hexdigest()


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


def _utf8(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode("utf-8"))
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def piece_codec(path: str) -> PieceCodec:
    """Kept between the tasks of a Python worker."""
    return PieceCodec(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def digest_partition(batches: Iterator, model: str):
    import pyarrow as pa

    codec = piece_codec(model)
    for batch in batches:
        doc_ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
        for a, b in slices(texts):
            n, ids, decoded = zip(*codec.digests(texts[a:b]), strict=True)
            yield pa.RecordBatch.from_arrays([doc_ids[a:b], pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=SCHEMA.names)


def piece_digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs (doc_id, text)."""
    model = model or default_model()
    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(lambda it: digest_partition(it, model), SCHEMA)


def encode_ids(texts, model: str | None = None):
    """A column of ids: encode_ids("text")."""
    from pyspark.sql.functions import pandas_udf

    path = model or default_model()

    @pandas_udf("array<int>")
    def encoded(s: pd.Series) -> pd.Series:
        codec = piece_codec(path)
        return s.map(lambda t: codec.encode(t or ""))

    return encoded(texts)


def decode_ids(ids, model: str | None = None):
    """A column of texts: decode_ids("ids")."""
    from pyspark.sql.functions import pandas_udf

    path = model or default_model()

    @pandas_udf("string")
    def decoded(s: pd.Series) -> pd.Series:
        codec = piece_codec(path)
        return s.map(lambda i: codec.decode(list(i)) if i is not None else "")

    return decoded(ids)
