"""Token ids of whole texts with the tokenizers library, as little-endian unsigned 32-bit integers.

Before any merge the vocabulary's pattern cuts a text into pieces that are encoded independently. A piece
never holds a space after another character, so a text can be cut before each single space between two other
characters; the ids of such chunks, and of the pieces in chunks not met before, are kept in bounded caches.
All pieces that the caches lack are encoded by the library, many at a time.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import islice

#: The pattern by which the vocabulary splits a text, for texts in which Python's classes agree with it.
_PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters for which they do: ASCII and Latin letters up to U+024F, without control characters that differ.
_PLAIN = re.compile("[\\t\\n\\r -~¡-©«-±´¶-¸»¿-ɏ‐-‧‰-⁞₠-₿]*")
#: A space that does not stand alone between two other characters.
_ODD_SPACE = re.compile(r"^ | (?=\s|$)|(?<=[\t\n\r]) ")

MAX_CHUNKS, MAX_PIECES = 850_000, 650_000
#: Stands before a text when it is cut: its first chunk has no space in front, unlike all others.
FIRST = "\x02"


def _trim(cache: dict, most: int) -> None:
    """Half of most stay, the latest, once there are more than most."""
    if len(cache) > most:
        for key in list(islice(cache, len(cache) - most // 2)):
            del cache[key]


def byte_alphabet() -> dict[int, str]:
    """The printable character by which byte-level vocabularies write each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordCache:
    """Encodes batches of texts; one for each Python worker and vocabulary."""

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer, pre_tokenizers

        self.np = np
        self.tokenizer = Tokenizer.from_file(path)
        #: The same merges for pieces already cut and written in the vocabulary's byte alphabet.
        self.merges = Tokenizer.from_file(path)
        self.merges.pre_tokenizer = pre_tokenizers.Split("\0", "removed")
        self.alphabet = byte_alphabet()
        vocabulary = self.tokenizer.get_vocab()
        self.size = self.tokenizer.get_vocab_size()
        #: Ids of tokens that begin with a space.
        self.leads = np.zeros(max(vocabulary.values()) + 1, bool)
        self.leads[[i for s, i in vocabulary.items() if s.startswith("Ġ")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.limit(None)

    def limit(self, entries: int | None) -> None:
        """At most so many chunks and as many pieces are kept from now on; None for the usual numbers."""
        self.most = (entries, entries) if entries else (MAX_CHUNKS, MAX_PIECES)
        self.trim()

    def trim(self) -> None:
        _trim(self.chunks, self.most[0])
        _trim(self.pieces, self.most[1])

    def _library(self, texts: list[str]) -> list[bytes]:
        return [self.np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_pieces(self, wanted: list[str]) -> None:
        """Pieces of a space and letters are joined, encoded as one text and cut where a token begins with a space."""
        words = [w for w in wanted if w[0] == " " and len(w) > 1 and w[1] not in "\t\n\r "]
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            spelled = "\n".join(some).encode().decode("latin-1").translate(self.alphabet)
            ids = self.np.array(self.merges.encode_batch_fast([spelled.replace(self.alphabet[10], "\0")], add_special_tokens=False)[0].ids, dtype="<u4")
            starts = self.np.flatnonzero(self.leads[ids])
            if len(starts) == len(some):
                raw, cuts = ids.tobytes(), (starts * 4).tolist()
                self.pieces.update(zip(some, (raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)), strict=True))
            else:
                self.pieces.update(zip(some, self._library(some), strict=True))
        rest = [w for w in wanted if w not in self.pieces]
        self.pieces.update(zip(rest, self._library(rest), strict=True))

    def _plain(self, text: str) -> bool:
        """True if the text can be cut at its spaces."""
        if "  " in text or text[0] == " " or text[-1] == " " or "\n " in text or " \n" in text or any(s in text for s in self.special):
            return False
        return bool(_PLAIN.fullmatch(text)) and not (("\t" in text or "\r" in text) and _ODD_SPACE.search(text))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as the library gives them for the whole text without special tokens."""
        out: list[bytes] = [b""] * len(texts)
        plain, other = [], []
        for i, t in enumerate(texts):
            if t:
                (plain if self._plain(t) else other).append(i)
        for i, ids in zip(other, self._library([texts[i] for i in other]), strict=True):
            out[i] = ids
        self.trim()
        if plain:
            for i, ids in zip(plain, self._cut_and_look_up([FIRST + texts[i] for i in plain]), strict=True):
                out[i] = ids
        return out

    def _cut_and_look_up(self, texts: list[str]) -> list[bytes]:
        """Cut texts at their spaces, look each distinct chunk up once, and lay the ids out in the texts' order."""
        import pyarrow as pa
        import pyarrow.compute as pc

        np = self.np
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        bounds, coded = lists.offsets.to_numpy(), lists.values.dictionary_encode()
        chunks, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        ids = list(map(self.chunks.get, chunks))
        gaps = [k for k, v in enumerate(ids) if v is None]
        cut = [_PIECE.findall(chunks[k][1:] if chunks[k][0] == FIRST else " " + chunks[k]) for k in gaps]
        self._learn_pieces([p for p in set().union(*cut) if p not in self.pieces])
        piece = self.pieces.__getitem__
        for k, pieces in zip(gaps, cut, strict=True):
            ids[k] = self.chunks[chunks[k]] = b"".join(map(piece, pieces))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts, n = np.cumsum(sizes) - sizes, sizes[codes]
        ends = np.cumsum(n)
        raw = np.frombuffer(b"".join(ids), "<u4")[np.arange(ends[-1]) + np.repeat(starts[codes] - ends + n, n)].tobytes()
        at = (4 * np.append(0, ends)[bounds]).tolist()
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


@lru_cache(maxsize=4)
def word_cache(path: str) -> WordCache:
    """Kept between the tasks of a Python worker."""
    return WordCache(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def slices(texts: list[str], chars: int = 4_000_000):
    """(from, to) of runs of texts that have about that many characters, so that no batch is unbounded."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
