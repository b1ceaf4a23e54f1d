"""Byte-level BPE by prefix dynamic programming.

The encoding of a text's first i bytes has one last token, and that token alone is stored for each i. A token t that ends at i is it
if the bytes before t end in a token which stays apart from t, so the table grows byte by byte: appending never changes what is
there, and after an edit the table is rebuilt only until it agrees with the old one over as many bytes as the longest token has.

Two neighbours stay apart if no pair across their seam would have merged before the merges that made them. Going back in time from
the two tokens, the later of the two merges is undone first; each pair met on the way must not be a token of lower rank than what
was undone. Of equal ranks the left merge comes first.

`encoded` works on whole texts: the pattern's matches are encoded one by one, and the ids of recent pieces are kept in a bounded
cache. Defined results: a null or empty text has no id. Repeated rows and ids are encoded row by row; other columns are ignored.
Lone surrogates cannot occur, since Spark's strings are UTF-8. An empty table gives no row. A very long text is encoded whole, piece by
piece, in memory of its length.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillgraph.llm.common import small_batches

#: Entries of a cache's generation: when the new one is full it becomes the old one, and the old one goes.
CACHE = 400_000

#: Lengths of tokens of less than four bytes.
SHORT = (3, 2, 1)

#: Texts with other white space than blanks and newlines are matched whole.
ODD_SPACE = re.compile(r"[^\S \n]")
PIECE = re.compile(r"[ \n]*[^ \n]+|[ \n]+")


class Ranks:
    """A rank file: tokens by id, and how each was merged."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ids.values()) + 1)
        for token, i in self.ids.items():
            self.tokens[i] = token
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.tokens))]
        self.longest = max(map(len, self.ids))
        #: Lengths, falling, of the tokens that end in four bytes, and of shorter ones.
        found: dict[bytes, set[int]] = {}
        for token in self.ids:
            if len(token) > 3:
                found.setdefault(token[-4:], {1, 2, 3}).add(len(token))
        self.lengths = {end: tuple(sorted(sizes, reverse=True)) for end, sizes in found.items()}
        self.left: list[int] = [-1] * len(self.tokens)
        self.right: list[int] = [-1] * len(self.tokens)
        self.whole = [False] * len(self.tokens)  # whether the token's own bytes are encoded as it
        self.known: dict[int, bool] = {}  # recent answers of apart()
        for i, token in sorted((i, t) for t, i in self.ids.items()):
            if len(token) == 1:
                self.whole[i] = True
            elif len(parts := self.merged(token, i)) == 2:
                (self.left[i], self.right[i]), self.whole[i] = parts, True
        #: Tokens that can occur in an encoding.
        self.usable = {t: i for t, i in self.ids.items() if self.whole[i]}

    def merged(self, text: bytes, below: int | None = None) -> list[int]:
        """Plain BPE: join the neighbours of the least rank (under `below`), leftmost first, until none is left."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((r, i) for i in range(len(parts) - 1) if (r := self.ids.get(parts[i] + parts[i + 1], 1 << 40)) is not None)
            if rank >= (1 << 40 if below is None else below):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def apart(self, a: int, b: int) -> bool:
        """Whether tokens a, b next to each other stay two tokens."""
        if len(self.known) >= CACHE:
            self.known.clear()
        found = self.known[a << 32 | b] = self._stay(a, b)
        return found

    def _stay(self, a: int, b: int) -> bool:
        tokens, left, right, bound = self.tokens, self.left, self.right, 1 << 40
        while True:
            joined = self.ids.get(tokens[a] + tokens[b])
            if joined is not None and joined < bound:
                return False
            made_a, made_b = a if right[a] >= 0 else -1, b if left[b] >= 0 else -1
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                bound, a = made_a, right[a]
            else:
                bound, b = made_b + 1, left[b]


@lru_cache(4)
def ranks(path: str) -> Ranks:
    return Ranks(path)


class PrefixTable:
    """The last token of each prefix of a byte string."""

    def __init__(self, r: Ranks, text: bytes = b""):
        self.ranks, self.text, self.last = r, b"", [-1]
        self.append(text)

    def append(self, more: bytes) -> None:
        self.text += more
        self._grow(len(self.text))

    def _grow(self, end: int) -> None:
        text, last, ranks = self.text, self.last, self.ranks
        usable, lengths, known, apart = ranks.usable.get, ranks.lengths.get, ranks.known.get, ranks.apart
        for i in range(len(last), end + 1):
            for size in lengths(text[i - 4 : i], SHORT) if i > 3 else SHORT:
                at = i - size
                if at >= 0 and (token := usable(text[at:i])) is not None:
                    if not at:
                        last.append(token)
                        break
                    stay = known(last[at] << 32 | token)
                    if stay if stay is not None else apart(last[at], token):
                        last.append(token)
                        break
            else:
                raise ValueError("the vocabulary lacks a byte of the text")

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put `new` in place of text[start:stop]; returns how many entries were computed anew."""
        old, shift = self.last, start + len(new) - stop
        self.text = self.text[:start] + new + self.text[stop:]
        self.last = old[: start + 1]
        self._grow(start + len(new))
        end, same = start + len(new), 0
        while end < len(self.text):
            end += 1
            self._grow(end)
            same = same + 1 if self.last[end] == old[end - shift] else 0
            if same >= self.ranks.longest:
                self.last += old[end - shift + 1 :]
                break
        return end - start

    def ids(self) -> list[int]:
        out, at, last, tokens = [], len(self.text), self.last, self.ranks.tokens
        while at:
            out.append(last[at])
            at -= len(tokens[last[at]])
        out.reverse()
        return out


class Recent:
    """A bounded cache of two generations; what is met again moves to the new one. Texts of over 64 characters are not kept."""

    def __init__(self, size: int = CACHE):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key: str) -> bytes | None:
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        if len(key) <= 64:
            if len(self.new) >= self.size:
                self.old, self.new = self.new, {}
            self.new[key] = value


def pieces_of(text: str) -> list[str] | None:
    """Cut a text where no match of the pattern crosses: before each run of blanks and newlines. None if it has other white space."""
    return None if ODD_SPACE.search(text) else PIECE.findall(text)


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.ranks, self.find = ranks(path), regex.compile(pattern).findall
        self.pieces, self.words = Recent(), Recent()

    def word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            found = b"".join(map(self.ranks.packed.__getitem__, PrefixTable(self.ranks, word.encode()).ids()))
            self.words.put(word, found)
        return found

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        pieces = pieces_of(text)
        if pieces is None:
            return b"".join(map(self.word, self.find(text)))
        return joined(pieces, self.pieces, lambda new: [b"".join(map(self.word, self.find(p))) for p in new])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.ranks.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def joined(pieces: list[str], cache: Recent, make: Callable[[list[str]], list[bytes]]) -> bytes:
    """The pieces' ids, from the cache or made now."""
    found = list(map(cache.new.get, pieces))
    if None in found:
        known = {p: cache.get(p) for p, x in zip(pieces, found, strict=True) if x is None}
        new = [p for p, x in known.items() if x is None]
        for p, x in zip(new, make(new), strict=True):
            known[p] = x
            cache.put(p, x)
        found = [known[p] if x is None else x for p, x in zip(pieces, found, strict=True)]
    return b"".join(found)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(name: str, pattern: str) -> Encoder:
    """One encoder a worker, so that its caches last over tasks."""
    if (name, pattern) not in _ENCODERS:
        _ENCODERS[name, pattern] = Encoder(public_tokenizers.path(name), pattern)
    return _ENCODERS[name, pattern]


def encoded(docs: DataFrame, vocabulary: str = "byte_bpe_multi_50k.tiktoken", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded (binary) of every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [coder.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(map(coder.decode, ids), pa.binary())], names=["doc_id", "ids", "decoded"])

    rows = small_batches(docs).select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")
