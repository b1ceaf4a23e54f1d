"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

A piece of n tokens costs n + n * n / LENGTH: linear work and attention. Each document is cut into whole sequences and a rest. Rests
are packed pool by pool: as many sequences as the pool's tokens fill are opened, and the rests, in descending order, go to the
sequence of the lowest cost that has room. A rest that fits nowhere is cut to fill the sequence of the lowest cost that is not full.
So under one sequence of padding is left a pool, and a pool is at most POOL rests or what one partition holds.

Sequence ids are the partition's number, then the number within it; a task that is run again gives the same ids, as long as its
input comes in the same order (files do). No shuffle is needed.

Defined results: a null or empty text is the end token alone. Repeated rows are packed as they stand; other columns are ignored. An
empty table gives no piece. A very long text is encoded whole and fills as many sequences as it needs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from quillgraph.llm.common import small_batches

LENGTH, POOL, END = 1024, 4096, 0


class TextIds:
    """Ids of texts by a vocabulary file of `tokenizers`.

    Where the file's ids follow its merges, as ranks do, tiktoken makes the same ids from it at an eighth of the time; else the library
    itself is used.
    """

    def __init__(self, path: str):
        ranks, added = ranks_of(path), added_of(path)
        fast = ranks is not None and added is not None and not set(added.values()) & set(ranks.values())
        self.tokenizer = None if fast else Tokenizer.from_file(path)
        self.fast = fast and tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def encode(self, text: str) -> bytes:
        ids = self.fast.encode_to_numpy(text, allowed_special="all") if self.fast else self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, "<u4").tobytes()


def added_of(path: str) -> dict[str, int] | None:
    """Added tokens of the file, which a text is split at before all else; None if one takes in space or is looked for within words only."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f).get("added_tokens") or []
    plain = not any(t.get(k) for t in found for k in ("single_word", "lstrip", "rstrip", "normalized"))
    return {t["content"]: t["id"] for t in found} if plain else None


def ranks_of(path: str) -> dict[bytes, int] | None:
    """Bytes to id of a byte-level BPE file whose ids are its bytes and then its merges in order, else None."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, before = whole["model"], whole.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or before.get("use_regex") is False or whole.get("normalizer"):
        return None
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes written as themselves; the others follow from U+0100 on
    byte_of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    vocabulary = model["vocab"]
    in_order = all(vocabulary.get(a + b) == 256 + k for k, (a, b) in enumerate(pairs)) and all(vocabulary.get(c, 256) < 256 for c in byte_of)
    if not in_order:
        return None
    return {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if i < 256 + len(pairs)}


_TEXT_IDS: dict[str, TextIds] = {}


def text_ids(name: str) -> TextIds:
    """One a worker: it is made once."""
    if name not in _TEXT_IDS:
        _TEXT_IDS[name] = TextIds(public_tokenizers.path(name))
    return _TEXT_IDS[name]


def cost(n: int) -> float:
    return n + n * n / LENGTH


def assigned(lengths: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(rest, first token, tokens, sequence, offset) of each piece; every rest is shorter than `length`."""
    n = -(-sum(lengths) // length)
    costs, room = np.zeros(n), np.full(n, length)
    out = []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        at, left = 0, lengths[k]
        while left:
            s = int(np.where(room >= left, costs, np.inf).argmin())
            if room[s] < left:  # fits nowhere: cut
                s = int(np.where(room > 0, costs, np.inf).argmin())
            size = min(left, int(room[s]))
            out.append((k, at, size, s, length - int(room[s])))
            costs[s] += cost(size)
            room[s] -= size
            at, left = at + size, left - size
    return out


def packed(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", length: int = LENGTH) -> DataFrame:
    """Per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = text_ids(vocabulary), END.to_bytes(4, "little")
        first, rows, pool = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40, [], []
        n_sequences = 0

        def flush() -> None:
            nonlocal n_sequences, pool
            top = n_sequences
            for k, at, n, s, offset in assigned([len(x[2]) // 4 for x in pool], length):
                doc, start, ids, tokens = pool[k]
                rows.append((doc, start + at, n, ids[4 * at : 4 * (at + n)], tokens, first + n_sequences + s, offset))
                top = max(top, n_sequences + s + 1)
            n_sequences, pool = top, []

        def made() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = (coder.encode(text) if text else b"") + end
                    tokens = len(ids) // 4
                    for start in range(0, tokens - length + 1, length):
                        rows.append((doc, start, length, ids[4 * start : 4 * (start + length)], tokens, first + n_sequences, 0))
                        n_sequences += 1
                    if rest := tokens % length:
                        pool.append((doc, tokens - rest, ids[4 * (tokens - rest) :], tokens))
                    if len(pool) >= POOL:
                        flush()
                    if len(rows) >= 4000:
                        yield made()
        flush()
        if rows:
            yield made()

    source = small_batches(docs).select("doc_id", "text")
    id_kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {id_kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
