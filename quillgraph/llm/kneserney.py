"""Language-model scores by an interpolated modified Kneser-Ney bigram model.

Counting, in three rounds of shards of at most about SHARD_BYTES of text each (their number grows with the texts):
1. words: 64-bit hashes and counts, in ranges of the hash. Concatenated, the ranges are one sorted array, and a word's place in it is
   its id.
2. bigrams: sorted contexts, and for each the sorted ids of the words after it and their counts, sharded by the context's hash; a
   context that alone would fill a good part of a shard is sharded by context and word instead. Each shard knows its contexts' totals.
3. continuations: for each word, the number of distinct contexts before it, aligned with the words' ranges.
Every shard is one file of arrays in the shared folder, under a fresh name that the task's row carries: a task that is run again writes
another file, and only the named one is read. Workers map the files and look up whole batches at once. Ids, counts and totals have 64
bits; arrays are stored in the narrowest type that holds them.

Probabilities: with c the count of (v, w), p(w | v) = (c - D(c)) / c(v) + g(v) p(w), where D has a value for 1, 2 and 3 or more, and
g(v) is the mass discounted at v. p(w) is the same with continuation counts, over a uniform 1 / (V + 1). A context never seen gives
p(w), a word never seen the uniform share. A text starts after a start mark and ends with an end token, which is scored.

Defined results: a null or empty text is the end token alone. A row with a null id is scored but never learned from. With nothing to
learn from, every token has probability 1 / (V + 1) = 1; an empty table gives no row. Repeated rows are counted and scored as they
stand; other columns are ignored. A very long text is cut nowhere: its tokens are counted and scored whole, in memory of its length.
Two words share a hash with a chance of V^2 / 2^65.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import crc_of_id, shared_path, small_batches
from quillgraph.llm.setsketch import mixed

END = xxhash.xxh3_64_intdigest(b" end")  # no word has a blank
#: Entries that a task holds before it sends them off, and tokens that are scored at once.
HELD, CHUNK = 3_000_000, 1_500_000
#: Text that a shard stands for, in bytes.
SHARD_BYTES = 64 << 20
#: With fewer words than this a pair of ids is sorted as one number, else as two.
PACKED = 2**32 - 2
#: The id of a word that is not known.
UNKNOWN = np.uint64(2**64 - 1)


def hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's tokens, A-Z lower-cased, the end token last."""
    words = (text or "").encode().lower().split()  # of bytes: ASCII letters and ASCII white space only
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


# Arrays as bytes, for the shuffle.


def squeezed(sorted_: np.ndarray) -> bytes:
    """A sorted array of 64-bit numbers: differences, byte plane by byte plane."""
    steps = np.diff(sorted_, prepend=np.zeros(1, np.uint64))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def spread(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def squeezed_counts(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes())


def spread_counts(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def starts_of(sorted_: np.ndarray) -> np.ndarray:
    """First places of the runs of equal numbers."""
    return np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(sorted_) else np.zeros(0, np.int64)


def pair_order(v: np.ndarray, w: np.ndarray, packed: bool) -> np.ndarray:
    """The order of pairs of ids. Packed, UNKNOWN keeps its place after all words."""
    return np.argsort(v << np.uint64(32) | w & np.uint64(2**32 - 1), kind="stable") if packed else np.lexsort((w, v))


def summed_pairs(v: np.ndarray, w: np.ndarray, counts: np.ndarray, packed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, sorted, and the sums of their counts."""
    order = pair_order(v, w, packed)
    v, w, counts = v[order], w[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])))) if len(v) else np.zeros(0, np.int64)
    return v[first], w[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def narrow(array: np.ndarray) -> np.ndarray:
    return array.astype(np.min_scalar_type(int(array.max())) if array.size else np.uint8)


def found_in_runs(words: np.ndarray, low: np.ndarray, high: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The place of each w in its sorted run words[low:high], -1 where it is not there."""
    low, end = low.copy(), high
    high = high.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        mid = (low[open_] + high[open_]) // 2
        less = words[mid] < w[open_]
        low[open_[less]] = mid[less] + 1
        high[open_[~less]] = mid[~less]
        open_ = open_[low[open_] < high[open_]]
    out = np.full(len(w), -1, np.int64)
    there = np.flatnonzero(low < end)
    hit = there[words[low[there]] == w[there]]
    out[hit] = low[hit]
    return out


# Shard files: the length of a header, the header, and arrays at multiples of 64 bytes.


def located(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder)


def put(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """Write arrays as a file of a fresh name, which is returned."""
    fs, at = located(folder)
    fs.create_dir(at, recursive=True)
    table, size = {}, 0
    for name, array in arrays.items():
        table[name] = [array.dtype.str, len(array), size]
        size += -(-array.nbytes // 64) * 64
    header = json.dumps(table).encode()
    header += b" " * (-(len(header) + 8) % 64)
    name = uuid.uuid4().hex
    with fs.open_output_stream(f"{at}/{name}") as out:
        out.write(len(header).to_bytes(8, "little") + header)
        for array in arrays.values():
            if array.nbytes:
                out.write(memoryview(np.ascontiguousarray(array)).cast("B"))
                out.write(bytes(-array.nbytes % 64))
    return name


def get(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped. A file of a remote folder is copied to a nameless file of the worker, gone when its map is."""
    fs, at = located(folder)
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        whole = np.memmap(f"{at}/{name}", np.uint8, "r")
    else:
        with tempfile.TemporaryFile() as copy:
            with fs.open_input_stream(f"{at}/{name}") as source:
                while part := source.read(16 << 20):
                    copy.write(part)
            copy.flush()
            whole = np.memmap(copy, np.uint8, "r")
    n = int.from_bytes(whole[:8].tobytes(), "little")
    table = json.loads(whole[8 : 8 + n].tobytes())
    return {k: whole[8 + n + at : 8 + n + at + size * np.dtype(kind).itemsize].view(kind) for k, (kind, size, at) in table.items()}


_FILES: dict[str, dict[str, dict[str, np.ndarray]]] = {}


def mapped(folder: str, name: str) -> dict[str, np.ndarray]:
    """get(), once a worker for each file; only the files of one model stay open."""
    if folder not in _FILES:
        _FILES.clear()
        _FILES[folder] = {}
    files = _FILES[folder]
    if name not in files:
        files[name] = get(folder, name)
    return files[name]


# The model.


@dataclass
class Discounts:
    """What is taken from counts 1, 2 and 3 or more, by the numbers of entries with counts 1 to 4."""

    n: list[int]
    d: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n1, n2, n3, n4 = self.n
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        self.d = np.array([0.0, *(min(max(x, 0.01 * k), k - 0.01) for k, x in enumerate(d, 1))])

    def of(self, counts: np.ndarray) -> np.ndarray:
        return self.d[np.minimum(counts, 3).astype(np.int64)]


@dataclass
class Words:
    """The words' ranges: folder, file of each shard (none: empty), first id of each shard and the end, tokens in all."""

    folder: str
    files: list[str | None]
    starts: np.ndarray
    tokens: int
    packed_below: int = PACKED

    @property
    def shards(self) -> int:
        return len(self.files)

    @property
    def size(self) -> int:
        return int(self.starts[-1])

    @property
    def packed(self) -> bool:
        return self.size < self.packed_below

    def find(self, h: np.ndarray, what: tuple[tuple[str, list[str | None]], ...] = ()) -> list[np.ndarray]:
        """Ids of sorted distinct hashes (UNKNOWN: not there), and their entries in further arrays of files of the shards (not there: 0)."""
        out = [np.full(len(h), UNKNOWN), *(np.zeros(len(h), np.int64) for _ in what)]
        of = word_shard(h, self.shards)
        for shard in np.unique(of).tolist():
            if self.files[shard] is None:
                continue
            first, end = np.searchsorted(of, [shard, shard + 1])
            known = mapped(self.folder, self.files[shard])["words"]
            at = np.minimum(np.searchsorted(known, h[first:end]), len(known) - 1)
            there = known[at] == h[first:end]
            out[0][first:end] = np.where(there, at.astype(np.uint64) + np.uint64(self.starts[shard]), UNKNOWN)
            for k, (name, files) in enumerate(what, 1):
                if files[shard] is not None:
                    out[k][first:end] = np.where(there, mapped(self.folder, files[shard])[name][at].astype(np.int64), 0)
        return out


def word_shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _shard_words(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """(shard, keys, counts) of the texts' words."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def sent() -> pa.RecordBatch:
        keys, counts = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        of = word_shard(keys, shards)
        sent_to = np.unique(of).tolist()
        edges = np.searchsorted(of, [*sent_to, shards])
        rows = [(s, squeezed(keys[a:b]), squeezed_counts(counts[a:b])) for s, a, b in zip(sent_to, edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["shard", "keys", "counts"])

    for batch in batches:
        column = batch.column(0)
        for at in range(0, len(column), 500):
            found = [hashes(t) for t in column.slice(at, 500).to_pylist()]
            keys, counts = np.unique(np.concatenate(found), return_counts=True)
            held.append((keys, counts.astype(np.uint64)))
            size += len(keys)
            if size >= HELD:
                yield sent()
                held, size = [], 0
    if held:
        yield sent()


def count_words(texts: DataFrame, folder: str, shards: int, packed_below: int = PACKED) -> Words:
    """Round 1 over texts(text). The driver gets a row a shard."""

    def reduce(table: pa.Table) -> pa.Table:
        keys, counts = summed(np.concatenate([spread(x) for x in table.column("keys").to_pylist()]), np.concatenate([spread_counts(x) for x in table.column("counts").to_pylist()]))
        name = put(folder, {"words": keys, "counts": narrow(counts)})
        return pa.table({"shard": table.column("shard")[:1], "n": [len(keys)], "tokens": [int(counts.sum())], "file": [name]})

    rows = texts.select("text").mapInArrow(lambda b: _shard_words(b, shards), "shard long, keys binary, counts binary")
    found = {r["shard"]: r for r in rows.groupBy("shard").applyInArrow(reduce, "shard long, n long, tokens long, file string").collect()}
    sizes = [found[s]["n"] if s in found else 0 for s in range(shards)]
    starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    return Words(folder, [found[s]["file"] if s in found else None for s in range(shards)], starts, sum(r["tokens"] for r in found.values()), packed_below)


@dataclass
class Model:
    words: Words
    before: list[str | None]  # files of the words' continuation counts
    pairs: list[str | None]  # files of the bigrams
    hot: np.ndarray  # contexts that are sharded with their words, sorted
    hot_stats: np.ndarray  # their totals and numbers of entries with counts 1, 2, 3 or more
    bigrams: int
    high: Discounts
    low: Discounts
    low_mass: float  # what the continuation counts leave to the uniform share

    def word_p(self, before: np.ndarray) -> np.ndarray:
        """p(w) by the number of contexts before w."""
        return (before - self.low.of(before)) / max(1, self.bigrams) + self.low_mass / (self.words.size + 1)

    def context_p(self, v: np.ndarray, w: np.ndarray, low: np.ndarray) -> np.ndarray:
        """p(w | v) of pairs of known contexts with any words, given p(w)."""
        of = pair_shard(v, w, self.hot, self.words.shards)
        order = np.argsort(of, kind="stable")
        out = low.copy()
        present = np.unique(of)
        edges = np.searchsorted(of[order], [*present.tolist(), self.words.shards])
        for k, shard in enumerate(present.tolist()):
            at = order[edges[k] : edges[k + 1]]
            own, counts, stats = v[at], np.zeros(len(at), np.int64), np.zeros((len(at), 4))
            if self.pairs[shard] is not None:
                file = mapped(self.words.folder, self.pairs[shard])
                contexts, ends = file["contexts"], file["ends"]
                c = np.minimum(np.searchsorted(contexts, own), len(contexts) - 1)
                there = contexts[c] == own
                stats = np.where(there[:, None], file["stats"].reshape(-1, 4)[c], 0).astype(float)
                start = np.where(c > 0, ends[np.maximum(c - 1, 0)], 0).astype(np.int64)
                place = found_in_runs(file["after"], start, np.where(there, ends[c].astype(np.int64), start), w[at])
                counts = np.where(place >= 0, file["times"][place], 0).astype(np.int64)
                if (many := counts == 255).any():
                    counts[many] = file["many"][np.searchsorted(file["many_at"], place[many])]
            if len(self.hot):
                c = np.minimum(np.searchsorted(self.hot, own), len(self.hot) - 1)
                stats = np.where((self.hot[c] == own)[:, None], self.hot_stats[c], stats)
            total = np.maximum(stats[:, 0], 1)
            p = (counts - self.high.of(counts)) / total + stats[:, 1:] @ self.high.d[1:] / total * low[at]
            out[at] = np.where(stats[:, 0] > 0, p, low[at])
        return out


def pair_shard(v: np.ndarray, w: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(np.where(np.isin(v, hot), mixed(v) + w, v)) % np.uint64(shards)).astype(np.int64)


def token_ids(texts: list[str | None], words: Words, what: tuple = ()) -> tuple[np.ndarray, list[np.ndarray]]:
    """Lengths of the texts in tokens, and for all tokens the ids and further entries."""
    found = [hashes(t) for t in texts]
    distinct, back = np.unique(np.concatenate(found), return_inverse=True)
    return np.array(list(map(len, found))), [x[back] for x in words.find(distinct, what)]


def contexts_of(ids: np.ndarray, lengths: np.ndarray, start: int) -> np.ndarray:
    """The id before each token; the first of a text comes after the start mark."""
    before = np.concatenate((np.array([start], np.uint64), ids[:-1]))
    before[np.concatenate(([0], np.cumsum(lengths)[:-1]))] = start
    return before


def slices(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batches of about so many characters of text (last column) each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pa.compute.binary_length(batch.column(batch.num_columns - 1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + chars)))
            yield batch.slice(at, end - at)
            at = end


def learned(texts: DataFrame, folder: str, shards: int, packed_below: int = PACKED) -> Model:
    """The model of texts(text)."""
    words = count_words(texts, folder, shards, packed_below)
    start, packed = words.size, words.packed  # the start mark's id
    most = max(1, words.tokens // (8 * shards))  # a context of more tokens is split

    def hot_words(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for shard in batch.column(0).to_pylist():
                if words.files[shard] is not None:
                    ids = np.flatnonzero(mapped(folder, words.files[shard])["counts"] > most) + words.starts[shard]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], names=["id"])

    spark = texts.sparkSession
    hot = np.array(sorted([r["id"] for r in spark.range(shards).mapInArrow(hot_words, "id long").collect()] + [start]), np.uint64)  # under 8 a shard, by `most`
    kinds = (("shard", pa.int64()), ("contexts", pa.binary()), ("after", pa.binary()), ("counts", pa.binary()))

    def rows_of(rows: list[tuple], kinds: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def sent() -> pa.RecordBatch:
            v, w, counts = summed_pairs(*(np.concatenate(x) for x in zip(*held, strict=True)), packed)
            of = pair_shard(v, w, hot, shards)
            order = np.argsort(of, kind="stable")
            sent_to = np.unique(of).tolist()
            edges = np.searchsorted(of[order], [*sent_to, shards]).tolist()
            parts = ((s, order[a:b]) for s, a, b in zip(sent_to, edges[:-1], edges[1:], strict=True))
            return rows_of([(s, squeezed(v[at]), squeezed_counts(w[at]), squeezed_counts(counts[at])) for s, at in parts], kinds)

        for part in slices(batches, 4 << 20):
            lengths, (ids,) = token_ids(part.column(0).to_pylist(), words)
            held.append(summed_pairs(contexts_of(ids, lengths, start), ids, np.ones(len(ids), np.uint64), packed))
            size += len(held[-1][0])
            if size >= HELD:
                yield sent()
                held, size = [], 0
        if held:
            yield sent()

    told = (("at", pa.int64()), ("kind", pa.string()), ("keys", pa.binary()), ("counts", pa.binary()), ("file", pa.string()))

    def reduce(table: pa.Table) -> pa.Table:
        """Write a shard of bigrams; send on what its words have before them, its hot contexts' stats and its counts of counts."""
        shard = table.column("shard")[0].as_py()
        joined = lambda name, f: np.concatenate([f(x) for x in table.column(name).to_pylist()])
        v, w, counts = summed_pairs(joined("contexts", spread), joined("after", spread_counts), joined("counts", spread_counts), packed)
        first = starts_of(v)
        contexts = v[first]
        stats = np.stack([np.add.reduceat(c.astype(np.uint64), first) for c in (counts, counts == 1, counts == 2, counts >= 3)], axis=1)
        many = np.flatnonzero(counts >= 255)
        ends = np.concatenate((first[1:], [len(v)]))
        file = {"contexts": narrow(contexts), "ends": narrow(ends), "after": narrow(w), "times": np.minimum(counts, 255).astype(np.uint8), "stats": narrow(stats.ravel()), "many_at": narrow(many), "many": narrow(counts[many])}
        rows = [(shard, "file", None, None, put(folder, file))]
        after, n = np.unique(w, return_counts=True)
        of = np.searchsorted(words.starts, after.astype(np.int64), "right") - 1
        sent_to = np.unique(of).tolist()
        edges = np.searchsorted(of, [*sent_to, shards]).tolist()
        rows += [(s, "before", squeezed(after[a:b]), squeezed_counts(n[a:b]), None) for s, a, b in zip(sent_to, edges[:-1], edges[1:], strict=True)]
        rows += [(int(contexts[k]), "hot", None, stats[k].astype(np.uint64).tobytes(), None) for k in np.flatnonzero(np.isin(contexts, hot)).tolist()]
        rows.append((shard % 64, "counts", None, np.array([*((counts == c).sum() for c in (1, 2, 3, 4)), len(counts)], np.uint64).tobytes(), None))
        return pa.Table.from_batches([rows_of(rows, told)])

    def finish(table: pa.Table) -> pa.Table:
        """Write a range of continuation counts, or add up a hot context's stats or counts of counts, or pass a file's name on."""
        at, kind = table.column("at")[0].as_py(), table.column("kind")[0].as_py()
        name, value = table.column("file")[0].as_py(), None
        if kind == "before":
            ids, n = summed(np.concatenate([spread(x) for x in table.column("keys").to_pylist()]), np.concatenate([spread_counts(x) for x in table.column("counts").to_pylist()]))
            whole = np.zeros(int(words.starts[at + 1] - words.starts[at]), np.uint64)
            whole[ids.astype(np.int64) - words.starts[at]] = n
            name = put(folder, {"before": narrow(whole)})
            value = [int((n == c).sum()) for c in (1, 2, 3, 4)] + [int((n >= 3).sum())]
        elif kind != "file":
            value = np.stack([np.frombuffer(x, np.uint64) for x in table.column("counts").to_pylist()]).sum(axis=0).tolist()
        return pa.table({"at": [at], "kind": [kind], "value": pa.array([value], pa.list_(pa.int64())), "file": pa.array([name], pa.string())})

    dealt = texts.select("text").mapInArrow(pairs, "shard long, contexts binary, after binary, counts binary")
    counted = dealt.groupBy("shard").applyInArrow(reduce, "at long, kind string, keys binary, counts binary, file string")
    found = counted.groupBy("at", "kind").applyInArrow(finish, "at long, kind string, value array<long>, file string").collect()
    files = {(r["kind"], r["at"]): r["file"] for r in found}
    added = lambda kind: np.array([r["value"] for r in found if r["kind"] == kind] or [[0] * 5], np.int64).sum(axis=0).tolist()
    made, totals, low = {r["at"]: r["value"] for r in found if r["kind"] == "hot"}, added("counts"), added("before")
    high_d, low_d = Discounts(totals[:4]), Discounts(low[:4])
    mass = (low_d.d[1] * low[0] + low_d.d[2] * low[1] + low_d.d[3] * low[4]) / totals[4] if totals[4] else 1.0
    stats = np.array([made.get(i, [0] * 4) for i in hot.tolist()], float).reshape(-1, 4)
    of = lambda kind: [files.get((kind, s)) for s in range(shards)]
    return Model(words, of("before"), of("file"), hot, stats, totals[4], high_d, low_d, mass)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row of docs(doc_id, held_out, text)."""
    words = model.words
    total = words.tokens + words.size + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 6 * CHUNK):
            lengths, (ids, counts, before) = token_ids(part.column(2).to_pylist(), words, (("counts", words.files), ("before", model.before)))
            first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            p = model.word_p(before)
            previous = contexts_of(ids, lengths, words.size)
            known = np.flatnonzero(previous != UNKNOWN)
            if len(known):
                v, w = previous[known], ids[known]
                order = pair_order(v, w, words.packed)
                new = np.concatenate(([True], (v[order][1:] != v[order][:-1]) | (w[order][1:] != w[order][:-1])))
                one = known[order[new]]
                p[known[order]] = model.context_p(previous[one], ids[one], p[one])[np.cumsum(new) - 1]
            base = np.add.reduceat(np.log10((counts + 1) / total), first)
            score = np.add.reduceat(np.log10(p), first)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:2], pa.array(lengths, pa.int64()), pa.array(np.add.reduceat((counts > 0).astype(np.int64), first)), pa.array(np.full(len(lengths), words.tokens)), pa.array(base), pa.array(score), pa.array(10 ** (-score / lengths))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_of_id(doc_id) % 7 == 2, F.lit(True))


def as_uri(folder: str) -> str:
    """A folder as a URI that pyarrow reads: file:/x and /x become file:///x."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        return folder.replace("file:/", "file:///", 1)
    return folder if "://" in folder else f"file://{os.path.abspath(folder)}"


def modelled(docs: DataFrame, shards: int | None = None, packed_below: int = PACKED) -> DataFrame:
    """Scores of every row of docs(doc_id, text), learned from the rows whose crc32(doc_id) mod 7 is not 2.

    Without `shards` there is one for each SHARD_BYTES of text, and no fewer than shuffle partitions.
    """
    spark = small_batches(docs).sparkSession
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    if shards is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    model = learned(rows.where(~F.col("held_out")), as_uri(shared_path(spark, "kneser-ney")), shards, packed_below)
    return scored(rows, model)
