"""Document fingerprints by content-defined chunking.

A gear hash of the last 32 bytes picks the chunk ends: up to the normal size a strict mask must match, past it a loose one, so chunk
sizes gather near the normal size. Ends depend on nearby bytes alone, so an insertion moves only the chunks around it. The
fingerprint is the set of chunk digests, each with its length; the likeness of a to b is the share of a's length whose chunks b has.

Written form: 13 hexadecimal digits a chunk, 10 of the digest and 3 of the length, sorted, without repeats. A null or empty text has
the empty fingerprint; it is like an empty one by 1 and like any other by 0.

`edited` pairs each row with the one of the next id (after the last comes the first; rows of one id go by a digest of their text, then by
the text; null ids come first). Ids are of any type that Python orders as Spark does: numbers, strings, dates, binary. Rows are dealt by
ranges of (id, digest), so many rows of one id are split too; equal rows stay together. The cuts come from a sample of SAMPLE
keys a range, and their number from the bytes of all texts: a range has about RANGE_BYTES, more where that would make over MOST_RANGES.
The first rows of a range are also sent to the range before, so a range has all that it needs and no task holds more
than one range and the row after it. Repeated rows are neighbours of each other. An empty table
gives no row. A very long text is chunked whole, in memory of its length; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillgraph.llm.common import small_batches

#: Chunk sizes in bytes, and the bits of the strict and the loose mask.
LEAST, NORMAL, MOST, STRICT, LOOSE = 16, 64, 512, 8, 4
WINDOW = 32
#: Text of a range of ids, how many ranges there may be, and keys that are sampled for each.
RANGE_BYTES, MOST_RANGES, SAMPLE = 32 << 20, 20_000, 20
#: A random number for each byte, from a digest of its value.
GEAR = np.array([int.from_bytes(hashlib.sha256(b"gear" + bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


def gear(data: bytes) -> np.ndarray:
    """At each byte, the sum of the last 32 bytes' numbers, each shifted by its distance."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint32(step)  # the right side is made before it is added
        step *= 2
    return h


def ends(data: bytes) -> list[int]:
    """Ends of the chunks, the last at the end of the data."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = gear(data)
    loose_at = np.flatnonzero(h >> np.uint32(32 - LOOSE) == 0)
    strict = (loose_at[h[loose_at] >> np.uint32(32 - STRICT) == 0] + 1).tolist()
    loose = (loose_at + 1).tolist()
    out, at, i, j = [], 0, 0, 0
    while n - at > LEAST:
        i = bisect_left(strict, at + LEAST, i)
        end = strict[i] if i < len(strict) and strict[i] < at + NORMAL else 0
        if not end:
            j = bisect_left(loose, at + NORMAL, j)
            end = loose[j] if j < len(loose) and loose[j] < at + MOST else at + MOST
        at = min(end, n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def chunks(text: str | None) -> dict[str, int]:
    """Digest and length of each distinct chunk, keyed by the written form."""
    data = (text or "").encode()
    out, at, digest = {}, 0, xxhash.xxh3_64_intdigest
    for end in ends(data):
        out[f"{digest(data[at:end]) & 0xFFFFFFFFFF:010x}{end - at:03x}"] = end - at
        at = end
    return out


def written_form(found: dict[str, int]) -> str:
    return "".join(sorted(found))


def read_form(fingerprint: str) -> dict[str, int]:
    parts = [fingerprint[i : i + 13] for i in range(0, len(fingerprint), 13)]
    return {p: int(p[10:], 16) for p in parts}


def likeness(a: dict[str, int], b: dict[str, int]) -> float:
    """The share of a's length whose chunks b has."""
    if not a:
        return float(not b)
    return sum(n for c, n in a.items() if c in b) / sum(a.values())


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([written_form(chunks(t)) for t in texts], pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    rows = small_batches(docs).select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_chars long, fingerprint string")


def _key(doc_id: object, digest: int) -> tuple:
    return (False, 0, digest) if doc_id is None else (True, doc_id, digest)


def _cuts(keys: DataFrame, n_ranges: int | None) -> list[tuple]:
    """The keys at which ranges begin, but for the first. keys: doc_id, digest, bytes."""
    whole = keys.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    n_ranges = n_ranges or min(MOST_RANGES, -(-whole["bytes"] // RANGE_BYTES))
    if n_ranges < 2 or not whole["n"]:
        return []
    share = min(1.0, SAMPLE * n_ranges / whole["n"])
    sample = sorted(_key(r["doc_id"], r["digest"]) for r in keys.select("doc_id", "digest").sample(share, seed=1).collect())
    return sorted({sample[k * len(sample) // n_ranges] for k in range(1, n_ranges)}) if sample else []


def _apart(spark: SparkSession, n: int) -> list[int]:
    """For each of n ranges a number that hash partitioning puts into a partition of its own."""
    found = spark.range(16 * n + 64).groupBy(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()
    of = {r["p"]: r["id"] for r in found}
    return [of.get(p, 16 * n + 64 + p) for p in range(n)]


def by_range(docs: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """docs(doc_id, text) dealt by ranges of ids: columns range, after (0 own row, 1 the row after the range), doc_id, text; sorted."""
    spark = small_batches(docs).sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("digest"))
    cut = spark.sparkContext.broadcast(_cuts(rows.select("doc_id", "digest", F.octet_length("text").alias("bytes")), n_ranges))  # at most MOST_RANGES keys

    def ranged(batch: pa.RecordBatch) -> list[tuple[int, tuple]]:
        keys = [_key(*x) for x in zip(batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist(), strict=True)]
        return [(bisect_right(cut.value, k), k) for k in keys]

    def leasts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, tuple[tuple, int, pa.RecordBatch]] = {}
        for batch in batches:
            for i, (at, key) in enumerate(ranged(batch)):
                if at not in least or key < least[at][0]:
                    least[at] = (key, i, batch)
            least = {at: (key, 0, b.slice(i, 1)) for at, (key, i, b) in least.items()}
        for at, (_, i, b) in least.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *b.slice(i, 1).columns], names=["range", "doc_id", "digest"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, (ids, _, texts) = ranged(batch), (batch.column(c) for c in ("doc_id", "digest", "text"))
            n = len(found)
            yield pa.RecordBatch.from_arrays([pa.array([apart[at] for at, _ in found], pa.int32()), pa.array([0] * n, pa.int32()), *batch.columns], names=names)
            if first := [i for i, (_, key) in enumerate(found) if key in before.value]:
                part = batch.take(pa.array(first))
                yield pa.RecordBatch.from_arrays([pa.array([apart[before.value[found[i][1]]] for i in first], pa.int32()), pa.array([1] * len(first), pa.int32()), *part.columns], names=names)

    names, kind = ["range", "after", *rows.columns], rows.schema["doc_id"].dataType.simpleString()
    lists = rows.select("doc_id", "digest").mapInArrow(leasts, f"range int, doc_id {kind}, digest long").groupBy("range").agg(F.min(F.struct("doc_id", "digest")).alias("k")).collect()
    least = sorted((r["range"], _key(*r["k"])) for r in lists)
    apart = _apart(spark, len(cut.value) + 1)
    before = spark.sparkContext.broadcast({v: least[k - 1][0] for k, (_, v) in enumerate(least)})  # least key of a range -> the range before it
    dealt = rows.mapInArrow(ranges, f"range int, after int, doc_id {kind}, text string, digest long")
    return dealt.repartition(len(apart), "range").sortWithinPartitions("range", "after", F.asc_nulls_first("doc_id"), "digest", "text").drop("digest")


def edited(docs: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs(doc_id, text).

    The edited text is the text with its last quarter (floor) replaced by the first as many code points of the next row's text.
    """
    dealt = by_range(docs, n_ranges)
    kind = dealt.schema["doc_id"].dataType
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [to_arrow_type(kind), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, size = [], None, 0  # held: the row that waits for the next
        for batch in batches:
            for at, after, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                if held and held[0] != at:
                    held = None
                if after and not held:
                    continue
                found = chunks(text)
                if held:
                    _, doc0, text0, found0 = held
                    k = len(text0) // 4
                    new = text0[: len(text0) - k] + text[:k]
                    found1 = chunks(new)
                    rows.append((doc0, len(text0), hashlib.sha256(new.encode()).hexdigest(), written_form(found0), written_form(found1), likeness(found0, found1), likeness(found0, found)))
                    size += len(text0)
                held = None if after else (at, doc, text, found)
                if size > 8 << 20 or len(rows) > 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = f"doc_id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(run, schema)
