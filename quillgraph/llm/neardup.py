"""Near-duplicate documents: sets of 5-word shingles, linked at a Jaccard similarity of 0.75 or more.

1. Each text becomes a SetSketch, its number of shingles and a digest of the whole set. Documents of equal digests are one class, named
   by 64 bits of the digest; one sketch of a class goes on. Sets of one or two shingles link only when equal and stop here.
2. Bands of registers name buckets. Within a bucket the most likely similarity of each pair is read from both sketches and both
   sizes; pairs that could reach the threshold tie their classes into a cluster. Only a spanning forest of a bucket's ties is
   written, never its pairs.
3. Each cluster's texts come together once, one a class. Pairs whose sketches could reach the threshold are confirmed on the full
   sets, the most similar first, and pairs already joined are passed over.
4. Components of the confirmed links, and the classes of step 1, give every document its component.

A bucket or cluster of more than BLOCK members (or WEIGHT shingles) is first compared with its first member. Members that tie with it
are joined, so only the rest still ask: each block of the rest meets each block of all members. A group of copies of one text costs
one comparison a member; nothing is left out. Where more than SPREAD blocks of a cluster's texts still ask (long chains), the cluster is
compared within the buckets of step 2 that hold one that asks, so that a text moves at most once for each of its 40 buckets.

Misses: a pair at similarity 0.75 shares no band with probability (1 - 0.75^4)^40 < 3e-7. It is passed over if fewer than AGREE of its
160 registers agree (probability 2e-10) or its estimate lies below SURE, over five standard errors of 0.035 away (below 1e-7). Together
below 5e-7, and much less for more similar pairs. Two classes share a name with a chance of n^2 / 2^65.

Defined results: a text without a word has an empty set, size 0, links with nothing and is its own component. Ids may be of any type
with an order. Rows of one id are judged each by its own text. A null id is linked with nothing: its component is null and the row is
kept. Equal sizes and similarities leave nothing open, since the component is a minimum. A very long text is sketched whole, in
memory of its length. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from quillgraph.llm import setsketch
from quillgraph.llm.common import small_batches, written
from quillgraph.operators.graph import components

#: Links need 100 * common >= PERCENT * union. SURE: the least estimate that is looked into. Share of registers that must agree.
PERCENT, SURE, AGREE = 75, 0.55, 0.53
BLOCK, WEIGHT, PAIRS = 1024, 4_000_000, 20_000
#: A cluster in which more than so many blocks' worth of texts do not link with its first is compared within its buckets.
SPREAD = 4
#: Sets of so few shingles link only when equal: 2 of 3 is less than the threshold.
TINY = 2


def id_of(docs: DataFrame) -> Column:
    return F.col("doc_id").cast("long") if isinstance(docs.schema["doc_id"].dataType, IntegralType) else F.col("doc_id")


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, hash (of the text), n (shingles), class (of equal sets; null if empty), registers (null up to TINY) of every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, classes, registers = [], [], []
            for text in batch.column(2).to_pylist():
                found = setsketch.shingles(text)
                sizes.append(len(found))
                classes.append(int.from_bytes(xxhash.xxh3_128_digest(found.tobytes())[:8], "little", signed=True) if len(found) else None)
                registers.append(setsketch.sketch(found).tobytes() if len(found) > TINY else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(registers, pa.binary())], names=["doc_id", "hash", "n", "class", "registers"])

    rows = small_batches(docs).select(id_of(docs).alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, hash long, n long, class long, registers binary")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys = setsketch.band_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(ids), -1))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids, keys.shape[1]))], names=["key", "id"])


def together(rows: DataFrame) -> DataFrame:
    """Rows of a key and pair of blocks x, y in one partition, sorted."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, "key", "x", "y").sortWithinPartitions("key", "x", "y", "id")


def compared(rows: DataFrame, payload: list[str], near: Callable, run: Callable, split: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """(a, b): spanning forests of the links within the keys of rows(key, id, blocks, *payload).

    run() takes columns key, x, y, asks, id, *payload and compares the pairs of which one asks. Keys of one block are compared as they
    are. Of larger ones, near() tells first which members link with the key's first one, from columns id, first, *payload and the
    first's payload; the others ask. Where they would ask more than SPREAD blocks' worth and split is given, it deals the key's rows and the
    ids that ask into smaller keys, which hold every pair that can link.
    """
    columns = ["key", "x", "y", "asks", "id", *payload]
    zero, yes = F.lit(0), F.lit(True)
    links = together(rows.where("blocks <= 1").select("key", zero.alias("x"), zero.alias("y"), yes.alias("asks"), "id", *payload)).select(*columns).mapInArrow(run, "a long, b long")
    large = rows.where("blocks > 1")
    if large.select("key").isEmpty():
        return links
    large = written(large, "large")
    first = written(large.groupBy("key").agg(F.min_by(F.struct("id", *payload), "id").alias("f")).select("key", F.col("f.id").alias("first"), *(F.col(f"f.{c}").alias(f"first_{c}") for c in payload)), "firsts")
    told = written(large.join(first, "key").select("key", "id", "first", *payload, *(f"first_{c}" for c in payload)).mapInArrow(near, "key long, id long, first long, near boolean"), "told")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    asking = told.where("not near").groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("askers"))
    spread = None
    if split:
        asking = written(asking, "asking")
        far = asking.where(F.col("askers") > SPREAD).select("key")
        if not far.isEmpty():
            asks = told.where("not near").join(far, "key", "left_semi").select("key", "id")
            spread = compared(split(large.join(far, "key", "left_semi"), asks), payload, near, run)
            asking = asking.where(F.col("askers") <= SPREAD)
    members = large.join(asking, "key").withColumn("y", own).withColumn("x", F.explode(F.sequence(zero, F.col("askers") - 1)))
    askers = large.join(told.where("not near").select("key", "id"), ["key", "id"], "left_semi").join(asking, "key")
    askers = askers.withColumn("x", F.pmod(F.xxhash64("id"), F.col("askers")).cast("int")).withColumn("y", F.explode(F.sequence(zero, F.col("blocks").cast("int") - 1)))
    both = members.withColumn("asks", F.lit(False)).unionByName(askers.withColumn("asks", yes))
    rest = together(both.select(*columns)).mapInArrow(run, "a long, b long")
    found = links.unionByName(told.where("near and id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))).unionByName(rest)
    return found if spread is None else found.unionByName(spread)


def by_bands(entries: DataFrame) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Deals large clusters by the buckets of their members: a text goes to as many keys as it has buckets with one that asks, at most."""

    def split(rows: DataFrame, asks: DataFrame) -> DataFrame:
        band = entries.withColumnRenamed("key", "band")
        placed = rows.select("key", "id", F.octet_length("text").alias("bytes")).join(band, "id").join(asks.withColumn("asks", F.lit(1)), ["key", "id"], "left")
        placed = written(placed.select(F.xxhash64("key", "band").alias("at"), "id", "bytes", F.coalesce("asks", F.lit(0)).alias("asks")), "dealt")
        sizes = placed.groupBy("at").agg(F.count(F.lit(1)).alias("members"), F.sum("asks").alias("asks"), F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK / 2), F.ceil(F.sum("bytes") / (8 * WEIGHT))).alias("blocks"))
        kept = placed.select("at", "id").join(sizes.where("members > 1 and asks > 0").select("at", "blocks"), "at")
        return kept.join(rows.select("id", "text"), "id").select(F.col("at").alias("key"), "id", "blocks", "text")

    return split


def grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[list]]:
    """Columns of each run of rows with equal first n_keys columns; runs may go over batches."""
    held: list[list] | None = None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        keys = list(zip(*columns[:n_keys], strict=True))
        at = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[at]:
                part = [c[at:i] for c in columns]
                if held and tuple(c[0] for c in held[:n_keys]) == keys[at]:
                    held = [a + b for a, b in zip(held, part, strict=True)]
                else:
                    if held:
                        yield held
                    held = part
                at = i
    if held:
        yield held


class Union:
    """Sets of row numbers; the root is the least."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def close(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether rows of registers a may reach the threshold with the same rows of b."""
    out = (100 * np.minimum(size_a, size_b) >= PERCENT * np.maximum(size_a, size_b)) & ((a == b).sum(axis=1) >= AGREE * setsketch.REGISTERS)
    at = np.flatnonzero(out)
    if len(at):
        out[at] = setsketch.likely(a[at], b[at], size_a[at], size_b[at]) >= SURE
    return out


def hopeful(registers: np.ndarray, sizes: np.ndarray, asks: np.ndarray, groups: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of a group (first, end) that may reach the threshold and of which one asks, chunk by chunk: rows i, j and their agreeing registers."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n_held = 0

    def look() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j = (np.concatenate(x) for x in zip(*held, strict=True))
        same = np.concatenate([(registers[i[at : at + PAIRS]] == registers[j[at : at + PAIRS]]).sum(axis=1) for at in range(0, len(i), PAIRS)])
        kept = same >= AGREE * setsketch.REGISTERS
        i, j, same = i[kept], j[kept], same[kept]
        if len(i):
            kept = np.concatenate([setsketch.likely(registers[i[at : at + PAIRS]], registers[j[at : at + PAIRS]], sizes[i[at : at + PAIRS]], sizes[j[at : at + PAIRS]]) for at in range(0, len(i), PAIRS)]) >= SURE
            i, j, same = i[kept], j[kept], same[kept]
        return i, j, same

    for first, end in groups:
        for row in range(first + 1, end):
            other = np.arange(first, row)
            fits = 100 * np.minimum(sizes[row], sizes[first:row]) >= PERCENT * np.maximum(sizes[row], sizes[first:row])
            other = other[fits if asks[row] else fits & asks[first:row]]
            if len(other):
                held.append((other, np.full(len(other), row)))
                n_held += len(other)
            if n_held >= PAIRS:
                yield look()
                held, n_held = [], 0
    if held:
        yield look()


def _registers(column: pa.Array | list[bytes]) -> np.ndarray:
    rows = column if isinstance(column, list) else column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint16).reshape(len(rows), -1)


def _forest(ids: list[int], union: Union) -> pa.RecordBatch:
    pairs = {(ids[k], ids[r]) for k in range(len(ids)) if (r := union.root(k)) != k and ids[r] != ids[k]}
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def _told(batch: pa.RecordBatch, near: np.ndarray | list[bool]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(near, pa.bool_())], names=["key", "id", "first", "near"])


def _tie_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns key, id, first, n, registers, first_n, first_registers."""
    for batch in batches:
        if batch.num_rows:
            n, m = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            yield _told(batch, close(_registers(batch.column(4)), _registers(batch.column(6)), n, m) | (batch.column(1).to_numpy() == batch.column(2).to_numpy()))


def _ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the buckets' hopeful pairs; columns key, x, y, asks, id, n, registers."""

    def tied(ids: list[int], sizes: list[int], registers: list[bytes], asks: list[bool], groups: list[tuple[int, int]]) -> pa.RecordBatch:
        union = Union(len(ids))
        for i, j, _ in hopeful(_registers(registers), np.array(sizes, np.int64), np.array(asks, bool), groups):
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                union.join(a, b)
        return _forest(ids, union)

    ids, sizes, registers, asks, groups = [], [], [], [], []
    for columns in grouped(batches, 3):
        groups.append((len(ids), len(ids) + len(columns[4])))
        asks += columns[3]
        ids += columns[4]
        sizes += columns[5]
        registers += columns[6]
        if len(ids) >= 4 * BLOCK:
            yield tied(ids, sizes, registers, asks, groups)
            ids, sizes, registers, asks, groups = [], [], [], [], []
    if ids:
        yield tied(ids, sizes, registers, asks, groups)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _link_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns key, id, first, text, first_text."""
    last, of_last = None, np.zeros(0, np.uint64)
    for batch in batches:
        out = []
        for own, first, text, first_text in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            if first != last:
                last, of_last = first, setsketch.shingles(first_text)
            out.append(own == first or similar(setsketch.shingles(text), of_last))
        yield _told(batch, out)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the clusters' confirmed links; columns key, x, y, asks, id, text."""
    for columns in grouped(batches, 3):
        asks, ids = columns[3:5]
        if len(ids) < 2:
            continue
        sets = [setsketch.shingles(t) for t in columns[5]]
        table, sizes, union = np.array([setsketch.sketch(s) for s in sets]), np.array([len(s) for s in sets], np.int64), Union(len(ids))
        for i, j, same in hopeful(table, sizes, np.array(asks, bool), [(0, len(ids))]):
            for k in np.argsort(-same, kind="stable").tolist():
                a, b = int(i[k]), int(j[k])
                if union.root(a) != union.root(b) and similar(sets[a], sets[b]):
                    union.join(a, b)
        yield _forest(ids, union)


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, hash, n, class, component (a class; null for empty sets and null ids), first (doc_id, hash: the component's least row) of every row."""
    rows = written(sketched(docs), "sketches")
    whole = rows.where("class is not null and doc_id is not null")
    least = F.min(F.struct("doc_id", "hash", "n", "registers")).alias("m")
    classes = written(whole.groupBy("class").agg(least).select(F.col("class").alias("id"), F.struct("m.doc_id", "m.hash").alias("row"), "m.n", "m.registers"), "classes")

    entries = written(classes.where("registers is not null").select("id", "registers").mapInArrow(_bands, "key long, id long"), "bands")
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n_key")).where("n_key > 1")
    buckets = entries.join(shared, "key").withColumn("blocks", F.ceil(F.col("n_key") / BLOCK)).drop("n_key").join(classes.select("id", "n", "registers"), "id")
    clusters = components(compared(buckets, ["n", "registers"], _tie_first, _ties))

    sized = clusters.join(classes.select("id", "row", "n"), "id")
    blocks = sized.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK / 2), F.ceil(F.sum("n") / WEIGHT)).alias("blocks"))
    named = sized.select("id", "row.doc_id", "row.hash", "component").join(written(blocks, "blocks"), "component")
    texts = docs.select(id_of(docs).alias("doc_id"), F.xxhash64("text").alias("hash"), "text").join(named, ["doc_id", "hash"])
    found = components(compared(texts.select(F.col("component").alias("key"), "id", "blocks", "text"), ["text"], _link_first, _links, by_bands(entries)))

    of_class = classes.select(F.col("id").alias("class"), "row").join(found.withColumnRenamed("id", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    of_class = written(of_class, "components")
    firsts = written(of_class.groupBy("component").agg(F.min("row").alias("first")), "firsts")  # a table, so that Spark can split the join below
    named = of_class.select("class", "component").join(firsts, "component")
    mine = F.when(F.col("doc_id").isNotNull(), F.col("class"))
    return rows.select("doc_id", "hash", "n", mine.alias("class")).join(named, "class", "left")


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs(doc_id, text)."""
    out = labelled(docs).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first.doc_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, of which one row of each component stays, that of the least id; of texts without a word one row of an id and text stays. Of rows with one id and text any may stay: which, where other columns differ, is not defined."""
    rows = labelled(docs).where("doc_id is not null")
    kept = rows.where("component is not null").select("first.doc_id", "first.hash").unionByName(rows.where("component is null").select("doc_id", "hash")).distinct()
    key, text = "dedup key of a row", "dedup hash of a text"
    tagged = docs.withColumns({key: id_of(docs), text: F.xxhash64("text")})
    stays = tagged.join(kept.toDF(key, text), [key, text], "left_semi").dropDuplicates([key, text]).drop(key, text)
    return stays.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
