"""URL filtering by a Bloom filter cascade.

A list entry is a host and a path prefix, written together (`example.org/es/`, or a bare host, which covers all paths). It fits its
host and all subdomains. The keys of a url are the entries that could fit it: its last k labels, for every k that a listed host
has, with its path's first n characters, for every n that a listed path has. The keys of all urls are the universe.

Level 1 of a cascade holds the listed keys. Level 2 holds the universe's keys that level 1 takes though they are not listed, level
3 the listed keys that level 2 takes, and so on until none is left. A key's answer is the parity of the first level that does not
hold it: exact for the whole universe, so a scan needs the levels alone and no join with the list.

Size: a level has BITS bits a key; the list's length bounds level 1, and each further level is a small share of the one before. Past
MAX_BYTES the levels would not be fit to send to every worker; then `cascades` raises and `judged` gives the same answer by
joins of keys (`semi_joined`).

A list is a tuple of entries or, at any length, a DataFrame of verdict, host and path. Of a DataFrame only the shapes of its entries
(label counts and path lengths) come to the driver. An entry that is there under both verdicts counts as allowed.

A list's own entries are a list of the caller's; the query's is made by rule from TOPICS, DEALS and DOMAINS, 1620 hosts.

Defined results: a null url or one without `://` has an empty host and path, no rule and the default verdict. Repeated urls and ids
are judged row by row, null ids too; other columns are ignored. An empty table gives no row, an empty list lists nothing. A url is
read whole, whatever its length; its keys are bounded by the shapes of the entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import small_batches, written

#: Bits and hash functions a key, and the largest size of all levels together.
BITS, HASHES, LEAST_BITS, MAX_BYTES = 10, 5, 1024, 256 << 20
#: Words of a level that come to the driver as one row.
PART = 1 << 16

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Entry:
    verdict: str
    host: str
    path: str = ""

    @property
    def key(self) -> str:
        return self.host + self.path


# The rules of the contract.
RULES = (
    Entry(ALLOW, "org", "/"),
    Entry(BLOCK, "example.org", "/es/"),
    Entry(BLOCK, "example.org", "/en/1"),
    Entry(ALLOW, "com", "/fr/"),
    Entry(BLOCK, "com", "/de/"),
)
# Parameters of the listed hosts: a topic and what is done with it, below each of the domains.
TOPICS = ["ads", "bets", "bonus", "casino", "cheap", "clicks", "coupon", "crypto", "dating", "debt", "discount", "doping", "escort", "fast", "followers", "forex", "free", "gold", "loan", "lottery", "mega", "miracle", "pills", "poker", "prize", "replica", "slots", "spam", "warez", "win"]
DEALS = ["bets", "cash", "clicks", "deal", "farm", "free", "market", "money", "now", "offer", "pills", "play", "shop", "spy", "spins", "track", "vip", "win"]
DOMAINS = ["example.com", "example.net", "example.org"]
LISTED = tuple(Entry(BLOCK, f"{a}-{b}.{d}") for a in TOPICS for b in DEALS for d in DOMAINS)


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


Entries = tuple[Entry, ...] | DataFrame


def shapes_of(entries: Entries) -> list[tuple[int, int]]:
    """Label counts and path lengths of entries; they share few."""
    if isinstance(entries, DataFrame):
        shape = F.size(F.split("host", r"\.")).alias("k"), F.length(F.coalesce("path", F.lit(""))).alias("n")
        return sorted(((r.k, r.n) for r in entries.where("host is not null").select(*shape).distinct().collect()), reverse=True)
    return sorted({(e.host.count(".") + 1, len(e.path)) for e in entries}, reverse=True)


def listing(spark: SparkSession, name: str, entries: Entries) -> DataFrame:
    """list, key of entries; a list's name is that of the keys and the verdict."""
    if isinstance(entries, DataFrame):
        rows = entries.where("host is not null and verdict is not null")
        return rows.select(F.concat_ws(" ", F.lit(name), "verdict").alias("list"), F.concat("host", F.coalesce("path", F.lit(""))).alias("key"))
    return spark.createDataFrame([(f"{name} {e.verdict}", e.key) for e in entries], "list string, key string")


def keys_of(host: Column, path: Column, entries: Entries) -> Column:
    """The keys of a url for these entries, the longest first."""
    shapes = shapes_of(entries)
    found = [F.when((F.length(path) >= n) & (F.size(F.split(host, r"\.", k + 1)) >= k), F.concat(F.substring_index(host, ".", -k), F.substring(path, 1, n))) for k, n in shapes]
    kept = F.array_distinct(F.array_compact(F.array(*found))) if found else F.array().cast("array<string>")
    return F.transform(F.array_sort(F.transform(kept, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("key")))), lambda s: s.key)


def hashed(keys: list[str]) -> np.ndarray:
    """Two 64-bit hashes a key."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(k.encode("utf-8", "surrogatepass")) for k in keys), ">u8").reshape(-1, 2).astype(np.uint64)


@dataclass
class Level:
    n_bits: int
    words: np.ndarray = field(repr=False)

    def holds(self, pairs: np.ndarray, level: int) -> np.ndarray:
        out = np.ones(len(pairs), bool)
        for at in places(pairs, level, self.n_bits):
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0
        return out


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    for _ in range(2):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def places(pairs: np.ndarray, level: int, n_bits: int) -> list[np.ndarray]:
    """Bit positions of each key by double hashing. Each level mixes the hashes anew: keys that collide in one part again."""
    start = mixed(pairs[:, 0] + mixed(np.array([2 * level + 1], np.uint64)))
    step = mixed(pairs[:, 1] + mixed(np.array([2 * level + 2], np.uint64))) | np.uint64(1)
    return [(start + np.uint64(i) * step) % np.uint64(n_bits) for i in range(HASHES)]


class TooLarge(ValueError):
    """The levels of the cascades are larger than may be sent to every worker."""


class Cascade:
    def __init__(self, levels: list[Level] | None = None):
        self.levels = levels or []

    def members(self, keys: list[str]) -> np.ndarray:
        """Whether each key is listed; exact for keys of the universe."""
        if not keys or not self.levels:
            return np.zeros(len(keys), bool)
        pairs = hashed(keys)
        out, open_ = np.zeros(len(keys), bool), np.ones(len(keys), bool)
        for k, level in enumerate(self.levels):
            holds = level.holds(pairs, k)
            out[open_ & ~holds] = k % 2 == 1  # stopped by a level of false positives: listed
            open_ &= holds
        out[open_] = len(self.levels) % 2 == 1
        return out


def cascades(listed: DataFrame, universe: DataFrame, max_bytes: int = MAX_BYTES) -> dict[str, Cascade]:
    """A cascade for each list, from listed(list, key) and universe(key). All lists grow a level at a time, together.

    The driver gets the levels' words, never the keys.
    """
    made: dict[str, Cascade] = {}
    inner, outer, level, used = written(listed.select("list", "key").distinct(), "listed"), universe.select("key"), 0, 0
    while sizes := {r["list"]: r["n"] for r in inner.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}:
        bits = {name: max(LEAST_BITS, -(-n * BITS // 64) * 64) for name, n in sizes.items()}
        used += sum(bits.values()) // 8
        if used > max_bytes:
            raise TooLarge(f"cascades over {sizes} keys are larger than {max_bytes} bytes; use semi_joined")
        new = {name: Level(n, np.zeros(n // 64, np.uint64)) for name, n in bits.items()}
        words = inner.mapInArrow(_words(level, bits), "list string, word long, bits long").groupBy("list", "word").agg(F.bit_or("bits").alias("bits"))
        packed = words.groupBy("list", F.expr(f"word div {PART}").alias("part")).applyInArrow(_packed, "list string, words binary, bits binary")
        for name, at, found in packed.collect():  # a row a part of the levels, under max_bytes in all
            new[name].words[np.frombuffer(at, np.int64)] = np.frombuffer(found, np.uint64)
        for name, one in new.items():
            made.setdefault(name, Cascade()).levels.append(one)
        wrong = outer.mapInArrow(_held(level, new), "list string, key string")
        if level == 0:  # the only step that meets the lists: which of the few taken keys are really on them
            wrong = wrong.join(inner, ["list", "key"], "left_anti")
        inner, outer, level = written(wrong, "level"), inner, level + 1
    return made


def _packed(table: pa.Table) -> pa.Table:
    """The words of a part of a level as one row."""
    word, bits = (table.column(c).to_numpy() for c in ("word", "bits"))
    return pa.table({"list": table.column("list")[:1], "words": [word.tobytes()], "bits": [bits.tobytes()]})


def _words(level: int, bits: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, pairs = np.array(batch.column(0).to_pylist(), object), hashed(batch.column(1).to_pylist())
            for name in set(names.tolist()):
                at = np.unique(np.concatenate(places(pairs[names == name], level, bits[name])))
                word, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(word), pa.array(bit.view(np.int64))], names=["list", "word", "bits"])

    return run


def _held(level: int, new: dict[str, Level]):
    """Keys that a level takes: of the universe for every list, else of the key's own list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(batch.num_columns - 1)
            pairs = hashed(keys.to_pylist())
            own = np.array(batch.column(0).to_pylist(), object) if batch.num_columns == 2 else None
            for name, one in new.items():
                holds = one.holds(pairs, level)
                if own is not None:
                    holds &= own == name
                kept = keys.filter(pa.array(holds))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(kept), pa.string()), kept], names=["list", "key"])

    return run


def judged(pages: DataFrame, rules: Entries = RULES, listed: Entries = LISTED, default: str = ALLOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """page_id, url, host, path, rule, verdict and listed (the listed entry that fits, or null) of every row of pages(page_id, url).

    The longest fitting rule decides; without one, the longest fitting listed entry; without that, the default.
    """
    spark = small_batches(pages).sparkSession
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.select("*", keys_of(F.col("host"), F.col("path"), rules).alias("rule_keys"), keys_of(F.col("host"), F.col("path"), listed).alias("listed_keys"))
    universe = written(rows.select(F.explode(F.array_distinct(F.concat("rule_keys", "listed_keys"))).alias("key")).distinct(), "universe")
    on_list = listing(spark, "rule_keys", rules).unionByName(listing(spark, "listed_keys", listed))
    try:
        lists = cascades(on_list, universe, max_bytes)
    except TooLarge:
        return _judged_by_joins(rows, on_list, universe, default)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found = batch.num_rows, {}
            for name in ("rule_keys", "listed_keys"):
                keys = batch.column(name).to_pylist()
                flat = [k for row in keys for k in row]
                took = {v: lists[f"{name} {v}"].members(flat) for v in (ALLOW, BLOCK) if f"{name} {v}" in lists}
                best: list[tuple[str | None, str | None]] = []
                i = 0
                for row in keys:  # keys are in falling length
                    hit = next(((k, v) for j, k in enumerate(row, i) for v, t in took.items() if t[j]), (None, None))
                    best.append(hit)
                    i += len(row)
                found[name] = best
            verdict = [found["rule_keys"][i][1] or found["listed_keys"][i][1] or default for i in range(n)]
            rule, on = [x for x, _ in found["rule_keys"]], [x for x, _ in found["listed_keys"]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(x, pa.string()) for x in (rule, verdict, on))], names=["page_id", "url", "host", "path", "rule", "verdict", "listed"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, host string, path string, rule string, verdict string, listed string")


def _judged_by_joins(rows: DataFrame, on_list: DataFrame, universe: DataFrame, default: str) -> DataFrame:
    """judged without cascades: the urls' keys that are listed, then each row's longest one of either kind."""
    verdicts = on_list.select("key", F.substring_index("list", " ", 1).alias("kind"), F.substring_index("list", " ", -1).alias("verdict"))
    verdicts = verdicts.groupBy("key", "kind").agg(F.min("verdict").alias("verdict"))  # allow comes first
    hits = semi_joined(universe, on_list).join(verdicts, "key")
    # kept as a table: the row numbers must be the same on both sides of the last join
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "judged")
    tagged = lambda kind: F.transform(kind, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    keys = F.concat(tagged("rule_keys"), tagged("listed_keys"))
    found = rows.select("row", F.explode(keys).alias("k")).select("row", "k.kind", "k.key").join(hits, ["kind", "key"])
    best = lambda kind: F.max_by(F.struct("key", "verdict"), F.when(F.col("kind") == kind, F.length("key"))).alias(kind)
    found = found.groupBy("row").agg(best("rule_keys"), best("listed_keys")).select("row", F.col("rule_keys").alias("r"), F.col("listed_keys").alias("l"))
    verdict = F.coalesce("r.verdict", "l.verdict", F.lit(default)).alias("verdict")
    return rows.drop("rule_keys", "listed_keys").join(found, "row", "left").select("page_id", "url", "host", "path", F.col("r.key").alias("rule"), verdict, F.col("l.key").alias("listed"))


def semi_joined(keys: DataFrame, listed: DataFrame) -> DataFrame:
    """The way beyond MAX_BYTES: the rows of keys whose key is listed, by a join that Spark may split where a key is hot."""
    return keys.join(listed.select("key").distinct(), "key", "left_semi")


def sql(rules: tuple[Entry, ...] = RULES, listed: tuple[Entry, ...] = LISTED, default: str = ALLOW) -> str:
    """The same judgement as DuckDB SQL."""
    values = lambda entries: ", ".join(f"('{e.verdict}', '{e.host}', '{e.path}')" for e in entries)
    best = "(SELECT arg_max({0}, length({1}.host || {1}.path)) FROM {1} WHERE (p.host = {1}.host OR ends_with(p.host, '.' || {1}.host)) AND starts_with(p.path, {1}.path))"
    return f"""
WITH rules(verdict, host, path) AS (VALUES {values(rules)}), listed(verdict, host, path) AS (VALUES {values(listed)}),
p AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)
)
SELECT page_id, url, host, path, rule, coalesce(v, w, '{default}') AS verdict, l AS listed
FROM (SELECT p.*, {best.format("rules.host || rules.path", "rules")} AS rule, {best.format("rules.verdict", "rules")} AS v,
  {best.format("listed.host || listed.path", "listed")} AS l, {best.format("listed.verdict", "listed")} AS w FROM p)"""
