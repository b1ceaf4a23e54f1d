"""Chains, components, bounded traversal and co-occurrence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.tables import dealt, written

MOST_NODES, MOST_DEPTH = 10, 5


def canonical(df: DataFrame, key: str, target: str, merged: Column) -> DataFrame:
    """(key, canonical_id, hops, error) of every row: follow targets while a row is merged.

    A chain may visit MOST_NODES nodes. Errors, in this order: no_target, self, cycle, depth, missing. Pointer doubling: each round
    joins a row's path with the path of its last node, so four written rounds cover every chain, and ended rows are not joined again.
    """
    nodes = df.select(F.col(key).cast("string").alias("id"), F.col(target).cast("string").alias("to"), merged.alias("merged"))
    known = nodes.select(F.col("id").alias("to"), F.lit(True).alias("there"))
    end = F.when(~F.col("merged"), "done").when(F.col("to").isNull(), "no_target").when(F.col("to") == F.col("id"), "self").when(F.col("there").isNull(), "missing")
    empty = F.array().cast("array<string>")
    state = nodes.join(known, "to", "left").select("id", F.when(end.isNull(), F.array("to")).otherwise(empty).alias("path"), end.alias("end"))
    reach = 1
    while reach <= MOST_NODES:
        state = written(state, "chains")
        on = state.where("end is null").withColumn("tail", F.element_at("path", -1))
        ahead = state.select(F.col("id").alias("tail"), F.col("path").alias("more"), F.col("end").alias("then"))
        state = on.join(ahead, "tail").select("id", F.concat("path", "more").alias("path"), F.col("then").alias("end")).unionByName(state.where("end is not null"))
        reach *= 2
    whole = F.concat(F.array("id"), "path")
    again = F.transform(whole, lambda x, i: F.when(F.array_position(whole, x) <= i, i))  # places of nodes met before
    rows = state.select("id", "end", whole.alias("whole"), F.array_min(F.array_compact(again)).alias("again"), F.size("path").alias("last"))
    deep = F.lit(MOST_NODES - 1)
    ends = F.col("end").isNotNull() & ((F.col("last") < deep) | (F.col("last") == deep) & (F.col("end") != "missing"))
    error = F.when(F.col("again") - 1 <= deep, "cycle").when(ends, F.nullif("end", F.lit("done"))).otherwise("depth")
    hops = F.when(F.col("again") - 1 <= deep, F.col("again") - 1).when(ends, F.col("last")).otherwise(deep)
    rows = rows.select("id", "whole", hops.alias("hops"), error.alias("error"))
    return rows.select(F.col("id").alias(key), F.when(F.col("error").isNull(), F.get("whole", F.col("hops"))).alias("canonical_id"), "hops", "error")


def components(links: DataFrame) -> DataFrame:
    """id and component (the least id reachable) of every id in links(a, b), ids being whole numbers or strings.

    Stars are formed again and again, each round a written table: each node's larger neighbours are tied to its least neighbour, then
    each node's smaller neighbours and the node itself to the least of them, until nothing changes. The rounds grow with the logarithm
    of the longest path. Nulls and self-links are ignored.

    A node of very many links is a hot key. Its minimum comes from partial minima; the joins with the minima are made on another form
    of the key, so that both sides have a shuffle of their own, right below the join, and Spark can split the hot partition.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    other = (lambda c: F.concat(c, F.lit("'"))) if dict(edges.dtypes)["a"] == "string" else F.bitwise_not  # one to one

    def with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
        right = least.select(other(F.col("a")).alias("k"), "m")
        return rows.withColumn("k", other(F.col("a"))).join(right, "k").drop("k")

    edges, before = written(edges, "links"), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first()
        if before == now or not now[0]:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = with_least(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = with_least(large, small).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(tied.unionByName(small.select("a", F.col("m").alias("b"))).distinct(), "links")
    stars = edges.groupBy("a").agg(F.min("b").alias("b"))
    return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def reachable(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(node, depth): nodes within `depth` hops of the seeds over edges(a, b), read both ways; the least depth counts.

    Each hop is a written table, so no hop is computed twice.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    seen = seeds.select(F.col(seeds.columns[0]).alias("node"), F.lit(0).alias("depth")).distinct()
    front = seen.select("node")
    for k in range(1, min(depth, MOST_DEPTH) + 1):
        new = written(front.join(both, front["node"] == both["a"]).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti"), "hop")
        front = new.select("node")
        seen = seen.unionByName(new.select("node", F.lit(k).alias("depth")))
    return seen


def hop_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(hop, and edges' columns): each edge once between nodes(node, depth), at the hop that first walks it; edges that close a cycle too."""
    at = lambda c, n: nodes.select(F.col("node").alias(c), F.col("depth").alias(n))
    return edges.join(at("a", "da"), "a").join(at("b", "db"), "b").select((F.least("da", "db") + 1).alias("hop"), *edges.columns).distinct()


def co_occurrence(df: DataFrame, group: str, item: str) -> DataFrame:
    """(a, b, n, first_source), a < b: items met in a same group, the number of such groups, and the least of their ids.

    The pairs of a group are the result, so their number is what the question asks; a large group's rows are dealt over `b`'s blocks by
    a salt of its size, so that no task makes all pairs of a group. Rows and pairs are dealt over so many parts that a task's share, and
    with it its memory, does not grow with the table.
    """
    rows = written(dealt(df.select(group, F.col(item).alias("b")), df.count(), group).distinct(), "groups")
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    n = sizes.agg(F.count(F.lit(1)), F.sum("size"), F.sum(F.col("size") * (F.col("size") - 1) / 2)).first()
    sized = dealt(rows, n[1] or 0, group).join(sizes.select(group, F.ceil(F.col("size") / 1000).cast("int").alias("salts")), group)
    right = sized.withColumn("salt", F.pmod(F.xxhash64("b"), "salts").cast("int")).drop("salts")
    left = sized.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(group, F.col("b").alias("a"), "salt")
    pairs = left.join(right, [group, "salt"]).where("a < b")
    return dealt(pairs, int(n[2] or 0), "a", "b", rows=1_000_000).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(group).alias("first_source"))


def edges(*parts: tuple[str, DataFrame, Column, Column]) -> DataFrame:
    """(label, a, b): direct edges of several kinds as one relation; a part is (label, rows, from, to)."""
    made = [d.select(F.lit(label).alias("label"), a.cast("string").alias("a"), b.cast("string").alias("b")).where("a is not null and b is not null") for label, d, a, b in parts]
    return reduce(DataFrame.unionByName, made).distinct()


def sourced_edges(*parts: tuple[str, DataFrame, Column, Column, Column]) -> DataFrame:
    """(label, a, b, source): each distinct edge with the least record that it comes from; a part is (label, rows, from, to, source)."""
    made = [d.select(F.lit(label).alias("label"), a.cast("string").alias("a"), b.cast("string").alias("b"), source.cast("string").alias("source")).where("a is not null and b is not null") for label, d, a, b, source in parts]
    return reduce(DataFrame.unionByName, made).groupBy("label", "a", "b").agg(F.min("source").alias("source"))
