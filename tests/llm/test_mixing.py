"""Mixing of sources: targets by hand, thresholds against sorted places, odd rows."""

from collections import defaultdict
from math import floor

from pyspark.sql import functions as F
from quillgraph.llm import mixing


def targets_by_hand(sizes, weights=mixing.WEIGHTS, most=mixing.MOST):
    """The excess of what is above its bound is shared out again until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    held = set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in held)
        free = sum(weight[s] for s in names if s not in held)
        share = {s: most * sizes[s] if s in held else rest * weight[s] / free for s in names}
        more = {s for s in names if share[s] > most * sizes[s]} - held
        if not more:
            return share
        held |= more


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_and_taken_words(spark):
    rows = [(i, "w " * (i % 37 + 1), ["a", "b", "c", "d", None][min(4, i % 23)]) for i in range(3000)]
    got = mixing.mixed(docs(spark, rows)).collect()
    by = {i: s for i, _, s in rows}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[by[r.doc_id]] += r.size
        taken[by[r.doc_id]] += r.taken
        assert r.taken <= 3 * r.size
    want = targets_by_hand(sizes)
    for r in got:
        assert abs(r.target - want[by[r.doc_id]]) < 1e-6 and r.source_size == sizes[by[r.doc_id]]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mixed(docs(spark, rows[::-1])).collect()))  # in any order of rows


def test_thresholds_equal_sorted_places(spark):
    """The same documents as by sorting each source's places; a larger budget keeps what a smaller one took."""
    rows = mixing.sized(docs(spark, [(i, "w " * (i % 11), f"s{i % 3}") for i in range(2000)])).cache()
    listed = rows.collect()
    took = {}
    for budget in (1.0, 700.5, 2500.0):
        edges = mixing.thresholds(rows, spark.createDataFrame([(f"s{k}", budget) for k in range(3)], "source string, short double"))
        for e in edges.collect():
            below, places = 0, sorted((r.at, r.size) for r in listed if r.source == e.source)
            for at, size in places:
                if below + size > budget:
                    break
                below += size
            assert (e.edge, e.short, e.there) == (at, budget - below, size)
            assert took.get(e.source, -1) <= e.edge
            took[e.source] = e.edge


def test_one_id_in_many_rows_is_cut_evenly(spark):
    got = mixing.mixed(docs(spark, [(7, "a b c d", "x")] * 300 + [(i, "w " * 10, "y") for i in range(20)])).collect()
    x = [r for r in got if r.size == 4]
    assert len(x) == 300 and len({r.taken for r in x}) == 1
    assert 0 <= x[0].target - sum(r.taken for r in x) < 300
    y = [r for r in got if r.size == 10]
    assert sum(r.taken for r in y) == floor(y[0].target)


def test_odd_and_empty_tables(odd, clashing, empty, spark):
    want = sorted(map(tuple, mixing.mixed(odd).collect()), key=repr)
    assert len(want) == odd.count() and sorted(map(tuple, mixing.mixed(clashing.withColumns({c: F.lit(1) for c in ("size", "at", "target", "source_size")})).collect()), key=repr) == want
    assert {r[1] for r in want if r[0] in (3, 4, 5)} == {0}
    assert mixing.mixed(empty).count() == 0
    none = mixing.mixed(docs(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert [(r.size, r.target, r.taken) for r in none] == [(0, 0.0, 0)] * 2
