"""The change feed against the rules day by day, with odd lines."""

import datetime as dt
import math
import random
import zlib
from collections import defaultdict

from quillgraph.llm import leaderboard

LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, flag string, shipped_at timestamp, batch string, cents string"
EPOCH = dt.datetime(1970, 1, 1)


def by_hand(lines, prices, nations):
    read = []
    for sale, no, item, vendor, quantity, amount, flag, at, *_ in lines:
        h = zlib.crc32(",".join("" if x is None else str(x) for x in (sale, item, vendor, no)).encode())
        s = 19723 + h % 150 if at is None else (at - EPOCH).days
        a = s + h % 7 + (20 if h % 5 == 0 else 0)
        cents = math.floor(100 * amount + 0.5) if amount is not None else quantity * math.floor(100 * prices[item] + 0.5) if None not in (quantity, prices.get(item)) else 0
        known = item in prices and nations.get(vendor) is not None
        read.append((max(1, min(10, 1 + (a - 19723) * 10 // 180)), a, s, nations.get(vendor) if known else None, item, -cents if flag == "swapped" else cents))
    sums, board, out, oldest = defaultdict(lambda: defaultdict(int)), {}, [], None
    for batch in range(1, 11):
        own = [r for r in read if r[0] == batch]
        counted = [r for r in own if r[3] is not None and (oldest is None or r[2] + 3 >= oldest)]
        for day in sorted({r[1] for r in counted}):
            for _, a, _, nation, item, cents in counted:
                if a == day:
                    sums[nation][item] += cents
            for nation, of in sums.items():
                now = {item: k + 1 for k, (_, item) in enumerate(sorted((-v, i) for i, v in of.items() if v > 0)[:10])}
                old = board.get(nation, {})
                for item in now.keys() | old.keys():
                    if now.get(item) != old.get(item):
                        out.append((nation, day, item, batch, "enter" if item not in old else "exit" if item not in now else "move", old.get(item), now.get(item), of[item]))
                board[nation] = now
        oldest = max([r[2] for r in own] + [oldest] * (oldest is not None), default=oldest)
    return out


def test_feed_against_the_rules(spark):
    rng = random.Random(5)
    items = [(i, None if i % 9 == 0 else i * 1.005) for i in range(40)]
    vendors = [(v, None if v == 3 else v % 3) for v in range(8)]
    lines = []
    for k in range(900):
        at = None if rng.random() < 0.05 else dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(-4, 170), hours=rng.randrange(24))
        lines.append((rng.choice([k, None]), rng.choice([1, 2, None]), rng.choice([None, 99, 7, 7, 7, *range(40)]), rng.choice([None, 50, 1, 1, 1, *range(8)]), rng.choice([None, 2, 10]), rng.choice([None, 0.005, 12.345, rng.random() * 500]), rng.choice(["kept", "swapped", None]), at, "mine", "mine"))
    lines += lines[:50]
    tables = [spark.createDataFrame(x, y) for x, y in ((lines, LINES), (items + items[:3], "item_id long, price double"), (vendors + [(None, 1)], "vendor_id long, nation_id int"))]
    want = by_hand(lines, dict(items), dict(vendors))
    assert len(want) > 200 and {c[4] for c in want} == {"enter", "exit", "move"}
    key = "spark.sql.streaming.stateStore.maintenanceInterval"
    before = spark.conf.get(key)
    got = leaderboard.feed(*tables)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert spark.conf.get(key) == before
    empty = leaderboard.feed(tables[0].limit(0), *tables[1:])
    assert empty.count() == 0 and empty.dtypes == got.dtypes


def test_only_keys_that_can_lead_are_followed(spark):
    """Ten keys stay far ahead: of a thousand others only those whose gains could reach them are contenders."""
    rows = [(1, i, 1e6 + i, 1e6 + i, 1e6 + i - 5) for i in range(10)] + [(1, 100 + i, float(i), float(i) + (2e6 if i == 500 else 10), float(i) - 10) for i in range(1000)] + [(2, 1, -5.0, -1.0, -9.0), (2, 2, -5.0, 1.0, -9.0)]
    found = leaderboard.contenders(spark.createDataFrame(rows, "nation_id int, item_id long, opening double, most double, least double"))
    assert {(r.nation_id, r.item_id) for r in found.collect()} == {(1, i) for i in range(10)} | {(1, 600), (2, 2)}


def test_a_batch_makes_few_shuffles(spark):
    """Boards are built once for all batches, so that a batch costs the stream's shuffle and those of its own lines."""
    lines = [(k, 1, k % 20, k % 5, 1, 10.0 + k % 7, "kept", dt.datetime(2024, 1, 1) + dt.timedelta(days=k % 12), "mine", "mine") for k in range(400)]
    tables = [spark.createDataFrame(x, y) for x, y in ((lines, LINES), ([(i, 5.0) for i in range(20)], "item_id long, price double"), ([(v, v % 2) for v in range(5)], "vendor_id long, nation_id int"))]
    shuffles = spark.sparkContext._jsc.sc().newShuffleId
    before = shuffles()
    assert leaderboard.feed(*tables).count() > 0
    assert shuffles() - before < 34  # 26; 40 when each batch built its boards itself
