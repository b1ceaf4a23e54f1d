"""URL lists as tables: of many hosts, by cascade and by joins."""

import random

from quillgraph.llm import urlfilter as u

NAMES = ("cheap-pills", "spam-farm", "casino-win", "ads-track", "free-bets")
DATA = "/root/testdata/sf0.1"


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_list_of_many_hosts_by_cascade_and_by_joins(spark):
    random.seed(7)
    listed = [("block", f"h{k}.example.{random.choice(('com', 'org', 'net'))}", random.choice(("", "/a/"))) for k in range(20_000)] + [("block", None, "")]
    hosts = [x[1] for x in random.sample(listed[:-1], 300)] + [f"h{k}.example.info" for k in range(300)]
    urls = [f"http://{random.choice(('', 'm.'))}{h}{random.choice(('/', '/a/1', '/b'))}" for h in hosts] + [None, "no scheme", f"http://{hosts[0]}/de/"] * 2
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame(listed, "verdict string, host string, path string")
    entries = tuple(u.Entry(v, h, p) for v, h, p in listed if h)
    got = rows_of(u.judged(pages, listed=table))
    assert got == rows_of(u.judged(pages, listed=entries)) == rows_of(u.judged(pages, listed=table, max_bytes=1))

    by_host = {}
    for e in entries:
        by_host.setdefault(e.host, []).append(e.path)
    for r in u.judged(pages, listed=table).collect():
        fits = [h + p for h in (r.host, r.host.partition(".")[2]) for p in by_host.get(h, ()) if r.path.startswith(p)]
        assert r.listed == max(fits, key=len, default=None)


def test_joins_equal_the_cascade_on_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    assert rows_of(u.judged(pages, max_bytes=1)) == rows_of(u.judged(pages))
    names = spark.createDataFrame([("block", f"{n}.example.{d}", "") for n in NAMES for d in ("com", "org")], "verdict string, host string, path string")
    assert u.judged(pages, listed=names).where("listed is not null").count() == pages.where("url rlike '://([^/?#]*[.])?(" + "|".join(NAMES) + ")[.]example[.](com|org)([/?#]|$)'").count()
