"""Each operator against a brute-force version, and on the odd tables."""

import collections
import hashlib
import html.parser as html_parser
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow.fs
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from quillgraph.llm import bpe, fingerprint, html, kneserney, langid, neardup, packing, quality, queries, setsketch, urlfilter
from tokenizers import Tokenizer

DATA = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


# 1 HTML

PAGE = """<html><head><title>x</title><style>p{}</style></head><body><header>Site</header><nav><a href=a>Home</a> <a href=b>News</a></nav>
<div class="cookie-notice">We use the cookies on the site and you can say no to all of them if you like to do so, as it is only for the site.</div>
<h1>A short title</h1><p>This is the first part of a story that was told by the people who lived in the house on the hill, and it is   long enough to be
one of the good blocks &amp; to show it.</p><p>Short one.</p><script>var t="<p>no</p>";</script><p>And this is the second part of the story that they told us when we came to the house, with more of the words that are in it
&lt;here&gt;.</p><form><p>Sign up for the news of the day and of the week and of the month with us.</p></form>
<div id="comments"><p>I have been to the house and it was the best of all the houses that I have seen in the whole of my life, so there.</p></div><footer>&copy; 2024 Site</footer></body></html>"""


def test_html_page_without_article():
    assert html.extract(PAGE).split("\n") == [
        "A short title",
        "This is the first part of a story that was told by the people who lived in the house on the hill, and it is long enough to be one of the good blocks & to show it.",
        "Short one.",
        "And this is the second part of the story that they told us when we came to the house, with more of the words that are in it <here>.",
    ]


def test_html_marked_article_and_odd_pages():
    assert html.extract("<nav>a</nav><article><h1>T</h1><p>One<br>two &nbsp; three</p><aside>no</aside></article><footer>f</footer>") == "T\nOne two three"
    for page in (None, "", "<", "<p", "<!--", "<script>", "</p></div>", "<a " * 50):
        assert isinstance(html.extract(page), str)
    assert html.extract(None) == html.extract("<!-- x -->") == ""
    assert len(html.extract("<article>" + "<p>the word of the day is one</p>" * 20_000 + "</article>").split("\n")) == 20_000


class Marked(html_parser.HTMLParser):
    """The blocks of the marked article, by the standard library's parser."""

    ENDS = {"p", "h1", "h2", "h3", "li", "ul", "ol", "div", "table", "tr", "td", "blockquote", "pre", "article", "section", "figure", "figcaption", "aside", "nav", "form", "footer"}
    OUT = {"aside", "nav", "form", "footer", "script", "style", "button", "noscript"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.out, self.found, self.now = 0, 0, [], ""
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        if text := " ".join(self.now.split()):
            self.found.append(text)
        self.now = ""

    def handle_starttag(self, tag, attributes):
        if tag in self.ENDS:
            self.end()
        if tag == "br":
            self.now += " "
        self.inside += tag == "article"
        if self.inside and (self.out or tag in self.OUT or html.beside(" ".join(f'{k}="{v}"' for k, v in attributes))) and tag not in html.VOID:
            self.out += 1

    def handle_endtag(self, tag):
        if tag in self.ENDS:
            self.end()
        self.out -= bool(self.out)
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside and not self.out:
            self.now += data


def test_html_matches_the_marked_articles(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect() if r.html]
    texts = [html.extract(p) for p in pages]
    assert sum(t == "\n".join(Marked(p).found) for t, p in zip(texts, pages, strict=True)) >= 0.97 * len(pages)
    unmarked = [html.extract(re.sub("<(/?)article", r"<\1div", p)) for p in pages]  # the density rules alone
    assert sum(map(str.__eq__, texts, unmarked)) >= 0.95 * len(pages)


def test_html_place_by_compound_classes_and_teasers():
    body = "<p>" + " the story of the man who was in the house on the hill and what he did there" * 3 + "</p>"
    for name in ("post-content share-enabled", "article tags-3", "entry related-off", "post-content"):
        assert len(html.extract(f"<div class='{name}'>{body}</div>")) > 200
    for name in ("related-posts", "comment-content", "sidebar", "share", "cookie notice"):
        assert html.extract(f"<div>{body}</div><div class='{name}'>{body}</div>").count("story") == 3
    teasers = "<article class=teaser><h2>One</h2><p>More of it</p></article>" * 3
    assert "Title\nthe story" in html.extract(f"{teasers}<div><h1>Title</h1>{body}{body}</div>")


def test_html_deep_markup():
    inner = "<b>" * 30 + "x" + "<p>the word of the day is one that we know</p>"
    assert html.extract(f"<p class=notice>{inner}") == "the word of the day is one that we know"
    deep = "<div>" * 40_000 + "the word" + "</i>" * 40_000 + "</div>" * 40_000
    began = time.monotonic()
    assert html.extract(deep) == "the word" and time.monotonic() - began < 5


def test_html_query_keeps_every_page(spark):
    out = queries.op1_html_text(spark, DATA)
    assert out.count() == spark.read.parquet(f"{DATA}/pages.parquet").count()
    assert out.where("n_chars <> length(text) or text is null").count() == 0
    rows = spark.createDataFrame([(None, None, None, "x"), (1, "u", "<p>a</p>", "y"), (1, "u", "<p>a</p>", "y")], "page_id long, url string, html string, text string")
    assert html.extracted(rows).count() == 3 and html.extracted(rows.limit(0)).count() == 0


# 2 packing


def held_sequences(rows, length=packing.LENGTH):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= length
    return by


def test_packing_round_trip_and_padding(spark, texts):
    rows = queries.op2_packing(spark, DATA).collect()
    by = held_sequences(rows)
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    assert pieces.keys() == texts.keys()
    for doc, text in texts.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    total = sum(r.length for r in rows)
    assert len(by) * packing.LENGTH - total < 0.01 * total + packing.LENGTH


def test_packing_assignment_balances_cost():
    random.seed(3)
    lengths = [random.randint(1, 1023) for _ in range(500)]
    out = packing.assigned(lengths)
    assert collections.Counter({k: n for k, n in enumerate(lengths)}) == sum((collections.Counter({k: n}) for k, _, n, _, _ in out), collections.Counter())
    used = collections.Counter()
    cost = collections.Counter()
    for _, _, n, s, offset in out:
        assert offset == used[s]
        used[s] += n
        cost[s] += packing.cost(n)
    assert max(used.values()) <= 1024 and max(cost.values()) < 1.5 * sum(cost.values()) / len(cost)
    assert packing.assigned([]) == []


def test_packing_odd_tables(odd, clashing, empty):
    assert packing.packed(empty).count() == 0
    rows = packing.packed(odd).collect()
    held_sequences(rows)
    assert sum(1 for r in rows if r.doc_id in (3, 4) and r.doc_tokens == 1 and r.ids == b"\0\0\0\0") == 2
    assert sum(r.length for r in packing.packed(clashing).collect()) == sum(r.length for r in rows)


# 3 URL filter


def test_url_rules_by_hand(spark):
    cases = {
        "https://a.EXAMPLE.org/es/1": ("a.example.org", "/es/1", "example.org/es/", "block"), "http://example.org/en/12?x": ("example.org", "/en/12", "example.org/en/1", "block"), "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "http://x.com/fr/1#t": ("x.com", "/fr/1", "com/fr/", "allow"), "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"), "http://x.com/en/": ("x.com", "/en/", None, "allow"), "ftp://org": ("org", "", None, "allow"),
        "http://m.cheap-pills.example.com/en/1": ("m.cheap-pills.example.com", "/en/1", None, "block"), "http://notcheap-pills.example.com/": ("notcheap-pills.example.com", "/", None, "allow"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "http://CASINO-win.example.net/": ("casino-win.example.net", "/", None, "block"), "http://casino.example.net/": ("casino.example.net", "/", None, "allow"), "://?x": ("", "", None, "allow"), "http://" + "a." * 3000 + "org/": ("a." * 3000 + "org", "/", "org/", "allow"),
    }
    rows = spark.createDataFrame([(k, u, "x") for k, u in enumerate(cases)], "page_id long, url string, rule string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judged(rows).collect()}
    assert got == cases
    assert urlfilter.judged(rows.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "http://x.com/de/"), (None, "http://x.com/de/"), (1, None), (1, "")], "page_id long, url string")
    for most in (urlfilter.MAX_BYTES, 1):
        assert sorted(map(str, urlfilter.judged(odd, max_bytes=most).select("page_id", "verdict").collect())) == ["Row(page_id=1, verdict='allow')"] * 2 + ["Row(page_id=None, verdict='block')"] * 2
    assert urlfilter.judged(rows, rules=(), listed=urlfilter.LISTED).where("rule is not null").count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    random.seed(5)
    universe = [f"host{i}.example" for i in range(5000)]
    lists = {"a": set(random.sample(universe, 700)), "b": set(random.sample(universe, 3))}
    made = urlfilter.cascades(spark.createDataFrame([(n, k) for n, ks in lists.items() for k in ks], "list string, key string"), spark.createDataFrame([(u,) for u in universe], "key string"))
    for n, ks in lists.items():
        assert [u in ks for u in universe] == made[n].members(universe).tolist()
    assert len(made["a"].levels) > 1
    with pytest.raises(ValueError):
        urlfilter.cascades(spark.createDataFrame([("a", "x")], "list string, key string"), spark.createDataFrame([("x",)], "key string"), max_bytes=1)
    keys = spark.createDataFrame([("x",), ("y",)], "key string")
    assert urlfilter.semi_joined(keys, spark.createDataFrame([("x",)], "key string")).count() == 1


# 4 quality


def quality_by_hand(t):
    w, seen, covered = WORD.findall(t), collections.defaultdict(list), set()
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(k for i in at for k in range(i, i + 8))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, docs, texts, odd):
    for table, known in ((docs, texts), (odd, None)):
        for r in quality.ledger(table).join(table.select("doc_id", "text").distinct(), "doc_id").collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == quality_by_hand(r.text or ""), r.doc_id


def test_quality_policies_and_ablation(docs, odd, clashing, empty):
    rows = quality.ledger(docs).cache()
    kept = quality.applied(rows, quality.BASE, quality.STRICT)
    assert kept.where("strict_v2 and not base_v1").count() == 0
    total = rows.count()
    for r in quality.ablation(rows, quality.STRICT).collect():
        bit = next(x.bit for x in quality.RULES if x.name == r.rule)
        bits = [x.fail_bits for x in rows.select("fail_bits").collect()]
        assert r.n_fail == sum(b >> bit & 1 for b in bits) and r.n_only == sum(b == 1 << bit for b in bits) and r.n_kept_without == sum(b in (0, 1 << bit) for b in bits) <= total
    assert quality.judged(empty).count() == 0 and quality.accepted(empty).count() == 0
    assert quality.judged(odd).count() == odd.count()
    out = quality.accepted(clashing)
    assert out.columns == clashing.columns and out.count() == quality.judged(odd).where("kept").count()


# 5 language model


def test_kneser_ney_matches_brute_force(spark, docs, texts):
    words = {d: [*WORD.findall(t.translate(LOWER)), None] for d, t in texts.items()}
    train = [d for d in words if zlib.crc32(str(d).encode()) % 7 != 2]
    c1 = collections.Counter(w for d in train for w in words[d])
    c2 = collections.Counter(p for d in train for p in zip(["<s>", *words[d]], words[d], strict=False))
    n, v, tot = sum(c1.values()), len(c1), len(c2)
    before, ctx = collections.Counter(w for _, w in c2), collections.defaultdict(lambda: [0, 0, 0, 0])
    for (a, _), k in c2.items():
        ctx[a][0] += k
        ctx[a][min(k, 3)] += 1
    high = kneserney.Discounts([sum(x == k for x in c2.values()) for k in (1, 2, 3, 4)]).d
    low = kneserney.Discounts([sum(x == k for x in before.values()) for k in (1, 2, 3, 4)]).d
    mass = sum(low[min(x, 3)] for x in before.values()) / tot
    p1 = lambda w: (before.get(w, 0) - low[min(before.get(w, 0), 3)]) / tot + mass / (v + 1)

    def p2(a, w):
        if a not in ctx:
            return p1(w)
        k = c2.get((a, w), 0)
        return (k - high[min(k, 3)]) / ctx[a][0] + sum(high[j] * ctx[a][j] for j in (1, 2, 3)) / ctx[a][0] * p1(w)

    assert math.isclose(sum(map(p1, c1)) + mass / (v + 1), 1)
    want = {d: sum(math.log10(p2(a, x)) for a, x in zip(["<s>", *w], w, strict=False)) for d, w in words.items()}
    for r in queries.op5_lm_scores(spark, DATA).collect():
        w = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(x in c1 for x in w), n, zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert math.isclose(r.base_score, sum(math.log10((c1.get(x, 0) + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert math.isclose(r.score, want[r.doc_id], rel_tol=1e-9)
    # other numbers of shards, and pairs of ids sorted as two numbers, change nothing
    for shards, packed_below in ((1, 0), (7, 0), (7, kneserney.PACKED)):
        assert all(math.isclose(r.score, want[r.doc_id], rel_tol=1e-9) for r in kneserney.modelled(docs, shards, packed_below).collect())


def test_kneser_ney_files_on_other_folders(tmp_path, monkeypatch):
    arrays = {"a": np.arange(5, dtype=np.uint64), "none": np.zeros(0, np.uint8), "b": np.array([2**40, 1], np.uint64)}
    folder = kneserney.as_uri(str(tmp_path))
    name = kneserney.put(folder, arrays)
    assert kneserney.put(folder, arrays) != name
    assert kneserney.as_uri("file:/x") == "file:///x" and kneserney.as_uri("hdfs://n/x") == "hdfs://n/x"
    for remote in (False, True):
        if remote:  # a file system that cannot be mapped
            sub = pyarrow.fs.SubTreeFileSystem(str(tmp_path), pyarrow.fs.LocalFileSystem())
            monkeypatch.setattr(kneserney, "located", lambda _: (sub, ""))
        got = kneserney.get(folder, name)
        assert got.keys() == arrays.keys() and all((got[k] == arrays[k]).all() and got[k].dtype == arrays[k].dtype for k in arrays)


def test_runs_are_searched_like_sorted_arrays():
    random.seed(2)
    runs = [sorted(random.sample(range(50), random.randint(0, 9))) for _ in range(200)]
    ends = np.cumsum(list(map(len, runs)))
    flat, k = np.array([x for r in runs for x in r], np.uint64), np.array([random.randrange(200) for _ in range(2000)])
    w = np.array([random.randrange(50) for _ in k], np.uint64)
    got = kneserney.found_in_runs(flat, ends[k] - np.array(list(map(len, runs)))[k], ends[k], w)
    for i, run, x in zip(got.tolist(), k.tolist(), w.tolist(), strict=True):
        assert (i >= 0) == (x in runs[run]) and (i < 0 or flat[i] == x)


def test_kneser_ney_odd_tables(spark, odd, clashing, empty):
    assert kneserney.modelled(empty).count() == 0
    a, b = ({(r.doc_id, r.n_tokens): r.score for r in kneserney.modelled(t).collect()} for t in (odd, clashing))
    assert a == pytest.approx(b) and all(np.isfinite(list(a.values())))
    nothing = kneserney.modelled(odd.where("doc_id is null")).first()
    assert nothing.train_tokens == 0 and nothing.score == nothing.base_score == 0


def test_squeezed_arrays_round_trip():
    random.seed(1)
    for n in (0, 1, 5000):
        a = np.sort(np.array([random.getrandbits(64) for _ in range(n)], np.uint64))
        assert (kneserney.spread(kneserney.squeezed(a)) == a).all() and (kneserney.spread_counts(kneserney.squeezed_counts(a)) == a).all()


# 6 BPE

ODD_TEXTS = ["", " ", "\n\n x  y\n", "it's we'll 'tis", "a b\tc \r\n d", "日本語 éü 123 ,.!", "x" * 5000, "ab " * 3000, "<|endoftext|>", "\x1c\x85 z"]


def test_bpe_equals_tiktoken_and_decodes():
    e = bpe.Encoder(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=e.ranks.ids, special_tokens={})
    random.seed(2)
    for t in [*ODD_TEXTS, *("".join(random.choice("aehtrn é\n 's1.") for _ in range(random.randint(0, 60))) for _ in range(3000))]:
        ids = e.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
        assert e.decode(ids) == t.encode()


def test_bpe_prefix_table_appends_and_edits():
    r = bpe.ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    random.seed(4)
    some = lambda n: bytes(random.choice(b"aehtrnsio ") for _ in range(n))
    for _ in range(200):
        a, b = some(random.randint(0, 200)), some(20)
        t = bpe.PrefixTable(r, a)
        t.append(b)
        assert t.last == bpe.PrefixTable(r, a + b).last and t.ids() == r.merged(a + b)
        i = random.randint(0, len(a))
        t.replace(i, min(len(a), i + 3), some(2))
        assert t.last == bpe.PrefixTable(r, t.text).last
    long = bpe.PrefixTable(r, some(5000))
    assert long.replace(100, 101, b"z") < 500


def test_bpe_query_and_odd_tables(spark, texts, odd, clashing, empty):
    ranks = bpe.ranks(P.path("byte_bpe_multi_50k.tiktoken")).ids
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in queries.op6_bpe(spark, DATA).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    assert bpe.encoded(empty).count() == 0 and bpe.encoded(clashing).count() == odd.count()


def test_packing_ids_equal_the_library():
    ids, t = packing.TextIds(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    added = ["<|endoftext|> hello", "a <|endoftext|><|endoftext|>b", "x  <|endoftext|>  y\n", "<|endoftext", "<|endoftext|>", "it's <|endoftext|>'s"]
    assert np.frombuffer(ids.encode(added[0]), "<u4").tolist() == [50256, 23748] and ids.fast
    for text in [*ODD_TEXTS, *added, *[a.join(ODD_TEXTS[:5]) for a in added]]:
        assert np.frombuffer(ids.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    slow = packing.TextIds(P.path("byte_bpe_50k.json"))
    slow.fast, slow.tokenizer = None, t
    assert slow.encode("Some text, twice.") == ids.encode("Some text, twice.")
    assert packing.ranks_of(P.path("word_bpe_49k.json")) is None


# 7 near duplicates


def linked_by_hand(texts):
    sets = {}
    for d, t in texts.items():
        w = WORD.findall(t.translate(LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def near_rows(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.linked(df).collect()}


def test_near_duplicates_match_brute_force(docs, texts):
    assert near_rows(docs) == linked_by_hand(texts)


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """Chains of edits, in groups larger than a block."""
    random.seed(6)
    base = [f"w{random.randint(0, 999)}" for _ in range(120)]
    texts = {}
    for i in range(60):
        k = (i * 7) % 120
        base[k : k + 2] = [f"new{i}", f"x{i}"]
        texts[i] = " ".join(base).upper() if i % 2 else " ".join(base)
    texts |= {100 + i: texts[i] for i in range(5)}
    rows, want = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), linked_by_hand(texts)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "SPREAD", 1000)
    assert near_rows(rows) == want


def test_long_chains_are_compared_within_buckets(spark, monkeypatch):
    """A cluster of which most texts do not link with its first: a text moves once a bucket at most, however long the chain."""
    random.seed(12)
    base, texts = [f"w{random.randint(0, 999)}" for _ in range(120)], {}
    for i in range(400):
        k = (i * 7) % 120
        base[k : k + 2] = [f"new{i}", f"x{i}"]
        texts[i] = " ".join(base)
    moved = []

    def dealt(entries, real=neardup.by_bands):
        split = real(entries)
        return lambda rows, asks: moved.append((rows.count(), (out := split(rows, asks)).count())) or out

    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "by_bands", dealt)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert near_rows(rows) == linked_by_hand(texts)
    assert moved and all(0 < out <= 40 * n for n, out in moved)


def test_near_duplicates_odd_tables(odd, clashing, empty):
    rows = [tuple(r) for r in neardup.linked(odd).collect()]
    assert len(rows) == 10
    got = {r[0]: r[1:] for r in rows}
    assert got[2] == (got[1][0], 1, False) and got[8][1] == 1 and got[3] == (0, 3, True) and got[5] == (0, 5, True) and got[None][1:] == (None, True)
    assert sorted(map(str, rows)) == sorted(str(tuple(r)) for r in neardup.linked(clashing).collect())
    assert neardup.linked(empty).count() == 0
    kept = neardup.deduplicated(clashing)
    assert kept.columns == clashing.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5", "6", "7", "None"]


def test_near_duplicates_of_one_id_and_of_text_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = spark.createDataFrame([(1, a, "x"), (1, b, "y"), (2, a, "z"), (3, a + " more", "w"), (4, b, "v"), (5, "", "e"), (5, None, "f")], "doc_id long, text string, class string")
    got = neardup.deduplicated(rows)
    assert got.columns == rows.columns and sorted((r.doc_id, r.text or "")[0:2] for r in got.collect()) == [(1, a), (1, b), (5, ""), (5, "")]
    assert sorted((r.doc_id, r.component_id) for r in neardup.linked(rows).collect()) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (5, 5)]
    named = spark.createDataFrame([("p/2", a), ("p/10", a), ("q", b), (None, b), ("r", a[:-4])], "doc_id string, text string")
    assert {r.doc_id: r.component_id for r in neardup.linked(named).collect()} == {"p/2": "p/10", "p/10": "p/10", "q": "q", None: None, "r": "p/10"}


def test_small_sets_meet_in_no_bucket():
    random.seed(11)
    tables = [setsketch.sketch(setsketch.shingles(f"only {random.random()} {k}")) for k in range(3000)]
    keys = collections.Counter(setsketch.band_keys(np.array(tables)).ravel().tolist())
    assert max(keys.values()) <= 2 and np.array(tables).min() > 0


def test_large_near_copy_groups_ask_only_for_the_rest(spark, monkeypatch):
    """A group of copies of one text with edits of its own in each, some chained ones, more than a block."""
    random.seed(9)
    base = [f"w{i}" for i in range(200)]
    texts = {}
    for i in range(120):
        words = list(base)
        words[random.randrange(200)] = f"own{i}"
        texts[i] = " ".join(words)
    chain = list(base)
    for i in range(200, 240):
        k = (i * 11) % 200
        chain[k : k + 2] = [f"c{i}", f"d{i}"]
        texts[i] = " ".join(chain)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = linked_by_hand(texts)
    assert near_rows(rows) == want
    monkeypatch.setattr(neardup, "BLOCK", 8)
    assert near_rows(rows) == want


def test_setsketch_merges_and_estimates():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = h[:2000], h[500:2400]
    assert (setsketch.merged(setsketch.sketch(a[:700]), setsketch.sketch(a[700:])) == setsketch.sketch(a)).all()
    assert abs(setsketch.likely(setsketch.sketch(a), setsketch.sketch(b), np.array([len(a)]), np.array([len(b)]))[0] - 1500 / 2400) < 0.15


# 8 fingerprints


def test_chunk_ends_match_a_slow_version():
    random.seed(8)
    for _ in range(60):
        data = bytes(random.choice(b"abcde fgh") for _ in range(random.randint(0, 800)))
        h = [sum(int(fingerprint.GEAR[data[i - k]]) << k for k in range(32) if i >= k) & 0xFFFFFFFF for i in range(len(data))]
        out, at = [], 0
        while len(data) - at > fingerprint.LEAST:
            fits = (e for e in range(at + fingerprint.LEAST, min(at + fingerprint.MOST, len(data) + 1)) if h[e - 1] >> (32 - (fingerprint.STRICT if e < at + fingerprint.NORMAL else fingerprint.LOOSE)) == 0)
            at = min(next(fits, at + fingerprint.MOST), len(data))
            out.append(at)
        assert fingerprint.ends(data) == out + ([len(data)] if at < len(data) else [])


def test_fingerprint_query_matches_brute_force(spark, texts):
    ids = sorted(texts)
    got = {r.doc_id: r for r in queries.op8_fingerprints(spark, DATA).collect()}
    assert got.keys() == texts.keys()
    for i, d in enumerate(ids):
        t, nxt = texts[d], texts[ids[(i + 1) % len(ids)]]
        new = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        a, b, c = map(fingerprint.chunks, (t, new, nxt))
        r = got[d]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(new.encode()).hexdigest(), fingerprint.written_form(a), fingerprint.written_form(b))
        assert r.near_edited == fingerprint.likeness(a, b) and r.near_next == fingerprint.likeness(a, c)
        assert fingerprint.read_form(r.fingerprint) == a


def test_fingerprint_odd_tables(odd, clashing, empty):
    assert fingerprint.edited(empty).count() == 0 and fingerprint.fingerprinted(empty).count() == 0
    rows = fingerprint.edited(odd).collect()
    assert len(rows) == 10 and {r.fingerprint for r in rows if r.doc_id in (3, 4)} == {""}
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 2, None)}) == 1
    assert fingerprint.edited(clashing, 2).count() == 10 and fingerprint.fingerprinted(odd).count() == 10
    one = fingerprint.edited(odd.where("doc_id = 1")).first()
    assert one.near_next == 1


# 9 language


def test_language_held_out_accuracy(spark):
    data = "/root/testdata/sf0.01"
    rows = queries.op9_language_id(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_language_profiles_and_distances_by_hand(spark):
    """Counts, ranks and out-of-place sums in plain Python."""
    random.seed(12)
    syllables = {"aa": "ka lo mi ru", "bb": "sch ei ung ver", "cc": "tion re les ka"}
    rows = [(i, " ".join("".join(random.choices(syllables[lang].split(), k=random.randint(1, 4))).title() for _ in range(30)), lang) for i, lang in enumerate(list(syllables) * 12)]
    rows += [(100, "Kalo 12 miru!", None), (101, "", "aa"), (102, "123", "bb"), (103, None, "cc")]

    def grams(text):
        out = []
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            padded = f"_{word}_"
            out += [*word, *(padded[i : i + 2] for i in range(len(padded) - 1)), *(padded[i : i + 3] for i in range(len(padded) - 2))]
        return out

    def code(g):
        return sum((32 if ch == "_" else ord(ch)) << 21 * (len(g) - 1 - i) for i, ch in enumerate(g))

    def ranked(counts):
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))][: langid.PROFILE]

    learned = collections.defaultdict(collections.Counter)
    for i, text, lang in rows:
        if lang and text and zlib.crc32(str(i).encode()) % 3 != 1:
            learned[lang].update(grams(text))
    profiles = {lang: ranked(c) for lang, c in learned.items()}
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identified(table).collect()}
    assert {lang: list(map(code, p)) for lang, p in profiles.items()} == langid.learn(table.where(~langid.held_out(F.col("doc_id"))))
    for i, text, _ in rows:
        own = ranked(collections.Counter(grams(text or "")))
        if not own:
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        far = {lang: sum(abs(p.index(g) - k) if g in p else langid.PROFILE for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert got[i].lang_pred == best and math.isclose(got[i].score, 1 - far[best] / (langid.PROFILE * len(own)))


def test_language_odd_tables(odd, clashing, empty):
    assert langid.identified(empty).count() == 0
    got = {r.doc_id: r for r in langid.identified(odd).collect()}
    assert {d for d, r in got.items() if r.lang_pred == "und"} == {3, 4, 5} and got[None].held_out and got[3].score == 0
    assert langid.accepted(clashing).columns == clashing.columns and langid.accepted(odd).count() == 7
    assert langid.accepted(empty).count() == 0
    unlabelled = odd.drop("lang").selectExpr("*", "cast(null as string) lang")
    assert {r.lang_pred for r in langid.identified(unlabelled).collect()} == {"und"}


def test_only_the_most_frequent_labels_are_learned(spark):
    rows = [(i, f"some text of label {i % 7}", f"l{i % 7}") for i in range(60)] + [(100 + i, "dirty", f"dirty{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(langid.learn(df, most=7)) == {f"l{k}" for k in range(7)}
    assert len(langid.learn(df)) == 207 and langid.learn(df.limit(0)) == {}


def test_ngrams_by_hand():
    text = "Ab, c"
    codes = collections.Counter(langid.ngrams(text).tolist())
    of = lambda s: sum((32 if ch == "_" else ord(ch)) << 21 * (len(s) - 1 - i) for i, ch in enumerate(s))
    assert codes == collections.Counter(map(of, ["a", "b", "c", "_a", "ab", "b_", "_c", "c_", "_ab", "ab_", "_c_"]))
