"""The training-data queries that SQL can express against DuckDB, and checked contents of odd rows."""

import hashlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from quillgraph.llm import bpe, queries
from quillgraph.llm import urlfilter as u

DATA = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "sale_lines", "items", "vendors"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    df = queries.queries()[name](spark, DATA)
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr([plain(x) for x in r]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want


def test_urls_of_odd_rows(spark):
    rows = [(1, "http://example.org/es/x"), (1, "http://example.org/es/x"), (None, "https://EXAMPLE.org/en/1?q"), (None, None), (2, ""), (3, "http://"), (4, "http://a.fr.com/fr/" + "x" * 200_000), (5, "no scheme")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("mine") for c in ("host", "path", "rule", "verdict", "key", "listed")})
    got = [(r.page_id, r.host, len(r.path), r.rule, r.verdict) for r in u.judged(pages).collect()]
    assert sorted(got, key=repr) == sorted(
        [(1, "example.org", 5, "example.org/es/", "block")] * 2
        + [(None, "example.org", 5, "example.org/en/1", "block"), (None, "", 0, None, "allow"), (2, "", 0, None, "allow"), (3, "", 0, None, "allow"), (4, "a.fr.com", 200_004, "com/fr/", "allow"), (5, "", 0, None, "allow")],
        key=repr,
    )
    assert u.judged(pages.limit(0)).count() == 0


def test_bpe_of_odd_rows(odd):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(P.path("byte_bpe_multi_50k.tiktoken")).ids, special_tokens={})
    digest = lambda data: hashlib.sha256(data).hexdigest()
    want = [(r.doc_id, digest(np.array(ids, "<u4").tobytes()), digest(text.encode())) for r in odd.collect() for text in [r.text or ""] for ids in [library.encode_ordinary(text)]]
    got = [(r.doc_id, digest(bytes(r.ids)), digest(bytes(r.decoded))) for r in bpe.encoded(odd).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
