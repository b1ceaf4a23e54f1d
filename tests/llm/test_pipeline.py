"""The pipeline against its stages' brute-force versions, and its stages' contracts."""

import collections

import corpus_pipeline
import numpy as np
import public_tokenizers as P
from quillgraph.llm import langid, quality
from test_operators import linked_by_hand
from tokenizers import Tokenizer

DATA = "/root/testdata/sf0.001"


def test_stage_order_and_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_dedup", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_matches_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id for r in langid.identified(docs).collect() if r.lang_pred != "und" and r.score >= langid.LEAST}
    good = {r.doc_id for r in quality.judged(docs).where("kept").collect()} & known
    kept = {d for d, (_, _, keep) in linked_by_hand({d: text[d] for d in good}).items() if keep}
    pieces = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, DATA).collect():
        pieces[r.doc_id].append((r.start, r.ids))
    assert pieces.keys() == kept
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for d in kept:
        assert np.frombuffer(b"".join(x for _, x in sorted(pieces[d])), "<u4").tolist() == [*t.encode(text[d], add_special_tokens=False).ids, 0]


def test_stages_on_odd_and_empty_tables(spark, clashing, empty):
    for table in (clashing, empty):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DATA)
            if name != "packing":
                assert out.columns == docs.columns
                docs = out
        assert out.count() >= 0


def test_clean_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id")
    judged = quality.judged(rows).join(labels, "doc_id")
    assert judged.where("quality = 1 and not base_failed and not kept").count() <= 0.01 * judged.where("quality = 1").count()
    assert judged.where("quality = 0 and kept").count() <= 0.05 * judged.where("quality = 0").count()
