"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams (1 to 3 code points, words padded by a blank), most frequent
first. A document's own list is compared with each profile: the distance of an n-gram is the difference of its two ranks, or the
profile length where the profile lacks it. The language with the least sum wins; ties go to the smaller name.

Defined results: a null text, or one without a letter, gives `und` with score 0. With no labelled row at all every document is
`und`. Rows are scored one by one, so repeated rows and repeated ids give repeated results; other columns are ignored. A null id
belongs to the held-out part. Whole texts are used, whatever their length. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import crc_of_id, small_batches

#: Entries of a profile, and the number of documents of a language whose n-grams are counted (expected; rows are picked by hash).
PROFILE = 300
SAMPLE_PER_LANG = 2000
#: Languages that are learned, those with most documents first: a profile has a few KB, so the model stays below a few MB.
MOST_LANGS = 500
UND = "und"
BLANK = 32
#: The least score that the pipeline accepts.
LEAST = 0.05


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(text: str) -> np.ndarray:
    """Codes of the text's n-grams, 21 bits a code point; empty if the text has no letter. A blank has its own code point, which no letter has."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.concatenate(([BLANK], np.where(letters()[points], points, BLANK), [BLANK]))
    points = points[np.concatenate(([True], (points[1:] != BLANK) | (points[:-1] != BLANK)))]  # one blank between words
    if len(points) < 2:
        return points[:0]
    one, two = points[points != BLANK], points[:-1] << 21 | points[1:]
    inner = points[1:-1] != BLANK  # no blank in the middle
    three = (points[:-2] << 42 | points[1:-1] << 21 | points[2:])[inner]
    return np.concatenate((one, two, three))


def ranked(text: str, size: int) -> np.ndarray:
    """The text's n-grams by falling count, ties by code."""
    codes, counts = np.unique(ngrams(text), return_counts=True)
    return codes[np.argsort(-counts, kind="stable")[:size]]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        langs = batch.column(0).dictionary_encode()
        order = np.argsort(of := langs.indices.to_numpy(), kind="stable")
        texts = batch.column(1).take(pa.array(order)).to_pylist()
        edges = np.searchsorted(of[order], np.arange(len(langs.dictionary) + 1)).tolist()
        for lang, a, b in zip(langs.dictionary.to_pylist(), edges[:-1], edges[1:], strict=True):
            codes, counts = np.unique(np.concatenate([ngrams(t) for t in texts[a:b]]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "code", "n"])


def learn(docs: DataFrame, size: int = PROFILE, sample: int = SAMPLE_PER_LANG, most: int = MOST_LANGS) -> dict[str, list[int]]:
    """Profiles from docs(doc_id, text, lang): one list of n-gram codes a language.

    About `sample` documents of a language are read, those of least hashed id (all where it has fewer). The `most` languages with most
    documents are learned, ties by name, so that dirty labels do not make the model grow. What comes to the driver is a count of each
    of them, and the model: `size` codes a language, in order. No text is shuffled.
    """
    rows = small_batches(docs).select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()
    if not known:
        return {}
    shares = F.create_map(*[F.lit(x) for r in known for x in (r["lang"], min(1.0, sample / r["n"]))])
    share = F.coalesce(F.element_at(shares, F.col("lang")), F.lit(0.0))
    picked = rows.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / 2.0**53 < share).select("lang", "text")
    counts = picked.mapInArrow(_counts, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code")).alias("place")
    best: dict[str, list[int]] = {}
    for r in sorted(counts.select("lang", "code", place).where(F.col("place") <= size).collect(), key=lambda r: (r["lang"], r["place"])):
        best.setdefault(r["lang"], []).append(r["code"])
    return best


class Scorer:
    """All profiles as one sorted code array and a rank for each language."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.size, self.langs = size, sorted(profiles)
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], np.int64))
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), -1, np.int64)  # the last column: in no profile
        for k, lang in enumerate(self.langs):
            self.ranks[k, np.searchsorted(self.codes, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and 1 - distance / largest possible distance."""
        own = ranked(text, self.size) if text else np.zeros(0, np.int64)
        if not len(own) or not self.langs:
            return UND, 0.0
        at = np.searchsorted(self.codes, own)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        there = self.ranks[:, at]
        far = np.where(there < 0, self.size, np.abs(there - np.arange(len(own)))).sum(axis=1)
        k = int(far.argmin())
        return self.langs[k], float(1 - far[k] / (self.size * len(own)))


def predict(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(profiles, size)
        for batch in batches:
            found = [scorer.predict(t) for t in batch.column(1).to_pylist()]
            langs, scores = pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), langs, scores], names=["doc_id", "lang_pred", "score"])

    kept = small_batches(docs).select("doc_id", "text")
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_of_id(doc_id) % 3 == 1, F.lit(True))


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows whose crc32(doc_id) mod 3 is not 1."""
    part = held_out(F.col("doc_id"))
    return predict(docs, learn(docs.where(~part))).select("doc_id", part.alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs, all columns, whose language is known and whose score is at least `least`."""
    profiles, at = learn(docs.where(~held_out(F.col("doc_id")))), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(profiles)
        for batch in batches:
            found = [scorer.predict(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([lang != UND and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
