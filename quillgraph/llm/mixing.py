"""Sources mixed to target weights by hash-threshold histograms, in DataFrame functions only.

Every document has a place, 60 bits of the digest of its id. A source that must give more than it has gives whole copies of all its
documents first; what remains is taken from the documents whose place lies below the source's threshold. The threshold comes from
histograms: sizes are summed by source and the first 12 bits of the place, the bucket in which the budget runs out is the boundary, and
only the boundary's documents are counted again by the next 12 bits, until the boundary is one place. Nothing is sorted; a larger budget
takes all that a smaller one takes. The document at the boundary is cut: it gives the words that are still missing, so a source misses
its target by less than a word for each row at its boundary.

Targets: the total is shared out by weight; a source whose share is above `most` times its size is held there and the excess goes
to the others by weight, until none is above. Weights repeat over the sources in code point order, a null source last.

Defined results: a null or empty text has size 0 and gives 0. Rows of one id share a place; where it is the boundary, each gives the
same share of its words, rounded down. Repeated rows count each. A null id has a place of its own. Other columns are ignored. An empty
table gives no row; a source of size 0 has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import SPACE_RE, written
from quillgraph.operators.windows import places

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
#: Bits of a place, and bits that a histogram resolves.
BITS, STEP = 60, 12


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and at, the document's place."""
    words = F.array_remove(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), SPACE_RE), "")
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.size(words).cast("long").alias("size"), F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long").alias("at"))


def weighted(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """sources with their weight, in code point order, null last."""
    placed = places(sources, "place", F.col("source").asc_nulls_last())
    each = F.array(*[F.lit(float(w)) for w in weights])
    return placed.withColumn("weight", F.get(each, (F.col("place") % len(weights)).cast("int"))).drop("place")


def level(sources: DataFrame, total: float, most: float) -> float:
    """The size that a weight of 1 gets: raised until no source that is not yet held is above most times its size."""
    found, before = 0.0, None
    while found != before:
        over = F.col("weight") * F.lit(found) > most * F.col("source_size")
        held = sources.agg(F.sum(F.when(over, F.col("source_size")).otherwise(0)).alias("size"), F.sum(F.when(~over, F.col("weight")).otherwise(0.0)).alias("weight")).first()
        if not held["weight"]:
            return found
        before, found = found, (total - most * held["size"]) / held["weight"]
    return found


def targeted(sources: DataFrame, share: float = 1.0, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, weight and target of each row of sources (source, source_size); share: of the sum of all sizes."""
    sources = written(weighted(sources, weights), "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    rise = level(sources, total * share, most)
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(rise), most * F.col("source_size")))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, edge (the place at the boundary), short (what is still missing before it) and there (the sizes of the boundary's rows).

    rows: source, size, at. budgets: source and short, each short less than its source's size. A source of budget 0 has no row.
    A round reads the boundary's documents only, and writes a row a source.
    """
    edges = budgets.where("short > 0").select("source", F.lit(0).cast("long").alias("prefix"), "short")
    for bits in range(STEP, BITS + 1, STEP):
        edges = written(_refined(rows, edges, bits), "mix-edges")
        if edges.where("first < last").isEmpty():
            break
    return edges.select("source", F.col("first").alias("edge"), "short", "there")


def _refined(rows: DataFrame, edges: DataFrame, bits: int) -> DataFrame:
    """The boundary among the buckets of so many bits within each boundary of STEP bits fewer."""
    e = edges.select(F.col("source").alias("e_source"), "prefix", F.col("short").alias("budget"))
    inside = rows.join(e, _same(F.col("source"), F.col("e_source")) & (F.shiftright("at", BITS - bits + STEP) == F.col("prefix")))
    buckets = inside.groupBy("source", F.shiftright("at", BITS - bits).alias("bucket")).agg(
        F.sum("size").alias("there"), F.min("at").alias("first"), F.max("at").alias("last"), F.first("budget").alias("budget")
    )
    listed = buckets.where("there > 0").groupBy("source", "budget").agg(F.array_sort(F.collect_list(F.struct("bucket", "there", "first", "last"))).alias("b"))
    # at most 2^STEP buckets a source: sizes are added up until the first that no longer fits
    start = F.struct(F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("i"), F.lit(True).alias("fits"))
    at = F.aggregate("b", start, lambda s, x: F.when(s.fits & (s.below + x.there <= F.col("budget")), F.struct((s.below + x.there).alias("below"), (s.i + 1).alias("i"), F.lit(True).alias("fits"))).otherwise(F.struct(s.below.alias("below"), s.i.alias("i"), F.lit(False).alias("fits"))))
    return listed.withColumn("s", at).withColumn("x", F.get("b", F.col("s.i").cast("int"))).select(
        "source", F.col("x.bucket").alias("prefix"), (F.col("budget") - F.col("s.below")).alias("short"), F.col("x.there").alias("there"), F.col("x.first").alias("first"), F.col("x.last").alias("last")
    )


def mixed(docs: DataFrame, share: float = 1.0, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of docs (doc_id, source, text)."""
    rows = written(sized(docs), "mix-sized")
    sources = targeted(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = written(sources.withColumn("copies", whole).withColumn("short", F.col("target") - F.col("copies") * F.col("source_size")), "mix-targets")
    edges = thresholds(rows, sources.select("source", "short"))
    plan = sources.drop("short").join(edges.withColumnRenamed("source", "e_source"), _same(F.col("source"), F.col("e_source")), "left")
    plan = written(plan.select(F.col("source").alias("p_source"), "source_size", "target", "copies", "edge", "short", "there"), "mix-plan")
    more = F.when(F.col("at") < F.col("edge"), F.col("size")).when(F.col("at") == F.col("edge"), F.floor(F.col("size") * (F.col("short") / F.col("there")))).otherwise(0)
    joined = rows.join(plan, _same(F.col("source"), F.col("p_source")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size") + more).cast("long").alias("taken"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS at
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM d GROUP BY source
), t AS (SELECT CAST(sum(source_size) AS DOUBLE) AS total, count(*) AS n FROM s),
f(i, rise) AS (
  SELECT 0, 0.0::DOUBLE
  UNION ALL
  SELECT f.i + 1, (max(t.total) - 3.0::DOUBLE * sum(CASE WHEN s.weight * f.rise > 3.0::DOUBLE * s.source_size THEN s.source_size ELSE 0 END))
                  / nullif(sum(CASE WHEN s.weight * f.rise > 3.0::DOUBLE * s.source_size THEN 0.0::DOUBLE ELSE s.weight END), 0)
  FROM f, s, t WHERE f.i <= t.n GROUP BY f.i
), g AS (
  SELECT s.source, s.source_size, least(s.weight * (SELECT rise FROM f ORDER BY i DESC LIMIT 1), 3.0::DOUBLE * s.source_size) AS target FROM s
), h AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM g
), c AS (
  SELECT d.*, h.source_size, h.target, h.copies, h.target - h.copies * h.source_size AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.at) AS below_and_here, sum(d.size) OVER (PARTITION BY d.source, d.at) AS here
  FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source
)
SELECT doc_id, size, source_size, target,
       CAST(copies * size + CASE WHEN below_and_here <= budget THEN size
                                 WHEN below_and_here - here <= budget AND here > 0 THEN floor(size * ((budget - (below_and_here - here)) / here))
                                 ELSE 0 END AS BIGINT) AS taken
FROM c
"""
