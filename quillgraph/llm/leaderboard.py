"""A change feed of each nation's best-selling items, from a stateful stream of sale lines.

Lines are cut into batches by their day of arrival and written; each batch is published by renaming its folder into the one that the
stream reads, and the stream, which is started anew for each, adds it to running sums by nation and item (update mode, one checkpoint).
Its sink subtracts the batch's own sums from what the sums are now, which gives the revenues before the batch, and writes the revenues of each
touched key by day. After the last batch the boards of all batches are built at once, as shuffles cost more than their rows where
there are many partitions. A key can stand on a board only if its upper bound within the batch reaches the tenth largest lower bound of its
nation; keys that a batch did not touch keep what the sums were after the last one that did. The days are filled in for these keys only, and
ten a task, nation and day are shuffled. Each batch begins with the board it finds.

Nothing that grows with the input goes through one task, to the driver or into a broadcast: the driver gets a row for each arrival
day; vendors and prices are joined by sorting; sums are taken before they are shuffled, so hot keys arrive as one row a task. State lies
where the session's `spark.sql.streaming.stateStore.providerClass` puts it: in memory by default, in RocksDB where nations x items are
too many for that. A call has a folder of its own; a batch's files go when its changes are written.

Defined results: of repeated vendors or items the least nation_id and price count. A null item_id or an item without a row, a null or unknown
vendor_id, and a vendor without nation are ignored, but count for lateness. A line that arrives before the first day is in the first
batch. Repeated lines count each. Other columns are ignored. No line: no row. Very long values: of a line's texts only flag is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.tables import removed, renamed, settings, shared_path, written

FIRST_DAY, DAYS, BATCHES, LATE, TOP = 19723, 180, 10, 3, 10
#: A batch's files have about so many lines, its sink's tasks so many at least: with many partitions, files and tasks cost more than their lines.
FILE_LINES, TASK_LINES = 100_000, 20_000
#: Executors leave the state of an earlier start after so long; else several starts' states stand beside each other.
STATE = {"spark.sql.streaming.stateStore.maintenanceInterval": "5s"}
CHANGES = "nation_id int, arrival_day long, item_id long, batch int, change string, old_rank int, new_rank int, revenue long"
KEY = ["nation_id", "item_id"]
LINE = "nation_id int, item_id long, cents double, shipped long, arrived long, batch int"
TOUCHED = "nation_id int, item_id long, since long, until long, revenue double, next double, opening double, most double, least double, batch int"


def dated(lines: DataFrame) -> DataFrame:
    """The columns that count, with shipped and arrived (days since 1970), sign and batch."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("sale_id", "item_id", "vendor_id", "line_no")]
    read = lines.select("item_id", "vendor_id", "quantity", "amount", "flag", F.to_date("shipped_at").alias("on"), F.crc32(F.concat_ws(",", *text).cast("binary")).alias("h"))
    shipped = F.coalesce(F.unix_date("on").cast("long"), F.lit(FIRST_DAY) + F.col("h") % 150)
    read = read.withColumn("shipped", shipped).withColumn("arrived", F.col("shipped") + F.col("h") % 7 + F.when(F.col("h") % 5 == 0, 20).otherwise(0))
    batch = F.least(F.lit(BATCHES), F.greatest(F.lit(1), 1 + F.floor((F.col("arrived") - FIRST_DAY) * BATCHES / DAYS))).cast("int")
    sign = F.when(F.col("flag") == "swapped", -1.0).otherwise(1.0)
    return read.select("item_id", "vendor_id", "quantity", "amount", sign.alias("sign"), "shipped", "arrived", batch.alias("batch"), "h")


def cut(lines: DataFrame, items: DataFrame, vendors: DataFrame, path: str, files: int) -> None:
    """Every line with its nation and cents, in a folder for each batch of at most so many files. An ignored line has no nation."""
    price = F.floor(100 * F.col("price") + 0.5).cast("double")
    prices = written(items.where("item_id is not null").groupBy("item_id").agg(F.min(price).alias("price")), "prices")
    nations = written(vendors.where("vendor_id is not null and nation_id is not null").groupBy("vendor_id").agg(F.min("nation_id").cast("int").alias("nation_id")), "nations")
    rest = ["shipped", "arrived", "batch", "h"]
    priced = lines.where("amount is not null").select("vendor_id", "item_id", (F.floor(100 * F.col("amount") + 0.5) * F.col("sign")).alias("cents"), *rest)
    bare = lines.where("amount is null").join(prices.hint("merge"), "item_id", "left")
    bare = bare.select("vendor_id", "item_id", (F.coalesce(F.col("quantity") * F.col("price"), F.lit(0.0)) * F.col("sign")).alias("cents"), *rest)
    every = priced.unionByName(bare)
    strange = written(lines.where("item_id is not null").select("item_id").distinct().join(prices.hint("merge"), "item_id", "left_anti"), "strange")
    if not strange.isEmpty():  # else no line is shuffled by its item
        every = every.join(strange.withColumn("strange", F.lit(True)).hint("merge"), "item_id", "left").where("strange is null").drop("strange")
    joined = every.join(nations.hint("merge"), "vendor_id", "left")
    nation = F.when(F.col("item_id").isNotNull(), F.col("nation_id"))
    joined = joined.select(nation.alias("nation_id"), F.col("item_id").cast("long").alias("item_id"), "cents", *rest)
    joined.repartition("batch", F.floor(F.col("h") / 35) % files).drop("h").write.partitionBy("batch").parquet(path)


def counted(lines: DataFrame, oldest: int | None) -> DataFrame:
    """Lines that have a nation and are not late."""
    kept = lines.where("nation_id is not null")
    return kept if oldest is None else kept.where(F.col("shipped") + LATE >= oldest)


def summed(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*KEY).agg(F.sum("cents").alias("revenue"))


def closed(now: DataFrame, lines: DataFrame) -> DataFrame:
    """Of each key that the batch touched a row a day: its revenue since that day, the day that ends it and the revenue then. On a key's first day
    its revenue before. most and least bound a key's revenue within the batch; they are left out where one day's row tells them."""
    daily = lines.groupBy(*KEY, "arrived").agg(F.sum("cents").alias("cents"))  # summed first: a hot key comes as a row a day
    whole, day = Window.partitionBy(*KEY), Window.partitionBy(*KEY).orderBy("arrived")
    sums = now.join(daily, KEY).withColumn("sum", F.sum("cents").over(day.rowsBetween(Window.unboundedPreceding, 0))).withColumn("opening", F.col("revenue") - F.sum("cents").over(whole))
    sums = sums.select(*KEY, F.col("arrived").alias("since"), (F.col("opening") + F.col("sum")).alias("revenue"), "opening")
    day = whole.orderBy("since")
    rows = sums.withColumns({"until": F.lead("since").over(day), "next": F.lead("revenue").over(day), "first": F.lag("since").over(day).isNull()})
    rows = rows.withColumns({"most": F.greatest("opening", F.max("revenue").over(whole)), "least": F.least("opening", F.min("revenue").over(whole))})
    one = F.col("first") & F.col("until").isNull()
    return rows.select(*KEY, "since", "until", "revenue", "next", F.when(F.col("first"), F.col("opening")).alias("opening"), *[F.when(~one, F.col(c)).alias(c) for c in ("most", "least")])


def bounded(touched: DataFrame) -> DataFrame:
    """Rows of closed with all bounds."""
    return touched.withColumns({"most": F.coalesce("most", F.greatest("opening", "revenue")), "least": F.coalesce("least", F.least("opening", "revenue"))})


def _place(by: list[str], value: str) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.col(value).desc(), "item_id"))


def bars(keys: DataFrame, by: list[str]) -> DataFrame:
    """The tenth largest lower bound of each group: ten keys are never below it."""
    return keys.withColumn("place", _place(by, "least")).where(F.col("place") == TOP).select(*by, F.col("least").alias("bar"))


def contenders(keys: DataFrame, bar: DataFrame | None = None, by: tuple[str, ...] = ("nation_id",)) -> DataFrame:
    """Keys that can stand on a board of the batch at all: ten others are certainly ahead of the rest, every day."""
    found = keys.join(bars(keys, [*by]) if bar is None else bar, [*by], "left")
    return found.where((F.col("most") > 0) & (F.col("most") >= F.coalesce("bar", "most"))).drop("bar")


def untouched(touched: DataFrame, batches: list[int]) -> DataFrame:
    """The keys of each later batch that left them as they were, with their bounds."""
    known = touched.where("until is null").select(*KEY, "batch", F.col("revenue").alias("closing"))
    until = F.coalesce(F.lead("batch").over(Window.partitionBy(*KEY).orderBy("batch")), F.lit(batches[-1] + 1))
    held = known.withColumn("until", until).where((F.col("closing") > 0) & (F.col("until") > F.col("batch") + 1))
    held = held.select(*KEY, F.explode(F.sequence(F.col("batch") + 1, F.col("until") - 1)).alias("batch"), "closing")
    return held.select(*KEY, "batch", *[F.col("closing").alias(c) for c in ("revenue", "most", "least")])


def changed(found: DataFrame, days: dict[int, list[int]]) -> DataFrame:
    """The changes of the boards over the arrival days of each batch. found: contenders of each batch, a row for each of their revenues; since is null
    if it holds from the batch's begin, until is null if to its end."""
    # each batch begins with the board it finds, at place 0
    dates = F.create_map(*[x for b, of in days.items() for x in (F.lit(b), F.array(*[F.lit(d).cast("long") for d in (of[0] - 1, *of)]))])
    start = F.when(F.col("since").isNull(), 0).otherwise(F.array_position("dates", F.col("since")) - 1).cast("int")
    end = F.when(F.col("until").isNull(), F.size("dates") - 1).otherwise(F.array_position("dates", F.col("until")) - 2).cast("int")
    held = found.where("revenue > 0").withColumn("dates", dates[F.col("batch")]).withColumns({"start": start, "end": end})
    each = held.select(*KEY, "batch", "revenue", "next", "dates", "end", F.explode(F.sequence("start", "end")).alias("at"))
    after = F.when(F.col("at") == F.col("end"), F.coalesce("next", "revenue")).otherwise(F.col("revenue"))
    each = each.select(*KEY, "batch", "at", "revenue", after.alias("next"), F.get("dates", F.col("at")).alias("day"), F.get("dates", F.col("at") + 1).alias("next_day"))
    board = each.withColumn("rank", _place(["nation_id", "batch", "at"], "revenue")).where(F.col("rank") <= TOP)
    key = Window.partitionBy(*KEY, "batch").orderBy("at")
    before = F.when(F.lag("at").over(key) == F.col("at") - 1, F.lag("rank").over(key))
    stays = F.coalesce(F.lead("at").over(key) == F.col("at") + 1, F.lit(False))
    board = board.withColumn("before", before).withColumn("stays", stays)

    def row(when: Column, day: str, change: Column, old: Column, new: Column, revenue: str) -> Column:
        return F.when(when, F.struct(F.col(day).alias("arrival_day"), change.alias("change"), old.alias("old_rank"), new.alias("new_rank"), F.col(revenue).cast("long").alias("revenue")))

    none = F.lit(None).cast("int")
    here = row((F.col("at") > 0) & ~F.col("before").eqNullSafe(F.col("rank")), "day", F.when(F.col("before").isNull(), "enter").otherwise("move"), F.col("before"), F.col("rank"), "revenue")
    gone = row(F.col("next_day").isNotNull() & ~F.col("stays"), "next_day", F.lit("exit"), F.col("rank"), none, "next")
    found = board.select(*KEY, "batch", F.explode(F.array_compact(F.array(here, gone))).alias("x"))
    return found.select("nation_id", "x.arrival_day", "item_id", "batch", "x.change", "x.old_rank", "x.new_rank", "x.revenue")


def feed(lines: DataFrame, items: DataFrame, vendors: DataFrame) -> DataFrame:
    """The changes of all boards over all batches of lines."""
    spark = lines.sparkSession
    root = shared_path(spark, "leaderboard")
    label = root.rpartition("/")[2]
    read = dated(lines)
    found = read.groupBy("arrived", "batch").agg(F.max("shipped").alias("shipped"), F.count("*").alias("n")).collect()  # a row for each arrival day
    if not found:
        return spark.createDataFrame([], CHANGES)
    days = {b: sorted(d["arrived"] for d in found if d["batch"] == b) for b in sorted({d["batch"] for d in found})}
    counts = {b: sum(d["n"] for d in found if d["batch"] == b) for b in days}
    cut(read, items, vendors, f"{root}/cut", -(-max(counts.values()) // FILE_LINES))
    oldest = None
    with settings(spark, STATE):
        for batch in days:
            renamed(spark, f"{root}/cut/batch={batch}", f"{root}/inbox/batch={batch}")
            _added(spark, root, batch, oldest, -(-counts[batch] // TASK_LINES))
            removed(spark, f"{root}/inbox/batch={batch}")
            oldest = max([oldest] * (oldest is not None) + [d["shipped"] for d in found if d["batch"] == batch])
    removed(spark, f"{root}/cut", f"{root}/inbox", f"{root}/checkpoint")
    touched, by = bounded(spark.read.schema(TOUCHED).parquet(f"{root}/touched")), ["nation_id", "batch"]
    last = touched.where("until is null")  # a row a key and batch
    # few of the untouched keys reach what ten of the touched ones surely have
    bar = written(bars(last.where("least > 0"), by), f"{label}/bars")
    rest = written(contenders(untouched(touched, [*days]), bar, by), f"{label}/untouched")
    bound = [*KEY, "batch", "least"]
    bar = written(bars(last.select(bound).unionByName(rest.select(bound)).where("least > 0"), by), f"{label}/bars")
    opened = contenders(touched.where("opening is not null"), bar, by).select(*KEY, "batch", F.col("since").alias("until"), F.col("opening").alias("revenue"), F.col("revenue").alias("next"))
    found = contenders(touched, bar, by).drop("opening").unionByName(opened, allowMissingColumns=True).unionByName(contenders(rest, bar, by), allowMissingColumns=True)
    changes = written(changed(found, days), f"{label}/changes")
    removed(spark, f"{root}/touched")
    return changes


def _added(spark: SparkSession, root: str, batch: int, oldest: int | None, files: int) -> None:
    """The stream, started on its checkpoint for one more batch; its sink writes the touched keys, in at most so many files."""

    def sink(now: DataFrame, epoch: int) -> None:
        own = counted(now.sparkSession.read.schema(LINE).option("basePath", f"{root}/inbox").parquet(f"{root}/inbox/batch={batch}"), oldest)
        closed(now, own).coalesce(files).write.mode("overwrite").parquet(f"{root}/touched/batch={batch}")  # the same if the epoch is run again

    stream = spark.readStream.schema(LINE).parquet(f"{root}/inbox")
    query = summed(counted(stream, oldest)).writeStream.outputMode("update").foreachBatch(sink)
    query.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()


SQL = """
WITH RECURSIVE bits(n, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT n, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
l AS (
  SELECT item_id, vendor_id, quantity, amount, flag, CAST(shipped_at AS DATE) AS day,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(concat_ws(',', coalesce(CAST(sale_id AS VARCHAR), ''), coalesce(CAST(item_id AS VARCHAR), ''),
               coalesce(CAST(vendor_id AS VARCHAR), ''), coalesce(CAST(line_no AS VARCHAR), '')), ''), lambda x: CAST(ord(x) AS BIGINT))),
               lambda x, y: xor(x >> 8, crc.t[xor(x, y) % 256 + 1])), 4294967295) AS h
  FROM sale_lines, crc
), s AS (SELECT *, coalesce(date_diff('day', DATE '1970-01-01', day), 19723 + h % 150) AS shipped FROM l),
a AS (SELECT *, shipped + h % 7 + CASE WHEN h % 5 = 0 THEN 20 ELSE 0 END AS arrived FROM s),
b AS (SELECT *, CAST(least(10, greatest(1, 1 + floor((arrived - 19723) * 10 / 180.0))) AS INT) AS batch FROM a),
o AS (SELECT batch, max(max(shipped)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS oldest FROM b GROUP BY batch),
c AS (
  SELECT v.nation_id, b.item_id, b.arrived,
         coalesce(floor(100 * b.amount + 0.5), b.quantity * floor(100 * i.price + 0.5), 0) * CASE WHEN b.flag = 'swapped' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS cents
  FROM b JOIN o ON o.batch = b.batch JOIN items i ON i.item_id = b.item_id JOIN vendors v ON v.vendor_id = b.vendor_id
  WHERE v.nation_id IS NOT NULL AND (o.oldest IS NULL OR b.shipped + 3 >= o.oldest)
), own AS (SELECT nation_id, item_id, arrived, sum(cents) AS cents FROM c GROUP BY ALL),
days AS (SELECT DISTINCT arrived FROM own),
grid AS (SELECT k.nation_id, k.item_id, d.arrived FROM (SELECT nation_id, item_id, min(arrived) AS first FROM own GROUP BY ALL) k JOIN days d ON d.arrived >= k.first),
run AS (
  SELECT g.nation_id, g.item_id, g.arrived, sum(coalesce(own.cents, 0)) OVER (PARTITION BY g.nation_id, g.item_id ORDER BY g.arrived) AS revenue
  FROM grid g LEFT JOIN own ON own.nation_id = g.nation_id AND own.item_id = g.item_id AND own.arrived = g.arrived
), placed AS (SELECT *, row_number() OVER (PARTITION BY nation_id, arrived ORDER BY revenue DESC, item_id) AS place FROM run),
ranked AS (SELECT *, CASE WHEN place <= 10 AND revenue > 0 THEN place END AS new_rank FROM placed),
moved AS (SELECT *, lag(new_rank) OVER (PARTITION BY nation_id, item_id ORDER BY arrived) AS old_rank FROM ranked)
SELECT CAST(nation_id AS INT) AS nation_id, CAST(arrived AS BIGINT) AS arrival_day, item_id, CAST(least(10, greatest(1, 1 + floor((arrived - 19723) * 10 / 180.0))) AS INT) AS batch,
       CASE WHEN old_rank IS NULL THEN 'enter' WHEN new_rank IS NULL THEN 'exit' ELSE 'move' END AS change,
       CAST(old_rank AS INT) AS old_rank, CAST(new_rank AS INT) AS new_rank, CAST(revenue AS BIGINT) AS revenue
FROM moved WHERE old_rank IS DISTINCT FROM new_rank
"""
