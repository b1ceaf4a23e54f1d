"""Streaming operators run over the event table until it is drained (SS1-SS8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.plans.registry import query, table
from quillgraph.streaming import context, ingest, ledgered, reminders
from quillgraph.tables import settings, shared_path


def _drained(s, d, make, mode):
    """What a stream over the events has written, after it was drained, started again, and replayed from the start.

    The second run reads the old checkpoint and finds nothing new. The third has a new checkpoint and sees every row again; its batches
    take the place of those of the same number, as a sink keyed by batch does, so a replay changes nothing.
    """
    schema = s.read.parquet(f"{d}/events.parquet").schema
    at = shared_path(s, "stream")
    path = f"{d}/events.parquet" if _is_folder(s, f"{d}/events.parquet") else d + "/events.parque[t]"
    for checkpoint in ("first", "first", "second"):
        stream = s.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path)
        ingest.run_once(make(stream), f"{at}/{checkpoint}", lambda rows, k: ingest.put_batch(rows, k, f"{at}/out"), mode)
    return s.read.parquet(f"{at}/out")


def _is_folder(s, path):
    p = s.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(s, d):
    """SS1-SS3: each key once, however often its rows come."""
    return _drained(s, d, lambda e: e.select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]), "append").select("user_id", "event_type")


@query("SELECT CAST(user_id AS VARCHAR) AS key, count(*)::BIGINT AS n, max(ts) AS last_at FROM events GROUP BY 1")
def stream_thread_state(s, d):
    """SS6, SS7: keyed state, forward-only times; the newest state of each key."""
    out = _drained(s, d, lambda e: ingest.thread_state(e, "user_id", "ts"), "update")
    last = out.groupBy("key").agg(F.max_by(F.struct("n", "last_at"), "batch").alias("r"))
    return last.select("key", "r.n", F.col("r.last_at").cast("timestamp_ntz").alias("last_at"))


@query("SELECT event_id, CASE WHEN value >= 5 THEN 'VALIDATED' ELSE 'FAILED' END AS stage, CASE WHEN value < 5 THEN 'validation' END AS error FROM events")
def stage_machine(s, d):
    """SS4, SS5: a bad row fails alone."""
    return ingest.split_failures(table(s, d, "events").select("event_id", "value"), F.col("value") >= 5).drop("value")


def _in_files(s, df, label, files):
    """df written as so many files into a folder of its own, for a stream to read in batches of any number of files."""
    at = shared_path(s, label)
    df.repartition(files).write.parquet(at)
    return lambda n: s.readStream.schema(df.schema).option("maxFilesPerTrigger", n).parquet(at)


@query("SELECT event_id, user_id, 'COMPLETED' AS stage FROM events WHERE value >= 5")
def exactly_once_replay(s, d):
    """SS1-SS4: messages completed once by key, though they are fed three times, cut into other batches each time; bad rows fail alone."""
    e = table(s, d, "events").select("event_id", "user_id", "value")
    stream = _in_files(s, e, "messages", 6)
    at = shared_path(s, "sink")
    sink = ledgered.Sink(s, f"{at}/out", "event_id", lambda rows: rows.withColumn("error", F.when(F.col("value") < 5, "validation")))
    for checkpoint, n in (("one", 2), ("two", 3), ("three", 6)):
        ledgered.poll(sink, lambda k=n: stream(k), f"{at}/{checkpoint}", cycles=1)
    return sink.completed().select("event_id", "user_id", "stage")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, 1::BIGINT AS times FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 11 <> 0")
def reminders_once(s, d):
    """SS8: a timer for each open item; three starts on one checkpoint remind of each due item once, and of no closed, future or undated one."""
    k = F.col("c_custkey")
    due = F.when(k % 7 == 0, "2999-01-01T00:00:00Z").when(k % 11 == 0, "soon").otherwise("2024-01-01T00:00:00Z")
    items = table(s, d, "customer").select(k.cast("string").alias("id"), F.lit(1).alias("seq"), F.when(k % 3 == 0, "done").alias("status"), due.alias("due_at"), F.col("c_name").alias("description"))
    stream, at = _in_files(s, items, "items", 2), shared_path(s, "reminders")
    with settings(s, reminders.STATE):
        for k in range(3):

            def put(rows, epoch):
                rows.write.mode("overwrite").parquet(f"{at}/out/epoch={epoch}")

            reminders.reminded(stream(1000)).writeStream.option("checkpointLocation", f"{at}/check").trigger(**reminders.ONE_TURN).foreachBatch(put).start().awaitTermination()
    return s.read.schema("id string, description string, due_at timestamp, epoch long").parquet(f"{at}/out").groupBy("id").agg(F.count(F.lit(1)).alias("times"))


@query("""WITH w AS (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda x: x <> '') AS v FROM conversations),
a AS (SELECT conv_id, turn, unnest(v[1:3]) AS x, unnest(range(1, least(len(v), 3) + 1)) AS pos FROM w), g AS (SELECT conv_id, v[4] AS x, max(turn) AS gone FROM w WHERE turn % 2 = 1 AND len(v) > 3 GROUP BY 1, 2),
p AS (SELECT a.conv_id, a.x, min(a.turn * 10 + a.pos) AS place FROM a LEFT JOIN g ON g.conv_id = a.conv_id AND g.x = a.x WHERE g.gone IS NULL OR a.turn >= g.gone GROUP BY 1, 2)
SELECT CAST(c.conv_id AS VARCHAR) AS thread, coalesce(string_agg(p.x, ' ' ORDER BY p.place), '') AS state FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN p ON p.conv_id = c.conv_id GROUP BY 1""")
def context_stream(s, d):
    """SS6, AR4: the words that a thread's turns add and remove, as map state of a stream whose turns arrive in any order, begun from a batch table."""
    words = F.filter(F.split("text", " "), lambda x: x != "")
    c = table(s, d, "conversations").where("conv_id is not null").withColumn("v", words)
    gone = F.when((F.col("turn") % 2 == 1) & (F.size("v") > 3), F.slice("v", 4, 1))
    deltas = c.select(F.col("conv_id").cast("string").alias("thread"), F.col("turn").cast("long").alias("seq"), F.lit("words").alias("field"), F.slice("v", 1, 3).alias("add"), gone.alias("remove"))
    first, later = deltas.where("seq % 3 = 1"), deltas.where("seq % 3 <> 1")
    stream, at = _in_files(s, later, "deltas", 3), shared_path(s, "context")
    with settings(s, reminders.STATE):
        query_ = context.folded(stream(1), first).writeStream.outputMode("update").option("checkpointLocation", f"{at}/check").trigger(availableNow=True)
        query_.foreachBatch(lambda rows, epoch: rows.write.mode("overwrite").parquet(f"{at}/out/epoch={epoch}")).start().awaitTermination()
    out = s.read.schema("thread string, version long, field string, state array<string>, epoch long").parquet(f"{at}/out")
    last = out.groupBy("thread").agg(F.max_by("state", "version").alias("state"))
    return deltas.select("thread").distinct().join(last, "thread", "left").select("thread", F.coalesce(F.array_join("state", " "), F.lit("")).alias("state"))
