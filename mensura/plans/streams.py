"""Queries that run a stream to its end and return what it left."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mensura.operators.lineage import shared_dir
from mensura.streaming import decisions, events


def stream_latest(spark, d):
    """The latest event of each user, kept by a stream of upserts."""
    folder = shared_dir(spark)
    name = f"{folder.rstrip('/')}/stream-{spark.sparkContext.applicationId}-{abs(hash((d, id(object()))))}"
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    query = events.upsert_latest(stream.select("user_id", "event_id", "event_type", "ts"), f"{name}/out", f"{name}/state", ["user_id"], ["ts", "event_id"])
    query.awaitTermination()
    last = max((p["batchId"] for p in query.recentProgress if p["numInputRows"]), default=0)
    return spark.read.parquet(f"{name}/out/v={last}").select("user_id", "event_id", "event_type")


def session_windows(spark, d):
    """Sessions by a gap of 30 minutes, in the batch form that the stream converges to."""
    out = events.sessions(spark.read.parquet(f"{d}/events.parquet"))
    return out.select("user_id", F.unix_micros("start").alias("start_us"), "n")


#: Users are jobs; each of their events is a command, in the order of time.
COMMANDS = """
SELECT user_id AS job, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
  CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AND user_id % 10 > 0 THEN 'start' ELSE CASE event_id % 11 WHEN 0 THEN 'start' WHEN 1 THEN 'measured' WHEN 2 THEN 'measured' WHEN 3 THEN 'lost'
    WHEN 4 THEN 'approve' WHEN 5 THEN 'reject' WHEN 6 THEN 'adjust' WHEN 7 THEN 'archive' WHEN 8 THEN 'restore' WHEN 9 THEN 'measured' ELSE 'other' END END AS kind,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(event_id % 1000 AS DOUBLE) / 4 END AS area, CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 7 AS INT) END AS base
FROM events"""


def job_decisions(spark, d):
    """What became of every command, from a stream that brings them in no order and some of them twice.

    Without a deadline: where there are timers a stream always has a batch to come, and doesn't end.
    """
    spark.read.parquet(f"{d}/events.parquet").createOrReplaceTempView("events")
    folder = f"{shared_dir(spark).rstrip('/')}/commands-{uuid.uuid4().hex}"
    commands = spark.sql(COMMANDS)
    again = commands.where("seq % 4 = 0")  # a replay
    commands.unionByName(again).repartition(6, F.xxhash64("job", "seq", F.rand(7))).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(commands.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    query = decisions.decided(stream, None).writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/out/n={n}"))
    query.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(decisions.ROWS).parquet(f"{folder}/out").select(*(c.split()[0] for c in decisions.ROWS.split(", ")))


_WHY = """CASE WHEN kind = 'start' THEN CASE WHEN status = 'none' THEN NULL ELSE 'already started' END
  WHEN status = 'none' OR (status = 'deleted' AND kind <> 'restore') THEN 'not found' WHEN kind = 'restore' THEN CASE WHEN status = 'deleted' THEN NULL ELSE 'not archived' END
  WHEN kind IN ('measured', 'lost') THEN CASE WHEN status = 'processing' OR (kind = 'measured' AND status = 'unmeasured') THEN NULL ELSE 'not processing' END
  WHEN kind NOT IN ('approve', 'reject', 'adjust', 'archive') THEN 'unknown command' WHEN status = 'processing' THEN 'job is still processing'
  WHEN base IS NOT NULL AND base <> version THEN 'stale version' WHEN kind = 'approve' AND area IS NULL THEN 'approve blocked: no measurement'
  WHEN kind = 'archive' AND decision = 'approved' THEN 'already approved' END"""


QUERIES = {"stream_latest": stream_latest, "session_windows": session_windows, "job_decisions": job_decisions}
ORACLE_SQL = {
    "job_decisions": f"""
WITH RECURSIVE e AS ({COMMANDS}),
f(job, seq, status, decision, version, area, outcome) AS (
  SELECT DISTINCT job, CAST(0 AS BIGINT), 'none', CAST(NULL AS VARCHAR), 0, CAST(NULL AS DOUBLE), '' FROM e
  UNION ALL SELECT job, seq, CASE WHEN why IS NOT NULL THEN status WHEN kind = 'approve' THEN 'approved' WHEN kind = 'reject' THEN 'rejected' WHEN kind = 'start' THEN 'processing' WHEN kind = 'measured' THEN 'pending'
      WHEN kind = 'lost' THEN 'unmeasured' WHEN kind = 'archive' THEN 'deleted' WHEN kind = 'restore' THEN coalesce(decision, 'pending') WHEN status <> 'approved' THEN 'pending' ELSE status END,
    CASE WHEN why IS NULL AND kind = 'approve' THEN 'approved' WHEN why IS NULL AND kind = 'reject' THEN 'rejected' ELSE decision END, version + CASE WHEN why IS NULL THEN 1 ELSE 0 END,
    CASE WHEN why IS NULL AND kind IN ('measured', 'adjust') THEN value ELSE area END, CASE WHEN why IS NULL THEN 'applied' ELSE 'refused: ' || why END
  FROM (SELECT f.job, e.seq, f.status, f.decision, f.version, f.area, e.kind, e.area AS value, {_WHY.replace("area IS NULL", "f.area IS NULL")} AS why FROM f JOIN e ON e.job = f.job AND e.seq = f.seq + 1))
SELECT * FROM f WHERE seq > 0""",
    "stream_latest": """
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p FROM events) WHERE p = 1""",
    "session_windows": """
WITH e AS (SELECT user_id, epoch_us(ts) AS t0, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, t0, sum(fresh) OVER (PARTITION BY user_id ORDER BY t0 ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(t0) AS start_us, count(*) AS n FROM s GROUP BY user_id, k""",
}
