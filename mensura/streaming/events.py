"""Structured Streaming: incremental patterns, sessions, and jobs with a deadline and late success."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, schema, per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def upsert_latest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str]):
    """Keeps the latest row of each key in ``path``; a replayed batch changes nothing.

    Each batch is merged with the version before it and written as the next one.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        both = batch
        if number:
            both = both.unionByName(spark.read.parquet(f"{path}/v={number - 1}"))
        rest = [c for c in batch.columns if c not in keys]
        latest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")
        latest.write.mode("overwrite").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user; works on a stream and on a table."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("at", late) if events.isStreaming else timed
    out = timed.groupBy("user_id", F.session_window("at", gap).alias("s")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "value")


OUTCOME = "job_id string, status string, area_m2 double, flag string"


def with_deadline(stream: DataFrame, seconds: int = 120) -> DataFrame:
    """Jobs(job_id, event, area_m2) that start, and end or run out of time.

    A job that passes its deadline is reported unmeasured; if it succeeds later
    after all, that result replaces the timeout and carries no flag.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        row = lambda *x: pd.DataFrame([(key[0], *x)], columns=["job_id", "status", "area_m2", "flag"])
        if state.hasTimedOut:
            state.update(("timed out",))
            yield row("UNMEASURED", None, f"no result within {seconds} s")
            return
        rows = pd.concat(list(batches))
        done = rows[rows.event == "done"]
        if len(done):
            if state.exists:
                state.remove()
            area = done.area_m2.iloc[-1]
            yield row("MEASURED", None if pd.isna(area) else float(area), None)
        elif not state.exists:
            state.update(("measuring",))
            state.setTimeoutDuration(seconds * 1000)

    return stream.groupBy("job_id").applyInPandasWithState(run, OUTCOME, "status string", "update", GroupStateTimeout.ProcessingTimeTimeout)
