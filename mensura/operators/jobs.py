"""Job histories: what was learned, who approved before, revisions and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mensura.functions import parsing
from mensura.operators import relational


def approved(jobs: DataFrame) -> DataFrame:
    is_ = lambda c: F.lower(F.trim(F.col(c))) == "approved"
    return jobs.where(F.coalesce(is_("decision"), F.lit(False)) | F.coalesce(is_("status"), F.lit(False)))


def learned_patterns(jobs: DataFrame) -> DataFrame:
    """Latest approval and history by file, project and content hash; of equal times the later row counts."""
    a = approved(jobs.dropDuplicates(["job_id"])).withColumn("approved_at", parsing.first_text(F.col("decided_at"), F.col("created_at")))
    keys = {"file": parsing.file_name(F.col("pdf_path")), "project": F.trim("project_ref"), "sha256": F.lower("document_sha256")}
    rows = [a.select(F.lit(kind).alias("match_type"), key.alias("key"), "job_id", "approved_at", "seq") for kind, key in keys.items()]
    all_ = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return relational.latest_with_history(all_, ["match_type", "key"], ["job_id", "approved_at"], ["approved_at", "seq"])


def delta_report(episodes: DataFrame, jobs: DataFrame) -> DataFrame:
    """By project: approved jobs and the mean of the known differences between first and final area."""
    d = approved(jobs).join(episodes.select("job_id", "initial_area_m2", "terminal_area_m2"), "job_id", "left")
    delta = F.col("terminal_area_m2") - F.col("initial_area_m2")
    ref = F.coalesce(F.nullif(F.trim("project_ref"), F.lit("")), F.lit("__no_project_ref__"))
    return d.groupBy(ref.alias("project_ref")).agg(F.count("*").alias("n_jobs"), F.count(delta).alias("n_delta"), F.avg(delta).alias("mean_delta"))


def numbered_events(events: DataFrame) -> DataFrame:
    """Events with their place in each job's episode, and the keys that each changed."""
    w = Window.partitionBy("job_id").orderBy("at", "event_id")
    keys = F.array_union(F.coalesce(F.map_keys("before"), F.array()), F.coalesce(F.map_keys("after"), F.array()))
    get = lambda m, k: F.try_element_at(F.col(m), k)
    changed = F.filter(keys, lambda k: ~get("before", k).eqNullSafe(get("after", k)))
    return events.withColumn("sequence", F.row_number().over(w)).withColumn("changed", F.array_sort(changed))


def revised(issued: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """Issued rows and, appended, corrections as further revisions; nothing issued is overwritten."""
    last = issued.groupBy(key).agg(F.max("revision").alias("last"))
    w = Window.partitionBy(key).orderBy("at")
    new = corrections.join(last, key, "left").withColumn("revision", (F.coalesce("last", F.lit(-1)) + F.row_number().over(w)).cast(issued.schema["revision"].dataType)).drop("last")
    return issued.unionByName(new, allowMissingColumns=True)


def swept(jobs: DataFrame) -> DataFrame:
    """Jobs left in processing by a restart become unmeasured, with a flag."""
    stuck = F.col("status") == "processing"
    state = F.when(stuck, "UNMEASURED").otherwise(F.col("measurement_state"))
    flags = F.when(stuck, F.concat(F.coalesce("flags", F.array().cast("array<string>")), F.array(F.lit("interrupted by restart")))).otherwise(F.col("flags"))
    return jobs.withColumn("measurement_state", state).withColumn("flags", flags).withColumn("status", F.when(stuck, "pending").otherwise(F.col("status")))
