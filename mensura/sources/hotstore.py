"""A hot store and its archive that change together, by versions and one manifest.

Every commit writes the parts that it changes as new folders and then one small
manifest that names the folders of both stores. A manifest's name is its version, and
it is moved into place by a rename that fails where the name is taken, so of two
writers that began from one version one fails and nothing is lost. Readers take the
last manifest there is: a row that moves from one store to the other is never in both
or in neither, and a job that dies half-way leaves folders that no manifest names.

Moves: a job that is processing, or that a client's quotation commits to, isn't
archived; a restored job is what it was decided to be, or pending. Refused and
unknown ids are returned with their reason, never dropped.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOT, ARCHIVE = "hot", "archive"


class Conflict(RuntimeError):
    """Another commit came between."""


class HotStore:
    """Jobs(job_id, status, decision, ...) below ``folder``, of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[str]:
        at = self._path(f"{self.folder}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(n for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def version(self) -> int:
        """The last version that was committed; 0 before the first."""
        last = self._manifests()
        return int(last[-1].split(".")[0]) if last else 0

    def _folders(self, version: int) -> dict[str, str]:
        if not version:
            return {}
        text = self.spark.read.text(f"{self.folder}/manifests/{version:012d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, store: str = HOT, version: int | None = None) -> DataFrame | None:
        """A store as the last commit, or an earlier one, left it; None before there is any."""
        folder = self._folders(self.version() if version is None else version).get(store)
        return None if folder is None else self.spark.read.parquet(f"{self.folder}/data/{folder}")

    def commit(self, base: int, **changed: DataFrame) -> int:
        """Replaces the given stores, all at once, where ``base`` is still the last version; the new version."""
        folders = dict(self._folders(base))
        for store, rows in changed.items():
            name = f"{store}-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.folder}/data/{name}")
            folders[store] = name
        manifests = f"{self.folder}/manifests"
        self._fs.mkdirs(self._path(manifests))
        staged, target = self._path(f"{manifests}/_{uuid.uuid4().hex}.json"), self._path(f"{manifests}/{base + 1:012d}.json")
        out = self._fs.create(staged, True)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(staged, target):
            self._fs.delete(staged, False)
            raise Conflict(f"version {base + 1} was committed by another writer")
        return base + 1

    def _tables(self, base: int) -> tuple[DataFrame, DataFrame]:
        hot = self.read(HOT, base)
        if hot is None:
            raise ValueError("there is no store yet")
        archive = self.read(ARCHIVE, base)
        extra = hot.withColumn("archived_at", F.lit(None).cast("timestamp")).withColumn("archive_note", F.lit(None).cast("string"))
        return hot, extra.limit(0) if archive is None else archive

    def archive(self, ids: DataFrame, at, note: str = "") -> DataFrame:
        """Moves the jobs of ids(job_id) to the archive; job_id and reason of those that stay."""
        base = self.version()
        hot, archive = self._tables(base)
        asked = ids.select("job_id").distinct()
        met = asked.join(hot.select("job_id", "status", "decision"), "job_id", "left")
        known = hot.select("job_id", F.lit(True).alias("known"))
        reason = F.when(F.col("known").isNull(), "not found").when(F.col("status") == "processing", "job is still processing").when(F.col("decision") == "approved", "job is already approved")
        verdict = met.join(known, "job_id", "left").select("job_id", reason.alias("reason"))
        go = verdict.where("reason IS NULL").select("job_id")
        moved = hot.join(go, "job_id", "left_semi").withColumn("status", F.lit("deleted")).withColumn("archived_at", F.lit(at).cast("timestamp")).withColumn("archive_note", F.lit(note))
        rest = archive.join(go, "job_id", "left_anti")
        self.commit(base, hot=hot.join(go, "job_id", "left_anti"), archive=rest.unionByName(moved))
        return verdict.where("reason IS NOT NULL")

    def restore(self, ids: DataFrame) -> DataFrame:
        """Moves the jobs of ids(job_id) back; job_id and reason of those that aren't archived. A job of the hot store is replaced."""
        base = self.version()
        hot, archive = self._tables(base)
        asked = ids.select("job_id").distinct()
        back = archive.join(asked, "job_id", "left_semi").withColumn("status", F.coalesce("decision", F.lit("pending"))).select(*hot.columns)
        unknown = asked.join(archive.select("job_id"), "job_id", "left_anti").withColumn("reason", F.lit("not found"))
        self.commit(base, hot=hot.join(back.select("job_id"), "job_id", "left_anti").unionByName(back), archive=archive.join(asked, "job_id", "left_anti"))
        return unknown
