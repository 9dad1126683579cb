"""Intake of uploaded files: every file becomes exactly one job, or several for an archive, or a rejected row."""

from __future__ import annotations

import email
import io
import zipfile
from collections.abc import Iterator
from email import policy
from fnmatch import fnmatch

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.functions import parsing, rules

MOST_MEMBERS, MOST_BYTES = 200, 200 << 20
MEMBERS = "path string, member string, content binary, reason string"


def files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, length and content of files; their kind is that of their extension."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    empty = spark.createDataFrame([(p, 0, b"") for p in empty_files(spark, folder, pattern, recursive)], "path string, length long, content binary")
    df = df.select("path", "length", "content").unionByName(empty)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ext == "pdf", "pdf").when(ext == "zip", "archive").when(ext == "eml", "mail").when(ext.isin("png", "jpg", "jpeg"), "image").when(ext.isin("dwg", "dxf"), "drawing").otherwise("other")
    return df.select("path", "length", "content", kind.alias("kind"))


def empty_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> list[str]:
    """Paths of files without content, which the file source leaves out."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listing = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, recursive)
    found = []
    while listing.hasNext():
        entry = listing.next()
        if entry.getLen() == 0 and fnmatch(entry.getPath().getName(), pattern):
            found.append(entry.getPath().toString())
    return found


def open_archive(content: bytes) -> list[tuple[str | None, bytes | None, str | None]]:
    """(member, content, None) of the PDFs of an archive, or a reason; names that leave the archive are refused."""
    out, total = [], 0
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            drawings = [i for i in z.infolist() if not i.is_dir() and i.filename.lower().endswith(".pdf")]
            for place, info in enumerate(drawings):
                total += info.file_size
                if place >= MOST_MEMBERS:
                    out.append((info.filename, None, "too many members"))
                elif total > MOST_BYTES:
                    out.append((info.filename, None, "archive too large"))
                elif info.filename.startswith("/") or ".." in info.filename.split("/"):
                    out.append((info.filename, None, "unsafe name"))
                else:
                    out.append((info.filename, z.read(info), None))
    except zipfile.BadZipFile:
        return [(None, None, "corrupt archive")]
    return out or [(None, None, "no drawing in archive")]


def open_mail(content: bytes) -> list[tuple[str | None, bytes | None, str | None]]:
    message = email.message_from_bytes(content, policy=policy.default)
    found = [(p.get_filename(), p.get_payload(decode=True), None) for p in message.iter_attachments() if (p.get_filename() or "").lower().endswith(".pdf")]
    return found or [(None, None, "no drawing attached")]


def members(uploads: DataFrame) -> DataFrame:
    """Archives and mails opened on the executors; other files are their own member."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                opened = open_archive(r.content) if r.kind == "archive" else open_mail(r.content) if r.kind == "mail" else [(r.path.rsplit("/", 1)[-1], r.content, None)]
                rows += [(r.path, *m) for m in opened]
            yield pd.DataFrame(rows, columns=["path", "member", "content", "reason"])

    return uploads.select("path", "kind", "content").mapInPandas(run, MEMBERS)


def jobs(opened: DataFrame) -> DataFrame:
    """A job row for each member; what isn't a drawing is rejected with its reason, never dropped."""
    magic = F.substring("content", 1, 5) == F.lit(b"%PDF-")
    reason = F.coalesce("reason", F.when(F.coalesce(F.octet_length("content"), F.lit(0)) == 0, "empty file"), F.when(~magic, "not a PDF"))
    name = parsing.safe_file_part(F.coalesce("member", parsing.file_name(F.col("path"))))
    return opened.select(
        F.substring(F.sha2(F.concat_ws("|", "path", "member"), 256), 1, 8).alias("job_id"), "path", name.alias("file"), F.sha2("content", 256).alias("document_sha256"),
        F.when(reason.isNull(), "processing").otherwise("rejected").alias("status"), F.when(reason.isNotNull(), rules.REJECTED).alias("measurement_state"), reason.alias("reason"),
    )
