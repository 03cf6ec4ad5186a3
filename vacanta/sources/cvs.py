"""CV text files: one whole UTF-8 file per user."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

# Fixed value: files are named cv_<user id>.txt
CV_FILE = r"cv_(\d+)\.txt$"
#: What ``write_cv_texts`` names its files, or their folders.
USER_FILE = r"user_id=(\d+)[/.]"
# Fixed value: folders that the files are dealt into, so that listing them is shared by tasks
FOLDERS = 256
# Tasks that list the folders of a level, files a task reads, bytes of texts it holds at a time
LISTERS = 64
FILES_PER_TASK = 1024
HELD_BYTES = 16 << 20


def _mounted(spark: SparkSession, path: str) -> str | None:
    """The folder of ``path`` as the tasks can open it, None in a store that only Spark's readers reach."""
    where = urlsplit(path)
    if where.scheme == "file":
        return unquote(where.path)
    default = spark._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:"
    return path if not where.scheme and default.startswith("file:") else None


def write_cv_texts(texts: DataFrame, path: str) -> None:
    """One file per user of ``(user_id, text)``, a line end after every text, for ``read_cv_texts`` with ``USER_FILE``.

    On a mounted folder the tasks write the files themselves: Spark's writer makes a folder for every user,
    moves them one by one on the driver, and starts a process for every permission it sets there. Other
    stores go through Spark's writer. A file appears whole, and a task that runs again writes the same ones.
    """
    by_user = texts.select("user_id", "text").repartition("user_id")
    root = _mounted(texts.sparkSession, path)
    if root is None:
        by_user.write.partitionBy("user_id").text(path)
        return

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((u, t) for f in frames for u, t in zip(f["user_id"], f["text"]))
        made = set()
        for user, own in groupby(rows, lambda row: row[0]):
            folder = f"{root}/{zlib.crc32(user.encode()) % FOLDERS}"
            if folder not in made:
                os.makedirs(folder, exist_ok=True)
                made.add(folder)
            unfinished = f"{folder}/.{uuid.uuid4().hex}"
            with open(unfinished, "wb") as file:
                for _, text in own:
                    file.write(text)
            os.replace(unfinished, f"{folder}/user_id={user}.txt")
        yield pd.DataFrame({"user_id": pd.Series(dtype=object)})

    lines = by_user.select(
        F.coalesce(F.col("user_id").cast("string"), F.lit("unknown")).alias("user_id"),
        F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).cast("binary").alias("text"),
    )
    done = lines.sortWithinPartitions("user_id").mapInPandas(write, "user_id string")
    done.write.format("noop").mode("overwrite").save()


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """``path`` of every ``.txt`` file below ``root`` that is not hidden. Tasks list the folders, level by level."""

    def entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for folder in (folder for frame in frames for folder in frame["path"]):
            with os.scandir(folder) as found:
                shown = (e for e in found if e.name[0] != "." and (e.name[0] != "_" or "=" in e.name))
                kinds = [(e.path, e.is_dir()) for e in shown if e.name.endswith(".txt") or e.is_dir()]
            yield pd.DataFrame(kinds, columns=["path", "is_folder"])

    folders, files = spark.createDataFrame([(root,)], "path string"), []
    while n := folders.count():
        shared = folders.repartition(min(n, LISTERS), "path")
        level = written(shared.mapInPandas(entries, "path string, is_folder boolean"), "cv-list")
        files.append(level.where("NOT is_folder").select("path"))
        folders = level.where("is_folder").select("path")
    return reduce(DataFrame.unionByName, files)


def _whole_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, value, modified)`` of the files below ``root``, read by the tasks.

    Spark's reader keeps every file's status on the driver and counts a file as 4 MB at least, so that
    a task gets few of them; here a task gets a fixed number.
    """

    def contents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "value", "modified"]
        rows, held = [], 0
        for path in (path for frame in frames for path in frame["path"]):
            with open(path, "rb") as file:
                rows.append((path, file.read(), os.fstat(file.fileno()).st_mtime_ns // 1_000_000))
            held += len(rows[-1][1])
            if held >= HELD_BYTES:
                yield pd.DataFrame(rows, columns=columns)
                rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    files = _listed(spark, root)
    shared = files.repartition(1 + files.count() // FILES_PER_TASK, "path")
    return shared.mapInPandas(contents, "path string, value binary, modified bigint").select(
        F.concat(F.lit("file://"), "path").alias("path"),
        F.col("value").cast("string").alias("value"),
        F.timestamp_millis("modified").alias("modified"),
    )


def read_cv_texts(
    spark: SparkSession, path: str, user_pattern: str = CV_FILE, strict: bool = False
) -> DataFrame:
    """``(user_id, text, uploaded_at, error)``; only ``.txt`` files are read.

    An empty file is an error row; ``strict`` fails the query instead.
    """
    root = _mounted(spark, path)
    if root is not None and os.path.isdir(root):
        found = _whole_files(spark, os.path.abspath(root))
    else:
        found = (
            spark.read.option("pathGlobFilter", "*.txt")
            .option("recursiveFileLookup", True)
            .text(path, wholetext=True)
            .select(
                F.col("_metadata.file_path").alias("path"),
                "value",
                F.col("_metadata.file_modification_time").alias("modified"),
            )
        )
    files = found.select(
        F.regexp_extract("path", user_pattern, 1).try_cast("bigint").alias("user_id"),
        F.col("value").alias("text"),
        F.col("modified").alias("uploaded_at"),
    )
    message = F.lit("Failed to extract content from CV file")
    empty = F.coalesce(F.length("text") == 0, F.lit(True))
    if strict:
        kept = F.when(empty, F.raise_error(message).cast("string")).otherwise(F.col("text"))
        return files.withColumn("text", kept).withColumn("error", F.lit(None).cast("string"))
    return files.withColumn("error", F.when(empty, message))
