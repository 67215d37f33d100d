"""Incremental indexing: manifests, what changed, and a stream that reindexes batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import diffed


def manifest(files: DataFrame) -> DataFrame:
    """(path, hash) of (path, content)."""
    return files.select("path", F.sha2(F.col("content"), 256).alias("hash"))


def dirty(old: DataFrame | None, new: DataFrame, full: bool = False) -> DataFrame:
    """(path, change): all of new where asked or where there is no old manifest, else the difference."""
    if full or old is None:
        return new.select("path", F.lit("added").alias("change"))
    return diffed(old, new)


def modified_since(files: DataFrame, since: str) -> DataFrame:
    """Of binaryFile rows, those modified after an ISO time."""
    return files.filter(F.col("modificationTime") > F.lit(since).cast("timestamp"))


def since_strategy(since: str | None, last_indexed_at: str | None, has_git: bool) -> tuple[str, str | None]:
    """How changes are found: by time for a date, by git for a ref where there is a repository, else in full."""
    import re

    given = since or last_indexed_at
    if given is None:
        return "full", None
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?", given):
        return "mtime", given
    return ("git", given) if has_git else ("full", None)


def git_changes(spark: SparkSession, root: str, since: str) -> DataFrame:
    """(path, change) of a repository's working tree against a commit or ref: added, modified, deleted; a renamed file is both. New files that git doesn't track yet count as added.

    The list of names is made on the driver; contents are not.
    """
    import subprocess

    def git(*what: str) -> list[str]:
        out = subprocess.run(["git", "-C", root, *what], capture_output=True, text=True)
        if out.returncode:
            raise ValueError(f"git {what[0]}: {out.stderr.strip()}")
        return [x for x in out.stdout.split("\0") if x]

    kinds = {"A": "added", "M": "modified", "T": "modified", "D": "deleted"}
    fields = git("diff", "--name-status", "--no-renames", "--relative", "-z", since)
    rows = [(path, kinds.get(status, "modified")) for status, path in zip(fields[::2], fields[1::2], strict=True)]
    rows += [(path, "added") for path in git("ls-files", "--others", "--exclude-standard", "-z")]
    return spark.createDataFrame(rows, "path string, change string")


def reindexed(chunks: DataFrame, changed: DataFrame, fresh: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(chunks, orphans): the chunks of changed paths (path) give way to fresh ones; orphans are ids that are gone. Other paths keep theirs."""
    touched = chunks.join(changed.select(path).distinct(), path, "left_semi").select(*chunks.columns)
    kept = chunks.join(changed.select(path).distinct(), path, "left_anti").select(*chunks.columns)
    out = kept.unionByName(fresh.select(*chunks.columns))
    return out, touched.select("id").distinct().join(out.select("id"), "id", "left_anti")


def missing(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a pass still has to do."""
    return items.join(done.select(*keys).distinct(), keys, "left_anti")


def watch(spark: SparkSession, folder: str, handle: Callable[[DataFrame, int], None], checkpoint: str, seconds: float = 0.5, once: bool = False):
    """Runs handle(files, batch) on new text files, batched by a processing-time trigger; exactly once by checkpoint."""
    files = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(folder)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    # a file that came twice in one batch counts once
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, k: handle(df.dropDuplicates(["path"]), k))
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")
    return writer.start()


def event_windows(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums of (ts, event_type, value) by window; a stream is bounded by its watermark. Beyond what batch reindexing needs."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("at", late) if events.isStreaming else rows
    return rows.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
