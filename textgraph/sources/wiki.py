"""Wikis: folders of markdown pages into page and section chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matches_any
from ..operators.extraction import front_matter, sections

EXCLUDED = [".git", "_images", "_attachments"]


def read_pages(spark: SparkSession, root: str, corpus: str, exclude: list[str] = EXCLUDED) -> DataFrame:
    """(corpus_id, path, content) of all .md files below root; a missing root is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    rel = F.substring(base, F.instr(base, root.rstrip("/").rpartition("/")[2] + "/") + len(root.rstrip("/").rpartition("/")[2]) + 1, 4096)
    pages = files.select(F.lit(corpus).alias("corpus_id"), F.regexp_replace(rel, r"\.md$", "").alias("path"), F.decode("content", "UTF-8").alias("content"))
    plain = [e for e in exclude if "*" not in e]
    for e in plain:
        pages = pages.filter(~F.col("path").startswith(e) & ~F.col("path").contains(f"/{e}"))
    return pages.filter(~matches_any(F.col("path"), [e for e in exclude if "*" in e]))


def page_chunks(pages: DataFrame) -> DataFrame:
    """page chunks (raw) and section chunks of (corpus_id, path, content)."""
    where = F.concat(F.lit("wiki/"), "path")
    whole = pages.select("corpus_id", where.alias("path"), F.lit(None).cast("string").alias("parent_path"), F.lit("page").alias("kind"), "content")
    keyed = pages.select(F.struct("corpus_id", "path").alias("page"), front_matter(F.col("content"))["body"].alias("body"))
    parts = sections(keyed, "page", "body")
    parent = F.concat(F.lit("wiki/"), "page.path")
    return whole.union(parts.select("page.corpus_id", F.concat(parent, F.lit("#"), "slug"), parent, F.lit("section"), "content"))
