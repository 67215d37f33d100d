"""Writes as pure functions: each takes tables and gives the tables of the next version."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PIPELINE_VERSION


def inserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with the rows whose key it lacks: insert-or-ignore, also for repeated rows."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti").select(*table.columns))


def replaced(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows in place of those of the same key."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def deleted(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), keys, "left_anti").select(*table.columns)


def updated(table: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Columns set where the condition holds."""
    return table.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def indexed(corpora: DataFrame, corpus: str, at: str, version: str | None) -> DataFrame:
    """A corpus after its index: ready, with the time and, if any, the version."""
    here = F.col("id") == corpus
    return updated(corpora, here, status=F.lit("ready"), last_indexed_at=F.lit(at), last_indexed_version=F.coalesce(F.lit(version).cast("string"), "last_indexed_version"))


def without_corpus(tables: dict[str, DataFrame], corpus: str) -> dict[str, DataFrame]:
    """Every table without the corpus's rows; its registration goes too."""
    own = {n: t.filter(F.col("corpus_id") != corpus) for n, t in tables.items() if "corpus_id" in t.columns}
    return own | ({"corpora": tables["corpora"].filter(F.col("id") != corpus)} if "corpora" in tables else {})


def wiped(tables: dict[str, DataFrame], corpus: str) -> dict[str, DataFrame]:
    """A fresh start for a corpus: its rows and the whole memo go, its registration stays, without anchors."""
    own = {n: t.filter(F.col("corpus_id") != corpus) for n, t in tables.items() if "corpus_id" in t.columns and n not in ("corrections", "runs")}
    if "layer2_cache" in tables:
        own["layer2_cache"] = tables["layer2_cache"].limit(0)
    if "corpora" in tables:
        none = F.lit(None).cast("string")
        own["corpora"] = updated(tables["corpora"], F.col("id") == corpus, last_indexed_version=none, backfill_cursor=none)
    return own


def valid_corrections(rows: DataFrame) -> DataFrame:
    """Corrections with exactly one scope."""
    return rows.filter(F.col("corpus_id").isNull() != F.col("collection_id").isNull())


def stamped(table: DataFrame, corpora: DataFrame) -> DataFrame:
    """Missing version stamps filled from the corpus's last version."""
    last = corpora.select(F.col("id").alias("corpus_id"), "last_indexed_version")
    return table.join(last, "corpus_id", "left").withColumn("derived_at_version", F.coalesce("derived_at_version", "last_indexed_version")).select(*table.columns)



def free_id(corpora: DataFrame, wanted: str) -> str:
    """wanted, or wanted-2, wanted-3, ... where it is taken."""
    taken = {r[0] for r in corpora.filter((F.col("id") == wanted) | F.col("id").startswith(f"{wanted}-")).select("id").collect()}
    k = 2
    out = wanted
    while out in taken:
        out, k = f"{wanted}-{k}", k + 1
    return out


def upgraded(corpora: DataFrame, corpus: str, steps: dict[int, object] | None = None) -> DataFrame:
    """A corpus brought to PIPELINE_VERSION: each step from its own version on runs once, in order."""
    row = corpora.filter(F.col("id") == corpus).select("pipeline_version").first()
    for k in range((row[0] or 0) + 1 if row else 1, PIPELINE_VERSION + 1):
        if steps and k in steps:
            steps[k]()
    return updated(corpora, F.col("id") == corpus, pipeline_version=F.lit(PIPELINE_VERSION))
