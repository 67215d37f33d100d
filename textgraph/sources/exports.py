"""Sinks: JSON lines of the model, and an index of definitions by file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORDS = ["chunk", "entity", "edge", "summary", "correction"]


def json_lines(**tables: DataFrame) -> DataFrame:
    """(rank, key, line): one JSON object a row, record types in the order of RECORDS."""
    parts = []
    for name, df in tables.items():
        line = F.to_json(F.struct(F.lit(name).alias("record_type"), *df.columns))
        parts.append(df.select(F.lit(RECORDS.index(name)).alias("rank"), F.col("id").alias("key"), line.alias("line")))
    return reduce(DataFrame.union, parts)


def write_json_lines(path: str, **tables: DataFrame) -> None:
    json_lines(**tables).orderBy("rank", "key").select("line").write.text(path)


def symbol_index(files: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """One document a file chunk: the definitions in it and their relations, as in a code index."""
    uri = F.regexp_replace("first_location_uri", "#.*$", "")
    kinds = ["calls", "extends", "implements", "imports"]
    rel = edges.filter(F.col("kind").isin(kinds)).groupBy(F.col("from_entity_id").alias("id")).agg(F.array_sort(F.collect_set(F.struct("kind", F.col("to_entity_id").alias("target")))).alias("relations"))
    own = entities.join(rel, "id", "left").groupBy(uri.alias("location_uri")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("symbol"), "kind", "relations"))).alias("occurrences"))
    return files.filter("kind = 'file'").select("location_uri").join(own, "location_uri", "left")
