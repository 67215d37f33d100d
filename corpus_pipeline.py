"""The corpus pipeline: five stages over documents, each written as Parquet and reread as the next one's input.

Edge cases, in every stage: a null or empty text is a document without words, lines but one, or ids, and stays; a null
doc_id is an id of its own below all others, except that no benchmark item is looked for in rows without an id, since
such a document can't be named; rows that repeat are each a document, until the near-duplicate stage keeps one of those
that share an id and a text; columns beyond doc_id and text are kept by all stages but the last, whatever their names;
texts of any length are taken whole; empty tables go through as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgraph.llm import decontamination, line_dedup, near_dedup, sentencepiece_codec, toxicity
from textgraph.llm.common import documents, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, by a model of the labels; all, where nothing is labelled toxic."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, documents(spark, sf_dir, "labels")))


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many share; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        kind, n_dropped = docs.schema["n_chars"].dataType, out.columns[-1]
        out = out.withColumn("n_chars", F.when(F.col(n_dropped) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id. A document without words is no one's copy."""
    return near_dedup.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; those without an id stay."""
    return decontamination.decontaminate(docs, documents(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document that is left, as digests, and of the text decoded from them."""
    return sentencepiece_codec.digests(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_shared_lines),
    ("near_dedup", without_copies),
    ("decontamination", without_benchmark),
    ("sentencepiece", encoded),
]

#: Neither a fitted model nor a vocabulary can be stated in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
