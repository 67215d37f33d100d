"""Finds benchmark items inside documents by size-partitioned MinHash containment search.

Items are partitioned by the size q of their set of five-word shingles, a partition for each power of two. An item's
MinHash sketch is the k smallest hashes of its shingles (bottom-k), those that few items hold first, so that a line that
many items share brings no pairs together. A document that holds 80 % of the item lacks floor(q / 5) shingles at most, so
k = floor(q / 5) + 1 sketch entries, of any order, can't all be missing: the search finds every such document. A
document too short for a partition isn't looked for there, and document shingles that hit no sketch go no further.
Candidates are verified on the exact shingle strings of these pairs alone.

A text of fewer than five words is one shingle as a whole; a text without words has none and matches nothing. A null
text counts as empty. Repeated item ids with different texts are one item with the union of the sets. Documents with the
same doc_id and text are reported once; with different texts, their sets are united. A row without doc_id can't be named
in a pair and isn't reported, and `decontaminate` keeps it. Other columns aren't read, and `decontaminate` keeps them; empty tables give no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, written, words

WORDS = 5
#: Containment is compared as 100 * shared >= 80 * size.
PERCENT = 80
#: Sides of a join are broadcast up to this size; beyond, the join shuffles.
BROADCAST_BYTES = 32_000_000


def shingle_starts(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1), F.greatest(n - (WORDS - 1), F.lit(1))))


def shingles(text: Column) -> Column:
    """Distinct five-word shingles joined by a space (words hold none)."""
    w = words(ascii_lower(text))
    made = F.transform(shingle_starts(F.size(w)), lambda i: F.array_join(F.slice(w, i, WORDS), " "))
    return F.array_distinct(F.coalesce(made, F.array().cast("array<string>")))


def _exploded(rows: DataFrame) -> DataFrame:
    """(doc_id, most, shingle) of every place of every text; most bounds the size of the row's set."""
    tokens = rows.select("doc_id", words(ascii_lower(F.col("text"))).alias("w"))
    starts = tokens.select("doc_id", "w", F.greatest(F.size("w") - (WORDS - 1), F.lit(1)).alias("most"), F.explode(shingle_starts(F.size("w"))).alias("i"))
    get = [F.get("w", F.col("i") + (k - 1)) for k in range(WORDS)]
    return starts.select("doc_id", "most", F.concat_ws(" ", *get).alias("shingle"))


def _small(df: DataFrame, width: Column | int) -> DataFrame:
    """df, broadcast where its rows of about `width` bytes take BROADCAST_BYTES at most."""
    size = df.agg(F.sum(width if isinstance(width, Column) else F.lit(width))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def sketches(sets: DataFrame, percent: int) -> DataFrame:
    """(item_id, hash, n_item, part, least): the sketch of each item, its partition and the size that a document needs there."""
    # 0, 1, 2, ... for shingles of 1, 2 to 3, 4 to 7, ... items: the rare ones come first in every item
    spread = sets.groupBy("hash").agg(F.floor(F.log2(F.count("*"))).alias("spread"))
    each = Window.partitionBy("item_id")
    sized = sets.join(spread, "hash").withColumn("n_item", F.count("*").over(each)).withColumn("rank", F.row_number().over(each.orderBy("spread", "hash", "shingle")))
    part = F.floor(F.log2("n_item"))
    picked = sized.filter(F.col("rank") <= F.floor(F.col("n_item") * (100 - percent) / 100) + 1)
    return picked.select("item_id", "hash", "n_item", part.alias("part"), F.ceil(F.pow(F.lit(2), part) * percent / 100).cast("long").alias("least"))


def contained(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (doc_id, item_id, n_shared, n_item) with 100 * n_shared >= percent * n_item."""
    entry = F.explode(shingles(F.col("text")))
    sets = written(items.select("item_id", entry.alias("shingle")).distinct().withColumn("hash", F.xxhash64("shingle")), "bench-sets")
    size = sets.groupBy("item_id").agg(F.count("*").alias("n_item"))
    sketch = written(sketches(sets, percent), "bench-sketch")
    wanted = written(sketch.groupBy("hash").agg(F.min("least").alias("least")), "bench-hashes")
    hits = _exploded(docs).withColumn("hash", F.xxhash64("shingle")).join(_small(wanted, 32), "hash").filter("most >= least")
    # one row for each document and sketch hash before any item is attached, however often a passage repeats; rows of one id are united
    hits = hits.groupBy("doc_id", "hash").agg(F.sum("most").alias("most"))
    met = hits.join(_small(sketch, 64), "hash").filter(F.col("most") >= F.col("least"))
    candidates = written(met.select("doc_id", "item_id").distinct(), "bench-candidates")
    found = written(candidates.select("doc_id").distinct(), "bench-found")
    some = docs.select("doc_id", "text").join(_small(found, 24), "doc_id", "left_semi")
    # the shingles of a candidate document are set against those of its own candidate items, not of all that share one
    pairs = written(candidates.join(_small(sets, F.octet_length("shingle") + 64), "item_id"), "bench-pairs")
    asked = _small(pairs.groupBy("doc_id", "hash").agg(F.lit(1).alias("asked")).drop("asked"), 32)
    held = _exploded(some).select("doc_id", "shingle", F.xxhash64("shingle").alias("hash")).join(asked, ["doc_id", "hash"], "left_semi").distinct()
    shared = pairs.join(held, ["doc_id", "hash", "shingle"]).groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    return shared.join(_small(size, 32), "item_id").filter(F.col("n_shared") * 100 >= F.col("n_item") * percent).select("doc_id", "item_id", "n_shared", "n_item")


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without those that hold an item."""
    leaks = contained(docs, items, percent).select("doc_id").distinct()
    return docs.join(_small(written(leaks, "bench-leaks"), 24), "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    return contained(docs.select("doc_id", "text"), items.select("item_id", "text"))


def _sql_sets(table: str, key: str) -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""SELECT DISTINCT {key}, array_to_string(w[i:i+{WORDS - 1}], ' ') AS shingle
  FROM (SELECT {key}, w, unnest(generate_series(1, greatest(len(w) - {WORDS - 1}, 1))) AS i
        FROM (SELECT {key}, regexp_extract_all({low}, '[^\\x20\\x09-\\x0D]+') AS w FROM {table}) WHERE len(w) > 0)"""


SQL = f"""
WITH b AS ({_sql_sets('benchmark', 'item_id')}), d AS ({_sql_sets('documents', 'doc_id')}),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id),
s AS (SELECT d.doc_id, b.item_id, count(*) AS n_shared FROM d JOIN b USING (shingle) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item FROM s JOIN n USING (item_id) WHERE n_shared * 100 >= n_item * {PERCENT}
"""
