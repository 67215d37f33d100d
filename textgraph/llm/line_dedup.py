"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of (key, n_docs, holder, fresh) in sorted buckets. Documents come in batches of falling ids. A batch is
merged against the runs by an anti-join, which tells the keys that no earlier batch held: these get their holder, the
largest document with the key, from this batch. The batch then adds its own run at level 0. A level that has `fanout`
runs is compacted into one run of the next level, so there are only O(fanout * log(batches)) runs to merge at any time.

Edge cases: a null or empty text is one empty line and never dropped; rows that share a doc_id count as one document;
a null doc_id counts as one document, below every other; extra columns are kept, and a new column whose name is taken gets
a trailing underscore; an empty table gives an empty result. The cost of a text is linear in its lines, however many of
them go. Nothing stays in the catalog, and runs that were merged into others are deleted.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..storage import Folder, bucketed, reopened, shared_dir, sorted_scans, written
from .common import SPACE, ascii_lower, free_name, partitions, slots

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 3
#: (document, line) pairs for each bucket of a run.
BUCKET_ROWS = 1 << 20


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def key_hash(key: Column) -> Column:
    """128 bits in hexadecimal, so that equal hashes mean equal keys at any size of corpus."""
    return F.md5(key.cast("binary"))


class LineRuns:
    """The levelled store in a folder; what `at` already holds is opened, in any later session.

    A run is a table in buckets by key, sorted in each: merges of runs and batches neither shuffle nor sort the runs.
    """

    def __init__(self, spark: SparkSession, at: str | None = None, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout, self.levels, self.version, self._merged, self._before = spark, fanout, [[]], 0, [], []
        self.folder = Folder(spark, at or f"{shared_dir(spark)}/line-runs-{uuid.uuid4().hex}")
        self.buckets, self.kind = buckets or slots(spark), None
        versions = [n for n in self.folder.names() if n.startswith("levels-")]
        if versions:
            known = json.loads(self.folder.get(versions[-1]))
            self.version, self.buckets, self.kind, self.fanout = int(versions[-1].split("-")[1]), known["buckets"], known["kind"], known["fanout"]
            self._before = known.get("merged", [])
            self.levels = [[(path, reopened(spark, path, self._columns(), "key", self.buckets)) for path in level] for level in known["levels"]]

    def _columns(self) -> str:
        return f"key binary, n_docs bigint, holder {self.kind}, fresh boolean"

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for _, run in level]

    def add(self, pairs: DataFrame) -> DataFrame:
        """pairs (doc, key), of documents below all that earlier batches had: adds their run and returns it, readable until the next batch.

        A merge anti-join against the runs tells which keys are new to the store (fresh). The largest document that
        holds a key is the largest of the batch where it was fresh, and needn't be looked at again.
        """
        self.kind = self.kind or pairs.schema["doc"].dataType.simpleString()
        own = pairs.distinct().groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc").alias("last_doc"))
        batch, own = self._table(own, "line-batch")
        with sorted_scans(self.spark):
            fresh = own.select("key")
            for run in self.runs():
                fresh = fresh.join(run.hint("merge").select("key"), "key", "left_anti")
            marked = own.join(fresh.hint("merge").withColumn("fresh", F.lit(True)), "key", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
            made = self._table(marked.select("key", "n_docs", F.when(F.col("fresh"), F.col("last_doc")).alias("holder"), "fresh"), "line-run")
        self._push(0, made)
        self._save()
        # what the version before had merged has no reader by now
        for path in [batch, *self._before]:
            self.folder.remove(path.rsplit("/", 1)[-1])
        self._before, self._merged = self._merged, []
        return made[1]

    def _table(self, rows: DataFrame, name: str) -> tuple[str, DataFrame]:
        made = f"{self.folder.at}/{name}-{uuid.uuid4().hex}"
        return made, bucketed(rows.repartition(self.buckets, "key"), name, "key", self.buckets, order=True, path=made)

    def _push(self, level: int, run: tuple[str, DataFrame]) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self._table(self._merge([path for path, _ in self.levels[level]]), "line-run")
            self._merged += [path for path, _ in self.levels[level]]
            self.levels[level] = []
            self._push(level + 1, merged)

    def _save(self) -> None:
        known = {"buckets": self.buckets, "kind": self.kind, "fanout": self.fanout, "merged": self._merged, "levels": [[path for path, _ in level] for level in self.levels]}
        self.version += 1
        if not self.folder.put(f"levels-{self.version:09}", json.dumps(known)):
            raise RuntimeError(f"another writer changed {self.folder.at}")

    def _merge(self, paths: list[str]) -> DataFrame:
        # the files without their buckets: Spark 4.1 takes a union of bucketed scans for partitioned by the key, but then doesn't scan by buckets
        rows = self.spark.read.schema(self._columns()).parquet(*paths)
        return rows.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("holder").alias("holder"), F.max("fresh").alias("fresh"))

    def totals(self) -> DataFrame:
        return self._merge([path for level in self.levels for path, _ in level])


def line_pairs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, key) for each distinct long line of each row."""
    keys = F.transform(lines(F.col("text")), line_key)
    long = F.filter(keys, lambda k: F.length(k) >= min_chars)
    rows = docs.select(F.col("doc_id").alias("doc"), F.array_distinct(F.transform(long, key_hash)).alias("keys"))
    return rows.select("doc", F.explode("keys").alias("key")).withColumn("key", F.unhex("key"))


def without_lines(text: str, drop: list, min_chars: int) -> tuple[str, int]:
    """text without the lines whose keys' hashes are in drop, and how many these were."""
    gone, kept, n = set(drop), [], 0
    for line in text.split("\n"):
        key = line.strip(SPACE)
        # bytes.lower changes A-Z alone
        if len(key) >= min_chars and hashlib.md5(key.encode().lower()).digest() in gone:
            n += 1
        else:
            kept.append(line)
    return "\n".join(kept), n


def id_batches(docs: DataFrame, batches: int):
    """Conditions on an id that deal documents into batches by falling id, null last; one batch where ids aren't numbers."""
    bounds = []
    if isinstance(docs.schema["doc_id"].dataType, NumericType):
        found = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else None
        bounds = sorted(set(found or []), reverse=True)
    tops = [None, *bounds]
    for top, low in zip(tops, [*bounds, None]):

        def batch(doc: Column, top=top, low=low) -> Column:
            below = F.lit(True) if top is None else F.coalesce(doc < top, F.lit(True))
            return below if low is None else below & F.coalesce(doc >= low, F.lit(False))

        yield batch


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """docs with text without the lines that min_docs documents or more share, and n_lines, n_dropped.

    A shared line stays in the largest doc_id that holds it. Every other line stays as it is.
    """
    spark = docs.sparkSession
    drop, held, whose, n_lines, n_dropped = (free_name(docs, c) for c in ("drop_keys", "held_lines", "drop_doc", "n_lines", "n_dropped"))
    pairs = written(line_pairs(docs, min_chars), "line-pairs")
    store = LineRuns(spark, buckets=partitions(pairs, BUCKET_ROWS, 1))
    for batch in id_batches(docs, batches):
        store.add(pairs.filter(batch(F.col("doc"))))
    shared = written(store.totals().filter(F.col("n_docs") >= min_docs).select("key", F.col("holder").alias("last_doc")), "line-shared")
    # a key may be held by a third of all documents: a plain join of two tables, whose hot keys adaptive execution splits
    lost = pairs.join(shared, "key").filter(F.coalesce(F.col("doc") < F.col("last_doc"), F.col("last_doc").isNotNull()))
    lost = lost.groupBy(F.col("doc").alias(whose)).agg(F.collect_set("key").alias(drop))
    joined = docs.join(lost, docs["doc_id"].eqNullSafe(lost[whose]), "left").drop(whose)

    @F.arrow_udf("text string, n long")
    def shortened(texts: pa.Array, drops: pa.Array) -> pa.Array:
        rows = [without_lines(t, d, min_chars) if d else (None, 0) for t, d in zip(texts.to_pylist(), drops.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([t for t, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["text", "n"])

    # texts that lose nothing don't go to Python
    affected = F.col(drop).isNotNull() & F.col("text").isNotNull()
    out = joined.withColumn(held, shortened(F.when(affected, F.col("text")), F.when(affected, F.col(drop))))
    out = out.withColumn(n_lines, F.size(lines(F.col("text"))).cast("long")).withColumn(n_dropped, F.coalesce(F.col(f"{held}.n"), F.lit(0).cast("long")))
    return out.withColumn("text", F.when(F.col(n_dropped) > 0, F.col(f"{held}.text")).otherwise(F.col("text"))).drop(held, drop)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = f"""
WITH l AS (
  SELECT d.doc_id, u.i, u.line, translate(trim(u.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents) d,
       LATERAL (SELECT unnest(a) AS line, generate_subscripts(a, 1) AS i) u),
s AS (SELECT k, max(doc_id) AS last_doc FROM l WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
j AS (SELECT l.doc_id, l.i, l.line, s.k IS NOT NULL AND l.doc_id < s.last_doc AS gone FROM l LEFT JOIN s ON l.k = s.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
