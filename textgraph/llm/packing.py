"""Packing by power-of-two decomposition.

A document's ids are cut into full pieces of `most` ids and then the binary digits of what is left, the largest first:
5000 ids with 2048 at most are pieces of 2048, 2048, 512, 256, 128 and 8. Each piece is a sequence by itself, so no
sequence crosses documents and none is padded. Sequences of equal length form a bucket; they are numbered without gaps,
bucket by bucket from the longest, so that a reader takes batches of one length as ranges of sequence_id.

No piece is shuffled: tasks count their pieces by length, and the sums of those counts give each task its first number.

Edge cases: a null or empty text has only the end id; rows that share a doc_id, and those without one, are each a document
(doc_no tells them apart); texts of any length are encoded whole; an empty table gives no pieces; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written
from .token_store import default_tokenizer, encoding, token_ids

MOST = 2048
END = 1
#: Ids that a task gathers before it hands on their pieces (16 MB), beyond those of its last document.
HELD = 1 << 22
COLUMNS = "doc_id long, doc_no long, start long, length long, doc_tokens long, ids binary, task long, place long"


def piece_lengths(n: int, most: int) -> np.ndarray:
    """Full pieces, then a piece for each binary digit of the rest, the largest first."""
    rest = n % most
    digits = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    return np.concatenate([np.full(n // most, most, np.int64), np.array(digits, np.int64)])


def pieces(docs: DataFrame, path: str | None = None, most: int = MOST, end: int = END, added: bool = True) -> DataFrame:
    """Each piece with its ids (little-endian, 32 bits), the task that made it and its place among the task's pieces of that length."""
    if most < 1 or most & (most - 1):
        raise ValueError("the longest sequence must be a power of two")
    with open(path or default_tokenizer(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        from pyspark import TaskContext

        own, task = encoding(spec.value), TaskContext.get().partitionId()
        made = np.zeros(most.bit_length(), np.int64)
        n_docs, held, doc_ids, ids = 0, 0, [], []

        def rows():
            nonlocal n_docs, held, doc_ids, ids
            sizes = np.array([len(x) for x in ids], np.int64)
            cut = [piece_lengths(int(n), most) for n in sizes]
            count = np.array([len(c) for c in cut])
            of, length = np.repeat(np.arange(len(ids)), count), np.concatenate(cut)
            ends = np.cumsum(length)
            start = ends - length - (np.cumsum(sizes) - sizes)[of]
            # pieces of one document follow each other, so their bytes are one buffer
            offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
            data = pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(ids).astype("<u4"))])
            kind = np.log2(length).astype(np.int64)
            order = np.argsort(kind, kind="stable")
            each = np.bincount(kind, minlength=len(made))
            place = np.empty(len(length), np.int64)
            place[order] = np.arange(len(length)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(made, each)
            made[:] += each
            doc_no = (task << 33) + n_docs + of
            out = [pa.array(doc_ids, pa.int64()).take(pa.array(of)), pa.array(doc_no, pa.int64()), pa.array(start), pa.array(length), pa.array(sizes[of]), data, pa.array(np.full(len(length), task)), pa.array(place)]
            n_docs, held, doc_ids, ids = n_docs + len(ids), 0, [], []
            return pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in COLUMNS.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(np.append(token_ids(own, text or "", added), np.uint32(end)))
                doc_ids.append(doc_id)
                held += len(ids[-1])
                if held >= HELD:
                    yield rows()
        if ids:
            yield rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, COLUMNS)


def pack(docs: DataFrame, path: str | None = None, most: int = MOST, end: int = END, added: bool = True) -> DataFrame:
    """doc_id, doc_no, start, length, doc_tokens, ids, sequence_id and offset of each piece."""
    rows = written(pieces(docs, path, most, end, added), "pieces")
    counts = rows.groupBy("length", "task").agg(F.count("*").alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_length = counts.groupBy("length").agg(F.sum("n").alias("n"))
    of_length = of_length.select("length", earlier(Window.orderBy(F.desc("length"))).alias("of_length"))  # a row for each power of two
    of_task = counts.select("length", "task", earlier(Window.partitionBy("length").orderBy("task")).alias("of_task"))
    # a row for each task and length: Spark broadcasts the table where its size allows, and shuffles otherwise
    first = written(of_task.join(F.broadcast(of_length), "length").select("length", "task", (F.col("of_length") + F.col("of_task")).alias("first")), "piece-starts")
    out = rows.join(first, ["length", "task"]).withColumn("sequence_id", F.col("first") + F.col("place"))
    return out.select("doc_id", "doc_no", "start", "length", "doc_tokens", "ids", "sequence_id", F.lit(0).cast("long").alias("offset"))


def save(packed: DataFrame, path: str) -> None:
    """The sequences as files, one folder for each length."""
    packed.select("length", "sequence_id", "doc_id", "start", "ids").write.partitionBy("length").parquet(path)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "doc_no")
