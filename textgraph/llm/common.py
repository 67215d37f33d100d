"""Helpers that the training-data operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import bucketed as bucketed
from ..storage import written as written

#: The bytes that end a word or are stripped from a line: space and \t \n \v \f \r.
SPACE = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def one_thread() -> None:
    """Keeps the matrix products of this Python worker to one thread, as its task has one core."""
    import ctypes
    from pathlib import Path

    for path in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Maximal runs of non-space characters; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPLIT), lambda w: w != "")


def free_name(df: DataFrame, name: str) -> str:
    """name, or a variant that is no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slots(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def partitions(df: DataFrame, rows: int, least: int = 2) -> int:
    """Partitions for a shuffle of df: so many that each has about `rows` of its rows, and `least` a slot."""
    return max(least * slots(df.sparkSession), -(-df.count() // rows))


def chosen(docs: DataFrame, ids: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """The rows of docs whose doc_id is among `most` of ids, taken in the order of a seeded hash, with the columns of ids.

    At most `most` ids are broadcast, so the size of that side is fixed by the parameter.
    """
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    few = ids.filter(F.col("doc_id").isNotNull()).orderBy(order, "doc_id").limit(most)
    return docs.join(F.broadcast(few), "doc_id")


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo by; of a null id, that of the empty string."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(by))
