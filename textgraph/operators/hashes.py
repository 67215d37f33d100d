"""Digests of ordered contents, by a running SHA-256 over sorted rows: a task holds one batch, however large a group is."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_sha256(rows: DataFrame, key: str, position: str, content: str) -> DataFrame:
    """(key, hash): the SHA-256 of each key's contents one after another, in the order of their positions, equal ones by content.

    Rows are dealt by key and sorted, both of which spill; a digest is carried from batch to batch and given out when its key ends.
    Null contents count as empty, and a null key as a key.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        state, held, none = None, None, object()
        last = none
        for batch in batches:
            keys, out = batch.column(0).to_pylist(), []
            for k, text in zip(keys, batch.column(1), strict=True):
                if k != last:
                    if state is not None:
                        out.append((held, state.hexdigest()))
                    last, held, state = k, k, hashlib.sha256()
                if text.is_valid:
                    state.update(memoryview(text.as_buffer()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], batch.schema.field(0).type), pa.array([h for _, h in out])], names=[key, "hash"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], batch.schema.field(0).type), pa.array([state.hexdigest()])], names=[key, "hash"])

    own = rows.select(F.col(key).alias("k"), F.col(position).alias("p"), F.col(content).cast("binary").alias("c"))
    return own.repartition("k").sortWithinPartitions("k", "p", "c").select("k", "c").mapInArrow(run, f"`{key}` {kind}, hash string")
