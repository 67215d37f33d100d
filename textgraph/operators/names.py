"""Names resolved by substring: which entities' names hold a word that a model or a text has given, without comparing each with each."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

GRAM = 3
#: Lengths of the runs that names are looked up by: a name goes by the longest that it holds.
RUNS = [1, 2, GRAM, 12]
MOST = 20
#: Names, or runs of theirs, that are sent to every task at once.
BLOCK = 200_000
#: Hashes of runs that are sent to every task at once, of 8 bytes each.
HASHES = 4_000_000
#: Characters whose runs are hashed at once.
PIECE = 60_000


def grams(text: Column, n: int = GRAM) -> Column:
    """The distinct runs of n characters of a text, none where it is shorter; linear in its length."""
    chars = F.split(text, "")
    runs = chars
    for k in range(1, n):
        runs = F.zip_with(runs, F.slice(chars, k + 1, F.greatest(F.size(chars), F.lit(1))), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.filter(runs, lambda r: r.isNotNull() & (r != "")))


def hashes(text: str, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n characters of a text, by doubling the lengths of runs."""
    part, length, out, have = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64), 1, None, 0
    mixed = lambda a, b: (x := (a ^ a >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + b) ^ x >> np.uint64(32)
    while True:
        if n & length:
            rest = part[have:]
            out, have = rest if out is None else mixed(out[: len(rest)], rest[: len(out)]), have + length
        if 2 * length > n:
            return out
        part, length = mixed(part[: max(0, len(part) - length)], part[length:]), 2 * length


def runs_among(names: list[str | None], n: int, asked: np.ndarray) -> list[tuple[int, str]]:
    """(position, run), once each, of the runs of n characters of names whose hashes are among asked, which are in order."""
    # most runs are told by a table of bits of their hashes
    mask = np.uint64(max(1 << 10, min(1 << 25, 1 << int(len(asked) * 8).bit_length())) - 1)
    known, found = np.zeros(int(mask) + 1, bool), set()
    known[asked & mask] = True

    def look(rows: list[int], cuts: list[str]) -> None:
        text, ends = "".join(cuts), np.cumsum([len(c) for c in cuts])
        own = hashes(text, n)
        at = np.flatnonzero(known[own & mask])
        own = own[at]
        at = at[asked[np.minimum(np.searchsorted(asked, own), len(asked) - 1)] == own]
        of = np.searchsorted(ends, at, "right")
        within = at + n <= ends[of]
        found.update((rows[r], text[i : i + n]) for r, i in zip(of[within].tolist(), at[within].tolist(), strict=True))

    rows, cuts, size = [], [], 0
    for k, name in enumerate(names):
        for start in range(0, len(name or "") - n + 1, PIECE):
            rows.append(k)
            cuts.append(name[start : start + PIECE + n - 1])
            size += len(cuts[-1])
            if size >= PIECE:
                look(rows, cuts)
                rows, cuts, size = [], [], 0
    if cuts:
        look(rows, cuts)
    return sorted(found)


def _holding(entities: DataFrame, n: int, block: DataFrame) -> DataFrame:
    """(id, appearance_count, gram): the runs of n characters of a block (gram) that the entities' names hold, once a name. Others of the same hash may be among them."""
    own = entities.select("id", "appearance_count", F.lower("canonical_name").alias("name"))
    if n <= GRAM:
        return own.select("id", "appearance_count", F.explode(grams(F.col("name"), n)).alias("gram")).join(block, "gram", "left_semi")

    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([hashes(g, n) for g in batch.column("gram").to_pylist()] or [np.zeros(0, np.uint64)]).view(np.int64))], names=["h"])

    # a block is bounded; long names have as many runs as characters, so those that aren't asked for stay in the task
    asked = np.unique(block.select("gram").mapInArrow(hashed, "h long").toArrow().column("h").to_numpy().view(np.uint64))
    asked = entities.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        for batch in batches:
            found = runs_among(batch.column("name").to_pylist(), n, asked.value)
            # of texts, which may be long, none is copied for what it holds
            few = batch.select(["id", "appearance_count"]).take(pa.array([k for k, _ in found], pa.int32()))
            yield pa.RecordBatch.from_arrays([*few.columns, pa.array([g for _, g in found], pa.string())], names=["id", "appearance_count", "gram"])

    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    return own.mapInArrow(run, f"id {kinds['id']}, appearance_count {kinds['appearance_count']}, gram string")


def _blocks(rows: DataFrame, key: str, most: int | None = None) -> list[DataFrame]:
    """rows in blocks by a hash of key, of about most (BLOCK) at most: each small enough to be sent to every task, however the planner takes its size."""
    n = -(-rows.count() // (most or BLOCK))
    return [F.broadcast(rows if n == 1 else rows.filter(F.pmod(F.xxhash64(key), F.lit(n)) == k)) for k in range(n)]


def _containing(names: DataFrame, entities: DataFrame, n: int) -> list[DataFrame]:
    """(low, id, appearance_count) of the entities whose name holds low, of n characters at least, by the run of n characters of low that fewest entities share.

    Runs of the entities' names are neither dealt nor written: what is asked for goes to them.
    """
    most = HASHES if n > GRAM else BLOCK
    whole = names.filter(F.length("low") == n).select(F.col("low").alias("gram"))
    hits = [_holding(entities, n, b).select(F.col("gram").alias("low"), "id", "appearance_count") for b in _blocks(whole, "gram", most)]
    longer = names.filter(F.length("low") > n)
    asked = written(longer.select("low", F.explode(grams(F.col("low"), n)).alias("gram")), "names-asked")
    wanted = written(asked.select("gram").distinct(), "names-grams")
    counts = [_holding(entities, n, b).groupBy("gram").agg(F.count("*").alias("n")) for b in _blocks(wanted, "gram", most)]
    if not counts:
        return hits
    # a run that no entity has rules the name out
    rarest = asked.join(written(reduce(DataFrame.union, counts), "names-counts").hint("merge"), "gram", "left").withColumn("n", F.coalesce("n", F.lit(0))).groupBy("low").agg(F.min(F.struct("n", "gram")).alias("r"))
    rarest = written(rarest.filter("r.n > 0").select("low", F.col("r.gram").alias("gram")), "names-rarest")
    index = entities.select("id", "appearance_count", F.lower("canonical_name").alias("name")).withColumn("gram", F.explode(grams(F.col("name"), n)))
    return hits + [b.join(index, "gram").filter(F.col("name").contains(F.col("low"))).select("low", "id", "appearance_count") for b in _blocks(rarest, "low")]


def resolved(names: DataFrame, entities: DataFrame, most: int = MOST) -> DataFrame:
    """(key, name, id): of names (key, name) the entities (id, canonical_name, appearance_count) whose name holds them in whatever case, by appearances, `most` of each.

    Each distinct name looks up its rarest run of as many characters as the longest of RUNS that it holds, and checks what it finds there. Empty names hold nothing.
    """
    low = names.filter(F.length("name") > 0).select("key", "name", F.lower("name").alias("low"))
    distinct = written(low.select("low").distinct(), "names-low")
    bounds = [*RUNS[1:], None]
    hits = [h for n, end in zip(RUNS, bounds, strict=True) for h in _containing(distinct.filter((F.length("low") >= n) & (F.length("low") < end if end else F.lit(True))), entities, n)]
    if not hits:
        return low.select("key", "name", F.lit(None).cast(entities.schema["id"].dataType).alias("id")).limit(0)
    k = F.row_number().over(Window.partitionBy("low").orderBy(F.desc("appearance_count"), "id"))
    few = reduce(DataFrame.union, hits).withColumn("k", k).filter(F.col("k") <= most).select("low", "id")
    few = F.broadcast(few) if distinct.count() * most <= BLOCK else few.hint("merge")
    return low.distinct().join(few, "low").select("key", "name", "id")
