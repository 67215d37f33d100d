"""Versions: snapshots on change, cascades, presence at a commit, tombstones, refinement, pruning. Every step is a pure function of tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import VERSIONED
from ..storage import written
from .ancestry import Labels, ancestors, descendants

def effective_sha(sha: Column, version: Column) -> Column:
    return F.coalesce(F.nullif(sha, F.lit("")), version, F.lit(""))

def superseded(head: DataFrame, incoming: DataFrame, keys: list[str], version: str = "derived_at_version") -> DataFrame:
    """Head rows that incoming rows of another version replace, with the version that did; unversioned rows leave none."""
    new = incoming.select(*(F.col(k).alias(f"new_{k}") for k in keys), F.col(version).alias("superseded_at_version"))
    on = reduce(Column.__and__, (F.col(k) == F.col(f"new_{k}") for k in keys))
    out = head.join(new, on).filter(F.col(version).isNotNull() & F.col("superseded_at_version").isNotNull() & (F.col(version) != F.col("superseded_at_version")))
    return out.select(*head.columns, "superseded_at_version")


def upserted(head: DataFrame, incoming: DataFrame, keys: list[str], version: str = "derived_at_version") -> DataFrame:
    """head with incoming rows in place of those of the same key; a missing version keeps the old one."""
    old = head.select(*(F.col(k).alias(f"old_{k}") for k in keys), F.col(version).alias("old_version"))
    on = reduce(Column.__and__, (F.col(k) == F.col(f"old_{k}") for k in keys))
    new = incoming.join(old, on, "left").withColumn(version, F.coalesce(version, "old_version")).select(*head.columns)
    return head.join(incoming.select(*keys), keys, "left_anti").select(*head.columns).unionByName(new)


def archived(history: DataFrame, rows: DataFrame, identity: list[str]) -> DataFrame:
    """history with rows that it doesn't have yet, by their identity."""
    new = rows.dropDuplicates(identity).join(history.select(*identity).distinct(), identity, "left_anti")
    return history.unionByName(new.select(*history.columns))


def not_archived(history: DataFrame, rows: DataFrame, identity: list[str]) -> DataFrame:
    """The rows, once each, that history doesn't have by their identity."""
    return rows.dropDuplicates(identity).join(history.select(*identity), identity, "left_anti").select(*rows.columns)


def differing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new that old lacks or holds with other values."""
    rest = [c for c in new.columns if c not in keys]
    had = old.select(*keys, F.struct(*rest).alias("old__row"))
    return new.join(had, keys, "left").filter(~F.col("old__row").eqNullSafe(F.struct(*rest)) | F.col("old__row").isNull()).select(*new.columns)


def stamped_as_superseded(rows: DataFrame, version: str, at: str | None = None) -> DataFrame:
    """Rows as history keeps them, superseded by a version."""
    return rows.withColumns({"superseded_at_version": F.lit(version), "superseded_at": F.lit(at or version), "superseded_at_sha": F.lit(version)})


def cascade_all(tables: dict[str, DataFrame], corpus: str, dirty: DataFrame) -> dict[str, DataFrame]:
    """What goes from each of the tables of a corpus when its chunks of dirty (id) change.

    Entities first or last seen in such a chunk go, with the edges, purposes, contracts, blocks and summaries that hang on
    them; then the chunks, with their summaries and embeddings.
    """
    t = {n: df.filter(F.col("corpus_id") == corpus) for n, df in tables.items()}
    chunks = t["chunks"].join(dirty.select("id").distinct(), "id", "left_semi").select(*t["chunks"].columns)
    entities, _ = cascade(t["entities"], t["edges"], chunks.select(F.col("location_uri").alias("uri")).distinct())
    ids = entities.select("id")
    of = lambda name, column, keys: t[name].join(keys.withColumnRenamed("id", column), column, "left_semi").select(*t[name].columns)
    edges = touching(t["edges"], from_entity_id=ids, to_entity_id=ids)
    out = {"chunks": chunks, "entities": entities, "edges": edges, "summaries": of("summaries", "target_id", ids.union(chunks.select("id")).distinct()), "embeddings": of("embeddings", "chunk_id", chunks.select("id"))}
    return out | {n: of(n, "entity_id", ids) for n in ("entity_purposes", "entity_contracts", "entity_blocks")}


#: Values that are told by bits in every task, and values that bits alone tell wrong, at most; beyond, rows are joined.
HELD, WRONG = 16_000_000, 500_000
#: One in so many rows that go at least, for a table to be written anew; else a delta names those that go.
REWRITTEN = 8


def _places(h: np.ndarray, n: int):
    """Four places among n, a power of two, for each hash."""
    h = h.view(np.uint64)
    step = h >> np.uint64(32) | np.uint64(1)
    return ((h + step * np.uint64(k)) & np.uint64(n - 1) for k in range(4))


class Held:
    """A set of values (one column), and which rows hold them: rows are told by bits of a hash in their tasks, and only the
    values that they tell, once each, are compared with the set, so no row is shuffled."""

    def __init__(self, values: DataFrame):
        self.values = written(values.select(F.col(values.columns[0]).alias("held__v")).filter("held__v is not null").distinct(), "held")
        self.count, self._told = self.values.count(), None
        if 0 < self.count <= HELD:
            n = max(1 << 13, 1 << (16 * self.count).bit_length())
            bits = np.zeros(n // 8, np.uint8)
            for at in _places(self.values.select(F.xxhash64("held__v").alias("h")).toArrow().column("h").to_numpy(), n):
                np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
            sent = self.values.sparkSession.sparkContext.broadcast(bits)

            def told(h: pd.Series) -> pd.Series:
                out = np.ones(len(h), bool)
                for at in _places(h.to_numpy(np.int64), n):
                    out &= (sent.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                return pd.Series(out)

            self._told = F.pandas_udf(told, "boolean")

    def marked(self, rows: DataFrame, mark: str, *columns: str) -> DataFrame:
        """rows with a column that tells whether one of some columns holds one of the values."""
        if not self.count:
            return rows.withColumn(mark, F.lit(False))
        if self._told is None:
            return self._joined(rows, mark, columns)
        told = [F.col(c).isNotNull() & self._told(F.xxhash64(c)) for c in columns]
        every = reduce(DataFrame.union, [rows.filter(t).select(F.col(c).alias("held__v")).distinct() for t, c in zip(told, columns, strict=True)])
        wrong = written(every.distinct().join(self.values, "held__v", "left_anti"), "told-wrong")
        n = wrong.count()
        if n > WRONG:
            return self._joined(rows, mark, columns)
        out, hit = rows, F.lit(False)
        for k, (t, c) in enumerate(zip(told, columns, strict=True)):
            if n:
                out = out.join(F.broadcast(wrong.select(F.col("held__v").alias(f"held__{k}"))), F.col(c) == F.col(f"held__{k}"), "left")
                t = t & F.col(f"held__{k}").isNull()
            hit = hit | t
        return out.select(*rows.columns, hit.alias(mark))

    def _joined(self, rows: DataFrame, mark: str, columns) -> DataFrame:
        out, hit = rows, F.lit(False)
        for k, c in enumerate(columns):
            out = out.join(self.values.select(F.col("held__v").alias(f"held__{k}")), F.col(c) == F.col(f"held__{k}"), "left")
            hit = hit | F.col(f"held__{k}").isNotNull()
        return out.select(*rows.columns, hit.alias(mark))


def once(rows: DataFrame, identity: list[str]) -> DataFrame:
    """The rows once each by their identity: only those whose identity may occur again, by a hash, are put together."""
    h = F.xxhash64(*identity)
    again = written(rows.groupBy(h.alias("again__h")).count().filter("count > 1").select("again__h"), "again")
    n = again.count()
    if not n:
        return rows
    if n > WRONG:
        return rows.dropDuplicates(identity)
    told = rows.join(F.broadcast(again), h == F.col("again__h"), "left")
    alone = told.filter("again__h is null").select(*rows.columns)
    return alone.unionByName(told.filter("again__h is not null").select(*rows.columns).dropDuplicates(identity))


def swept(catalog, corpus: str, dirty: DataFrame, version: str, at: str | None = None) -> int:
    """What cascade_all names, on a catalog: rows go from their tables into the histories, all in one version; a Conflict where one of the tables has changed meanwhile."""
    work = catalog.reading()
    replaced, changed, appended = {}, {}, {}

    def sweep(name: str, held: Held, *columns: str) -> DataFrame:
        own, rows = F.coalesce(F.col("corpus_id") == corpus, F.lit(False)), work.table(name)
        # outside of the corpus no row is touched, and none is looked up
        marked = held.marked(rows.filter(own), "swept__gone", *columns)
        gone = marked.filter("swept__gone").drop("swept__gone")
        every, n = rows.count(), gone.count()
        if n:
            past = stamped_as_superseded(gone, version, at).withColumn("derived_at_sha", effective_sha(F.col("derived_at_sha"), F.col("derived_at_version")))
            identity, before = [*VERSIONED[name], "derived_at_kind", "derived_at_sha"], work.table(f"{name}_history")
            past = once(past, identity)
            appended[f"{name}_history"] = past if before.isEmpty() else past.join(before.select(*identity), identity, "left_anti").select(*past.columns)
            if REWRITTEN * n >= every:
                replaced[name] = marked.filter("not swept__gone").drop("swept__gone").unionByName(rows.filter(~own))
            else:
                changed[name] = (None, gone.select(*VERSIONED[name]).distinct())
        return gone

    chunks = written(sweep("chunks", Held(dirty.select("id")), "id").select("id", "location_uri"), "swept-chunks")
    entities = sweep("entities", Held(chunks.select("location_uri")), "first_location_uri", "last_location_uri")
    ids, own = Held(entities.select("id")), Held(chunks.select("id"))
    sweep("edges", ids, "from_entity_id", "to_entity_id")
    sweep("summaries", Held(ids.values.union(own.values)), "target_id")
    sweep("embeddings", own, "chunk_id")
    for name in ("entity_purposes", "entity_contracts", "entity_blocks"):
        sweep(name, ids, "entity_id")
    return work.commit(replaced=replaced, changed=changed, appended=appended)


def dirty_chunks(chunks: DataFrame, dirty: DataFrame, path: Column) -> DataFrame:
    """Chunks whose source path is among the dirty (path)."""
    return chunks.withColumn("source__path", path).join(dirty.select(F.col("path").alias("source__path")).distinct(), "source__path", "left_semi").select(*chunks.columns)


def cascade(entities: DataFrame, edges: DataFrame, dirty_uris: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) that go when the chunks at dirty_uris (uri) change: entities first or last seen there, and edges of theirs or there."""
    gone = written(touching(entities, first_location_uri=dirty_uris, last_location_uri=dirty_uris).dropDuplicates(["id"]), "gone-entities")
    ids = gone.select("id")
    return gone, touching(edges, from_entity_id=ids, to_entity_id=ids, location_uri=dirty_uris)


def touching(rows: DataFrame, **keys: DataFrame) -> DataFrame:
    """The rows that hold, in one of the named columns, a value of that column's keys (one column each): each row once, in one pass over the rows."""
    out, hit = rows, F.lit(False)
    for k, (column, values) in enumerate(keys.items()):
        own = values.select(F.col(values.columns[0]).alias(f"touched__{k}")).filter(f"touched__{k} is not null").distinct()
        out = out.join(own, F.col(column) == F.col(f"touched__{k}"), "left")
        hit = hit | F.col(f"touched__{k}").isNotNull()
        # what is known to be touched needs no key any more
        out = out.withColumn(f"touched__{k}", F.when(F.col(f"touched__{k}").isNotNull(), True))
    return out.filter(hit).select(*rows.columns)


def present_at(head: DataFrame, history: DataFrame, tombstones: DataFrame, ancestry: DataFrame | Labels, target: str, keys: list[str]) -> DataFrame:
    """Rows valid at a commit: of a sha that the target descends from (or, for a range, that descends from it), the head
    row before the latest of history, without what a commit before the target buried. ancestry: labels, or pairs (ancestor, descendant)."""
    if isinstance(ancestry, Labels):
        own = head.sparkSession.range(1).select(F.lit(target).alias("sha"))
        up, down = (way(ancestry, target).union(own).distinct() for way in (ancestors, descendants))
    else:
        up = ancestry.filter(F.col("descendant") == target).select(F.col("ancestor").alias("sha")).union(ancestry.sparkSession.range(1).select(F.lit(target))).distinct()
        down = ancestry.filter(F.col("ancestor") == target).select(F.col("descendant").alias("sha")).union(ancestry.sparkSession.range(1).select(F.lit(target))).distinct()
    both = head.withColumn("rank", F.lit(None).cast("string")).unionByName(history.select(*head.columns, F.col("superseded_at").alias("rank")))
    both = both.withColumn("sha", effective_sha(F.col("derived_at_sha"), F.col("derived_at_version")))
    range_like = F.col("derived_at_kind") == "range_predating"
    valid = both.filter(~range_like).join(up, "sha", "left_semi").unionByName(both.filter(range_like).join(down, "sha", "left_semi"))
    order = Window.partitionBy(*keys).orderBy(F.col("rank").isNull().desc(), F.desc("rank"), F.desc("sha"))
    best = valid.withColumn("k", F.row_number().over(order)).filter("k = 1").select(*head.columns)
    return without_buried(best, tombstones, up, keys[0])


def without_buried(rows: DataFrame, tombstones: DataFrame, up: DataFrame, key: str) -> DataFrame:
    """rows without those whose tombstone has a sha among up (sha)."""
    dead = tombstones.join(up, tombstones["derived_at_sha"] == up["sha"], "left_semi").select(F.col("artifact_id").alias(key)).distinct()
    return rows.join(dead, key, "left_anti").select(*rows.columns)


def refined(kind: Column, sha: Column, new_kind: Column, new_sha: Column) -> Column:
    """What becomes of a provenance: a concrete one stays, a range gives way to anything else."""
    change = (kind == "range_predating") & ((new_kind == "concrete") | (new_sha != sha))
    return F.struct(F.when(change, new_kind).otherwise(kind).alias("kind"), F.when(change, new_sha).otherwise(sha).alias("sha"), change.alias("changed"))


def supersessions(histories: list[DataFrame]) -> DataFrame:
    """(sha, at): the last time at which each sha superseded a row of any table."""
    every = reduce(DataFrame.unionByName, [h.select(F.col("superseded_at_sha").alias("sha"), F.col("superseded_at").alias("at")) for h in histories])
    return every.filter("sha is not null and sha <> ''").groupBy("sha").agg(F.max("at").alias("at"))


def pruned_shas(histories: list[DataFrame], keep: int) -> DataFrame:
    """(sha) of all but the keep newest supersessions: a range filter by the keep-th newest, no global window."""
    shas = supersessions(histories)
    newest = shas.orderBy(F.desc("at"), F.desc("sha")).limit(keep)
    return shas.join(newest, "sha", "left_anti").select("sha")


def pruned(history: DataFrame, shas: DataFrame) -> DataFrame:
    return history.join(shas.withColumnRenamed("sha", "superseded_at_sha"), "superseded_at_sha", "left_anti").select(*history.columns)


def prune_counts(histories: dict[str, DataFrame], keep: int) -> DataFrame:
    """What a pruning would take of each table."""
    gone = pruned_shas(list(histories.values()), keep)
    each = [h.join(gone.withColumnRenamed("sha", "superseded_at_sha"), "superseded_at_sha", "left_semi").agg(F.lit(name).alias("table"), F.count("*").alias("pruned")) for name, h in histories.items()]
    return reduce(DataFrame.unionByName, each)


def superseding_version(rows: DataFrame, key: list[str], order: list[str], version: str) -> DataFrame:
    """Each row with the next newer version of the same artifact."""
    return rows.withColumn("superseded_at_version", F.lead(version).over(Window.partitionBy(*key).orderBy(*order)))


def diffed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between two manifests (path, hash): added, deleted, modified."""
    both = old.withColumnRenamed("hash", "old").join(new.withColumnRenamed("hash", "new"), "path", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return both.select("path", change.alias("change")).filter("change is not null")


def tombstones_for(before: DataFrame, after: DataFrame, kind: str, sha: str) -> DataFrame:
    """Burials of what a walk's step took away: ids before, not after."""
    gone = before.select("corpus_id", "id").join(after.select("id"), "id", "left_anti")
    return gone.select("corpus_id", F.lit(kind).alias("artifact_kind"), F.col("id").alias("artifact_id"), F.lit("concrete").alias("derived_at_kind"), F.lit(sha).alias("derived_at_sha"))


def touched(chunks: DataFrame, version: str, message: str | None, author: str | None) -> DataFrame:
    """Chunks stamped with a change: introduced once, last modified now; unknown message and author keep the old."""
    def new(value, old):
        return F.coalesce(F.lit(value).cast("string"), F.col(old)).alias(old)

    return chunks.withColumn("introduced_at_version", F.coalesce("introduced_at_version", F.lit(version))).withColumn("last_modified_at_version", F.lit(version)).withColumn("last_modified_commit_message", new(message, "last_modified_commit_message")).withColumn("last_modified_author", new(author, "last_modified_author"))


def at_version(head: DataFrame, past: DataFrame, version: str) -> DataFrame:
    """The rows of head and history whose version is exactly this one; history may lack columns."""
    own = F.col("derived_at_version") == version
    return head.filter(own).unionByName(past.filter(own).select(*[c for c in past.columns if c in head.columns]), allowMissingColumns=True)


def below_paths(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """Chunks whose path starts with one of the paths (path) that are gone, joined by prefixes of the lengths that occur."""
    known = gone.select(F.col("path").alias("prefix")).filter("prefix <> ''").distinct()
    lengths = known.select(F.length("prefix").alias("n")).distinct()
    cut = chunks.select("path").distinct().join(F.broadcast(lengths), F.length("path") >= F.col("n"))  # no more rows than a path has characters
    hit = cut.select("path", F.expr("substr(path, 1, n)").alias("prefix")).join(known, "prefix", "left_semi").select("path").distinct()
    return chunks.join(hit, "path", "left_semi")
