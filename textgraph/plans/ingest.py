"""From a source to an index, and from its changes to the next version of it."""

from __future__ import annotations

import datetime
import os
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import location_uri, slugify
from ..operators import graph, history, writes
from ..schema import PIPELINE_VERSION, VERSIONED
from ..sources.adapters import Registry, SourceAdapter, default_registry
from ..sources.books import identified
from ..storage import Catalog, Folder, written
from ..streaming.reindex import dirty, git_changes, manifest, modified_since, since_strategy
from .artifact_passes import Setting, as_table, run_pass
from .passes import missing_prerequisites, parse_passes
from .provider import DryRun, Provider

DEFAULT = "chunk,structure"


def now() -> str:
    return datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="microseconds")


def register_or_find(catalog: Catalog, kind: str, name: str, source: str, at: str) -> str:
    """The id of the corpus of a source: the one that is there, or a new one, named after its name and free."""
    spark, work = catalog.spark, catalog.reading()
    corpora = work.table("corpora")
    known = corpora.filter(F.col("source") == source).orderBy("created_at", "id").select("id").first()
    if known:
        return known[0]
    wanted = spark.range(1).select(slugify(F.lit(name))).first()[0]
    if not wanted:
        raise ValueError(f"no id can be made of {name!r}")
    own = writes.free_id(corpora, wanted)
    row = spark.createDataFrame([(own, name, kind, source, "{}", "registered", at, PIPELINE_VERSION)], "id string, name string, kind string, source string, config string, status string, created_at string, pipeline_version int")
    work.commit(changed={"corpora": (as_table(row, "corpora"), None)})
    return own


def sourced_chunks(adapter: SourceAdapter, sources: DataFrame) -> DataFrame:
    """The chunks of sources, with the path of the source that each comes from."""
    # chunkers copy the corpus, so it carries the source through them
    tagged = sources.withColumn("corpus_id", F.concat("corpus_id", F.lit("\x01"), "path"))
    if adapter.kind == "code":
        return adapter.chunks(sources).withColumn("source", F.regexp_replace(F.regexp_replace("path", "#.*$", ""), "^src/", ""))
    out = adapter.chunks(tagged)
    return out.withColumn("source", F.substring_index("corpus_id", "\x01", -1)).withColumn("corpus_id", F.substring_index("corpus_id", "\x01", 1))


def chunk_rows(adapter: SourceAdapter, sources: DataFrame, at: str, version: str | None) -> DataFrame:
    """Rows of the table of chunks for sources (corpus_id, path, content)."""
    hashes = sources.select(F.col("path").alias("source"), F.sha2("content", 256).alias("source_hash"))
    rows = identified(sourced_chunks(adapter, sources)).join(hashes, "source")
    # parents are told by their location
    parent = F.when(F.col("parent_path").isNull() | F.col("parent_path").contains("://"), F.col("parent_path")).otherwise(location_uri(F.col("corpus_id"), F.col("parent_path")))
    rows = rows.withColumns({"parent_path": parent, "byte_length": F.octet_length("content").cast("long"), "created_at": F.lit(at), "semantic_processed": F.lit(False), "derived_at_version": F.lit(version).cast("string"), "derived_at_kind": F.lit("concrete"), "derived_at_sha": F.lit(version or "")})
    rows = rows.withColumns({"introduced_at_version": F.col("derived_at_version"), "last_modified_at_version": F.col("derived_at_version")})
    return as_table(rows, "chunks").dropDuplicates(["id"])


def structured(adapter: SourceAdapter, sources: DataFrame, version: str | None, known: DataFrame) -> dict[str, tuple[DataFrame, DataFrame | None]]:
    """The entities and edges of sources without a model, edges between what is there alone."""
    made = adapter.structure(sources)
    if made is None:
        return {}
    # what no path or name makes an id of is hashed
    stamp = {"derived_at_version": F.lit(version).cast("string"), "derived_at_kind": F.lit("concrete"), "derived_at_sha": F.lit(version or "")}
    entities = as_table(made[0].withColumns(stamp), "entities").dropDuplicates(["id"])
    corpus, nowhere = sources.select(F.max("corpus_id").alias("corpus")), F.lit("")
    edges = made[1] if "id" in made[1].columns else made[1].crossJoin(F.broadcast(corpus)).withColumn("corpus_id", F.col("corpus")).withColumn("location_uri", nowhere)  # one row
    if "id" not in edges.columns:
        edges = edges.withColumn("id", F.sha2(F.concat_ws("|", "corpus_id", "from_entity_id", "to_entity_id", "kind", "location_uri"), 256))
    ends = entities.select("id").union(known.select("id")).distinct()
    edges = graph.guarded(as_table(edges.withColumns(stamp), "edges").dropDuplicates(["id"]), ends)
    return {"entities": (entities, None), "edges": (edges, None)}


def ingest(spark: SparkSession, catalog: Catalog, kind: str, name: str, source: str, passes: str = DEFAULT, providers: dict[str, Provider] | None = None, registry: Registry | None = None, at: str | None = None) -> str:
    """Registers the source, if it isn't, and indexes it as it is now: the corpus's id. What it had before of other contents goes, as in reindex."""
    if "://" not in source and not Folder(spark, source).exists():
        raise ValueError(f"no source at {source}")
    asked = parse_passes(passes)
    adapter, at = (registry or default_registry()).require(kind), at or now()
    corpus = register_or_find(catalog, kind, name, source, at)
    present = {n for n in ("chunks", "entities") if not catalog.table(n).filter(F.col("corpus_id") == corpus).isEmpty()}
    if missing := missing_prerequisites(asked, present):
        raise ValueError(f"needs an earlier pass: {', '.join(missing)}")
    if {"chunk", "structure"} & set(asked):
        reindex(catalog, corpus, adapter.discover(spark, source, corpus), adapter, at)
    tiers = providers or {"haiku": DryRun()}
    every = {t: tiers.get(t) or next(iter(tiers.values())) for t in ("haiku", "sonnet", "opus")}
    for p in asked:
        if p in ("summarize", "aliases", "purpose", "contract", "theme"):
            run_pass(catalog, p, Setting(corpus, every, at), adapter.summary_levels)
    return corpus


def reindex(catalog: Catalog, corpus: str, sources: DataFrame, adapter: SourceAdapter, at: str | None = None, full: bool = False, partial: bool = False) -> dict[str, int]:
    """Brings a corpus to what its sources (corpus_id, path, content) are now: how many of them were added, modified and deleted.

    Chunks of changed sources that no source makes any more go, with all that hangs on them, into the histories; other
    chunks keep their ids and what hangs on them. With partial, sources that aren't given are taken as unchanged and a
    null content as a deletion; otherwise what isn't given is gone. All of it is one version.
    """
    at, work = at or now(), catalog.reading()
    old = work.table("sources").filter(F.col("corpus_id") == corpus)
    given = written(manifest(sources.filter("content is not null")), "manifest")
    before = old.select("path", "hash")
    before = before.join(sources.select("path").distinct(), "path", "left_semi") if partial else before
    changes = dirty(before, given)
    if full:
        changes = changes.unionByName(given.join(changes, "path", "left_anti").select("path", F.lit("modified").alias("change")))
    changes = written(changes, "changes")
    counts = {r["change"]: r["n"] for r in changes.groupBy("change").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {"added": 0, "modified": 0, "deleted": 0}
    version = _version(old, changes, given)
    fresh = written(sources.filter("content is not null").join(changes.filter("change <> 'deleted'").select("path"), "path", "left_semi").select("corpus_id", "path", "content"), "fresh-sources")
    rows = written(chunk_rows(adapter, fresh, at, version), "fresh-chunks")
    chunks = work.table("chunks").filter(F.col("corpus_id") == corpus)
    # what the changed sources had said: no other source's chunk has their hash, but one of the same content
    lost = old.join(changes.filter("change <> 'added'").select("path"), "path", "left_semi")
    still = old.join(lost.select("path"), "path", "left_anti").select("hash").union(given.select("hash"))
    hashes = lost.select("hash").join(still, "hash", "left_anti").select(F.col("hash").alias("source_hash")).distinct()
    orphans = written(chunks.join(hashes, "source_hash", "left_semi").select("id").join(rows.select("id"), "id", "left_anti"), "orphans")
    gone = history.cascade_all({n: work.table(n) for n in VERSIONED}, corpus, orphans)
    past = {n: history.stamped_as_superseded(df, version, at).withColumn("derived_at_sha", history.effective_sha(F.col("derived_at_sha"), F.col("derived_at_version"))) for n, df in gone.items()}
    appended = {f"{n}_history": history.not_archived(work.table(f"{n}_history"), df, [*VERSIONED[n], "derived_at_kind", "derived_at_sha"]) for n, df in past.items()}
    # a chunk that was there keeps what is known of it
    new = rows.join(chunks.select("id"), "id", "left_anti").select(*rows.columns)
    moved = rows.join(chunks.select("id", F.col("source_hash").alias("was")), "id").filter(~F.col("was").eqNullSafe(F.col("source_hash"))).select("id", "source_hash", "location_uri", "parent_path")
    kept = chunks.drop("source_hash", "location_uri", "parent_path").join(moved, "id").select(*rows.columns)
    made = structured(adapter, fresh, version, work.table("entities").filter(F.col("corpus_id") == corpus))
    changed = {n: (None, df.select(*VERSIONED[n]).distinct()) for n, df in gone.items()}
    for n, (df, _) in {"chunks": (new.unionByName(kept), None), **made}.items():
        # what comes back in the same version isn't gone
        changed[n] = (df, changed[n][1].join(df.select(*VERSIONED[n]), VERSIONED[n], "left_anti"))
    now_sources = given.join(changes.select("path"), "path", "left_semi").select(F.lit(corpus).alias("corpus_id"), "path", "hash")
    lost_sources = changes.filter("change = 'deleted'").select(F.lit(corpus).alias("corpus_id"), "path")
    own = writes.indexed(work.table("corpora").filter(F.col("id") == corpus), corpus, at, version)
    work.commit(changed=changed | {"sources": (now_sources, lost_sources), "corpora": (own, None)}, appended=appended)
    return {k: counts.get(k, 0) for k in ("added", "modified", "deleted")}


def changed_since(spark: SparkSession, catalog: Catalog, corpus: str, root: str, adapter: SourceAdapter, since: str | None = None) -> tuple[str, DataFrame, bool]:
    """(strategy, sources, partial) for reindex: by time of change for a date, by git for a ref where there is a repository, else all.

    Without since, that of the last index. Times tell nothing of deletions, git does: those come with a null content.
    """
    row = catalog.table("corpora").filter(F.col("id") == corpus).select("last_indexed_at").first()
    if row is None:
        raise ValueError(f"no corpus {corpus}")
    how, at = since_strategy(since, row[0], os.path.isdir(f"{root}/.git"))
    sources = adapter.discover(spark, root, corpus)
    if how == "git":
        changes = git_changes(spark, root, at).withColumn("path", adapter.source_of(F.col("path")))
        gone = changes.filter("change = 'deleted'").select(F.lit(corpus).alias("corpus_id"), "path", F.lit(None).cast("string").alias("content"))
        return how, sources.join(changes.filter("change <> 'deleted'").select("path").distinct(), "path", "left_semi").select("corpus_id", "path", "content").unionByName(gone), True
    if how == "mtime":
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        base = root.rstrip("/").rpartition("/")[2]
        rel = F.substring_index("path", f"/{base}/", -1)
        touched = modified_since(files, at).select(adapter.source_of(rel).alias("path"))
        return how, sources.join(touched.distinct(), "path", "left_semi").select("corpus_id", "path", "content"), True
    return how, sources, False


def _version(old: DataFrame, changes: DataFrame, given: DataFrame) -> str:
    """The version of the tree that the changes make."""
    from ..operators.artifacts import tree_version

    kept = old.select("path", "hash").join(changes.select("path"), "path", "left_anti")
    return tree_version(kept.unionByName(given.join(changes.select("path"), "path", "left_semi").select("path", "hash"))).first()[0]


def watched(catalog: Catalog, corpus: str, adapter: SourceAdapter, changes: DataFrame, checkpoint: str, once: bool = False):
    """Reindexes a corpus by a stream of settled changes (path, change, content), a version a batch. A batch that comes again changes nothing."""

    def handle(df: DataFrame, _: int) -> None:
        rows = df.select(F.lit(corpus).alias("corpus_id"), "path", "content")
        if not rows.isEmpty():
            reindex(catalog, corpus, written(rows, "watched"), adapter, partial=True)

    writer = changes.writeStream.option("checkpointLocation", checkpoint).outputMode("append").foreachBatch(handle)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
