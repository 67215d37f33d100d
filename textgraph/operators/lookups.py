"""Point and list lookups, counts, and the merge of repeated entities. Every limit has a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunks_of(chunks: DataFrame, corpus: str) -> DataFrame:
    return chunks.filter(F.col("corpus_id") == corpus).orderBy("location_uri")


def unprocessed(chunks: DataFrame) -> DataFrame:
    return chunks.filter(~F.coalesce("semantic_processed", F.lit(False))).orderBy("location_uri")


def chunk_sources(chunks: DataFrame) -> DataFrame:
    """(id, source_hash), '' where none is known."""
    return chunks.select("id", F.coalesce("source_hash", F.lit("")).alias("source_hash"))


def resumed(chunks: DataFrame, position: str, last: str) -> DataFrame:
    """The chunks from the one with the id `last` on, in the order of position; none where it isn't there."""
    at = chunks.filter(F.col("id") == last).agg(F.min(position).alias("from"))
    return chunks.crossJoin(F.broadcast(at)).filter(F.col(position) >= F.col("from")).drop("from")  # one row


def edges_of_corpus(edges: DataFrame, corpus: str) -> DataFrame:
    return edges.filter(F.col("corpus_id") == corpus).orderBy("id")


def of_model(artifacts: DataFrame, model: str, **key: str) -> DataFrame:
    """The artifact of one model for one key, not the best of all."""
    found = artifacts.filter(F.col("model") == model)
    for column, value in key.items():
        found = found.filter(F.col(column) == value)
    return found


def listed(artifacts: DataFrame, kind: str) -> DataFrame:
    """Summaries, purposes, contracts, blocks or themes in their own order."""
    order = {"summaries": ["generated_at", "id"], "entity_purposes": ["entity_id", "model"], "entity_contracts": ["entity_id", "model"], "entity_blocks": ["position", "id"], "themes": [F.desc("confidence"), "id"]}
    return artifacts.orderBy(*order[kind])


def corrections_of(corrections: DataFrame, corpus: str | None = None, collection: str | None = None) -> DataFrame:
    """The corrections of a corpus, of a collection, or all, as they were applied."""
    own = corrections.filter(F.col("corpus_id") == corpus) if corpus else corrections
    own = own.filter(F.col("collection_id") == collection) if collection else own
    return own.orderBy("applied_at", "id")


def tombstones(dead: DataFrame) -> DataFrame:
    return dead.orderBy(F.desc("created_at"), F.desc("artifact_id"))


def with_kind(hits: DataFrame, kinds: DataFrame) -> DataFrame:
    """Hits (uri, ...) with the kind of their chunk, `chunk` where none is known."""
    return hits.join(kinds.select("uri", "kind"), "uri", "left").withColumn("kind", F.coalesce("kind", F.lit("chunk")))


def classified_target(target: Column, corpus: Column, scheme: str) -> Column:
    """What a correction is about: a chunk by its location, the corpus by its id, else an entity."""
    return F.when(target.startswith(scheme), "chunk").when(target == corpus, "corpus").otherwise("entity")


def children(chunks: DataFrame, parent: str) -> DataFrame:
    return chunks.filter(F.col("parent_path") == parent).orderBy("location_uri")


def entities_named(entities: DataFrame, text: str, most: int = 20) -> DataFrame:
    """Entities whose name or aliases contain text, whatever its case."""
    q = text.lower()
    hit = F.lower("canonical_name").contains(q) | F.lower(F.to_json("aliases")).contains(q)
    return entities.filter(hit).orderBy(F.desc("appearance_count"), "id").limit(most)


def top_entities(entities: DataFrame, most: int = 10) -> DataFrame:
    return entities.orderBy(F.desc("appearance_count"), "id").limit(most)


def entities_at(entities: DataFrame, uri: str) -> DataFrame:
    return entities.filter((F.col("first_location_uri") == uri) | (F.col("last_location_uri") == uri))


def of_abstract_kind(entities: DataFrame, kind: str, corpora: list[str], most: int = 50) -> DataFrame:
    return entities.filter((F.col("abstract_kind") == kind) & F.col("corpus_id").isin(corpora)).orderBy(F.desc("appearance_count"), "id").limit(most)


def edges_of(edges: DataFrame, entity: str, direction: str = "both", kind: str | None = None, most: int = 50) -> DataFrame:
    out, into = F.col("from_entity_id") == entity, F.col("to_entity_id") == entity
    if direction not in ("both", "outbound", "inbound"):
        raise ValueError(f"no such direction: {direction}")
    found = edges.filter({"both": out | into, "outbound": out, "inbound": into}[direction])
    return (found.filter(F.col("kind") == kind) if kind else found).orderBy("id").limit(most)


def with_abstract_kind(entities: DataFrame, corpora: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """entities with abstract_kind by (kind, kind of corpus); '' where the taxonomy has none. Both other tables are small by nature, and Spark decides on their size."""
    kinds = corpora.select(F.col("id").alias("corpus_id"), F.col("kind").alias("corpus_kind"))
    known = taxonomy.select(F.col("concrete_kind").alias("kind"), "corpus_kind", "abstract_kind")
    out = entities.drop("abstract_kind").join(kinds, "corpus_id", "left").join(known, ["kind", "corpus_kind"], "left")
    return out.withColumn("abstract_kind", F.coalesce("abstract_kind", F.lit(""))).drop("corpus_kind")


def counts(corpora: DataFrame, **tables: DataFrame) -> DataFrame:
    """One row a corpus with the number of its rows in each table: one aggregate a table, not one query a corpus."""
    out = corpora
    for name, table in tables.items():
        n = table.groupBy(F.col("corpus_id").alias("id")).agg(F.count("*").alias(f"{name}_count"))
        out = out.join(n, "id", "left").withColumn(f"{name}_count", F.coalesce(f"{name}_count", F.lit(0)))
    return out


def merge_repeated(entities: DataFrame, seq: str) -> DataFrame:
    """One row an id: counts add up, the highest confidence, the first name and first location, the latest of what is known else."""
    order = F.struct(F.col(seq))

    def latest(c):
        return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c)

    first = [F.min_by(c, order).alias(c) for c in ("corpus_id", "canonical_name", "kind", "first_location_uri")]
    return entities.groupBy("id").agg(*first, latest("description"), latest("last_location_uri"), F.sum("appearance_count").alias("appearance_count"), F.max("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"))


def first_content(chunks: DataFrame, seq: str, scope: str = "global") -> DataFrame:
    """The first chunk of each content hash, over all corpora or within each."""
    keys = ["id"] if scope == "global" else ["corpus_id", "id"]
    best = chunks.groupBy(*keys).agg(F.min_by(F.struct(*chunks.columns), F.struct(seq, "corpus_id", "location_uri")).alias("r"))
    return best.select("r.*")


def latest_runs(runs: DataFrame, most: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("id")).limit(most)


def stale_as_failed(runs: DataFrame) -> DataFrame:
    return runs.withColumn("status", F.when(F.col("status") == "running", "failed").otherwise(F.col("status")))


def run_totals(runs: DataFrame) -> DataFrame:
    """Processed, skipped and failed items of each pass, from the statistics' JSON."""
    s = F.from_json("stats", "processed long, skipped long, failed long, cost double")
    return runs.withColumn("s", s).groupBy("pass").agg(*(F.sum(F.coalesce(f"s.{c}", F.lit(0))).alias(c) for c in ("processed", "skipped", "failed", "cost")))


def head_versions(**tables: DataFrame) -> DataFrame:
    """(table, key, version) of each head row, '' where none is known; blocks count once an entity, by their highest."""
    parts = []
    for name, df in tables.items():
        key = "entity_id" if "entity_id" in df.columns else "id"
        version = F.coalesce("derived_at_version", F.lit(""))
        rows = df.select(F.lit(name).alias("table"), F.col(key).alias("key"), version.alias("version"))
        parts.append(rows.groupBy("table", "key").agg(F.max("version").alias("version")) if name == "entity_blocks" else rows)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def default_contracts(entities: DataFrame, model: str) -> DataFrame:
    """The row that an entity without content, or whose model failed, gets: no flag set."""
    flags = ["is_public", "is_fallible", "is_nullable", "mutates_state", "is_unsafe", "is_deprecated", "must_use", "is_incomplete", "is_test", "discards_result"]
    none = F.array().cast("array<string>")
    return entities.select(F.col("id").alias("entity_id"), "corpus_id", *(F.lit(False).alias(f) for f in flags), F.lit(0).cast("long").alias("panic_call_count"), *(none.alias(a) for a in ("debt_markers", "assumptions", "risks")), F.lit(model).alias("model"))


def taxonomy(rows: DataFrame) -> DataFrame:
    """Concrete kinds with the abstract one that each is of, by corpus kind."""
    return rows.orderBy("corpus_kind", "concrete_kind")
