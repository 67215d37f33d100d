"""Queries of the tools over a catalog of the driver's tables, and of single functions and lookups."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from . import functions as fn
from .catalogue import query
from .operators import graph, history, lookups
from .plans.model import SQL as MODEL_SQL
from .plans.tools import Tools
from .sources import code
from .storage import Catalog, shared_dir

_TOOLS: dict[str, Tools] = {}

# the catalog's own tables, as SQL for the oracle
_UNIQUE = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1"
_MODEL = "CASE event_type WHEN 'purchase' THEN 'opus-1' WHEN 'signup' THEN 'sonnet-1' WHEN 'click' THEN 'haiku-1' ELSE event_type END"
_RANK = "CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE 0 END"
MODEL_SQL |= {
    "said": f"SELECT 'customer:' || user_id AS id, {_MODEL} AS model, {_RANK} AS tier, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS generated_at, event_id, value, event_type FROM ({_UNIQUE}) WHERE event_type <> 'error'",
    "best_said": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier DESC, generated_at DESC, model DESC) AS k FROM said) WHERE k = 1",
    "edited": f"SELECT 'customer:' || user_id AS id, 'edit ' || event_id AS text FROM ({_UNIQUE}) WHERE event_type = 'error'",
    "told": "SELECT coalesce(b.id, e.id) AS id, coalesce(e.text, 'summary ' || b.event_id) AS text FROM best_said b FULL JOIN edited e ON e.id = b.id",
    "seen": "SELECT p.*, appearance_count, a, z FROM plain_entities p LEFT JOIN (SELECT id, count(*) AS appearance_count, min(u) AS a, max(u) AS z FROM (SELECT from_entity_id AS id, location_uri AS u FROM edges UNION ALL SELECT to_entity_id, location_uri FROM edges) GROUP BY 1) USING (id)",
}


class OnDemand(Catalog):
    """A catalog whose tables are written whole, each when it is first read: a query pays for the tables that it reads, and for no others."""

    def __init__(self, spark, root: str, tables: dict):
        super().__init__(spark, root)
        self._unwritten = tables

    def _fill(self, name: str) -> None:
        if name in self._unwritten:
            table = self._unwritten[name]
            self.commit(**{name: table() if callable(table) else table})
            del self._unwritten[name]

    def table(self, name: str, version: int | None = None):
        self._fill(name)
        return super().table(name, version)

    def changed_at(self, name: str) -> int:
        self._fill(name)
        return super().changed_at(name)


def _tables(m) -> dict:
    """The tables of a catalog, or functions that give them: the order schema as the corpus `star`, conversations as the book `chat`, events as what models said of customers."""
    s, null = m.spark, lambda kind="string": F.lit(None).cast(kind)
    version = [null().alias(c) for c in ("derived_at_version", "derived_at_kind", "derived_at_sha")]
    e = m.raw("events")
    last = e.groupBy("user_id", "event_type").agg(F.max(F.struct("event_id", "ts", "value")).alias("r")).select("user_id", "event_type", "r.*")
    who, at = F.concat(F.lit("customer:"), "user_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("generated_at")
    model = F.when(F.col("event_type") == "purchase", "opus-1").when(F.col("event_type") == "signup", "sonnet-1").when(F.col("event_type") == "click", "haiku-1").otherwise(F.col("event_type"))
    said = last.filter("event_type <> 'error'")
    of_model = [model.alias("model"), fn.model_tier(model).alias("model_tier"), at]
    star = F.lit("star").alias("corpus_id")
    named = lambda text: F.concat(F.lit(text), "event_id")
    corpora = m.corpora.union(s.sql("SELECT 'chat', 'book'"))
    c = m.raw("conversations")
    chapter = F.concat(F.lit("text://chat/ch/"), "conv_id")
    turns = c.select(F.col("text").alias("content"), chapter.alias("parent_path"), F.lit("scene").alias("kind"), F.concat(chapter, F.lit("/sc/"), "turn").alias("location_uri"), F.lit("chat").alias("corpus_id"))
    heads = c.select("conv_id").distinct().select(F.concat(F.lit("conversation number "), "conv_id").alias("content"), null().alias("parent_path"), F.lit("chapter").alias("kind"), chapter.alias("location_uri"), F.lit("chat").alias("corpus_id"))
    docs = m.chunks.select("content", null().alias("parent_path"), F.lit("chapter").alias("kind"), "location_uri", "corpus_id")
    chunks = turns.union(heads).union(docs)

    def typed():
        return lookups.with_abstract_kind(m.plain_entities, m.corpora, m.taxonomy).join(m.places(), "id", "left")

    n, regions, region = m.raw("nation"), m.raw("region"), F.concat(F.lit("region:"), "r_regionkey")
    members = [("all", "langs", "collection"), ("all", "star", "corpus"), ("langs", "chat", "corpus"), ("langs", "all", "collection"), ("other", "web", "corpus")]
    edits = last.filter("event_type = 'error'").select(named("x").alias("id"), star, null().alias("collection_id"), F.lit("edit_summary").alias("kind"), F.to_json(F.struct(F.lit("edit_summary").alias("type"), F.lit("entity").alias("target_kind"), who.alias("target_id"), named("edit ").alias("text"))).alias("payload"), at.alias("applied_at"))
    links = m.raw("part").filter("p_partkey div 10 % 3 < 2").select(F.concat(F.lit("l"), "p_partkey").alias("id"), null().alias("corpus_id"), F.lit("all").alias("collection_id"), F.lit("entity_link").alias("kind"), F.to_json(F.struct(F.lit("entity_link").alias("type"), F.concat(F.lit("part:"), "p_partkey").alias("a"), F.concat(F.lit("part:"), F.col("p_partkey") + 10).alias("b"), F.lit("same_as").alias("link_kind"))).alias("payload"), F.lit("2024").alias("applied_at"))
    none = F.array().cast("array<string>")
    flags = {f: F.lit(False) for f in ("is_public", "is_nullable", "mutates_state", "is_unsafe", "is_deprecated", "must_use", "is_test", "discards_result")} | {"is_fallible": F.col("value") > 50, "is_incomplete": F.col("value") < 1}
    return {
        "corpora": corpora.select("id", F.col("id").alias("name"), "kind", null().alias("source"), F.lit("{}").alias("config"), F.lit("ready").alias("status"), F.col("id").alias("created_at"), null().alias("last_indexed_at"), F.lit(3).alias("pipeline_version"), null().alias("last_indexed_version"), null().alias("backfill_cursor")),
        "chunks": chunks.select(F.sha2("content", 256).alias("id"), "corpus_id", "parent_path", "kind", "location_uri", "content", F.octet_length("content").cast("long").alias("byte_length"), F.lit("").alias("created_at"), (F.col("kind") == "scene").alias("semantic_processed"), F.when(F.col("kind") == "scene", F.sha2("parent_path", 256)).alias("source_hash"), *(null().alias(x) for x in ("introduced_at_version", "last_modified_at_version", "last_modified_commit_message", "last_modified_author")), *version, null().alias("file_shape_hash")),
        "entities": lambda: typed().select("id", "corpus_id", "canonical_name", "kind", "abstract_kind", none.alias("aliases"), null().alias("description"), "first_location_uri", "last_location_uri", F.coalesce("appearance_count", F.lit(0)).alias("appearance_count"), F.lit(0.9).alias("confidence"), *version, F.lit("").alias("content_hash")),
        "edges": lambda: m.edges.select("id", "corpus_id", "from_entity_id", "to_entity_id", "kind", "location_uri", F.lit(0.5).alias("confidence"), *version),
        "summaries": said.select(named("s").alias("id"), star, F.lit("entity").alias("target_kind"), who.alias("target_id"), F.lit("summary").alias("depth"), named("summary ").alias("text"), *of_model, *version),
        "entity_purposes": said.select(who.alias("entity_id"), star, named("purpose ").alias("purpose"), *of_model, *version),
        "entity_contracts": said.select(who.alias("entity_id"), star, *(v.alias(k) for k, v in flags.items()), F.lit(0).cast("long").alias("panic_call_count"), none.alias("debt_markers"), none.alias("assumptions"), F.when(F.col("value") > 200, F.array(F.lit("high"))).otherwise(none).alias("risks"), F.when(F.col("value").between(40, 41), "gap").alias("intent_gap"), null().alias("caller_notes"), *of_model, *version),
        "entity_blocks": n.select(F.concat(F.lit("b"), "n_nationkey").alias("id"), star, F.concat(F.lit("nation:"), "n_nationkey").alias("entity_id"), F.col("n_name").alias("label"), F.col("n_name").alias("description"), F.lit(0).cast("long").alias("position"), *version),
        "themes": n.select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"), star, F.col("n_name").alias("title"), F.col("n_name").alias("statement"), (F.col("n_nationkey") / F.lit(100.0)).alias("confidence"), F.lit("opus-1").alias("model"), F.lit("opus").alias("model_tier"), F.lit("2024").alias("generated_at"), *version),
        "kind_taxonomy": m.taxonomy.union(m.part_kinds),
        "collections": s.createDataFrame([("all", "All", "set", "1"), ("langs", "Languages", "set", "2"), ("other", "Other", "set", "3"), ("world", "World", "set", "4")], "id string, name string, kind string, created_at string").union(regions.select(region, "r_name", F.lit("region"), F.lit("5"))),
        "collection_members": s.createDataFrame(members, "collection_id string, member_id string, member_type string").union(regions.select(F.lit("world"), region, F.lit("collection"))).union(n.select(F.concat(F.lit("region:"), "n_regionkey"), F.concat(F.lit("nation:"), "n_nationkey"), F.lit("corpus"))),
        "corrections": edits.union(links).select("id", "corpus_id", "collection_id", "kind", "payload", "applied_at"),
    }


def tools(m) -> Tools:
    """The tools over a catalog of these tables, each written once for a folder in an application, when a tool reads it."""
    at = f"{shared_dir(m.spark)}/catalog-{hashlib.sha256(m.dir.encode()).hexdigest()[:16]}"
    if at not in _TOOLS:
        _TOOLS[at] = Tools(OnDemand(m.spark, at, _tables(m)))
    return _TOOLS[at]


# tools


@query("SELECT c.id, coalesce(n, 0) AS chunk_count, coalesce(e, 0) AS entity_count FROM (SELECT id FROM corpora UNION ALL SELECT 'chat') c LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT source AS id FROM documents UNION ALL SELECT 'chat' FROM conversations UNION ALL SELECT 'chat' FROM (SELECT DISTINCT conv_id FROM conversations)) GROUP BY 1) x ON x.id = c.id LEFT JOIN (SELECT 'star' AS id, count(*) AS e FROM plain_entities) y ON y.id = c.id", "corpora", "plain_entities")
def tool_corpus_list(m):
    return tools(m).tool_corpus_list().data.select("id", "chunk_count", "entity_count")


@query("SELECT 'star' AS id, 'code' AS kind, (SELECT count(*) FROM plain_entities) AS entity_count, (SELECT count(*) FROM edges) AS edge_count, (SELECT string_agg(canonical_name, '|' ORDER BY n DESC, canonical_name DESC) FROM (SELECT canonical_name, coalesce(appearance_count, 0) AS n FROM seen ORDER BY n DESC, id LIMIT 10)) AS top", "plain_entities", "edges", "seen")
def tool_corpus_overview(m):
    return tools(m).tool_corpus_overview("star").data.select("id", "kind", "entity_count", "edge_count", F.array_join("top_entities", "|").alias("top"))


@query("WITH q(name) AS (VALUES ('supplier:3'), ('Supplier#000000001'), ('no such thing'), ('customer#00000000')), h AS (SELECT q.name, count(e.id) AS n FROM q LEFT JOIN plain_entities e ON e.id = q.name OR contains(lower(e.canonical_name), lower(q.name)) GROUP BY 1) SELECT name, CASE WHEN n = 0 THEN 'not_found' WHEN n = 1 THEN 'ok' ELSE 'ambiguous' END AS status FROM h", "plain_entities")
def tool_entity(m):
    rows = [(name, tools(m).tool_entity("star", name).status) for name in ("supplier:3", "Supplier#000000001", "no such thing", "customer#00000000")]
    return m.spark.createDataFrame(rows, "name string, status string")


@query("SELECT location_uri FROM edges WHERE from_entity_id = 'supplier:1' OR to_entity_id = 'supplier:1' INTERSECT SELECT location_uri FROM edges WHERE from_entity_id = 'supplier:2' OR to_entity_id = 'supplier:2'", "edges")
def tool_entity_meet(m):
    found = tools(m).tool_entity_meet("star", "supplier:1", "supplier:2")
    return found.data if found.data is not None else m.edges.select("location_uri").limit(0)


_CHAPTER = "SELECT 'text://chat/ch/3' AS location_uri, 'chapter' AS kind, (SELECT string_agg('text://chat/ch/3/sc/' || turn, ',' ORDER BY 'text://chat/ch/3/sc/' || turn) FROM conversations WHERE conv_id = 3) AS children"


@query(_CHAPTER)
def tool_read(m):
    return tools(m).tool_read("text://chat/ch/3").data.select("location_uri", "kind", F.array_join("children", ",").alias("children"))


@query(_CHAPTER)
def tool_chapter_summary(m):
    return tools(m).tool_chapter_summary("chat", "Three").data.select("location_uri", "kind", F.array_join("children", ",").alias("children"))


@query("SELECT id, text FROM told WHERE id IN ('customer:1', 'customer:2', 'customer:3', 'customer:4', 'customer:5', 'customer:6')", "said", "best_said", "edited", "told")
def tool_summarize(m):
    own, out = tools(m), []
    for k in range(1, 7):
        found = own.tool_summarize("star", "entity", f"customer:{k}")
        out += [(f"customer:{k}", r["text"]) for r in (found.data.collect() if found.data is not None else [])]
    return m.spark.createDataFrame(out, "id string, text string")


@query("SELECT p.id, p.canonical_name, (SELECT count(*) FROM (SELECT id FROM edges WHERE from_entity_id = 'customer:5' OR to_entity_id = 'customer:5' ORDER BY id LIMIT 100)) AS n_edges, (SELECT text FROM told WHERE told.id = 'customer:5') AS summary FROM plain_entities p WHERE p.id = 'customer:5'", "plain_entities", "edges", "said", "best_said", "edited", "told")
def tool_character_profile(m):
    return tools(m).tool_character_profile("star", "customer:5").data.select("id", "canonical_name", F.size("edges").cast("long").alias("n_edges"), "summary")


@query("SELECT * FROM (VALUES ('all', 2, 2), ('langs', 2, 2), ('other', 1, 1)) t(id, member_count, corpus_count) UNION ALL SELECT 'world', (SELECT count(*) FROM region)::INTEGER, (SELECT count(*) FROM nation)::INTEGER UNION ALL SELECT 'region:' || r_regionkey, count(n_nationkey)::INTEGER, count(n_nationkey)::INTEGER FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def tool_collection_list(m):
    return tools(m).tool_collection_list().data.select("id", F.col("member_count").cast("int").alias("member_count"), F.col("corpus_count").cast("int").alias("corpus_count"))


@query("SELECT 2 AS corpora, (SELECT count(*) FROM conversations) + (SELECT count(DISTINCT conv_id) FROM conversations) AS chunk_count, (SELECT count(*) FROM edges) AS edge_count, '{\"same_as\":' || (SELECT count(*) FROM part WHERE p_partkey // 10 % 3 < 2) || '}' AS links", "edges")
def tool_collection_overview(m):
    return tools(m).tool_collection_overview("all").data.select(F.col("corpora").cast("int").alias("corpora"), "chunk_count", "edge_count", "links")


@query("SELECT uri FROM (SELECT 'text://chat/ch/' || conv_id AS uri FROM (SELECT DISTINCT conv_id FROM conversations)) WHERE uri = 'text://chat/ch/7'")
def tool_collection_search(m):
    return tools(m).tool_collection_search("all", "conversation number 7", 1).data.select("uri")


@query("SELECT c.id AS entity_id, c.model, 'purpose ' || c.event_id AS purpose FROM best_said c WHERE c.id = 'customer:5'", "said", "best_said")
def tool_entity_contracts(m):
    return tools(m).tool_entity_contracts("customer:5").data.select("entity_id", "model", "purpose")


@query("SELECT id, canonical_name, kind FROM plain_entities WHERE contains(lower(canonical_name), 'widget') AND kind = 'function' ORDER BY id LIMIT 1000", "plain_entities")
def inspect_entities(m):
    return tools(m).inspect_entities("star", "Widget", "function", 0.5, 1000).select("id", "canonical_name", "kind")


@query("SELECT 'same_as' AS link_kind, 'part:' || p_partkey AS a, 'part:' || (p_partkey + 10) AS b FROM part WHERE p_partkey // 10 % 3 < 2")
def inspect_links(m):
    return tools(m).inspect_links("all", "same_as")


@query("SELECT 'chunk' AS record, NULL AS id, NULL AS text FROM part WHERE false UNION ALL SELECT 'entity', id, canonical_name FROM plain_entities UNION ALL SELECT 'edge', id, kind FROM edges UNION ALL SELECT 'summary', id, text FROM told", "plain_entities", "edges", "said", "best_said", "edited", "told")
def export_records(m):
    """What an export of the order corpus writes, summaries as people edited them."""
    out, rows = tools(m).exported("star"), None
    for record, (key, text) in {"chunk": ("id", "content"), "entity": ("id", "canonical_name"), "edge": ("id", "kind"), "summary": ("target_id", "text")}.items():
        own = out[record].select(F.lit(record).alias("record"), F.col(key).alias("id"), F.col(text).alias("text"))
        rows = own if rows is None else rows.unionByName(own)
    return rows


@query("SELECT 'nation:' || n_nationkey AS id, n_name AS name, 0 AS depth, n_name || ': ' || n_name AS blocks FROM nation")
def tool_explain_component(m):
    """Every nation as a module whose name begins alike, with its blocks."""
    prefix = m.raw("nation").agg(F.min("n_name"), F.max("n_name")).first()
    shared = next((prefix[0][:k] for k in range(len(prefix[0]), 0, -1) if prefix[1].startswith(prefix[0][:k])), "")
    found = tools(m).tool_explain_component("star", module_prefix=shared or prefix[0])
    return found.data.select("id", "name", F.col("depth").cast("int").alias("depth"), F.array_join("blocks", "; ").alias("blocks"))


@query("SELECT canonical_name FROM (SELECT p.canonical_name, p.id, coalesce(s.appearance_count, 0) AS n FROM plain_entities p LEFT JOIN seen s ON s.id = p.id WHERE contains(lower(p.canonical_name), 'customer#00000000') ORDER BY n DESC, p.id LIMIT 20)", "plain_entities", "edges", "seen")
def tool_entity_suggestions(m):
    """The names that an ambiguous one may mean."""
    found = tools(m).tool_entity("star", "customer#00000000").suggestions
    return m.spark.createDataFrame([(n,) for n in found], "canonical_name string")


@query("SELECT id, confidence FROM (SELECT 'nation:' || n_nationkey AS id, n_nationkey / 100.0::DOUBLE AS confidence FROM nation)")
def tool_corpus_themes(m):
    return tools(m).tool_corpus_themes("star").data.select("id", "confidence")


@query("SELECT id, canonical_name, coalesce(appearance_count, 0) AS appearance_count FROM seen WHERE kind IN ('class', 'module', 'interface') ORDER BY 3 DESC, id LIMIT 50", "plain_entities", "edges", "seen")
def tool_entity_search_by_abstract_kind(m):
    return tools(m).tool_entity_search_by_abstract_kind(["star"], "component").data.select("id", "canonical_name", "appearance_count")


@query("SELECT * FROM taxonomy UNION ALL SELECT DISTINCT lower(p_type), 'catalog', 'product' FROM part", "taxonomy")
def tool_list_abstract_kinds(m):
    return tools(m).tool_list_abstract_kinds().data


@query(f"SELECT 'x' || event_id AS id, 'star' AS corpus_id, 'edit_summary' AS kind FROM ({_UNIQUE}) WHERE event_type = 'error'")
def tool_list_corrections(m):
    return tools(m).tool_list_scholia("star").data.select("id", "corpus_id", "kind")


@query("SELECT e.id FROM plain_entities e WHERE NOT EXISTS (SELECT 1 FROM edges x WHERE x.kind = 'verified_by' AND x.to_entity_id = e.id)", "plain_entities", "edges")
def tool_entities_without_tests(m):
    return tools(m).tool_entities_without_tests("star").data.select("id")


@query("SELECT id, kind FROM edges WHERE to_entity_id = 'nation:4' AND kind = 'located_in' ORDER BY id LIMIT 50", "edges")
def tool_entity_edges(m):
    return tools(m).tool_entity_edges("nation:4", "inbound", "located_in").data.select("id", "kind")


# lookups


@query("SELECT sha256('conversation number ' || conv_id) AS id, 'text://chat/ch/' || conv_id AS location_uri FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT sha256(text), 'text://' || source || '/doc/' || doc_id FROM documents")
def chunk_unprocessed(m):
    return lookups.unprocessed(tools(m).t("chunks")).select("id", "location_uri")


@query("SELECT sha256('conversation number ' || conv_id) AS id, '' AS source_hash FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT sha256(text), '' FROM documents UNION ALL SELECT sha256(text), sha256('text://chat/ch/' || conv_id) FROM conversations")
def chunk_source_hashes(m):
    return lookups.chunk_sources(tools(m).t("chunks"))


@query("SELECT id, kind, location_uri FROM edges", "edges")
def edge_list(m):
    return lookups.edges_of_corpus(tools(m).t("edges"), "star").select("id", "kind", "location_uri")


@query("SELECT id AS entity_id, 'purpose ' || event_id AS purpose FROM said WHERE model = 'haiku-1' AND id = 'customer:5'", "said")
def artifact_of_model(m):
    return lookups.of_model(tools(m).t("entity_purposes"), "haiku-1", entity_id="customer:5").select("entity_id", "purpose")


@query("SELECT 's' || event_id AS id, id AS target_id, model, generated_at FROM said", "said")
def summary_list(m):
    return lookups.listed(tools(m).t("summaries"), "summaries").select("id", "target_id", "model", "generated_at")


@query("SELECT id AS entity_id, model, 'purpose ' || event_id AS purpose FROM said", "said")
def purpose_list(m):
    return lookups.listed(tools(m).t("entity_purposes"), "entity_purposes").select("entity_id", "model", "purpose")


@query("SELECT id AS entity_id, model, value > 50 AS is_fallible, value < 1 AS is_incomplete FROM said", "said")
def contract_list(m):
    return lookups.listed(tools(m).t("entity_contracts"), "entity_contracts").select("entity_id", "model", "is_fallible", "is_incomplete")


@query("SELECT 'b' || n_nationkey AS id, 'nation:' || n_nationkey AS entity_id, n_name AS label FROM nation")
def block_list(m):
    return lookups.listed(tools(m).t("entity_blocks"), "entity_blocks").select("id", "entity_id", "label")


@query("SELECT 'l' || p_partkey AS id FROM part WHERE p_partkey // 10 % 3 < 2")
def collection_corrections(m):
    return lookups.corrections_of(tools(m).t("corrections"), collection="all").select("id")


@query("SELECT vec_id % 10 AS corpus, count(*) AS n FROM embeddings GROUP BY 1")
def embedding_counts(m):
    return m.raw("embeddings").select((F.col("vec_id") % 10).alias("corpus_id")).groupBy(F.col("corpus_id").alias("corpus")).agg(F.count("*").alias("n"))


@query("SELECT 'user:' || user_id AS artifact_id, event_type AS artifact_kind FROM events ORDER BY ts DESC, 1 DESC")
def tombstone_list(m):
    dead = m.raw("events").select(F.concat(F.lit("user:"), "user_id").alias("artifact_id"), F.col("event_type").alias("artifact_kind"), F.col("ts").alias("created_at"))
    return lookups.tombstones(dead).select("artifact_id", "artifact_kind")


@query("SELECT 'parts' AS \"table\", 'part:' || p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS version FROM part UNION ALL SELECT 'entity_blocks', 'brand:' || p_brand, max(p_type) FROM part GROUP BY p_brand")
def head_versions(m):
    p = m.raw("part")
    own = p.select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("derived_at_version"))
    blocks = p.select(F.concat(F.lit("brand:"), "p_brand").alias("entity_id"), F.col("p_type").alias("derived_at_version"))
    return lookups.head_versions(parts=own, entity_blocks=blocks)


@query("WITH c AS (SELECT doc_id, sha256(text) AS id FROM documents) SELECT doc_id FROM c WHERE doc_id >= (SELECT min(doc_id) FROM c WHERE id = (SELECT id FROM c WHERE doc_id = 100))")
def chunk_resume(m):
    last = m.chunks.filter("doc_id = 100").select("id").first()[0]
    return lookups.resumed(m.chunks.select("id", "doc_id"), "doc_id", last).select("doc_id")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'chunk' WHEN p_partkey % 3 = 1 THEN 'corpus' ELSE 'entity' END AS target FROM part")
def correction_target(m):
    k = F.col("p_partkey")
    target = F.when(k % 3 == 0, F.concat(F.lit(fn.SCHEME + "star/"), "p_name")).when(k % 3 == 1, "star").otherwise(F.col("p_name"))
    return m.raw("part").select(k, lookups.classified_target(target, F.lit("star"), fn.SCHEME).alias("target"))


# joins and versions


@query("WITH b AS (SELECT * FROM best_said WHERE value > 50) SELECT x.id, x.kind FROM edges x WHERE x.from_entity_id IN (SELECT id FROM b)", "edges", "said", "best_said")
def edges_to_fallible(m):
    turned = m.edges.select("id", "kind", F.col("from_entity_id").alias("to_entity_id"))
    return graph.to_fallible(turned, tools(m).t("entity_contracts")).select("id", "kind")


@query("SELECT page_id FROM pages p WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT left(url, length(url) - 1) AS prefix FROM pages WHERE page_id % 50 = 7) g WHERE starts_with(p.url, g.prefix))")
def deleted_by_prefix(m):
    p = m.raw("pages")
    gone = p.filter("page_id % 50 = 7").select(F.expr("left(url, length(url) - 1)").alias("path"))
    return history.below_paths(p.select("page_id", F.col("url").alias("path")), gone).select("page_id")


@query("SELECT event_id FROM artifacts WHERE day = '12'", "artifacts")
def at_version(m):
    a = m.artifacts.withColumn("derived_at_version", F.col("day"))
    return history.at_version(a.filter("event_type = 'view'"), a.filter("event_type <> 'view'").drop("value"), "12").select("event_id")


@query("SELECT uri, coalesce(kind, 'chunk') AS kind FROM (SELECT 'text://chat/ch/' || conv_id AS uri, CASE WHEN conv_id % 2 = 0 THEN 'chapter' END AS kind FROM (SELECT DISTINCT conv_id FROM conversations))")
def hit_kind(m):
    hits = m.raw("conversations").select(F.concat(F.lit("text://chat/ch/"), "conv_id").alias("uri"), "conv_id").distinct()
    kinds = hits.filter("conv_id % 2 = 0").select("uri", F.lit("chapter").alias("kind"))
    return lookups.with_kind(hits.select("uri"), kinds)


# functions


@query("SELECT item_id, regexp_replace(regexp_replace(lower(trim(text)), '\\s', '-', 'g'), '[^\\p{L}\\p{N}_-]', '', 'g') AS slug FROM benchmark")
def heading_slug(m):
    return m.raw("benchmark").select("item_id", fn.heading_slug(F.col("text")).alias("slug"))


@query("SELECT p_partkey, 'src/p' || p_partkey || '.py' AS path, 'p' || p_partkey || '.py' AS source FROM part")
def file_path(m):
    uri = F.concat(F.lit(fn.SCHEME + "star/src/p"), "p_partkey", F.lit(".py#"), "p_name")
    path = fn.file_path(uri)
    return m.raw("part").select("p_partkey", path.alias("path"), fn.source_path(path).alias("source"))


@query("SELECT page_id, regexp_matches(url, '^https?://[^/]*/(?:.*/)?[^/]*[0-9]$') AS hit FROM pages")
def glob_match(m):
    digits = [f"http*://*/**/*{k}" for k in range(10)]
    return m.raw("pages").select("page_id", fn.matches_any(F.col("url"), digits).alias("hit"))


_WORDS = ", ".join(f"('{w}', {k})" for k, w in enumerate(fn.NUMBER_WORDS, 1))


@query(f"SELECT p_partkey, coalesce(w.n, 0) AS n FROM part LEFT JOIN (SELECT * FROM (VALUES {_WORDS}) t(w, n)) w ON w.n = p_size")
def word_number(m):
    """The sizes of parts, as words where there is one; 0 where none is."""
    words = F.array(*map(F.lit, fn.NUMBER_WORDS))
    named = F.coalesce(F.try_element_at(words, F.col("p_size")), F.concat(F.lit("size "), "p_size"))
    return m.raw("part").select("p_partkey", F.coalesce(fn.word_number(F.initcap(named)), F.lit(0)).alias("n"))


@query("SELECT p_partkey, ['rust', 'typescript', 'typescript', 'javascript', 'python', 'go', 'php', NULL][(p_partkey % 8 + 1)::INTEGER] AS language FROM part")
def language_of(m):
    ext = F.element_at(F.array(*map(F.lit, ["rs", "ts", "vue", "jsx", "py", "go", "php", "txt"])), (F.col("p_partkey") % 8 + 1).cast("int"))
    return m.raw("part").select("p_partkey", fn.language_of(F.concat(F.lit("src/a.b/"), "p_brand", F.lit("."), ext)).alias("language"))


@query("SELECT event_id, props AS json FROM events")
def fenced_json(m):
    k = F.col("event_id") % 3
    said = F.when(k == 0, F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))).when(k == 1, F.concat(F.lit("So: "), "props", F.lit(" as asked"))).otherwise(F.col("props"))
    return m.raw("events").select("event_id", fn.fenced_json(said).alias("json"))


@query("SELECT event_id, round((event_id * 3.0::DOUBLE + user_id * 15.0::DOUBLE) / 1e6, 9) AS dollars FROM events")
def cost_dollars(m):
    return m.raw("events").select("event_id", F.round(fn.cost_dollars(F.col("event_id"), F.col("user_id")), 9).alias("dollars"))


_BYTES = " + ".join(f"('0x' || substr(h, {2 * k + 1}, 2))::HUGEINT * {256**k}::HUGEINT" for k in range(8))


@query(f"SELECT item_id, ({_BYTES})::VARCHAR AS seed FROM (SELECT item_id, sha256(text) AS h FROM benchmark)")
def prompt_seed(m):
    return m.raw("benchmark").select("item_id", fn.prompt_seed(F.col("text")).cast("string").alias("seed"))


@query("SELECT item_id, regexp_full_match(slug, '[a-z0-9]+(-[a-z0-9]+)*') AS valid FROM (SELECT item_id, left(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '-', 'g'), '-'), 12) AS slug FROM benchmark)")
def valid_id(m):
    return m.raw("benchmark").select("item_id", fn.valid_id(F.substring(fn.slugify(F.col("text")), 1, 12)).alias("valid"))


@query("SELECT p_partkey, ['function', 'function', 'class', 'class', 'interface', 'module', 'item'][(p_partkey % 7 + 1)::INTEGER] AS kind, replace(p_brand, '#', '_') AS symbol FROM part")
def item_kind_and_symbol(m):
    word = F.element_at(F.array(*map(F.lit, ["fn", "func", "struct", "impl", "trait", "mod", "const"])), (F.col("p_partkey") % 7 + 1).cast("int"))
    name = F.translate("p_brand", "#", "_")
    text = F.when(word.isin("impl", "const"), F.concat(F.lit("fn "), name)).otherwise(F.concat(word, F.lit(" "), name, F.lit(" {")))
    return m.raw("part").select("p_partkey", code.item_kind(word).alias("kind"), code.symbol_of(text).alias("symbol"))
