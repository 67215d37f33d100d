"""The tables of the data model, as Spark schemas."""

from __future__ import annotations

from pyspark.sql.types import StructType

_VERSION = "derived_at_version string, derived_at_kind string, derived_at_sha string"
_MODEL = "model string, model_tier string, generated_at string"

HEAD = {
    "corpora": "id string, name string, kind string, source string, config string, status string, created_at string, last_indexed_at string, pipeline_version int, last_indexed_version string, backfill_cursor string",
    "chunks": f"id string, corpus_id string, parent_path string, kind string, location_uri string, content string, byte_length long, created_at string, semantic_processed boolean, source_hash string, introduced_at_version string, last_modified_at_version string, last_modified_commit_message string, last_modified_author string, {_VERSION}, file_shape_hash string",
    "entities": f"id string, corpus_id string, canonical_name string, kind string, abstract_kind string, aliases array<string>, description string, first_location_uri string, last_location_uri string, appearance_count long, confidence double, {_VERSION}, content_hash string",
    "edges": f"id string, corpus_id string, from_entity_id string, to_entity_id string, kind string, location_uri string, confidence double, {_VERSION}",
    "summaries": f"id string, corpus_id string, target_kind string, target_id string, depth string, text string, {_MODEL}, {_VERSION}",
    "entity_purposes": f"entity_id string, corpus_id string, purpose string, {_MODEL}, {_VERSION}",
    "entity_contracts": f"entity_id string, corpus_id string, is_public boolean, is_fallible boolean, is_nullable boolean, mutates_state boolean, is_unsafe boolean, is_deprecated boolean, must_use boolean, is_incomplete boolean, is_test boolean, discards_result boolean, panic_call_count long, debt_markers array<string>, assumptions array<string>, risks array<string>, intent_gap string, caller_notes string, {_MODEL}, {_VERSION}",
    "entity_blocks": f"id string, corpus_id string, entity_id string, label string, description string, position long, {_VERSION}",
    "themes": f"id string, corpus_id string, title string, statement string, confidence double, {_MODEL}, {_VERSION}",
    "embeddings": f"id string, corpus_id string, chunk_id string, model string, vector array<float>, created_at string, surrounding_context_hash string, {_VERSION}",
    "kind_taxonomy": "concrete_kind string, corpus_kind string, abstract_kind string",
    "collections": "id string, name string, kind string, created_at string",
    "collection_members": "collection_id string, member_id string, member_type string",
    "corrections": "id string, corpus_id string, collection_id string, kind string, payload string, applied_at string",
    "runs": "id string, corpus_id string, pass string, started_at string, finished_at string, status string, stats string, provider string",
    "layer2_cache": "cache_key string, artifact_kind string, entity_id string, content_hash string, file_shape_hash string, model string, stable_sampling boolean, payload string, first_seen_at_sha string, created_at string, hit_count long",
    "sources": "corpus_id string, path string, hash string",
    "tombstones": "corpus_id string, artifact_kind string, artifact_id string, derived_at_kind string, derived_at_sha string, reason string, created_at string",
}

#: Head tables whose rows are archived when a newer version replaces them, with their keys.
VERSIONED = {"entities": ["id"], "edges": ["id"], "entity_purposes": ["entity_id", "model"], "entity_contracts": ["entity_id", "model"], "entity_blocks": ["id"], "summaries": ["corpus_id", "target_kind", "target_id", "model"], "chunks": ["id"], "themes": ["id"], "embeddings": ["id"]}
#: Tables whose rows are told apart by a key, so that a commit may change some of them.
KEYS = VERSIONED | {"runs": ["id"], "corpora": ["id"], "collections": ["id"], "sources": ["corpus_id", "path"]}
#: The version of this data model.
PIPELINE_VERSION = 3
SUPERSEDED = "superseded_at_version string, superseded_at string, superseded_at_sha string"

#: fixed values: concrete kind, corpus kind, abstract kind
TAXONOMY = [("function", "code", "process"), ("class", "code", "component"), ("module", "code", "component"), ("interface", "code", "component"), ("character", "book", "person"), ("location", "book", "place"), ("faction", "book", "organization"), ("concept", "book", "concept")]


def schema(table: str) -> StructType:
    if table.endswith("_history"):
        return StructType.fromDDL(f"{HEAD[table.removesuffix('_history')]}, {SUPERSEDED}")
    return StructType.fromDDL(HEAD[table])
