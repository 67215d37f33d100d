"""Derived artifacts: the best of several models', inconsistencies, the tier router, hashes of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tier_rank
from .hashes import running_sha256

# fixed values: thresholds of the router
OPUS_IN_DEGREE, OPUS_PANICS, OPUS_MODULE_OUT = 20, 3, 15
SONNET_IN_DEGREE, SONNET_LINES = 10, 150


def best_of(artifacts: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key: the highest tier, then the latest, then the model's name."""
    row = F.max_by(F.struct(*artifacts.columns), F.struct(tier_rank(F.col("model_tier")), "generated_at", "model"))
    return artifacts.groupBy(*keys).agg(row.alias("r")).select("r.*")


def best_with_ties(artifacts: DataFrame, key: str) -> DataFrame:
    """Rows generated at the latest time of the key's best tier, whatever their own tier."""
    own = Window.partitionBy(key)
    ranked = artifacts.withColumn("rank", tier_rank(F.col("model_tier"))).withColumn("top", F.max("rank").over(own))
    at = F.max(F.when(F.col("rank") == F.col("top"), F.col("generated_at"))).over(own)
    return ranked.withColumn("at", at).filter(F.col("generated_at") == F.col("at")).select(*artifacts.columns)


def inconsistencies(contracts: DataFrame) -> DataFrame:
    """Best contracts that are incomplete, have a gap of intent, or name risks without being fallible."""
    odd = F.col("is_incomplete") | F.col("intent_gap").isNotNull() | (~F.col("is_fallible") & (F.size("risks") > 0))
    return best_with_ties(contracts, "entity_id").filter(odd).orderBy("entity_id", "model")


def routed_tier(unsafe: Column, fallible: Column, public: Column, mutating: Column, panics: Column, debt: Column, in_degree: Column, out_degree: Column, kind: Column, lines: Column, enabled: bool = True, default: str = "haiku") -> Column:
    """The model tier that an entity's signals ask for; all comparisons are strict. A router that isn't enabled gives the default."""
    if not enabled:
        return F.lit(default)
    return (
        F.when(unsafe, "opus").when((in_degree > OPUS_IN_DEGREE) & fallible, "opus").when(public & (panics > OPUS_PANICS), "opus")
        .when((kind == "module") & (out_degree > OPUS_MODULE_OUT), "opus").when(public & fallible, "sonnet").when(mutating & fallible, "sonnet").when(panics > 0, "sonnet").when(debt, "sonnet")
        .when(kind.isin("class", "module"), "sonnet").when(in_degree > SONNET_IN_DEGREE, "sonnet").when(lines > SONNET_LINES, "sonnet").otherwise("haiku")
    )


def tier_counts(artifacts: DataFrame) -> DataFrame:
    return artifacts.groupBy("model_tier").agg(F.count("*").alias("n"))


def file_shapes(entities: DataFrame) -> DataFrame:
    """(uri, shape): SHA-256 over the sorted distinct entity ids of a file, each with a newline."""
    ids = F.array_sort(F.collect_set("id"))
    return entities.groupBy(F.col("first_location_uri").alias("uri")).agg(F.sha2(F.concat(F.array_join(ids, "\n"), F.lit("\n")), 256).alias("shape"))


def source_hashes(chunks: DataFrame, source: str, position: str) -> DataFrame:
    """(source, hash): SHA-256 over a source's chunks, in order."""
    return running_sha256(chunks, source, position, "content")


def tree_version(files: DataFrame) -> DataFrame:
    """One row: the version of a tree of (path, hash)."""
    line = F.concat(F.col("path"), F.lit("\0"), F.col("hash"), F.lit("\n"))
    whole = running_sha256(files.select(F.lit(1).alias("tree"), "path", line.alias("line")), "tree", "path", "line")
    found = F.coalesce(F.max("hash"), F.sha2(F.lit(""), 256))
    return whole.agg(F.concat(F.lit("v1-tree:"), found).alias("version"))


def cached(wanted: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of wanted by cache_key; a payload that is no JSON object counts as a miss."""
    good = cache.filter(F.get_json_object("payload", "$").isNotNull()).select("cache_key", "payload")
    return wanted.join(good, "cache_key"), wanted.join(good, "cache_key", "left_anti")


def themes_with_edges(themes: DataFrame, edges: DataFrame, most: int = 200) -> DataFrame:
    """Themes by confidence with their inbound upheld_by and violated_by edges, most of each kind."""
    inbound = edges.filter(F.col("kind").isin("upheld_by", "violated_by"))
    k = F.row_number().over(Window.partitionBy("to_entity_id", "kind").orderBy("id"))
    few = inbound.withColumn("k", k).filter(F.col("k") <= most).select(F.col("to_entity_id").alias("theme_id"), F.col("kind").alias("edge_kind"), "from_entity_id")
    return themes.join(few, themes["id"] == few["theme_id"], "left").drop("theme_id").orderBy(F.desc("confidence"), "id", "edge_kind", "from_entity_id")
