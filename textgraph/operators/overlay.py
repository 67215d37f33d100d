"""The correction overlay: merges, renames, aliases and edited summaries, applied to what is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import roots

PAYLOAD = "type string, absorbed string, canonical string, entity_id string, new_name string, alias string, target_kind string, target_id string, text string, a string, b string, link_kind string"


def parsed(corrections: DataFrame) -> DataFrame:
    return corrections.withColumn("p", F.from_json("payload", PAYLOAD)).select("id", "corpus_id", "collection_id", "applied_at", "p.*")


def apply_merges(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """Absorbed rows go, also where what absorbed them isn't there; the canonical row gains their names, aliases and counts."""
    to = roots(merges)
    with_root = entities.join(to, F.col("id") == F.col("absorbed"), "left").drop("absorbed")
    names = F.array_sort(F.collect_list(F.struct("id", F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("n"))))
    gains = with_root.filter("root is not null").groupBy("root").agg(F.sum("appearance_count").alias("more"), F.flatten(F.transform(names, lambda x: x["n"])).alias("names"))
    kept = with_root.filter("root is null").drop("root").join(gains, F.col("id") == F.col("root"), "left").drop("root")
    aliases = F.filter(F.array_distinct(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("names", F.array().cast("array<string>")))), lambda n: n != F.col("canonical_name"))
    return kept.withColumn("aliases", aliases).withColumn("appearance_count", F.col("appearance_count") + F.coalesce("more", F.lit(0))).select(*entities.columns)


def apply_renames(entities: DataFrame, renames: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """The last rename of an entity, or of what it was merged into, wins."""
    if merges is not None:
        renames = renames.join(roots(merges), F.col("entity_id") == F.col("absorbed"), "left").withColumn("entity_id", F.coalesce("root", "entity_id"))
    last = renames.groupBy("entity_id").agg(F.max_by("new_name", F.struct("applied_at", "id")).alias("new_name"))
    out = entities.join(last, entities["id"] == last["entity_id"], "left")
    return out.withColumn("canonical_name", F.coalesce("new_name", "canonical_name")).select(*entities.columns)


def apply_aliases(entities: DataFrame, changes: DataFrame) -> DataFrame:
    """alias_add and alias_remove (type, entity_id, alias), in order."""
    each = changes.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("applied_at", "id", "type", "alias"))).alias("steps"))
    out = entities.join(each, entities["id"] == each["entity_id"], "left")
    fold = F.aggregate("steps", F.coalesce("aliases", F.array().cast("array<string>")), lambda t, s: F.when(s["type"] == "alias_remove", F.array_remove(t, s["alias"])).otherwise(F.array_union(t, F.array(s["alias"]))))
    return out.withColumn("aliases", F.when(F.col("steps").isNull(), F.col("aliases")).otherwise(fold)).select(*entities.columns)


def apply_corrections(entities: DataFrame, corrections: DataFrame) -> DataFrame:
    """Merges, then renames, then aliases."""
    p = parsed(corrections)
    merges = p.filter("type = 'merge'").select("absorbed", "canonical")
    out = apply_merges(entities, merges)
    out = apply_renames(out, p.filter("type = 'rename'").select("id", "applied_at", "entity_id", "new_name"), merges)
    return apply_aliases(out, p.filter("type in ('alias_add', 'alias_remove')"))


def overridden(summaries: DataFrame, edits: DataFrame) -> DataFrame:
    """Summaries (target_kind, target_id, text) with the latest edit of each target, if any; an edit has no time of generation."""
    keys = ["target_kind", "target_id"]
    last = edits.groupBy(*keys).agg(F.max_by("text", F.struct("applied_at", "id")).alias("edited"))
    out = summaries.join(last, keys, "full_outer")
    return out.withColumn("text", F.coalesce("edited", "text")).withColumn("generated_at", F.when(F.col("edited").isNotNull(), "").otherwise(F.col("generated_at"))).drop("edited")
