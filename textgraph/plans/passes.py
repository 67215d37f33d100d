"""The passes of an index: each a function of tables to tables; model calls run in mapInPandas over cache misses only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cache_key, fenced_json, model_tier
from ..operators import graph, lookups
from ..operators.artifacts import cached
from .provider import Provider

# fixed values: the passes in order, and what each needs from an earlier one
PASSES = ["history", "chunk", "structure", "semantic", "aliases", "summarize", "purpose", "contract", "theme", "embed"]
NEEDS = {"structure": ["chunk"], "summarize": ["chunk"], "semantic": ["structure"], "aliases": ["structure", "semantic"], "purpose": ["structure", "semantic"], "contract": ["structure", "semantic"]}
THEME_ENTITIES = 20


def parse_passes(text: str) -> list[str]:
    """A comma-separated list, in the order of PASSES; unknown names are an error."""
    asked = [p.strip().lower() for p in text.split(",") if p.strip()]
    if unknown := [p for p in asked if p not in PASSES]:
        raise ValueError(f"no such pass: {', '.join(unknown)}")
    return [p for p in PASSES if p in asked]


def missing_prerequisites(passes: list[str], present: set[str]) -> list[str]:
    """Passes whose input neither exists (chunks, entities) nor is made by another of the passes."""
    made = {"chunk": "chunks", "structure": "entities", "semantic": "entities"}
    return [p for p in passes if p in NEEDS and not any(n in passes and n != p for n in NEEDS[p]) and not {made[n] for n in NEEDS[p]} & present]


def answered(prompts: DataFrame, provider: Provider) -> DataFrame:
    """prompts (key, prompt) with the provider's answer."""
    kind = prompts.schema["key"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            yield pdf[["key"]].assign(answer=[provider.complete(p) for p in pdf["prompt"]])

    return prompts.select("key", "prompt").mapInPandas(run, f"key {kind}, answer string")


def memoised(wanted: DataFrame, cache: DataFrame, provider: Provider, kind: str) -> tuple[DataFrame, DataFrame]:
    """(answers, new cache rows) for wanted (entity_id, content_hash, shape, prompt): only what the cache lacks is asked."""
    keyed = wanted.withColumn("cache_key", cache_key(F.lit(kind), F.col("entity_id"), F.col("content_hash"), F.col("shape"), F.lit(provider.model), F.lit(True)))
    hits, misses = cached(keyed, cache)
    asked = answered(misses.select(F.col("cache_key").alias("key"), "prompt"), provider)
    new = asked.select(F.col("key").alias("cache_key"), F.to_json(F.struct("answer")).alias("payload"))
    payload = F.get_json_object("payload", "$.answer").alias("answer")
    back = hits.select("entity_id", payload).union(misses.select("entity_id", "cache_key").join(new, "cache_key").select("entity_id", payload))
    return back, new


def structure(entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities first, then the edges whose ends exist."""
    return entities, graph.guarded(edges, entities)


SEMANTIC = "entities array<struct<name:string,kind:string,description:string>>, edges array<struct<from:string,to:string,kind:string>>, summary_text string"


def semantic(chunks: DataFrame, provider: Provider) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) that the provider names in each unprocessed chunk; edges by name, whatever its case, inside the chunk."""
    todo = lookups.unprocessed(chunks).select(F.col("id").alias("key"), F.concat(F.lit("Answer in JSON.\n"), "content").alias("prompt"))
    said = answered(todo, provider).withColumn("j", F.from_json(fenced_json(F.col("answer")), SEMANTIC))
    names = said.select("key", F.explode("j.entities").alias("e")).select("key", "e.*")
    found = said.select("key", F.explode("j.edges").alias("e")).select("key", F.col("e.from").alias("a"), F.col("e.to").alias("b"), "e.kind")
    known = names.select("key", F.lower("name").alias("low"), "name").distinct()
    for c in ("a", "b"):
        found = found.withColumn("low", F.lower(c)).join(known.withColumnRenamed("name", f"{c}_name"), ["key", "low"]).drop("low")
    return names, found.select("key", F.col("a_name").alias("from_name"), F.col("b_name").alias("to_name"), "kind")


def roll_up(children: DataFrame, provider: Provider) -> DataFrame:
    """(parent, text, model): summaries of (parent, position, kind, summary), the children joined in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("position", "kind", "summary"))), lambda c, k: F.concat(c["kind"], F.lit(" "), (k + 1).cast("string"), F.lit(": "), c["summary"]))
    prompts = children.groupBy(F.col("parent").alias("key")).agg(F.array_join(lines, "\n\n").alias("prompt"))
    out = answered(prompts, provider)
    return out.select(F.col("key").alias("parent"), F.col("answer").alias("text"), F.lit(provider.model).alias("model"), model_tier(F.lit(provider.model)).alias("model_tier"))


def themes(entities: DataFrame, provider: Provider) -> str | None:
    """What the provider says of a corpus's top entities; None under THEME_ENTITIES of them."""
    names = [r[0] for r in lookups.top_entities(entities, 100).select("canonical_name").collect()]
    return provider.complete("Themes, in JSON:\n" + "\n".join(names)) if len(names) >= THEME_ENTITIES else None


def embedded(chunks: DataFrame, embeddings: DataFrame, provider) -> DataFrame:
    """(chunk_id, model, vector) of chunks that have no vector yet."""
    todo = chunks.select(F.col("id").alias("chunk_id"), "content").join(embeddings.select("chunk_id").distinct(), "chunk_id", "left_anti")

    def run(batches):
        for pdf in batches:
            yield pdf[["chunk_id"]].assign(model=provider.model, vector=[provider.embed(t) for t in pdf["content"]])

    return todo.mapInPandas(run, "chunk_id string, model string, vector array<float>")
