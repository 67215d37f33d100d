"""The query tools by name: each gives a result envelope around a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import NUMBER_WORDS, SCHEME
from ..operators import artifacts as art
from ..operators import collections as coll
from ..operators import graph, lookups, overlay, search
from ..operators.postings import Postings
from ..storage import Catalog


@dataclass
class Result:
    """status: ok, not_found, ambiguous, invalid_input or error."""

    status: str
    data: DataFrame | None = None
    message: str = ""
    suggestions: list[str] = field(default_factory=list)


def ok(df: DataFrame) -> Result:
    return Result("ok", df)


def found(df: DataFrame, what: str) -> Result:
    return ok(df) if not df.isEmpty() else Result("not_found", message=f"{what} not found")


class Tools:
    """Tools over a catalog. embed, where given, turns a query into a vector; without it searches fall back to keywords."""

    def __init__(self, catalog: Catalog, embed=None):
        self.catalog, self.embed = catalog, embed

    def t(self, name: str, corpus: str | None = None) -> DataFrame:
        df = self.catalog.table(name)
        return df.filter(F.col("corpus_id") == corpus) if corpus else df

    def index(self) -> Postings:
        """The search index of the catalog's chunks, after what changed since it was last used has been put in.

        It lies beside the tables and is shared by all tools over the catalog. Chunks are told apart by their location.
        """
        at, now = f"{self.catalog.root}/_search", self.catalog.changed_at("chunks")
        own = Postings(self.catalog.spark, at)
        was = own.state["source"]
        if was is None:
            return Postings.build(self.t("chunks"), at, str(now))
        if was != str(now):
            old, new = self.catalog.table("chunks", int(was)).select("location_uri", "id"), self.t("chunks")
            fresh = new.join(old, ["location_uri", "id"], "left_anti").select("location_uri", "corpus_id", "content")
            own.change(fresh, old.join(new, "location_uri", "left_anti").select("location_uri"), str(now))
        return own

    @cached_property
    def _corrections(self) -> DataFrame:
        return overlay.parsed(self.t("corrections"))

    def _entities(self, corpus: str) -> DataFrame:
        own = self.t("corrections").filter(F.col("corpus_id") == corpus)
        return overlay.apply_corrections(self.t("entities", corpus), own)

    def _links(self, collection: str) -> DataFrame:
        return self._corrections.filter((F.col("collection_id") == collection) & (F.col("type") == "entity_link")).select("a", "b", F.coalesce("link_kind", F.lit("same_as")).alias("link_kind"))

    def call(self, tool_name: str, /, **arguments) -> Result:
        tool = getattr(self, f"tool_{tool_name}", None)
        if tool is None:
            return Result("error", message=f"no such tool: {tool_name}")
        try:
            return tool(**arguments)
        except (TypeError, ValueError) as e:
            return Result("invalid_input", message=str(e))

    @classmethod
    def names(cls) -> list[str]:
        return sorted(n.removeprefix("tool_") for n in dir(cls) if n.startswith("tool_"))

    def tool_corpus_list(self) -> Result:
        base = self.t("corpora").select("id", "name", "kind", F.col("last_indexed_at").alias("last_indexed"), "created_at")
        return ok(lookups.counts(base, chunk=self.t("chunks"), entity=self.t("entities")).orderBy("created_at", "id").drop("created_at"))

    def tool_corpus_overview(self, corpus_id: str) -> Result:
        top = lookups.top_entities(self.t("entities", corpus_id))
        top = overlay.apply_corrections(top, self.t("corrections").filter(F.col("corpus_id") == corpus_id))
        counts = lookups.counts(self.t("corpora").filter(F.col("id") == corpus_id).select("id", "name", "kind"), chunk=self.t("chunks"), entity=self.t("entities"), edge=self.t("edges"))
        names = top.agg(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("appearance_count", "canonical_name")))), lambda x: x["canonical_name"]).alias("top_entities"))
        summary = self._summary(corpus_id, "corpus", corpus_id).agg(F.first("text").alias("summary"))
        return found(counts.crossJoin(names).crossJoin(summary), corpus_id)  # one row each

    def tool_search(self, corpus_id: str, query: str, mode: str = "keyword", limit: int = 20, position: str | None = None, alpha: float = 0.5) -> Result:
        if mode not in ("keyword", "semantic", "hybrid"):
            raise ValueError(f"no such mode: {mode}")
        chunks = self.t("chunks")
        kinds = chunks.select(F.col("location_uri").alias("uri"), "kind")
        vector = self.embed(query) if self.embed and mode != "keyword" else None
        if vector is None:
            hits = self.index().keyword(query, limit, position, corpus_id)
        else:
            joined = self.t("embeddings", corpus_id).select("chunk_id", "vector").join(chunks.select(F.col("id").alias("chunk_id"), F.col("location_uri").alias("uri")), "chunk_id")
            words = lambda: self.index().keyword(query, search.OVER_FETCH * limit, position, corpus_id)
            hits = search.semantic(joined, vector, limit, position) if mode == "semantic" else search.blended(words(), joined, vector, limit, alpha, position)
        return ok(lookups.with_kind(hits, kinds).orderBy(F.desc("score"), "uri"))

    def _resolve(self, corpus: str, name: str, kind: str | None = None) -> DataFrame:
        merges = self._corrections.filter((F.col("corpus_id") == corpus) & (F.col("type") == "merge")).select("absorbed", "canonical")
        to = graph.roots(merges).filter(F.col("absorbed") == name).select("root").first()
        exact = self.t("entities").filter(F.col("id") == (to[0] if to else name))
        rows = exact if not exact.isEmpty() else overlay.apply_corrections(lookups.entities_named(self.t("entities", corpus), name), self.t("corrections").filter(F.col("corpus_id") == corpus))
        if kind:
            return rows.filter(F.col("kind") == kind)
        others = rows.filter("kind <> 'file'")
        return others if rows.count() > 1 and others.count() == 1 else rows

    def tool_entity(self, corpus_id: str, name_or_id: str, kind: str | None = None) -> Result:
        rows = self._resolve(corpus_id, name_or_id, kind)
        names = [r[0] for r in rows.orderBy("canonical_name", "id").select("canonical_name").limit(20).collect()]
        if not names:
            near = lookups.entities_named(self.t("entities", corpus_id), name_or_id, 5)
            return Result("not_found", message=f"{name_or_id} not found", suggestions=[r["canonical_name"] for r in near.collect()])
        return ok(rows) if len(names) == 1 else Result("ambiguous", rows, suggestions=names)

    def tool_entity_edges(self, entity_id: str, direction: str = "both", kind: str | None = None, limit: int = 50) -> Result:
        return ok(lookups.edges_of(self.t("edges"), entity_id, direction, kind, limit))

    def _ids(self, corpus: str, name: str) -> list[str]:
        e = self.t("entities", corpus)
        exact = e.filter(F.col("id") == name)
        first = exact.select("id").first() or lookups.entities_named(e, name, 1).select("id").first()
        return [first[0]] if first else []

    def tool_entity_meet(self, corpus_id: str, a: str, b: str) -> Result:
        one, two = self._ids(corpus_id, a), self._ids(corpus_id, b)
        if not one or not two:
            return Result("not_found", message=f"{a if not one else b} not found")
        return found(graph.meet(self.t("edges", corpus_id), one, two), f"{a} with {b}")

    def tool_read(self, uri: str, depth: str = "summary") -> Result:
        if depth not in ("summary", "scenes", "full"):
            raise ValueError(f"no such depth: {depth}")
        chunk = self.t("chunks").filter(F.col("location_uri") == uri)
        own = chunk.select("corpus_id").first()
        if own is None:
            return Result("not_found", message=f"no chunk at {uri}")
        out = chunk.select("location_uri", "kind", "corpus_id", *(["content"] if depth == "full" else []))
        seen = lookups.entities_at(self.t("entities", own[0]), uri)
        seen = overlay.apply_corrections(seen, self.t("corrections").filter(F.col("corpus_id") == own[0]))
        here = seen.agg(F.array_sort(F.collect_set("canonical_name")).alias("entities"))
        below = lookups.children(self.t("chunks", own[0]), uri).agg(F.array_sort(F.collect_list("location_uri")).alias("children"))
        text = self._summary(own[0], "chunk", uri).agg(F.first("text").alias("summary"))
        return ok(out.crossJoin(here).crossJoin(below).crossJoin(text))  # one row each

    def _summary(self, corpus: str, kind: str, target: str) -> DataFrame:
        here = (F.col("target_kind") == kind) & (F.col("target_id") == target)
        best = art.best_of(self.t("summaries", corpus).filter(here), ["target_id"]).select("target_kind", "target_id", "text", "generated_at")
        edits = self._corrections.filter((F.col("corpus_id") == corpus) & (F.col("type") == "edit_summary") & here).select("target_kind", "target_id", "text", "applied_at", "id")
        return overlay.overridden(best, edits)

    def tool_summarize(self, corpus_id: str, target_kind: str, target_id: str) -> Result:
        if target_kind not in ("corpus", "entity", "chunk", "range"):
            raise ValueError(f"no such target: {target_kind}")
        return found(self._summary(corpus_id, target_kind, target_id), target_id)

    def tool_related(self, corpus_id: str, uri: str, limit: int = 10) -> Result:
        return ok(graph.related(self.t("edges", corpus_id), uri, limit))

    def tool_chapter_summary(self, corpus_id: str, chapter: str) -> Result:
        word = chapter.strip().lower()
        number = NUMBER_WORDS.index(word) + 1 if word in NUMBER_WORDS else int(word) if word.isdigit() else None
        if number:
            return self.tool_read(f"{SCHEME}{corpus_id}/ch/{number}")
        hits = self.index().keyword(chapter, 5, corpus=corpus_id).join(self.t("chunks").filter("kind = 'chapter'").select(F.col("location_uri").alias("uri")), "uri", "left_semi")
        first = hits.orderBy(F.desc("score"), "uri").first()
        return self.tool_read(first["uri"]) if first else Result("not_found", message=f"{chapter} not found")

    def tool_character_profile(self, corpus_id: str, name: str) -> Result:
        who = self.tool_entity(corpus_id, name)
        if who.status != "ok":
            return who
        key = who.data.select("id").first()[0]
        edges = lookups.edges_of(self.t("edges"), key, most=100).agg(F.collect_list(F.struct("kind", "from_entity_id", "to_entity_id", "location_uri")).alias("edges"))
        return ok(who.data.crossJoin(edges).crossJoin(self._summary(corpus_id, "entity", key).agg(F.first("text").alias("summary"))))  # one row each

    def tool_find_scene(self, corpus_id: str, a: str, b: str) -> Result:
        where = self.tool_entity_meet(corpus_id, a, b)
        return self.tool_read(where.data.orderBy("location_uri").first()[0], "full") if where.status == "ok" else where

    def tool_collection_list(self) -> Result:
        members = self.t("collection_members")
        direct = members.groupBy(F.col("collection_id").alias("id")).agg(F.count("*").alias("member_count"))
        out = self.t("collections").join(direct, "id", "left").withColumn("member_count", F.coalesce("member_count", F.lit(0)))
        counts = coll.corpora_below(members).groupBy(F.col("collection_id").alias("id")).agg(F.count("*").alias("corpus_count"))
        return ok(out.join(counts, "id", "left").withColumn("corpus_count", F.coalesce("corpus_count", F.lit(0))).orderBy("id"))

    def tool_collection_overview(self, collection_id: str) -> Result:
        counts = lookups.counts(self.t("corpora").select("id"), chunk=self.t("chunks"), entity=self.t("entities"), edge=self.t("edges"))
        return ok(coll.overview(self.t("collection_members"), counts, self._links(collection_id), collection_id))

    def _below(self, collection: str) -> DataFrame:
        return coll.resolved(self.t("collection_members"), collection)

    def tool_collection_search(self, collection_id: str, query: str, limit: int = 20) -> Result:
        """The best first, over all corpora of the collection: the statistics are those of all chunks anyway."""
        own = self._below(collection_id)
        hits = self.index().keyword(query, limit, within=own.select("corpus_id"))
        where = self.t("chunks").select(F.col("location_uri").alias("uri"), "corpus_id")
        return ok(coll.best_search(hits.join(where, "uri"), limit))

    def _named(self, collection: str, name: str) -> DataFrame:
        own = self._below(collection)
        return self.t("entities").join(own, "corpus_id").filter(F.lower("canonical_name").contains(name.lower()) | F.lower(F.to_json("aliases")).contains(name.lower()))

    def tool_collection_entity_resolve(self, collection_id: str, name: str) -> Result:
        rows = coll.resolve_entity(self._named(collection_id, name), self._links(collection_id))
        return found(rows.orderBy("position", F.desc("appearance_count"), "id"), name)

    def tool_collection_entity_meet(self, collection_id: str, a: str, b: str) -> Result:
        own = self._below(collection_id)
        edges = self.t("edges").join(own, "corpus_id")
        met = coll.meet_across(edges, self._named(collection_id, a).select("id"), self._named(collection_id, b).select("id"), self._links(collection_id))
        order = edges.select("location_uri", "position").distinct()
        return ok(met.join(order, "location_uri").orderBy("position", "location_uri"))

    def tool_entity_contracts(self, entity_id: str) -> Result:
        best = art.best_of(self.t("entity_contracts").filter(F.col("entity_id") == entity_id), ["entity_id"])
        purpose = art.best_of(self.t("entity_purposes").filter(F.col("entity_id") == entity_id), ["entity_id"]).select("entity_id", "purpose")
        tests = lookups.edges_of(self.t("edges"), entity_id, "inbound", "verified_by", 100).groupBy(F.col("to_entity_id").alias("entity_id")).agg(F.array_sort(F.collect_set("from_entity_id")).alias("verified_by"))
        return found(best.join(purpose, "entity_id", "left").join(tests, "entity_id", "left"), entity_id)

    def tool_find_inconsistencies(self, corpus_id: str) -> Result:
        return ok(art.inconsistencies(self.t("entity_contracts", corpus_id)))

    def tool_find_unreachable(self, corpus_id: str) -> Result:
        return ok(graph.unreached(self.t("entities", corpus_id), self.t("edges"), "calls").orderBy("id"))

    def tool_entities_without_tests(self, corpus_id: str) -> Result:
        return ok(graph.unreached(self.t("entities", corpus_id), self.t("edges"), "verified_by").orderBy("id"))

    def tool_corpus_themes(self, corpus_id: str, include_edges: bool = False) -> Result:
        themes = self.t("themes", corpus_id)
        return ok(art.themes_with_edges(themes, self.t("edges")) if include_edges else themes.orderBy(F.desc("confidence"), "id"))

    def tool_explain_component(self, corpus_id: str, entity_id: str | None = None, module_prefix: str | None = None, max_depth: int = 3) -> Result:
        if not entity_id and not module_prefix:
            raise ValueError("entity_id or module_prefix is needed")
        e = self.t("entities", corpus_id)
        seeds = e.filter(F.col("id") == entity_id) if entity_id else e.filter(F.col("canonical_name").startswith(module_prefix))
        seen = graph.walk(self.t("edges", corpus_id), seeds, ["calls"], max_depth)
        purpose = art.best_of(self.t("entity_purposes", corpus_id), ["entity_id"]).select(F.col("entity_id").alias("id"), "purpose")
        blocks = self.t("entity_blocks", corpus_id).groupBy(F.col("entity_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "label", "description"))), lambda b: F.concat_ws(": ", b["label"], b["description"])).alias("blocks"))
        told = art.best_of(self.t("summaries", corpus_id).filter("target_kind = 'entity'"), ["target_id"]).select(F.col("target_id").alias("id"), F.col("text").alias("summary"))
        names = e.select("id", F.col("canonical_name").alias("name"), "kind")
        nodes = seen.join(names, "id").join(purpose, "id", "left").join(told, "id", "left").join(blocks, "id", "left")
        return found(nodes.orderBy("depth", "position"), entity_id or module_prefix)

    def explained(self, corpus_id: str, entity_id: str | None = None, module_prefix: str | None = None, max_depth: int = 3) -> Result:
        """The same nodes as one text."""
        nodes = self.tool_explain_component(corpus_id, entity_id, module_prefix, max_depth)
        return ok(graph.narrative(nodes.data)) if nodes.status == "ok" else nodes

    def tool_entity_search_by_abstract_kind(self, corpus_ids: list[str], abstract_kind: str, limit: int = 50) -> Result:
        return ok(lookups.of_abstract_kind(self.t("entities"), abstract_kind, corpus_ids, limit))

    def tool_list_abstract_kinds(self) -> Result:
        return ok(lookups.taxonomy(self.t("kind_taxonomy")))

    def tool_list_scholia(self, corpus_id: str) -> Result:
        return ok(self.t("corrections", corpus_id).orderBy("applied_at", "id").select("id", "corpus_id", "kind", "applied_at"))

    def tool_apply_scholion(self, id: str, kind: str, payload: str, applied_at: str, corpus_id: str | None = None, collection_id: str | None = None) -> Result:
        if (corpus_id is None) == (collection_id is None):
            raise ValueError("exactly one of corpus_id and collection_id is needed")
        new = self.catalog.spark.createDataFrame([(id, corpus_id, collection_id, kind, payload, applied_at)], self.t("corrections").schema)
        self.catalog.write(appended={"corrections": new})
        self.__dict__.pop("_corrections", None)
        return ok(new)

    # what an operator looks at, beside the tools

    def inspect_entities(self, corpus_id: str, name: str | None = None, kind: str | None = None, min_confidence: float | None = None, limit: int = 50) -> DataFrame:
        """Corrected entities by name or alias, kind and confidence, in the order of their ids."""
        out = self._entities(corpus_id)
        if name:
            low = name.lower()
            out = out.filter(F.lower("canonical_name").contains(low) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a).contains(low)))
        out = out.filter(F.col("kind") == kind) if kind else out
        out = out.filter(F.col("confidence") >= min_confidence) if min_confidence is not None else out
        return out.orderBy("id").limit(limit)

    def inspect_chunk(self, location: str) -> DataFrame:
        """The chunk at a location, or none."""
        return self.t("chunks").filter(F.col("location_uri") == location)

    def inspect_links(self, collection_id: str, kind: str | None = None) -> DataFrame:
        """The entity links of a collection by kind and ends."""
        if self.t("collections").filter(F.col("id") == collection_id).isEmpty():
            raise ValueError(f"no collection {collection_id}")
        out = self._links(collection_id)
        return (out.filter(F.col("link_kind") == kind) if kind else out).select("link_kind", "a", "b").orderBy("link_kind", "a", "b")

    def exported(self, corpus_id: str) -> dict[str, DataFrame]:
        """The records of a corpus for JSON lines: corrected entities, and summaries with what people made of them."""
        edits = self._corrections.filter((F.col("corpus_id") == corpus_id) & (F.col("type") == "edit_summary")).select("target_kind", "target_id", "text", "applied_at", "id")
        best = art.best_of(self.t("summaries", corpus_id), ["target_kind", "target_id"]).select("target_kind", "target_id", "text", "generated_at")
        return {"chunk": self.t("chunks", corpus_id), "entity": self._entities(corpus_id), "edge": self.t("edges", corpus_id), "summary": overlay.overridden(best, edits)}
