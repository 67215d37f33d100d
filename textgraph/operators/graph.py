"""The entity graph: degrees, anti-joins, co-occurrence, similarity, bounded walks, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .artifacts import best_of


def unreached(entities: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """Entities that no edge of the kind points to: uncalled, or untested."""
    targets = edges.filter(F.col("kind") == kind).select(F.col("to_entity_id").alias("id"))
    return entities.join(targets, "id", "left_anti")


def guarded(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges whose two ends exist."""
    ids = entities.select("id")
    source = edges.join(ids.withColumnRenamed("id", "from_entity_id"), "from_entity_id", "left_semi")
    return source.join(ids.withColumnRenamed("id", "to_entity_id"), "to_entity_id", "left_semi").select(*edges.columns)


def to_fallible(edges: DataFrame, contracts: DataFrame) -> DataFrame:
    """Edges whose target's best contract says that it may fail."""
    best = best_of(contracts, ["entity_id"]).filter("is_fallible").select(F.col("entity_id").alias("to_entity_id"))
    return edges.join(best, "to_entity_id", "left_semi").select(*edges.columns)


def degrees(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """entities with in_degree and out_degree. Both kinds of ends are counted in one step, and meet the entities in one join."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    into = edges.select(F.col("to_entity_id").alias("id"), one.alias("in_degree"), none.alias("out_degree"))
    out = edges.select(F.col("from_entity_id").alias("id"), none.alias("in_degree"), one.alias("out_degree"))
    n = into.union(out).groupBy("id").agg(F.sum("in_degree").alias("in_degree"), F.sum("out_degree").alias("out_degree"))
    return entities.join(n, "id", "left").select(*entities.columns, *(F.coalesce(c, none).alias(c) for c in ("in_degree", "out_degree")))


def seen_with(edges: DataFrame, uri: str) -> DataFrame:
    """(id, first_location_uri, last_location_uri) of the entities that an edge at uri points to: only edges to these are grouped."""
    own = written(edges.filter(F.col("location_uri") == uri).select("to_entity_id").distinct(), "seen-own")
    every = edges.join(own, "to_entity_id", "left_semi")
    return every.groupBy(F.col("to_entity_id").alias("id")).agg(F.min("location_uri").alias("first_location_uri"), F.max("location_uri").alias("last_location_uri"))


def ends(edges: DataFrame) -> DataFrame:
    """(location_uri, entity_id), distinct."""
    return edges.select("location_uri", F.col("from_entity_id").alias("entity_id")).union(edges.select("location_uri", F.col("to_entity_id").alias("entity_id"))).distinct()


def locations_of(edges: DataFrame, ids: list[str]) -> DataFrame:
    return edges.filter(F.col("from_entity_id").isin(ids) | F.col("to_entity_id").isin(ids)).select("location_uri").distinct()


def meet(edges: DataFrame, a: list[str], b: list[str]) -> DataFrame:
    """Locations where both occur, in order."""
    return locations_of(edges, a).intersect(locations_of(edges, b)).orderBy("location_uri")


def related(edges: DataFrame, uri: str, most: int = 10) -> DataFrame:
    """Other locations by the Jaccard index of their entity sets: only edges that touch the entities of one location are looked at."""
    own = written(ends(edges.filter(F.col("location_uri") == uri)).select("entity_id"), "related-own")
    others = edges.filter(F.col("location_uri") != uri)
    touched = [others.join(own, others[c] == own["entity_id"]).select("location_uri", "entity_id") for c in ("from_entity_id", "to_entity_id")]
    shared = written(touched[0].union(touched[1]).distinct().groupBy("location_uri").agg(F.count("*").alias("overlap")), "related-shared")
    sizes = ends(edges.join(shared.select("location_uri"), "location_uri", "left_semi")).groupBy("location_uri").agg(F.count("*").alias("n"))
    size = own.agg(F.count("*").alias("n_own"))
    scored = shared.join(sizes, "location_uri").join(F.broadcast(size))  # one row
    score = F.col("overlap") / (F.col("n") + F.col("n_own") - F.col("overlap"))
    return scored.select("location_uri", F.round(score, 6).alias("jaccard"), F.lit("shared_entities").alias("relationship")).orderBy(F.desc("jaccard"), "location_uri").limit(most)


def walk(edges: DataFrame, seeds: DataFrame, kinds: list[str], max_depth: int = 3, fan_out: int = 50) -> DataFrame:
    """(id, depth, position): what the seeds reach along outbound edges, fan_out targets a node at most (in order of edge id), visited once.

    In the order of depth and position nodes come as from a queue: seeds by id, then the targets of each in turn. Each
    round joins the edges with its frontier alone.
    """
    order = Window.partitionBy("from_entity_id").orderBy("edge")
    steps = edges.filter(F.col("kind").isin(kinds)).select("from_entity_id", F.col("id").alias("edge"), F.col("to_entity_id").alias("next"))
    seen = written(seeds.select("id").distinct().select("id", F.lit(0).alias("depth"), F.col("id").alias("position")), "walk")
    edge = seen
    for depth in range(1, max_depth + 1):
        near = steps.join(edge.select(F.col("id").alias("from_entity_id"), "position"), "from_entity_id")
        near = near.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= fan_out)
        ahead = near.groupBy(F.col("next").alias("id")).agg(F.min(F.concat("position", F.lit("/"), F.lpad(F.col("k").cast("string"), 6, "0"))).alias("position"))
        edge = written(ahead.join(seen, "id", "left_anti").select("id", F.lit(depth).alias("depth"), "position"), "walk")
        if edge.isEmpty():
            break
        seen = seen.unionByName(edge)
    return seen


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each end of (a, b) reaches, either way; label propagation with pointer jumping."""
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "components-links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "components")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        step = written(labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label")), "components")
        far = step.select(F.col("node").alias("via"), F.col("label").alias("far"))
        step = written(step.join(far, step["label"] == far["via"]).select("node", "old", F.least("label", "far").alias("label")), "components")
        labels = step.select("node", "label")
        if step.filter("old <> label").isEmpty():
            return labels


def roots(merges: DataFrame) -> DataFrame:
    """(absorbed, root): the end of each chain of merges (absorbed, canonical); chains that close on themselves end at their smallest id."""
    hops = written(merges.groupBy("absorbed").agg(F.min("canonical").alias("root")), "roots")
    while True:
        up = hops.select(F.col("absorbed").alias("via"), F.col("root").alias("far"))
        step = hops.join(up, hops["root"] == up["via"], "left")
        # a cycle shrinks to its smallest id instead of turning for ever
        back = F.col("far").isNotNull() & (F.col("via") != F.col("far"))
        step = step.select("absorbed", F.col("root").alias("old"), F.when(back & (F.col("far") == F.col("absorbed")), F.least("absorbed", "root")).when(back, F.col("far")).otherwise(F.col("root")).alias("root"))
        step = written(step, "roots")
        if step.filter("old <> root").isEmpty():
            return step.select("absorbed", "root")
        hops = step.select("absorbed", "root")


def merged_edges(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Edges pointed from absorbed entities to what absorbed them; loops stay."""
    to = roots(merges)
    out = edges
    for c in ("from_entity_id", "to_entity_id"):
        out = out.join(to.withColumnRenamed("absorbed", c), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
    return out.select(*edges.columns)


def merged_entities(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """Entities without the absorbed ones, whose appearances are added to those of what absorbed them."""
    to = roots(merges)
    gone = entities.join(to, F.col("id") == F.col("absorbed"))
    more = gone.groupBy(F.col("root").alias("id")).agg(F.sum("appearance_count").alias("more"))
    kept = entities.join(to.select(F.col("absorbed").alias("id")), "id", "left_anti").join(more, "id", "left")
    return kept.withColumn("appearance_count", F.col("appearance_count") + F.coalesce("more", F.lit(0))).select(*entities.columns)


def narrative(nodes: DataFrame) -> DataFrame:
    """One text from nodes (depth, position, name, kind, purpose, summary, blocks) in order: a heading of the first's name, then each node indented by depth."""
    pad = F.repeat(F.lit("  "), F.col("depth"))
    line = lambda *parts: F.concat(pad, *parts, F.lit("\n"))
    blocks = F.transform(F.coalesce("blocks", F.array().cast("array<string>")), lambda b, k: line(F.lit("  "), (k + 1).cast("string"), F.lit(". "), b))
    head = line(F.lit("## "), F.col("name"), F.lit(" (`"), F.col("kind"), F.lit("`)"))
    told = [F.coalesce(line(F.col(c)), F.lit("")) for c in ("purpose", "summary")]
    text = F.concat(head, *told, F.array_join(blocks, ""), F.lit("\n"))
    parts = nodes.agg(F.array_sort(F.collect_list(F.struct("depth", "position", F.col("name").alias("n"), text.alias("t")))).alias("parts"))
    body = F.array_join(F.transform("parts", lambda p: p["t"]), "")
    # fixed value: the heading
    return parts.filter(F.size("parts") > 0).select(F.regexp_replace(F.concat(F.lit("# Diegesis of "), F.col("parts")[0]["n"], F.lit("\n\n"), body), r"\s+$", "").alias("narrative"))


def ancestry(commits: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(ancestor, descendant) pairs, each commit with itself, from (id, parent): path doubling, so log2 of the depth in rounds."""
    own = commits.select(F.col("id").alias("ancestor"), F.col("id").alias("descendant"))
    hops = commits.filter("parent is not null").select(F.col("parent").alias("ancestor"), F.col("id").alias("descendant")).distinct()
    paths = written(own.union(hops).distinct(), "ancestry")
    n = paths.count()
    for _ in range(max_rounds):
        left, right = paths.select("ancestor", F.col("descendant").alias("mid")), paths.select(F.col("ancestor").alias("mid"), "descendant")
        paths = written(left.join(right, "mid").select("ancestor", "descendant").distinct(), "ancestry")
        if (m := paths.count()) == n:
            break
        n = m
    return paths


def first_parent_chain(commits: DataFrame, head: str, start: str | None = None) -> DataFrame:
    """The commits (id, position) from start, or the root, to head along first parents (id, parent), oldest first.

    Jumps double each round, so a chain of n commits takes log2(n) rounds.
    """
    jumps = written(commits.filter("parent is not null").groupBy("id").agg(F.min("parent").alias("up")), "chain-jumps")
    chain = written(commits.filter(F.col("id") == head).select("id", F.lit(0).cast("long").alias("back")).distinct(), "chain")
    for k in range(62):
        ahead = chain.join(jumps, "id").select(F.col("up").alias("id"), (F.col("back") + (1 << k)).alias("back"))
        longer = written(chain.union(ahead), "chain")
        if ahead.isEmpty():
            break
        chain = longer
        far = jumps.select(F.col("id").alias("via"), F.col("up").alias("far"))
        jumps = written(jumps.join(far, jumps["up"] == far["via"]).select("id", F.col("far").alias("up")), "chain-jumps")
    if start is not None:
        end = chain.filter(F.col("id") == start).select("back").first()
        if end is None:
            raise ValueError(f"{start} is not on the first-parent chain of {head}")
        chain = chain.filter(F.col("back") <= end[0])
    last = chain.agg(F.max("back").alias("last"))
    return chain.crossJoin(F.broadcast(last)).select("id", (F.col("last") - F.col("back")).alias("position")).orderBy("position")  # one row
