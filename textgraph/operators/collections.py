"""Nested collections, links across corpora, and candidates for links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalise_name
from ..storage import written
from .graph import components


def resolved(members: DataFrame, collection: str) -> DataFrame:
    """(corpus_id, position): the corpora below a collection, depth first, members by name, each once; cycles are cut. Collections are named by people, so few."""
    spark, found = members.sparkSession, []
    level = spark.createDataFrame([(collection, [collection])], "id string, path array<string>")
    while True:
        below = members.join(level, members["collection_id"] == level["id"]).filter(~F.array_contains("path", F.col("member_id")))
        below = written(below.select("member_id", "member_type", F.array_append("path", F.col("member_id")).alias("path")), "collection-level")
        if below.isEmpty():
            break
        found.append(below.filter("member_type = 'corpus'").select(F.col("member_id").alias("corpus_id"), "path"))
        level = below.filter("member_type = 'collection'").select(F.col("member_id").alias("id"), "path")
    every = reduce(DataFrame.union, found) if found else spark.createDataFrame([], "corpus_id string, path array<string>")
    first = every.groupBy("corpus_id").agg(F.min("path").alias("path"))
    return first.select("corpus_id", (F.row_number().over(Window.orderBy("path")) - 1).alias("position"))


def corpora_below(members: DataFrame) -> DataFrame:
    """(collection_id, corpus_id): the corpora below each collection, once each; all collections take each step together."""
    nested = members.filter("member_type = 'collection'").select(F.col("collection_id").alias("node"), "member_id")
    seen = written(members.select("collection_id", F.col("collection_id").alias("node")).distinct(), "nested")
    step = seen
    while True:
        ahead = step.join(nested, "node").select("collection_id", F.col("member_id").alias("node")).distinct()
        step = written(ahead.join(seen, ["collection_id", "node"], "left_anti"), "nested-step")
        if step.isEmpty():
            break
        seen = written(seen.union(step), "nested")
    own = members.filter("member_type = 'corpus'").select(F.col("collection_id").alias("node"), F.col("member_id").alias("corpus_id"))
    return seen.join(own, "node").select("collection_id", "corpus_id").distinct()


def same_as(links: DataFrame) -> DataFrame:
    """(node, label) over the same_as links (a, b, link_kind)."""
    return components(links.filter("link_kind = 'same_as'").select("a", "b"))


def linked(links: DataFrame, kinds: list[str]) -> DataFrame:
    """Both directions of links of the kinds, without loops."""
    own = links.filter(F.col("link_kind").isin(kinds) & (F.col("a") != F.col("b")))
    return own.select("a", "b", "link_kind").union(own.select(F.col("b").alias("a"), F.col("a").alias("b"), "link_kind")).distinct()


def overview(members: DataFrame, counts: DataFrame, links: DataFrame, collection: str) -> DataFrame:
    """One row: totals over the corpora below, and links by kind as a sorted map."""
    totals = counts.join(resolved(members, collection), counts["id"] == F.col("corpus_id")).agg(F.count("*").alias("corpora"), *(F.sum(c).alias(c) for c in counts.columns if c.endswith("_count")))
    kinds = links.groupBy("link_kind").agg(F.count("*").alias("n")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("link_kind", "n"))))).alias("links"))
    return totals.crossJoin(F.broadcast(kinds))  # one row each


def resolve_entity(named: DataFrame, links: DataFrame) -> DataFrame:
    """Candidates (id) by name, without those that another candidate links to by another kind than same_as; with their class."""
    forward = links.filter("link_kind <> 'same_as'")
    ids = named.select("id").distinct()
    demoted = forward.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi").filter("a <> b").select(F.col("b").alias("id")).distinct()
    kept = named.join(demoted, "id", "left_anti")
    classes = same_as(links)
    others = classes.select("label", F.col("node").alias("other"))
    sets = classes.join(others, "label").filter("node <> other").groupBy(F.col("node").alias("id")).agg(F.array_sort(F.collect_set("other")).alias("same_as"))
    related = forward.groupBy(F.col("a").alias("id")).agg(F.array_sort(F.collect_set(F.concat_ws(":", "link_kind", "b"))).alias("related"))
    empty = F.array().cast("array<string>")
    return kept.join(sets, "id", "left").join(related, "id", "left").withColumn("same_as", F.coalesce("same_as", empty)).withColumn("related", F.coalesce("related", empty))


def meet_across(edges: DataFrame, a: DataFrame, b: DataFrame, links: DataFrame) -> DataFrame:
    """Locations that both hold: each side's ids (id) with their same_as classes."""
    classes = same_as(links)

    def side(ids: DataFrame) -> DataFrame:
        label = ids.join(classes, ids["id"] == classes["node"], "left").select(F.coalesce("label", "id").alias("label")).distinct()
        every = label.join(classes, "label").select(F.col("node").alias("id")).union(ids.select("id")).distinct()
        ends = edges.select("location_uri", F.col("from_entity_id").alias("id")).union(edges.select("location_uri", F.col("to_entity_id").alias("id")))
        return ends.join(every, "id", "left_semi").select("location_uri").distinct()

    return side(a).intersect(side(b))


def _without(name: Column, *places: Column) -> Column:
    """name without the characters at these places, which rise."""
    parts, start = [], F.lit(0)
    for k in places:
        parts.append(F.substr(name, start + 1, k - start))
        start = k + 1
    return F.concat(*parts, F.substr(name, start + 1))


def _at(name: Column, k: Column) -> Column:
    return F.substr(name, k + 1, F.lit(1))


def _cuts(names: DataFrame, name: str, first: bool, single: bool, double: bool) -> DataFrame:
    """names, a row for each cut, with (i, j, key, gone): the name without one character (j is -1) or two. Of places in a run of one character only the first where `first` is true, as all give the same key."""
    n, i, j, text = F.length(name), F.col("i"), F.col("j"), F.col(name)
    # places are rows before anything is cut, so cutting is compiled
    out = names.withColumn("i", F.explode(F.sequence(F.lit(0), n - 1)))
    if first:
        out = out.filter((i == 0) | (_at(text, i) != _at(text, i - 1)))
    ahead = F.when(i < n - 1, F.sequence(i + 1, n - 1)).otherwise(F.array().cast("array<int>"))
    alone = F.array(F.lit(-1))
    out = out.withColumn("j", F.explode(F.concat(alone, ahead) if single and double else alone if single else ahead))
    key = F.when(j < 0, _without(text, i)).otherwise(_without(text, i, j))
    gone = F.when(j < 0, _at(text, i)).otherwise(F.concat(_at(text, i), _at(text, j)))
    return out.withColumn("key", key).withColumn("gone", gone)


def link_candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id_a, id_b, confidence): HIGH for equal normalised names, MEDIUM for names at most two edits apart within one abstract kind.

    A kind's names aren't compared all with all, and each name is looked up once:
    - names of one length that differ at one or two places are equal without them and have others there, so each such pair is met once, at those places;
    - others of one length are equal without one character each, and few pairs share two such keys;
    - of different lengths, the longer without two characters is the shorter, or that without one. Only lengths that the other side has are cut.
    """

    def side(df, s):
        name = normalise_name(F.col("canonical_name"))
        return df.select(F.col("id").alias(f"id_{s}"), F.col("abstract_kind").alias(f"kind_{s}"), name.alias(f"name_{s}")).filter(F.col(f"name_{s}") != "")

    left, right = side(a, "a"), side(b, "b")
    high = left.join(right, F.col("name_a") == F.col("name_b")).select("id_a", "id_b", F.lit("HIGH").alias("confidence"))

    tasks = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), a.sparkSession.sparkContext.defaultParallelism)

    def names(df, s):
        """(kind, name, length, id, many): each name once, with its id, or one of many. The files are small and their keys are not, so they are dealt over all tasks."""
        own = df.filter(f"kind_{s} <> ''").groupBy(F.col(f"kind_{s}").alias("kind"), F.col(f"name_{s}").alias("name")).agg(F.min(f"id_{s}").alias("id"), (F.count("*") > 1).alias("many"))
        return written(own.withColumn("length", F.length("name")), "link-names").repartition(tasks)

    x, y = names(left, "a"), names(right, "b")
    lengths = {s: written(df.select("kind", "length").distinct(), "link-lengths") for s, df in (("a", x), ("b", y))}
    other = {"a": "b", "b": "a"}
    met = ["kind", *(f"{c}_{s}" for s in ("a", "b") for c in ("name", "id", "many"))]

    def keys(df, s, more, cuts=None):
        """(kind, i_s, j_s, key, gone_s, name_s, id_s, many_s) of the names that are `more` characters longer than some on the other side. No file tells how many these are, so none is broadcast."""
        fit = lengths[other[s]].select("kind", (F.col("length") + more).alias("length"))
        own = df.join(fit, ["kind", "length"], "left_semi").select("kind", *(F.col(c).alias(f"{c}_{s}") for c in ("name", "id", "many")))
        if cuts is None:
            return own.withColumn("key", F.col(f"name_{s}")).hint("merge")
        return _cuts(own, f"name_{s}", *cuts).withColumnsRenamed({c: f"{c}_{s}" for c in ("i", "j", "gone")}).hint("merge")

    # of one length: other characters at one or two places
    placed = lambda df, s: keys(df, s, 0, (False, True, True)).withColumnsRenamed({f"i_{s}": "i", f"j_{s}": "j"}).hint("merge")
    apart = (_at(F.col("gone_a"), F.lit(0)) != _at(F.col("gone_b"), F.lit(0))) & ((F.col("j") < 0) | (_at(F.col("gone_a"), F.lit(1)) != _at(F.col("gone_b"), F.lit(1))))
    replaced = placed(x, "a").join(placed(y, "b"), ["kind", "i", "j", "key"]).filter(apart).select(*met)
    # of one length, and different at more places: one character moved, or two others at different ones
    one = (True, True, False)
    span = F.sequence(F.least("i_a", "i_b"), F.greatest("i_a", "i_b"))
    differ = F.size(F.filter(span, lambda k: _at(F.col("name_a"), k) != _at(F.col("name_b"), k)))
    shifted = keys(x, "a", 0, one).join(keys(y, "b", 0, one), ["kind", "key"]).filter((F.abs(F.col("i_a") - F.col("i_b")) > 1) & (differ > 2)).select(*met)
    # of different lengths
    two = (False, False, True)
    pairs = [keys(x, "a", 1, two).join(keys(y, "b", -1, one), ["kind", "key"]), keys(x, "a", -1, one).join(keys(y, "b", 1, two), ["kind", "key"]), keys(x, "a", 2, two).join(keys(y, "b", -2), ["kind", "key"]), keys(x, "a", -2).join(keys(y, "b", 2, two), ["kind", "key"])]
    unlike = reduce(DataFrame.union, [p.select(*met) for p in pairs]).filter(F.levenshtein("name_a", "name_b", 2) >= 0)
    near = replaced.union(shifted.union(unlike).distinct())
    for s, df, own in (("a", left, x), ("b", right, y)):
        if not own.filter("many").isEmpty():
            shared = own.filter("many").select(F.col("kind").alias(f"kind_{s}"), F.col("name").alias(f"name_{s}"))
            every = df.join(shared, [f"kind_{s}", f"name_{s}"], "left_semi").select(F.col(f"kind_{s}").alias("kind"), f"name_{s}", F.col(f"id_{s}").alias("each"))
            near = near.join(every, ["kind", f"name_{s}"], "left").withColumn(f"id_{s}", F.when(F.col(f"many_{s}"), F.col("each")).otherwise(F.col(f"id_{s}"))).drop("each")
    return high.union(near.select("id_a", "id_b", F.lit("MEDIUM").alias("confidence")))


def best_search(hits: DataFrame, limit: int = 20) -> DataFrame:
    """Hits of several corpora (corpus_id, uri, score), the best first."""
    return hits.orderBy(F.desc("score"), "corpus_id", "uri").limit(limit)
