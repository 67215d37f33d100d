"""Ancestry of commits by labels: chains of first parents with positions, and links between chains.

Each commit lies on one chain, at one position; all commits before it on its chain are its ancestors. The parent edges
that don't follow a chain (forks and merges) are links: from a position on one chain to one on another. So what a commit
descends from is, for each chain that it reaches, all up to one position, and what descends from it all from one position
on. Both are found over the links alone, a row for each chain. A round follows every link once, so there are as many as
links that a path must follow one after another: few where side branches come back to a main line, but many where side
branches merge into each other in a long row. The labels take a row a commit, and no pairs are ever written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written

#: Lists of up to so many hops are followed by doubling alone; of longer ones hops are first taken out in so many rounds.
FEW, ROUNDS = 200_000, 8


@dataclass
class Labels:
    """places: (id, chain, pos); links: (chain, at, other, upto): from `at` on, a chain holds `other` up to `upto`."""

    places: DataFrame
    links: DataFrame


def labelled(commits: DataFrame) -> Labels:
    """Labels of commits (id, parent), a row for each parent and one with a null parent for a root; with a column nth, 0 tells the first parent, else it is the smallest.

    A parent that isn't among the commits is taken as one of its own, without parents.
    """
    edges = commits.filter("parent is not null")
    first = F.min_by("parent", "nth") if "nth" in commits.columns else F.min("parent")
    edges = written(edges.select("id", "parent", *(["nth"] if "nth" in commits.columns else [])).distinct(), "parent-edges")
    up = edges.groupBy("id").agg(first.alias("up"))
    up = written(up, "first-parents")
    ids = commits.select("id").union(edges.select("parent")).distinct()
    # of several commits on one first parent, that with most behind it carries on its chain, so that few chains lie between any commit and its root
    heirs = up.join(_behind(ids, up), "id").groupBy("up").agg(F.max_by("id", F.struct("behind", "id")).alias("id"))
    hops = _ended(heirs.select("id", F.col("up").alias("to"), F.lit(1).cast("long").alias("pos")))
    places = written(ids.join(hops, "id", "left").select("id", F.coalesce("to", "id").alias("chain"), F.coalesce("pos", F.lit(0)).cast("long").alias("pos")), "chain-places")
    below, above = places.select("id", "chain", F.col("pos").alias("at")), places.select(F.col("id").alias("parent"), F.col("chain").alias("other"), F.col("pos").alias("upto"))
    links = edges.select("id", "parent").join(below, "id").join(above, "parent").filter("chain <> other").groupBy("chain", "at", "other").agg(F.max("upto").alias("upto"))
    return Labels(places, written(links, "chain-links"))


def _ended(hops: DataFrame) -> DataFrame:
    """hops (id, to, pos), each followed to its end, an id without a hop of its own; pos adds up on the way.

    Of long lists some hops are first taken out, a quarter of them in each round, and looked up again at the end, so jumps
    that double each round go over few, and what is moved is in proportion to the list.
    """
    live, out = written(hops, "chain-hops"), []
    while len(out) < ROUNDS and live.count() > FEW:
        coin = lambda c, k=len(out): F.pmod(F.xxhash64(F.lit(k), c), F.lit(2)) == 1
        # of hops one after the other no two go at once
        goes = coin("id") & ~coin("to")
        gone = written(live.filter(goes), "chain-gone")
        stay = live.filter(~goes)
        near = gone.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("pos").alias("more"))
        stepped = stay.filter(coin("to")).join(near, "to", "left").select("id", F.coalesce("far", "to").alias("to"), (F.col("pos") + F.coalesce("more", F.lit(0))).alias("pos"))
        live = written(stay.filter(~coin("to")).union(stepped), "chain-hops")
        out.append(gone)
    while True:
        far = live.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("pos").alias("more"))
        step = written(live.join(far, "to", "left").select("id", F.coalesce("far", "to").alias("to"), (F.col("pos") + F.coalesce("more", F.lit(0))).alias("pos"), "more"), "chain-hops")
        live = step.drop("more")
        if step.filter("more is not null").isEmpty():
            break
    for gone in reversed(out):
        far = live.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("pos").alias("more"))
        found = gone.join(far, "to", "left").select("id", F.coalesce("far", "to").alias("to"), (F.col("pos") + F.coalesce("more", F.lit(0))).alias("pos"))
        live = live.union(written(found, "chain-found"))
    return live


def _behind(ids: DataFrame, up: DataFrame) -> DataFrame:
    """(id, behind): how many commits come after each along first parents, itself included.

    Commits that are the only one on their parent are drawn together with it, then those that nothing follows are added to
    their parents and leave, until none is left. Each time at most half as many ends are left. What a commit has behind it
    is what the first of those drawn together has, less what lies between.
    """
    tree = written(ids.join(up, "id", "left").select("id", "up", F.lit(1).cast("long").alias("w")), "chain-tree")
    levels = []
    while True:
        only = tree.filter("up is not null").groupBy("up").agg(F.count("*").alias("k"), F.min("id").alias("id")).filter("k = 1").select("id", F.col("up").alias("to"))
        drawn = written(_ended(only.join(tree.select(F.col("id").alias("to"), F.col("w").alias("pos")), "to").select("id", "to", "pos")), "chain-drawn")
        head = drawn.select("id", F.col("to").alias("head"))
        whole = tree.join(head, "id", "left").groupBy(F.coalesce("head", "id").alias("id")).agg(F.sum("w").alias("w"), F.min(F.when(F.col("head").isNull(), F.col("up"))).alias("up"))
        whole = written(whole.join(head.withColumnRenamed("id", "up"), "up", "left").select("id", F.coalesce("head", "up").alias("up"), "w"), "chain-tree")
        inner = whole.filter("up is not null").select(F.col("up").alias("id")).distinct()
        last = written(whole.join(inner, "id", "left_anti"), "chain-last")
        levels.append((drawn, last.select("id", F.col("w").alias("behind"))))
        more = last.filter("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("w").alias("more"))
        tree = written(whole.join(inner, "id", "left_semi").join(more, "id", "left").select("id", "up", (F.col("w") + F.coalesce("more", F.lit(0))).alias("w")), "chain-tree")
        if tree.isEmpty():
            break
    sizes = None
    for drawn, last in reversed(levels):
        first = last if sizes is None else last.union(sizes)
        rest = drawn.join(first.select(F.col("id").alias("to"), "behind"), "to").select("id", (F.col("behind") - F.col("pos")).alias("behind"))
        sizes = first.union(written(rest, "chain-sizes"))
    return sizes


def _spread(start: DataFrame, ahead, best) -> DataFrame:
    """(chain, pos) that no step of ahead improves any more."""
    reach = written(start, "reach")
    frontier = reach
    while True:
        found = ahead(frontier).groupBy("chain").agg(best("pos").alias("pos"))
        known = reach.select("chain", F.col("pos").alias("old"))
        better = F.col("old").isNull() | (best("pos", "old") != F.col("old"))
        frontier = written(found.join(known, "chain", "left").filter(better).drop("old"), "reach-step")
        if frontier.isEmpty():
            return reach
        reach = written(reach.union(frontier).groupBy("chain").agg(best("pos").alias("pos")), "reach")


def _most(*c):
    return F.max(*c) if len(c) == 1 else F.greatest(*c)


def _least(*c):
    return F.min(*c) if len(c) == 1 else F.least(*c)


def ancestors(labels: Labels, target: str) -> DataFrame:
    """(sha) of a commit and all that it descends from."""
    start = labels.places.filter(F.col("id") == target).select("chain", "pos")
    step = lambda f: labels.links.join(f, "chain").filter("at <= pos").select(F.col("other").alias("chain"), F.col("upto").alias("pos"))
    spans = _spread(start, step, _most).select("chain", F.col("pos").alias("upto"))
    return labels.places.join(spans, "chain").filter("pos <= upto").select(F.col("id").alias("sha"))


def descendants(labels: Labels, target: str) -> DataFrame:
    """(sha) of a commit and all that descend from it."""
    start = labels.places.filter(F.col("id") == target).select("chain", "pos")
    step = lambda f: labels.links.join(f.select(F.col("chain").alias("other"), "pos"), "other").filter("upto >= pos").select("chain", F.col("at").alias("pos"))
    spans = _spread(start, step, _least).select("chain", F.col("pos").alias("since"))
    return labels.places.join(spans, "chain").filter("pos >= since").select(F.col("id").alias("sha"))


def related(labels: Labels, pairs: DataFrame) -> DataFrame:
    """pairs (ancestor, descendant) with `holds`: whether the one is the other or comes before it. Spans are found for the distinct descendants at once."""
    own = labels.places.join(pairs.select(F.col("descendant").alias("id")).distinct(), "id").select(F.col("id").alias("descendant"), "chain", "pos")
    reach = written(own, "pair-reach")
    frontier = reach
    while True:
        found = labels.links.join(frontier, "chain").filter("at <= pos").groupBy("descendant", F.col("other").alias("chain")).agg(F.max("upto").alias("pos"))
        known = reach.select("descendant", "chain", F.col("pos").alias("old"))
        frontier = written(found.join(known, ["descendant", "chain"], "left").filter("old is null or pos > old").drop("old"), "pair-step")
        if frontier.isEmpty():
            break
        reach = written(reach.union(frontier).groupBy("descendant", "chain").agg(F.max("pos").alias("pos")), "pair-reach")
    at = labels.places.select(F.col("id").alias("ancestor"), "chain", F.col("pos").alias("at"))
    out = pairs.join(at, "ancestor", "left").join(reach, ["descendant", "chain"], "left")
    return out.select("ancestor", "descendant", F.coalesce(F.col("at") <= F.col("pos"), F.lit(False)).alias("holds"))
