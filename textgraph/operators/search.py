"""Ranked search: BM25 over postings, cosine over vectors, and their blend."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clamped_cosine
from ..storage import written

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
OVER_FETCH = 4


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


@dataclass(frozen=True)
class Query:
    """A parsed query: any of `either` must hold, each a list of (words that must all be there, words that mustn't all be there)."""

    either: tuple[tuple[tuple[tuple[str, ...], tuple[tuple[str, ...], ...]], ...], ...]

    @property
    def terms(self) -> list[str]:
        """The distinct words that count for the rank, in order."""
        return list(dict.fromkeys(w for group in self.either for have, _ in group for w in have))

    @property
    def words(self) -> list[str]:
        return list(dict.fromkeys([*self.terms, *(w for group in self.either for _, no in group for n in no for w in n)]))

    def holds(self, has: Callable[[str], Column]) -> Column:
        every = lambda words: reduce(Column.__and__, map(has, words))
        one = lambda have, no: reduce(Column.__and__, [every(have), *(~every(n) for n in no)])
        return reduce(Column.__or__, [reduce(Column.__and__, [one(*x) for x in group]) for group in self.either])


def parse_query(query: str) -> Query:
    """Words side by side must all be there; then NOT binds tightest, then AND, then OR (all uppercase). Operators without a side are dropped."""
    groups: list[list[tuple[list[str], list[list[str]]]]] = [[([], [])]]
    into = groups[0][0][0]
    for part in re.sub("[^A-Za-z0-9_-]+", " ", query).split():
        if part == "OR":
            groups.append([([], [])])
            into = groups[-1][-1][0]
        elif part == "AND":
            groups[-1].append(([], []))
            into = groups[-1][-1][0]
        elif part == "NOT":
            groups[-1][-1][1].append([])
            into = groups[-1][-1][1][-1]
        else:
            into += [w for w in part.lower().replace("-", "_").split("_") if w]
    kept = [[(tuple(have), tuple(tuple(n) for n in no if n)) for have, no in group if have] for group in groups]
    return Query(tuple(tuple(group) for group in kept if group))


def keyword(chunks: DataFrame, query: str, limit: int = 20, position: str | None = None, corpus: str | None = None, within: DataFrame | None = None) -> DataFrame:
    """(uri, score, relevance): the best `limit` chunks by BM25 that the query holds for, by rank; those after position are then dropped.

    Only the terms of the query leave the scan: a chunk contributes one row, its length and the counts of the terms, so
    the statistics are one aggregate over all corpora and nothing else is shuffled.
    """
    asked = parse_query(query)
    if not asked.either:
        return chunks.select(F.col("location_uri").alias("uri"), F.lit(0.0).alias("score"), F.lit(0.0).alias("relevance")).limit(0)
    terms, number = asked.terms, {w: k for k, w in enumerate(asked.words)}
    words = chunks.select("location_uri", "corpus_id", tokens(F.col("content")).alias("w"))

    def frequency(word: str) -> Column:
        return F.size(F.filter("w", lambda x: x == word))

    tf = [frequency(w).alias(f"tf{k}") for w, k in number.items()]
    # texts are taken apart once: the counts serve the statistics and the ranks
    rows = written(words.select("location_uri", "corpus_id", F.size("w").alias("dl"), *tf), "search-counts")
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.sum((F.col(f"tf{number[t]}") > 0).cast("long")).alias(f"df{number[t]}") for t in terms))
    return ranked(rows, stats, asked, number, limit, position, corpus, within)


def ranked(rows: DataFrame, stats: DataFrame, asked: Query, number: dict[str, int], limit: int, position: str | None, corpus: str | None, within: DataFrame | None) -> DataFrame:
    scored = rows.filter(asked.holds(lambda w: F.col(f"tf{number[w]}") > 0)).crossJoin(F.broadcast(stats))  # one row of statistics
    score = F.lit(0.0)
    for k in (number[t] for t in asked.terms):
        f, df = F.col(f"tf{k}").cast("double"), F.col(f"df{k}").cast("double")
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    found = scored.filter(F.col("corpus_id") == corpus) if corpus else scored
    found = found.join(within, "corpus_id", "left_semi") if within is not None else found
    top = found.select(F.col("location_uri").alias("uri"), F.round(score, 6).alias("score")).orderBy(F.desc("score"), "uri").limit(limit)
    return scoped(normalised(top), position)


def normalised(top: DataFrame) -> DataFrame:
    """relevance: scores scaled to [0, 1] over the rows at hand, 1 where all are equal."""
    ends = top.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    out = top.crossJoin(F.broadcast(ends))
    return out.withColumn("relevance", F.round(F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0), 6)).drop("lo", "hi")


def scoped(rows: DataFrame, position: str | None) -> DataFrame:
    return rows.filter(F.col("uri") <= position) if position else rows


def semantic(vectors: DataFrame, query: list[float], limit: int = 20, position: str | None = None) -> DataFrame:
    """(uri, score): the nearest vectors (uri, vector) by clamped cosine; the scope comes before the limit."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = scoped(vectors, position).select("uri", F.round(clamped_cosine(F.col("vector"), q), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "uri").limit(limit)


def hybrid(chunks: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], limit: int = 20, alpha: float = 0.5, position: str | None = None) -> DataFrame:
    """blended, of the chunks' own keyword hits."""
    return blended(keyword(chunks, query, OVER_FETCH * limit, position), vectors, query_vector, limit, alpha, position)


def blended(hits: DataFrame, vectors: DataFrame, query_vector: list[float], limit: int = 20, alpha: float = 0.5, position: str | None = None) -> DataFrame:
    """alpha * semantic + (1 - alpha) * keyword relevance, over four times the limit of each; a missing side counts 0."""
    a = min(1.0, max(0.0, alpha))
    words = hits.select("uri", F.col("relevance").alias("kw"))
    near = semantic(vectors, query_vector, OVER_FETCH * limit, position).select("uri", F.col("score").alias("sem"))
    both = words.join(near, "uri", "full_outer")
    score = a * F.coalesce("sem", F.lit(0.0)) + (1 - a) * F.coalesce("kw", F.lit(0.0))
    return both.select("uri", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "uri").limit(limit)
