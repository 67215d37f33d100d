"""Quality rules: a learned decision list over statistics of a text.

Sequential covering on labelled statistics: a rule grows as a conjunction of thresholds by FOIL gain on two thirds of the
rows, is pruned from its end on the other third by (p - n) / (p + n), and takes the rows that it covers away. Rules that
don't hold on the pruning rows end the list. The list is emitted as one ordered Spark CASE expression.

The list is fitted on the driver from at most LABELLED_ROWS labelled rows; statistics cover every row. Edge cases: a null
or empty text has all statistics 0 and fails the base rules; without labels of both kinds there is no rule, and what
passes the base rules is kept; labels of a repeated doc_id count once, as bad if any says so; other columns are kept by
`with_statistics`; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, chosen, documents

LABELLED_ROWS = 20_000
MAX_RULES, MAX_CONDITIONS, CUTS = 12, 4, 48
#: A rule must be right this often, on the pruning rows, and cover so many bad rows there.
PRECISION, COVER = 0.9, 3
SYMBOLS = "#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_digits", "n_lines", "n_distinct"]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window which the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    pairs = np.unique(x[:-1] * len(ids) + x[1:], return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * len(ids) + x[2:]
    _, which, count = np.unique(windows, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[which] > 1)
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[at + k] = True
    return int(covered.sum())


def statistics(text: str) -> list[int]:
    raw = text.encode()
    words = raw.split()  # of bytes: splits at exactly \x20 \x09-\x0D
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return [
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        sum(map(raw.count, (b"%d" % k for k in range(10)))),
        len(lines),
        len(set(words)),
    ]


def with_statistics(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns of docs and the statistics of each row's text."""
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns] + [f"{c} long" for c in COUNTS])

    def run(batches):
        for batch in batches:
            rows = [statistics(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
            made = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(columns))), *made], names=[*columns, *COUNTS])

    return docs.select(*columns, F.col("text").alias("text")).mapInArrow(run, schema)


#: Features: a count, or one over another in per mille.
FEATURES = {"n_words": ("n_words", None), "word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "digits": ("n_digits", "word_chars"), "words_a_line": ("n_words", "n_lines"), "variety": ("n_distinct", "n_words")}


def feature(name: str) -> Column:
    a, b = FEATURES[name]
    return F.col(a).cast("double") if b is None else F.coalesce(F.try_divide(F.col(a) * F.lit(1000.0), F.col(b)), F.lit(0.0))


def feature_matrix(rows: dict[str, np.ndarray]) -> np.ndarray:
    def one(a, b):
        return rows[a].astype(float) if b is None else np.divide(rows[a] * 1000.0, rows[b], out=np.zeros(len(rows[a])), where=rows[b] != 0)

    return np.stack([one(*FEATURES[f]) for f in FEATURES], 1)


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, list(FEATURES).index(self.feature)]
        return v >= self.cut if self.at_least else v <= self.cut

    def column(self) -> Column:
        return feature(self.feature) >= self.cut if self.at_least else feature(self.feature) <= self.cut


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, (c.holds(x) for c in rule), np.ones(len(x), bool))


def _grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    rule, inside = (), np.ones(len(x), bool)
    while len(rule) < MAX_CONDITIONS and (inside & ~bad).any():
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        best = (1e-9, None)
        for name, v in zip(FEATURES, x.T):
            for cut in np.unique(np.quantile(v[inside], np.linspace(0, 1, CUTS), method="nearest")):
                for at_least in (True, False):
                    c = Condition(name, at_least, float(cut))
                    held = inside & c.holds(x)
                    p1, n1 = (held & bad).sum(), (held & ~bad).sum()
                    if p1:
                        gain = p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))
                        best = max(best, (gain, c), key=lambda g: g[0])
        if best[1] is None:
            break
        rule += (best[1],)
        inside &= best[1].holds(x)
    return rule


def _worth(rule: Rule, x: np.ndarray, bad: np.ndarray) -> tuple[float, int, float]:
    held = covers(rule, x)
    p, n = int((held & bad).sum()), int((held & ~bad).sum())
    return ((p - n) / (p + n) if p + n else -1.0), p, p / (p + n) if p + n else 0.0


def learn(x: np.ndarray, bad: np.ndarray, seed: int = 7) -> list[Rule]:
    """An ordered list of rules, each of which rejects what it covers."""
    rules: list[Rule] = []
    chance = np.random.default_rng(seed)
    while len(rules) < MAX_RULES and bad.sum() >= 2 * COVER and not bad.all():
        growing = chance.random(len(x)) < 2 / 3
        rule = _grow(x[growing], bad[growing])
        if not rule:
            break
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: _worth(r, x[~growing], bad[~growing])[0])
        _, p, precision = _worth(rule, x[~growing], bad[~growing])
        if p < COVER or precision < PRECISION:
            break
        rules.append(rule)
        rest = ~covers(rule, x)
        x, bad = x[rest], bad[rest]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """true for what no rule rejects: the rules in order, as one conditional expression."""
    expr = F
    for rule in rules:
        expr = expr.when(reduce(Column.__and__, (c.column() for c in rule)), F.lit(False))
    return expr.otherwise(F.lit(True)) if rules else F.lit(True)


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS) -> list[Rule]:
    ids = labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = with_statistics(chosen(docs.select("doc_id", "text"), ids, most), ["doc_id", "quality"])
    found = rows.orderBy(F.xxhash64("doc_id"), "doc_id", *COUNTS).limit(most).toPandas()
    if found.empty:
        return []
    x = feature_matrix({c: found[c].to_numpy() for c in COUNTS})
    return learn(x, found["quality"].to_numpy() == 0)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    rules = fit(docs, labels)
    out = with_statistics(docs, ["doc_id"]).withColumn("base_failed", base_failed())
    return out.select("doc_id", *COUNTS[:5], "base_failed", (~F.col("base_failed") & verdict(rules)).alias("kept"))


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(spark, documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
