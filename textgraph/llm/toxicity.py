"""Toxicity by non-negative positive-unlabelled learning.

Positives are rows whose label says toxic; the unlabelled are all texts of the learning folds, whatever their label. A
logistic model over the presence of words and word prefixes is fitted in numpy by minimising the class-prior-corrected risk
    pi * E_p[l(+)] + max(0, E_u[l(-)] - pi * E_p[l(-)])
and, when the second term falls below zero, by stepping against it. The prior pi is the toxic share of the labelled rows;
nothing else is learned from labels of 0. Marks are the words and prefixes whose document frequency among the positives
exceeds that among all texts by a z-score; all that pass are kept. The unlabelled rows are dealt by a hash of their ids
into groups of about GROUP_ROWS, each is fitted on its own patterns of marks, and the weights are averaged by rows.

THRESHOLD is put at the cut with the best F1 as estimated from positives that the fit didn't see, the logits of all
unlabelled rows and the prior (`cut_of`).

Only rows whose crc32(doc_id) modulo 3 is not 1 are learned from; lang, source, labels and ids are no inputs of a score.
At most POSITIVES labelled rows are used; marks and patterns come from all rows, and every row is scored, whole.
Edge cases: a null or empty text has the score of no word; without positives every score is the prior, 0 at least;
a repeated doc_id with different labels counts as toxic; rows without a doc_id are unlabelled text of fold 0; repeated
rows count each; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chosen, documents, one_thread, remainder, written

#: Rows labelled toxic that are learned from, at most.
POSITIVES = 3_000
#: Unlabelled rows of a group.
GROUP_ROWS = 10_000
#: Beginnings of words whose marks a worker remembers; beyond, it starts anew.
REMEMBERED = 100_000
Z_LEAST, SHARE_LEAST = 4.0, 0.01
THRESHOLD = 0.7
#: Recall from which on the prior is estimated.
ENOUGH = 0.7
WORD = re.compile(r"[^\W\d_]+")
#: Blanks all of ASCII but its letters.
_BLANK = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
PREFIXES = (3, 4, 5, 6, 7)


def marks(word: str) -> list[str]:
    """What a word shows: itself and its prefixes, these with a dash. Prefixes catch inflected forms."""
    return [word, *(f"{word[:k]}-" for k in PREFIXES if len(word) >= k)]


class Finder:
    """The positions, in a list of marks, of those that texts show; remembers what beginnings of words show."""

    def __init__(self, wanted: list[str]):
        self.whole = {m: k for k, m in enumerate(wanted) if m[-1] != "-"}
        self.prefix = {m[:-1]: k for k, m in enumerate(wanted) if m[-1] == "-"}
        self.words = {m.encode() for m in self.whole if m.isascii()}
        self.heads = {m[: PREFIXES[0]].encode() for m in self.prefix if m.isascii()}
        self.shown: dict[bytes, tuple[int, ...]] = {}

    def _of(self, start: bytes) -> tuple[int, ...]:
        """The prefixes of an ASCII word that starts so, with PREFIXES[-1] letters if it has as many."""
        if start[: PREFIXES[0]] not in self.heads:
            return ()
        w = start.decode()
        return tuple(self.prefix[w[:n]] for n in PREFIXES if len(w) >= n and w[:n] in self.prefix)

    def __call__(self, text: str | None) -> set[int]:
        # no word goes across what is blanked; a run with letters beyond ASCII may hold several
        plain = (text or "").lower()
        runs, odd = set(plain.encode().translate(_BLANK).split()), ()
        if not plain.isascii():
            odd = {w for r in runs if not r.isascii() for w in WORD.findall(r.decode())}
            runs = {r for r in runs if r.isascii()}
        starts = {r[: PREFIXES[-1]] for r in runs}
        shown, whole = self.shown, self.whole
        if len(shown) > REMEMBERED:
            shown.clear()
        for start in starts.difference(shown):
            shown[start] = self._of(start)
        found = set().union(*filter(None, map(shown.__getitem__, starts)))
        found.update(whole[w.decode()] for w in self.words & runs)
        for w in odd:
            found.update(k for k in (whole.get(w), *(self.prefix.get(w[:n]) for n in PREFIXES if len(w) >= n)) if k is not None)
        return found


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float
    slope: float
    offset: float

    def scores(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.offset, -30, 30)))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def nnpu(xp: np.ndarray, xu: np.ndarray, nu: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, l2: float = 1e-4) -> np.ndarray:
    """Weights, and bias last, of the non-negative risk over the rows xp and the patterns xu (of nu rows each): Adam on the whole of both; logistic loss."""
    xp, xu = (np.c_[x, np.ones(len(x))].astype(np.float64) for x in (xp, xu))
    share = nu / nu.sum()
    w = np.zeros(xp.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        zp, zu = xp @ w, xu @ w
        sp, su = _sigmoid(zp), _sigmoid(zu)
        on_positive = xp.T @ (sp - 1) / len(xp)
        # the risk of calling unlabelled rows positive, less the part that truly is positive
        negative = share @ np.logaddexp(0, zu) - prior * np.logaddexp(0, zp).mean()
        on_negative = xu.T @ (su * share) - prior * (xp.T @ sp) / len(xp)
        grad = prior * on_positive + on_negative if negative >= 0 else -on_negative
        grad = grad + l2 * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def cut_of(positive: np.ndarray, levels: np.ndarray, rows: np.ndarray, prior: float) -> float:
    """The logit to cut at, from positives, the prior and the logits of unlabelled rows (`rows` of them at each of `levels`) alone.

    Recall is the positives' share above a cut, precision prior * recall / (share of the unlabelled above it). No precision
    exceeds 1, so the prior is at most the least of share / recall, taken where recall is ENOUGH or more. The cut has the
    best F1 and lies at a quarter of the gap between two levels, nearer to the upper one.
    """
    order = np.argsort(-levels, kind="stable")
    down, above = levels[order], np.cumsum(rows[order]) / rows.sum()
    recall = (positive[:, None] >= down[None]).mean(0)
    prior = min(prior, float((above / np.maximum(recall, 1e-12))[recall >= ENOUGH].min()))
    precision = np.minimum(1.0, prior * recall / above)
    k = int(np.argmax(2 * precision * recall / np.maximum(precision + recall, 1e-12)))
    return float((3 * down[k] + down[k + 1]) / 4 if k + 1 < len(down) else down[k] - 1.0)


def _texts(docs: DataFrame, extra: list[str]) -> DataFrame:
    return docs.select(*extra, F.coalesce("text", F.lit("")).alias("text"))


def _marked(rows: DataFrame, extra: dict[str, str], wanted: list[str] | None = None) -> DataFrame:
    """The extra columns and `marks` of each row: all of its text, or the positions in `wanted` of those that are there."""
    sent = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        find = Finder(sent.value) if sent.value is not None else None
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = part.column("text").to_pylist()
                if find is None:
                    made = pa.array([sorted({m for w in set(WORD.findall(t.lower())) for m in marks(w)}) for t in texts], pa.list_(pa.string()))
                else:
                    made = pa.array([sorted(find(t)) for t in texts], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in extra), made], names=[*extra, "marks"])

    schema = ", ".join([*(f"{c} {t}" for c, t in extra.items()), f"marks array<{'string' if wanted is None else 'long'}>"])
    return _texts(rows, list(extra)).mapInArrow(run, schema)


def _counted(rows: DataFrame, wanted: list[str]) -> np.ndarray:
    """How many rows show each of the wanted marks: added up in each task before anything is shuffled."""
    sent = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        find, n = Finder(sent.value), np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                for text in batch.slice(k, 500).column("text").to_pylist():
                    shown = find(text)
                    n[np.fromiter(shown, np.int64, len(shown))] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["mark", "n"])

    found = rows.select("text").mapInArrow(run, "mark long, n long").groupBy("mark").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(wanted), np.int64)
    out[found["mark"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def _dense(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.float32)
    for k, r in enumerate(rows):
        out[k, np.asarray(r, np.int64)] = 1
    return out


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of at most POSITIVES rows labelled toxic and of all rows of the learning folds as unlabelled text."""
    learned = remainder(F.col("doc_id"), 3) != 1
    known = labels.filter("toxic is not null").filter(learned).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    nothing = Model({}, 0.0, 1.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    if not 0 < share < 1:
        return nothing
    text = docs.select("doc_id", "text")
    # copies of one text would make its rare words look like marks
    positive = chosen(text, known.filter("toxic = 1"), POSITIVES, 1).groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    positive = written(positive.select(F.coalesce("text", F.lit("")).alias("text"), (F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(5)) == 0).alias("kept_out")), "toxic-positive")
    n_fit, n_out = (positive.filter(c).count() for c in ("not kept_out", "kept_out"))
    if not n_fit:
        return nothing
    if n_out < 20:  # too few to find a cut by
        positive, n_fit = positive.withColumn("kept_out", F.lit(False)), n_fit + n_out
    # a mark of one in a hundred positives at least, so that there are no more than a hundred times those of one text
    each = _marked(positive.filter("not kept_out"), {}).select(F.explode("marks").alias("mark"))
    least = max(2, int(np.ceil(SHARE_LEAST * n_fit)))
    found = each.groupBy("mark").agg(F.count("*").alias("n")).filter(F.col("n") >= least).orderBy("mark").toPandas()
    candidates, pn = found["mark"].tolist(), found["n"].to_numpy(np.float64)
    if not len(candidates):
        return nothing
    unlabelled = text.filter(learned)
    n_all = max(1, unlabelled.count())
    base = _counted(unlabelled, candidates) / n_all
    frequency = pn / n_fit
    z = (frequency - base) / np.sqrt(np.maximum(base, 1 / n_all) * (1 - base) / n_fit + 1e-12)
    wanted = [candidates[k] for k in np.flatnonzero(z > Z_LEAST)]
    if not len(wanted):
        return nothing
    # rows that show the same marks are one pattern; patterns are dealt into groups by their hash, each group with its share of every pattern
    groups = max(1, round(n_all / GROUP_ROWS))
    place = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(groups)).cast("int").alias("part")
    kind = docs.schema["doc_id"].dataType.simpleString()
    shown = _marked(unlabelled, {"doc_id": kind}, wanted).groupBy(place, "marks").agg(F.count("*").alias("n"))
    shown = written(shown, "toxic-patterns")
    seen = _marked(positive, {"kept_out": "boolean"}, wanted).orderBy("kept_out", "marks").collect()
    xp = _dense([r["marks"] for r in seen if not r["kept_out"]], len(wanted))
    sent = docs.sparkSession.sparkContext.broadcast(xp)

    def one(table: pa.Table) -> pa.Table:
        one_thread()
        rows = sorted(zip(table.column("marks").to_pylist(), table.column("n").to_pylist()))
        w = nnpu(sent.value, _dense([m for m, _ in rows], sent.value.shape[1]), np.array([n for _, n in rows], float), share)
        return pa.table({"used": pa.array([sum(n for _, n in rows)], pa.int64()), "w": pa.array([w], pa.list_(pa.float64()))})

    # groups are small in bytes but long to fit: adaptive execution would put them into few tasks
    made = shown.repartition(groups, "part").groupBy("part").applyInArrow(one, "used long, w array<double>")
    mean = made.select("used", F.posexplode("w").alias("k", "v")).groupBy("k").agg((F.sum(F.col("v") * F.col("used")) / F.sum("used")).alias("v")).orderBy("k").toPandas()
    w = mean["v"].round(9).to_numpy(float)
    weights = dict(zip(wanted, w[:-1].tolist(), strict=True))
    # the logits of all unlabelled rows, in steps of a hundredth
    values = F.array(*map(F.lit, w[:-1].tolist()))
    logit = F.aggregate("marks", F.lit(float(w[-1])), lambda t, k: t + F.element_at(values, (k + 1).cast("int")))
    levels = shown.groupBy(F.round(logit, 2).alias("z")).agg(F.sum("n").alias("n")).orderBy("z").toPandas()
    held = _dense([r["marks"] for r in seen if r["kept_out"] or n_out < 20], len(wanted)) @ w[:-1] + w[-1]
    cut = cut_of(np.round(held, 2), levels["z"].to_numpy(float), levels["n"].to_numpy(float), share)
    return Model(weights, float(w[-1]), 1.0, float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut))


def scorer(model: Model):
    """Scores lists of texts."""
    find, weights = Finder(list(model.weights)), list(model.weights.values())

    def score(texts: list[str | None]) -> np.ndarray:
        # in order of weight, so that equal texts have equal scores on any executor
        logits = [model.bias + sum(sorted(map(weights.__getitem__, find(t)))) for t in texts]
        return model.scores(np.array(logits, float))

    return score


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = scorer(sent.value)
        for batch in batches:
            found = score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with all their columns, without the rows that score threshold or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = scorer(sent.value)
        for texts in parts:
            yield pd.Series(own(texts.tolist()))

    return docs.filter(score(F.col("text")) < threshold)


def query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs, fit(docs, labels))
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(spark, documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
