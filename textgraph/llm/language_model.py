"""Scores of whole documents by a gated recurrent language model, beside a unigram base.

Documents are packed into chunks: the distinct words of about CHUNK_TOKENS tokens, and the documents as indices into
them. A corpus-wide word count then moves one row for each distinct word of a chunk, not one for each token, and the
counts come back to each chunk as one array. Everything that is counted covers all training documents.

The model's symbols are the end, the TOP most frequent words and RARE classes of other words (by their last two
letters). A gated recurrent network predicts the next symbol through a class-factored softmax: a class of symbols, then
the symbol within it. Within a rare class, words follow their smoothed counts. Weights are fitted by truncated
backpropagation through windows of WINDOW steps, with the state carried from window to window, on all training
documents: these are dealt by a hash of their ids into groups of about GROUP_TOKENS tokens, each group is read once in
the order of that hash, BUFFER tokens at a time, and the groups' weights are averaged by token counts, once after a
first TRAIN_SHARE and again after all the rest. The groups depend on the documents alone, not on how files are split.

Scoring runs whole documents side by side, longest first, in windows that hand on their state.
Edge cases: a null or empty text is the end token alone; a null doc_id counts as held out; without training documents
all counts are 0 and the model is the initial one; repeated rows repeat; other columns aren't read; empty tables work.
"""

from __future__ import annotations

import pickle
import zlib
from collections import defaultdict
from contextlib import contextmanager
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, bucketed, one_thread, remainder, slots, written

TOP, RARE = 1500, 48
EMBED, HIDDEN = 12, 24
FIRST, CLASSES = 40, 20
CHUNK_TOKENS = 3_000_000
WINDOW, STREAMS = 16, 384
TRAIN_SHARE = (0.05, 0.95)
GROUP_TOKENS, BUFFER = 2_500_000, 500_000
#: Weight vectors that one task adds up.
FAN_IN = 32
RATE, CLIP = 0.01, 1.0
SEED = 17

_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def rare_class(word: str) -> int:
    return zlib.crc32(word[-2:].encode()) % RARE


# chunks


def chunks(docs: DataFrame, tokens: int = CHUNK_TOKENS) -> DataFrame:
    """One row a chunk: its distinct words, their counts in training documents, and its documents."""
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        fresh = lambda: defaultdict(count().__next__)
        ids: dict[bytes, int] = fresh()
        own, marks, keep, at, held = [], [], [], [], 0

        def row():
            nonlocal seq, ids, own, marks, keep, at, held
            flat = np.concatenate(at)
            lens = np.array([len(a) for a in at], np.int64)
            train = np.repeat(np.array(keep, bool), lens)
            n = np.bincount(flat[train], minlength=len(ids))
            # words hold no space
            made = pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + seq], pa.int64()), pa.array([b" ".join(ids).decode()]), pa.array([n.astype(np.int32)], pa.list_(pa.int32())), pa.array([flat.astype("<u4").tobytes()], pa.binary()), pa.array([lens.tobytes()], pa.binary()), pa.array([np.array(keep, np.uint8).tobytes()], pa.binary()), pa.array([np.array(marks, "<i8").tobytes()], pa.binary()), pa.array([own], pa.list_(batch.schema.field("doc_id").type))],
                names=["chunk", "words", "n_train", "flat", "lens", "train", "marks", "ids"],
            )
            seq, ids, own, marks, keep, at, held = seq + 1, fresh(), [], [], [], [], 0
            return made

        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            for doc_id, mark, train, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "train")), texts, strict=True):
                words = (text or b"").translate(_LOWER).split()
                at.append(np.fromiter(map(ids.__getitem__, words), np.uint32, len(words)))
                own.append(doc_id)
                marks.append(mark)
                keep.append(train)
                held += len(words) + 1
                if held >= tokens:
                    yield row()
        if own:
            yield row()

    rows = docs.select("doc_id", F.xxhash64(F.lit(SEED), "doc_id").alias("mark"), (remainder(F.col("doc_id"), 10) != 0).alias("train"), "text")
    return rows.mapInArrow(run, f"chunk long, words string, n_train array<int>, flat binary, lens binary, train binary, marks binary, ids array<{kind.simpleString()}>")


# the network


def by_gate(a: np.ndarray) -> np.ndarray:
    """(n, 3 * HIDDEN) as (3, n, HIDDEN); those of z and r with the sign that their exponential takes."""
    made = np.array(a.reshape(-1, 3, HIDDEN).swapaxes(0, 1), order="C")
    np.negative(made[:2], out=made[:2])
    return made


class Model:
    """Symbols 0: end, 1 .. RARE: rare classes, then words by falling count."""

    def __init__(self, top: list[str], counts: np.ndarray, rare_counts: np.ndarray, end: int):
        self.index = {w: RARE + 1 + k for k, w in enumerate(top)}
        freq = np.concatenate([[end], rare_counts, counts]).astype(float) + 1.0
        n = len(freq)
        order = np.argsort(-freq, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        # the most frequent symbols are a small class of their own, the others CLASSES of one size
        self.size = max(FIRST, -(-(n - FIRST) // CLASSES))
        self.kls = np.where(place < FIRST, 0, 1 + (place - FIRST) // self.size).astype(np.uint8)
        self.slot = np.where(place < FIRST, place, (place - FIRST) % self.size)
        self.n_classes = int(self.kls.max()) + 1
        self.width = np.bincount(self.kls, minlength=self.n_classes).tolist()
        chance = np.random.default_rng(SEED)
        draw = lambda *s: (chance.standard_normal(s) * 0.1).astype(np.float32)
        mass = np.bincount(self.kls, freq)
        within = np.full((self.n_classes, self.size), -1e9, np.float32)
        within[self.kls, self.slot] = np.log(freq / mass[self.kls])
        self.p = {
            "emb": draw(n, EMBED), "wx": draw(EMBED, 3 * HIDDEN), "wh": draw(HIDDEN, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32),
            "wc": draw(HIDDEN, self.n_classes) * 0, "bc": np.log(mass / mass.sum()).astype(np.float32), "ww": draw(self.n_classes, HIDDEN, self.size) * 0, "bw": within,
        }
        self.moments: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.steps = 0

    def table(self) -> np.ndarray:
        """What each symbol adds to the gates (gate, symbol, HIDDEN)."""
        made = np.matmul(self.p["emb"], by_gate(self.p["wx"]))
        made += by_gate(self.p["b"][None])
        return made

    @staticmethod
    def step(gates: np.ndarray, h: np.ndarray, wh: np.ndarray, u: np.ndarray, n: np.ndarray, new: np.ndarray) -> None:
        """One step from h into new; u gets z, r and what r is multiplied by, n the candidate. gates and wh are by_gate."""
        np.matmul(h, wh, out=u)
        zr = u[:2]
        zr += gates[:2]
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        np.multiply(u[1], u[2], out=n)
        n += gates[2]
        np.tanh(n, out=n)
        np.subtract(h, n, out=new)
        new *= u[0]
        new += n

    def output(self, h: np.ndarray, symbols: np.ndarray, grad: bool = False):
        """ln P of each symbol; with grad, also the gradients of its mean negative: of h, and of the output weights.

        States lie between -1 and 1, so the sum of the weights bounds the logits. Up to a bound of 40, biases are factors
        of the sums of exponentials and not added to each logit; beyond, they are added, and logits are clipped at 80.
        """
        p, real = self.p, np.arange(self.size) < np.array(self.width)[:, None]
        bound = max(float((np.abs(p["wc"]).sum(0) + np.abs(p["bc"])).max()), float((np.abs(p["ww"]).sum(1) + np.abs(p["bw"]))[real].max()))
        plain = bound > 40
        bc, bw = (np.zeros_like(p["bc"]), np.zeros_like(p["bw"])) if plain else (p["bc"], p["bw"])
        fc, fw = np.exp(bc), np.exp(bw)
        kls = self.kls.take(symbols)
        # all that follows is in the order of the classes
        order = np.argsort(kls, kind="stable")
        kls, slot, h = kls.take(order), self.slot.take(symbols).take(order), h.take(order, 0)
        bounds = np.searchsorted(kls, np.arange(self.n_classes + 1))
        rows = np.arange(len(h))
        ea = h @ p["wc"]
        if plain:
            ea += p["bc"]
            np.minimum(ea, 80, out=ea)
        flat, own = ea.reshape(-1), rows * self.n_classes + kls
        logp = flat.take(own) + bc.take(kls)
        np.exp(ea, out=ea)
        sa = ea @ fc
        logp -= np.log(sa)
        if grad:
            flat[own] -= sa / fc.take(kls)
            sa = 1 / (sa * len(h))
            g = {"wc": ((h * sa[:, None]).T @ ea) * fc, "bc": (sa @ ea) * fc, "ww": np.zeros_like(p["ww"]), "bw": np.zeros_like(p["bw"])}
            gh, within = (ea @ (p["wc"] * fc).T) * sa[:, None], p["ww"] * fw[:, None]
        room = np.empty(int(np.diff(bounds).max(initial=0)) * self.size, np.float32)
        for c, width in enumerate(self.width):
            at = slice(bounds[c], bounds[c + 1])
            hc, sc = h[at], slot[at]
            if not len(hc):
                continue
            flat = room[: len(hc) * width]
            e = np.matmul(hc, p["ww"][c, :, :width], out=flat.reshape(len(hc), width))
            if plain:
                e += p["bw"][c, :width]
                np.minimum(e, 80, out=e)
            own = rows[: len(hc)] * width + sc
            of_own = flat.take(own) + bw[c].take(sc)
            np.exp(e, out=e)
            se = e @ fw[c, :width]
            logp[at] += of_own - np.log(se)
            if grad:
                flat[own] -= se / fw[c].take(sc)
                se = 1 / (se * len(h))
                g["ww"][c, :, :width], g["bw"][c, :width] = (hc * se[:, None]).T @ e, se @ e
                gh[at] += (e @ within[c, :, :width].T) * se[:, None]
        back = np.empty_like(order)
        back[order] = rows
        if not grad:
            return logp.take(back)
        g["ww"] *= fw[:, None]
        g["bw"] *= fw
        return logp.take(back), gh.take(back, 0), g

    def window(self, symbols: np.ndarray, targets: np.ndarray, fresh: np.ndarray, h: np.ndarray):
        """One truncated window (steps, streams): mean loss, gradients and the state after it. fresh marks a document's start."""
        p, (steps, streams) = self.p, symbols.shape
        flat_symbols, wh = symbols.reshape(-1), by_gate(p["wh"])
        gates = self.table().take(flat_symbols, 1).reshape(3, steps, streams, HIDDEN)
        carry = (~fresh).astype(np.float32)[:, :, None]
        befores, states, ns = (np.empty((steps, streams, HIDDEN), np.float32) for _ in range(3))
        zs, rs, us = u = np.empty((3, steps, streams, HIDDEN), np.float32)
        for t in range(steps):
            np.multiply(h, carry[t], out=befores[t])
            self.step(gates[:, t], befores[t], wh, u[:, t], ns[t], states[t])
            h = states[t]
        logp, gout, g = self.output(states.reshape(-1, HIDDEN), targets.reshape(-1), grad=True)
        gout = gout.reshape(steps, streams, HIDDEN)
        # what a state's gradient is multiplied by on its way to each gate
        to_n = (1 - zs) * (1 - ns * ns)
        to_z = (befores - ns) * zs * (1 - zs)
        to_r = us * rs * (1 - rs)
        gu, gh, wht = np.empty((steps, streams, 3 * HIDDEN), np.float32), np.zeros((streams, HIDDEN), np.float32), np.ascontiguousarray(p["wh"].T)
        for t in reversed(range(steps)):
            gh += gout[t]
            gn, own = to_n[t], gu[t]
            gn *= gh
            np.multiply(gh, to_z[t], out=own[:, :HIDDEN])
            np.multiply(gn, to_r[t], out=own[:, HIDDEN : 2 * HIDDEN])
            np.multiply(gn, rs[t], out=own[:, 2 * HIDDEN :])
            gh *= zs[t]
            gh += own @ wht
            gh *= carry[t]
        flat_gu = gu.reshape(-1, 3 * HIDDEN)
        g["wh"] = befores.reshape(-1, HIDDEN).T @ flat_gu
        gu[:, :, 2 * HIDDEN :] = to_n
        g |= {"wx": p["emb"].take(flat_symbols, 0).T @ flat_gu, "b": np.ones(len(flat_gu), np.float32) @ flat_gu}
        order = np.argsort(flat_symbols.astype(np.uint16), kind="stable")
        ordered = flat_symbols.take(order)
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        g["emb"] = np.zeros_like(p["emb"])
        g["emb"][ordered[first]] = np.add.reduceat((flat_gu @ p["wx"].T).take(order, 0), first)
        return -float(logp.mean()), g, states[-1]

    def train(self, documents: list[np.ndarray]) -> int:
        """One pass over documents of symbols (the end last); the number of tokens used. Steps continue from the last call."""
        if not documents:
            return 0
        flat = np.concatenate(documents)
        start = np.zeros(len(flat), bool)
        start[np.cumsum([0, *map(len, documents[:-1])])] = True
        previous = np.r_[0, flat[:-1]]
        previous[start] = 0
        streams = int(min(STREAMS, max(1, len(flat) // (WINDOW * 8))))
        steps = -(-len(flat) // streams)
        # the last stream is filled up from the start, so that no token is left out
        shape = lambda a: np.ascontiguousarray(np.resize(a, steps * streams).reshape(streams, steps).T)
        x, y, fresh = shape(previous), shape(flat), shape(start)
        fresh[0] = True
        h = np.zeros((streams, HIDDEN), np.float32)
        if not self.moments:
            self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        for t in range(0, steps, WINDOW):
            _, g, h = self.window(x[t : t + WINDOW], y[t : t + WINDOW], fresh[t : t + WINDOW], h)
            self.steps += 1
            norm = np.sqrt(sum(float(np.vdot(a, a)) for a in g.values()))
            scale = np.float32(min(1.0, CLIP / (norm + 1e-9)))
            unbias = np.float32(np.sqrt(1 - 0.99**self.steps))
            rate = np.float32(RATE / (1 - 0.9**self.steps)) * unbias
            for k, a in g.items():
                a *= scale
                m, v = self.moments[k]
                m += np.float32(0.1) * (a - m)
                a *= a
                a -= v
                a *= np.float32(0.01)
                v += a
                np.sqrt(v, out=a)
                a += np.float32(1e-8) * unbias
                np.divide(m, a, out=a)
                a *= rate
                self.p[k] -= a
        return len(flat)

    def log10(self, documents: list[np.ndarray], batch: int = 1024, window: int = 32) -> np.ndarray:
        """log10 P of each document of symbols, whole."""
        lens = np.array([len(d) for d in documents], np.int64)
        total, longest = np.zeros(len(documents)), np.argsort(-lens, kind="stable")
        if not lens.any():
            return total
        flat, ends = np.concatenate([documents[k] for k in longest]), np.cumsum(lens[longest])
        table, wh = self.table(), by_gate(self.p["wh"])
        for k in range(0, len(longest), batch):
            own = longest[k : k + batch]
            size = lens[own]
            start = ends[k : k + batch] - size
            h, last = np.zeros((len(own), HIDDEN), np.float32), np.zeros(len(own), np.int64)
            for t in range(0, int(size[0]), window):
                steps = np.arange(t, min(t + window, int(size[0])))
                # documents are as long as that or longer, the longest first
                lives = np.searchsorted(-size, -steps)
                part = flat.take(start[: lives[0]] + steps[:, None], mode="clip").astype(np.int64)
                inside = np.arange(lives[0]) < lives[:, None]
                states, at, live = np.empty((int(lives.sum()), HIDDEN), np.float32), 0, -1
                for s, now in enumerate(lives.tolist()):
                    if now != live:
                        live = now
                        gates, u, n = np.empty((3, live, HIDDEN), np.float32), np.empty((3, live, HIDDEN), np.float32), np.empty((live, HIDDEN), np.float32)
                    table.take(last[:live], 1, out=gates, mode="clip")
                    self.step(gates, h[:live], wh, u, n, states[at : at + live])
                    h, last = states[at : at + live], part[s]
                    at += live
                logp = self.output(states, part[inside])
                total[own] += np.bincount(np.nonzero(inside)[1], logp, len(own))
        return total / np.log(10)

    def vector(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def load(self, values: np.ndarray) -> None:
        at = 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k] = values[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n


class Rare(dict):
    """Symbols of rare words, by their last two letters."""

    def __missing__(self, letters: str) -> int:
        self[letters] = found = 1 + rare_class(letters)
        return found


def _symbols(model: Model, words: list[str]) -> np.ndarray:
    get, rare = model.index.get, Rare()
    return np.fromiter((get(w) or rare[w[-2:]] for w in words), np.int64, len(words))


def _documents(symbols: np.ndarray, flat: np.ndarray, lens: np.ndarray) -> list[np.ndarray]:
    """Each document's symbols and the end."""
    ends = np.cumsum(lens + 1)
    every = np.zeros(int(lens.sum()) + len(lens), symbols.dtype)
    inside = np.ones(len(every), bool)
    inside[ends - 1] = False
    every[inside] = symbols[flat]
    return np.split(every, ends[:-1]) if len(lens) else []


def _row(r: dict) -> tuple[list[str], np.ndarray, np.ndarray]:
    return r["words"].split(" ") if r["words"] else [], np.frombuffer(r["flat"], "<u4"), np.frombuffer(r["lens"], np.int64)


def symbol_rows(table: DataFrame, model: Model) -> DataFrame:
    """(mark, symbols) of each training document; symbols are 16-bit numbers, the end last."""
    sent = table.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches):
        own = pickle.loads(sent.value)
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1)
                words, flat, lens = _row({k: r.column(k)[0].as_py() for k in ("words", "flat", "lens")})
                train = np.flatnonzero(np.frombuffer(r.column("train")[0].as_py(), np.uint8))
                every = _documents(_symbols(own, words).astype("<u2"), flat, lens)
                marks = np.frombuffer(r.column("marks")[0].as_py(), "<i8")
                for k in range(0, len(train), 2000):
                    part = train[k : k + 2000]
                    yield pa.RecordBatch.from_arrays([pa.array(marks[part]), pa.array([every[d].tobytes() for d in part], pa.binary())], names=["mark", "symbols"])

    return table.select("words", "flat", "lens", "train", "marks").mapInArrow(run, "mark long, symbols binary")


def averaged(parts: DataFrame) -> np.ndarray | None:
    """The mean of the vectors p (64-bit floats) of (part, used, p), weighted by used. FAN_IN at most are added in one place."""

    def add(batches):
        part, used, total = None, 0, None
        for batch in batches:
            for r in batch.to_pylist():
                if part is not None and r["up"] != part:
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([used], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "used", "p"])
                    used, total = 0, None
                own = np.frombuffer(r["p"], "<f8")
                part, used, total = r["up"], used + r["used"], own.copy() if total is None else total + own
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([used], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "used", "p"])

    while (n := parts.count()) > FAN_IN:
        up = parts.withColumn("up", F.expr(f"part div {FAN_IN}")).repartition(-(-n // FAN_IN), "up").sortWithinPartitions("up", "part")
        parts = written(up.select("up", "part", "used", "p").mapInArrow(add, "part long, used long, p binary"), "lm-averaged")
    found = parts.orderBy("part").collect()
    used = sum(r["used"] for r in found)
    return sum(np.frombuffer(r["p"], "<f8") for r in found) / used if used else None


def fit(table: DataFrame, model: Model, tokens: int) -> Model:
    """The model after a round of training for each share of the documents; tokens is their number in all."""
    spark = table.sparkSession
    rows = symbol_rows(table, model)
    lower = 0.0
    for share in TRAIN_SHARE:
        sent = spark.sparkContext.broadcast(pickle.dumps(model))
        groups = max(1, round(share * tokens / GROUP_TOKENS))
        place = F.pmod(F.xxhash64("mark"), F.lit(1 << 20)) / F.lit(float(1 << 20))
        picked = rows.filter((place >= lower) & (place < lower + share)) if lower + share < 1 else rows.filter(place >= lower)
        picked = picked.withColumn("part", F.pmod(F.xxhash64(F.lit(2), "mark"), F.lit(groups)))
        lower += share

        def run(batches, sent=sent):
            one_thread()
            part, used, held, own, docs = None, 0, 0, None, []

            def row():
                n = used + own.train(docs)
                return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([(own.vector().astype("<f8") * n).tobytes()], pa.binary())], names=["part", "used", "p"])

            for batch in batches:
                for group, symbols in zip(batch.column("part").to_pylist(), batch.column("symbols").to_pylist(), strict=True):
                    if group != part:
                        if part is not None:
                            yield row()
                        part, used, held, own, docs = group, 0, 0, pickle.loads(sent.value), []
                    docs.append(np.frombuffer(symbols, "<u2").astype(np.int64))
                    held += len(docs[-1])
                    if held >= BUFFER:
                        used, held, docs = used + own.train(docs), 0, []
            if part is not None:
                yield row()

        dealt = picked.repartition(groups, "part").sortWithinPartitions("part", "mark", "symbols")
        vector = averaged(written(dealt.select("part", "symbols").mapInArrow(run, "part long, used long, p binary"), "lm-weights"))
        if vector is not None:
            model.load(vector)
    return model


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    spark = docs.sparkSession
    # in buckets by chunk, so that the counts come to the chunks and not the other way
    table = bucketed(chunks(docs), "lm-chunks", "chunk", slots(spark))
    words = table.filter("words <> ''").select("chunk", F.posexplode(F.arrays_zip(F.split("words", " ").alias("w"), F.col("n_train").alias("n"))).alias("pos", "x")).select("chunk", "pos", F.col("x.w").alias("word"), F.col("x.n").alias("n"))
    counted = written(words.groupBy("word").agg(F.sum("n").alias("c"), F.count("*").alias("chunks")).filter("c > 0"), "lm-counts")
    counts = counted.select("word", "c")
    n_docs = docs.filter(remainder(F.col("doc_id"), 10) != 0).count()
    whole = counts.agg(F.count("*"), F.sum("c")).first()
    v, n = (whole[0] or 0) + (n_docs > 0), (whole[1] or 0) + n_docs
    top = counts.orderBy(F.desc("c"), "word").limit(TOP).collect()
    kls = F.pmod(F.crc32(F.right("word", F.lit(2))), F.lit(RARE))
    rare = np.zeros((RARE, 2))
    for r in counts.groupBy(kls.alias("k")).agg(F.count("*").alias("v"), F.sum("c").alias("c")).collect():
        rare[int(r["k"])] = r["v"], r["c"]
    for r in top:
        rare[rare_class(r["word"])] -= 1, r["c"]
    model = fit(table, Model([r["word"] for r in top], np.array([r["c"] for r in top], float), rare[:, 1], n_docs), n)
    # log10 of what the counts of each rare class are divided by
    below = np.log10(rare[:, 1] + 0.1 * (rare[:, 0] + 1))
    sent = spark.sparkContext.broadcast(pickle.dumps((model, below, n, v, n_docs)))
    # most words are of one chunk alone, which knows their count: they are not joined
    back = words.join(counted.filter("chunks > 1").select("word", "c"), "word").filter("c <> n").groupBy("chunk").agg(F.collect_list(F.struct("pos", "c")).alias("known"))
    back = back.select("chunk", F.col("known.pos").alias("pos"), F.col("known.c").alias("c"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        one_thread()
        own, below, n, v, n_docs = pickle.loads(sent.value)
        base_z = np.log10(n + 0.1 * (v + 1))
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1)
                words, flat, lens = _row({k: r.column(k)[0].as_py() for k in ("words", "flat", "lens")})
                c = np.array(r.column("n_train")[0].values, float) if words else np.zeros(0)
                if r.column("pos")[0].is_valid:
                    c[r.column("pos")[0].values.to_numpy()] = r.column("c")[0].values.to_numpy()
                symbols = _symbols(own, words).astype(np.uint16)
                log_c = np.log10(c + 0.1)
                is_rare = symbols <= RARE
                extra = np.where(is_rare, log_c - below[np.where(is_rare, symbols, 1) - 1], 0.0)
                doc = np.repeat(np.arange(len(lens)), lens)
                total = lambda x: np.bincount(doc, x[flat], len(lens))  # noqa: B023, E731
                base = total(log_c) + np.log10(n_docs + 0.1) - (lens + 1) * base_z
                known = total((c > 0).astype(float)).astype(np.int64) + (n_docs > 0)
                score = own.log10(_documents(symbols, flat, lens)) + total(extra)
                held = np.frombuffer(r.column("train")[0].as_py(), np.uint8) == 0
                m = len(lens)
                yield pa.RecordBatch.from_arrays([r.column("ids")[0].values, pa.array(held), pa.array(lens + 1), pa.array(known), pa.array(np.full(m, n, np.int64)), pa.array(base), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    joined = table.select("chunk", "words", "n_train", "flat", "lens", "train", "ids").join(back, "chunk", "left")
    with single_rows(spark):
        return written(joined.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "lm-scores")


@contextmanager
def single_rows(spark: SparkSession):
    """Within, batches that go to Python hold one row: a chunk is many megabytes, and several of them would lie in memory twice."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return scores(docs)
