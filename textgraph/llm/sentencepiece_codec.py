"""SentencePiece BPE by vectorised merge rounds, exact to the library.

No piece of the vocabulary holds the space mark after another character, so merges never cross from a word to the next
mark and the distinct words of a batch are merged together: their symbols lie in one flat array; each round looks up the
rank of every adjacent pair, takes the minimum of each word by a segmented reduction, merges that pair leftmost first in
all words at once and compacts the array, until no pair is left. All occurrences in a word merge in one round where the
merged piece can't be part of an equally good or better pair; else only the leftmost does, as the library would.

Edge cases: null and empty texts have no ids and decode to the empty string; characters outside the vocabulary become
byte pieces; a word of over LONG symbols has rounds of its own, which take near-linear time; rows repeat as they are;
extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MARK = "▁"
LONG = 3000
#: Distinct words whose ids a worker remembers; beyond, it starts anew.
REMEMBERED = 400_000
#: Words that are merged at once, and rows that are encoded at once: what lies in memory beside what is remembered.
AT_ONCE, ROWS = 10_000, 200
NEVER = np.int64(1) << 40

codecs.register_error("one_by_one", lambda e: ("�", e.start + 1))


class Codec:
    """Encoder and decoder over the pieces and scores of a BPE model file."""

    def __init__(self, model: bytes):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = library.get_piece_size()
        pieces = [library.id_to_piece(i) for i in range(n)]
        plain = [not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i)) for i in range(n)]
        if any(MARK in p.lstrip(MARK) for p, ok in zip(pieces, plain) if ok):
            raise ValueError("a piece has the space mark after another character")
        self.symbols = {p: i for i, (p, ok) in enumerate(zip(pieces, plain)) if ok}
        self.n, self.byte_ids = n, {int(p[3:5], 16): i for i, p in enumerate(pieces) if library.is_byte(i)}
        for p in list(self.symbols):  # characters that only occur inside pieces
            for c in p:
                self.symbols.setdefault(c, len(pieces) + len(self.symbols))
        self.other = max(self.symbols.values()) + 1
        base = np.int64(self.other + 1)
        scores = [library.get_score(i) for i in range(n)]
        rank_of = {s: r for r, s in enumerate(sorted({s for s, ok in zip(scores, plain) if ok}, reverse=True))}
        pairs: dict[int, tuple[int, int]] = {}
        eager = np.ones(int(base), bool)
        for p, i in [(p, i) for p, i in self.symbols.items() if i < n and len(p) > 1]:
            rank = rank_of[scores[i]]
            for k in range(1, len(p)):
                left, right = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if left is not None and right is not None:
                    pairs[int(left * base + right)] = (rank, i)
                    for part in (left, right):
                        if part < n and rank <= rank_of[scores[part]]:
                            eager[part] = False
        self.base, self.eager, self.pairs = base, eager, pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[int(k)][0] for k in self.keys], np.int64)
        self.merged = np.array([pairs[int(k)][1] for k in self.keys], np.int64)
        self.text_of = [self._surface(library, i, p) for i, p in enumerate(pieces)]
        self.silent = {i for i in range(n) if library.is_control(i)}
        self.decimal = [str(i) for i in range(n)]
        #: The ids of words, as 32-bit numbers.
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _surface(library, i: int, piece: str) -> bytes:
        if library.is_control(i):
            return b""
        if library.is_unknown(i):
            return " ⁇ ".encode()
        return bytes([int(piece[3:5], 16)]) if library.is_byte(i) else piece.replace(MARK, " ").encode()

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        want = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        hit = self.keys[at] == want
        return np.where(hit, self.ranks[at], NEVER), np.where(hit, self.merged[at], -1)

    def _rounds(self, words: list[str]) -> list[list[int]]:
        """The symbols of each word after all merges."""
        get, other = self.symbols.get, self.other
        sym = np.array([get(c, other) for c in chain.from_iterable(words)], np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        done: list = [None] * len(words)
        while len(sym):
            rank = np.full(len(sym), NEVER, np.int64)
            into = np.full(len(sym), -1, np.int64)
            if len(sym) > 1:
                rank[:-1], into[:-1] = self._lookup(sym[:-1], sym[1:])
                rank[:-1][word[:-1] != word[1:]] = NEVER
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            ends = np.r_[starts[1:], len(sym)]
            least = np.minimum.reduceat(rank, starts)
            for k in np.flatnonzero(least == NEVER):
                done[word[starts[k]]] = sym[starts[k] : ends[k]].tolist()
            of = np.repeat(np.arange(len(starts)), ends - starts)
            live = least[of] != NEVER
            best = live & (rank == least[of])
            at = np.flatnonzero(best)
            # the leftmost of each word, and all that don't overlap where the merged piece is eager
            first = np.r_[True, of[at][1:] != of[at][:-1]] if len(at) else np.zeros(0, bool)
            run_start = np.r_[True, (np.diff(at) != 1) | first[1:]] if len(at) else first
            begun = np.maximum.accumulate(np.where(run_start, np.arange(len(at)), 0)) if len(at) else at
            every_other = (np.arange(len(at)) - begun) % 2 == 0
            lead = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0)) if len(at) else at
            one_piece = self.eager[into[at]] & self.eager[into[at]][lead]
            at = at[first | (every_other & one_piece)]
            sym[at] = into[at]
            stay = live
            stay[at + 1] = False
            sym, word = sym[stay], word[stay]
        return done

    def _long_rounds(self, word: str) -> list[int]:
        """The symbols of one long word after all merges.

        Again each round merges all pairs of the least rank, leftmost first, but the places of each rank are kept from
        round to round and neighbours are linked, so a round costs what it merges and not the length of the word.
        """
        get, n = self.symbols.get, len(word)
        sym = np.fromiter((get(c, self.other) for c in word), np.int64, n)
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        places: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def pairs_at(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return self._lookup(sym[at], sym[after[at]])

        def offer(at: np.ndarray) -> None:
            at = at[(at >= 0) & (at < n)]
            at = at[alive[at] & (after[at] < n)]
            rank = pairs_at(at)[0]
            at, rank = at[rank != NEVER], rank[rank != NEVER]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            starts = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]) if len(at) else at
            for k, part in zip(rank[starts].tolist(), np.split(at, starts[1:]) if len(at) else []):
                if k not in places:
                    places[k] = []
                    heapq.heappush(ranks, k)
                places[k].append(part)

        def merge(at: np.ndarray, into: np.ndarray) -> None:
            gone = after[at]
            sym[at], alive[gone], after[at] = into, False, after[gone]
            right = after[at]
            before[right[right < n]] = at[right < n]

        offer(np.arange(n))
        while ranks:
            least = heapq.heappop(ranks)
            at = np.unique(np.concatenate(places.pop(least)))
            at = at[alive[at] & (after[at] < n)]
            rank, into = pairs_at(at)
            at, into = at[rank == least], into[rank == least]
            if not len(at):
                continue
            if self.eager[into].all() and (into == into[0]).all():
                run_start = np.r_[True, after[at[:-1]] != at[1:]]
                begun = np.maximum.accumulate(np.where(run_start, np.arange(len(at)), 0))
                pick = (np.arange(len(at)) - begun) % 2 == 0
                at, into = at[pick], into[pick]
                merge(at, into)
                offer(np.concatenate([at, before[at]]))
                continue
            # a merged piece may be part of an equally good or better pair: leftmost by leftmost
            ready, others = [(least, i) for i in at.tolist()], []
            while ready:
                k, i = heapq.heappop(ready)
                if not alive[i] or after[i] >= n:
                    continue
                hit = self.pairs.get(int(sym[i] * self.base + sym[after[i]]))
                if hit is None or hit[0] != k:
                    continue
                merge(np.array([i]), np.array([hit[1]]))
                for j in (i, int(before[i])):
                    if j >= 0 and after[j] < n and (new := self.pairs.get(int(sym[j] * self.base + sym[after[j]]))):
                        if new[0] <= least:
                            heapq.heappush(ready, (new[0], j))
                        else:
                            others.append(j)
            offer(np.array(others, np.int64))
        return sym[alive].tolist()

    def _ids(self, word: str, symbols: list[int]) -> bytes:
        if max(symbols, default=0) < self.n:
            return array("i", symbols).tobytes()
        out, at = array("i"), 0
        for s in symbols:
            if s < self.n:
                out.append(s)
                at += len(self.text_of[s].decode())
            else:  # a character without a piece
                out.extend(self.byte_ids[b] for b in word[at].encode())
                at += 1
        return out.tobytes()

    def learn(self, words: set[str]) -> None:
        """Adds the ids of words to those known."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(words)
        short = [w for w in new if len(w) <= LONG]
        for k in range(0, len(short), AT_ONCE):
            part = short[k : k + AT_ONCE]
            for w, symbols in zip(part, self._rounds(part), strict=True):
                self.known[w] = self._ids(w, symbols)
        for w in new:
            if len(w) > LONG:
                self.known[w] = self._ids(w, self._long_rounds(w))

    @staticmethod
    def split(text: str) -> list[str]:
        if not text:
            return []
        if "  " in text or MARK in text or text[-1] == " " or text[0] == " ":
            return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", (" " + text).replace(" ", MARK))
        return [MARK + w for w in text.split(" ")]

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        parts = [self.split(t) for t in texts]
        self.learn(set(chain.from_iterable(parts)))
        for p in parts:
            yield np.frombuffer(b"".join(map(self.known.__getitem__, p)), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.text_of.__getitem__, ids))
        first = next((i for i in ids if i not in self.silent), None)
        if first is not None and raw[:1] == b" " and first not in self.byte_ids.values() and first != 0:
            raw = raw[1:]
        return raw.decode("utf-8", "one_by_one")


@lru_cache(maxsize=2)
def codec(model: bytes) -> Codec:
    return Codec(model)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _over(docs: DataFrame, path: str | None, fields: str, make) -> DataFrame:
    """doc_id and what make(codec, ids) gives for each row. The model file (under 1 MB) is read on the driver."""
    model = docs.sparkSession.sparkContext.broadcast(_read(path or default_model()))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own = codec(model.value)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                texts = [t or "" for t in part.column("text").to_pylist()]
                made = [make(own, ids) for ids in own.encode(texts)]
                columns = [pa.array(c) for c in zip(*made)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", *(f.split()[0] for f in fields.split(", "))])
        # the codec stays with the worker; what it remembers would burden the tasks that follow
        own.known.clear()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {fields}")


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, the ids of its whole text and the text decoded from them."""
    return _over(docs, path, "ids array<int>, decoded string", lambda own, ids: (np.array(ids, np.int32), own.decode(ids)))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    def make(own: Codec, ids: list[int]):
        joined = ",".join(map(own.decimal.__getitem__, ids))
        return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()

    return _over(docs, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return digests(docs)
