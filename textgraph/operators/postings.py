"""A search index that is kept up to date: segments of postings, graves, and a manifest that names what is current.

A segment holds postings (part, term, batch, place, tf) in parts by hash of the term, each in order of its terms, and its
documents (part, location_uri, corpus_id, dl, batch, place) in parts by hash of the location. A row of postings is a word in
documents that were read together, their batch: arrays of their places in it and of how often they have the word. So what is
dealt out and sorted are words of batches, and a posting takes two numbers; a search joins those of its words with the
documents. A change writes one new segment and one file of graves, which bury what older
segments hold of its documents. Numbers and total lengths of the live documents are kept by addition. Segments of about
one size are merged `FANOUT` at a time, without what is buried, so a search meets few of them.

A search reads, of each segment, the parts and row groups of its own words, and the list of documents. A manifest is written once and never changed;
of two writers on the same one the second gets an error, and a reader goes on with the files of the manifest it opened:
they are deleted when the change after next is made.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Conflict, Folder
from .search import parse_query, ranked

PARTS = 64
FANOUT = 4
#: Postings up to which segments count as the smallest size.
SMALL = 1 << 20


#: Bytes of the texts of a batch, unless one text has more.
BATCH = 1 << 25
POSTINGS = "batch string, term string, place array<int>, tf array<int>"
MADE = f"{POSTINGS}, location_uri array<string>, corpus_id array<string>, dl array<int>"
_IN_WORDS = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))


def _words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of lower-case texts, as search.tokens has them, and how many each text has."""
    text = text.cast(pa.string())
    ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = _IN_WORDS[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = ends[:-1][ends[:-1] < len(raw)]  # a text's first byte follows no other
    first[begins] = inside[begins]
    n = np.diff(np.searchsorted(np.flatnonzero(first), ends))
    letters, at = raw[inside], np.flatnonzero(first[inside])
    return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(np.append(at, len(letters)).astype(np.int32)), pa.py_buffer(letters)]), n


def _made(documents: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch: a row without a word that lists its documents, and one for each word."""

    def rows(n: int, **columns) -> pa.RecordBatch:
        kinds = {"term": pa.string(), "place": pa.list_(pa.int32()), "tf": pa.list_(pa.int32()), "location_uri": pa.list_(pa.string()), "corpus_id": pa.list_(pa.string()), "dl": pa.list_(pa.int32())}
        own = {"batch": pa.repeat(batch, n)} | {c: columns[c] if c in columns else pa.nulls(n, kind) for c, kind in kinds.items()}
        return pa.RecordBatch.from_pydict(own)

    batch, (words, dl) = uuid.uuid4().hex, _words(documents.column("text"))
    listed = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
    whole, numbers = [0, len(dl)], lambda values: pa.array(values.astype(np.int32))
    yield rows(1, location_uri=listed(whole, documents.column("location_uri")), corpus_id=listed(whole, documents.column("corpus_id")), dl=listed(whole, numbers(dl)))
    words = words.dictionary_encode()
    key, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(dl) + np.repeat(np.arange(len(dl)), dl), return_counts=True)
    code, place = np.divmod(key, len(dl))
    ends = np.append(np.flatnonzero(np.diff(code, prepend=-1)), len(code))
    yield rows(len(words.dictionary), term=words.dictionary, place=listed(ends, numbers(place)), tf=listed(ends, numbers(tf)))


def made(chunks: DataFrame, size: int = BATCH) -> DataFrame:
    """Batches of chunks, made where these are read. Their names are random, so they must be written before they are used twice."""
    texts = chunks.select("location_uri", "corpus_id", F.lower(F.coalesce("content", F.lit(""))).alias("text"))

    def run(batches):
        for batch in batches:
            at = np.cumsum(pc.binary_length(batch.column("text")).to_numpy().astype(np.int64)) // size
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for a, z in zip(cuts, cuts[1:]):
                if z > a:
                    yield from _made(batch.slice(a, z - a))

    return texts.mapInArrow(run, MADE)


def _each(postings: DataFrame) -> DataFrame:
    """(batch, term, place, tf), a row for each document."""
    return postings.select("batch", "term", F.inline(F.arrays_zip("place", "tf")))


def _part(column: str):
    return F.pmod(F.hash(column), F.lit(PARTS)).alias("part")


class Postings:
    """The index in a folder. Documents are named by location_uri, which is unique among the live ones."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.folder = spark, Folder(spark, at)
        names = [n for n in self.folder.names() if n.startswith("index-")]
        self.state = json.loads(self.folder.get(names[-1])) if names else {"number": 0, "segments": [], "graves": [], "n": 0, "dl": 0, "old": [], "source": None}
        if any("form" not in s for s in self.state["segments"]):
            # of a form that isn't read any more: it can only be built anew, and then goes
            every = [x["at"] for x in self.state["segments"] + self.state["graves"]]
            self.state |= {"segments": [], "graves": [], "n": 0, "dl": 0, "source": None, "old": self.state["old"] + every, "stale": True}

    def _check(self) -> None:
        if self.state.get("stale"):
            raise ValueError(f"{self.folder.at} has an older form and must be built anew")

    @classmethod
    def build(cls, chunks: DataFrame, at: str, source: str | None = None) -> Postings:
        """An index of chunks alone, in place of what was there, which readers that have it open keep until the change after next."""
        out = cls(chunks.sparkSession, at)
        dead = [s["at"] for s in out.state["segments"]] + [g["at"] for g in out.state["graves"]]
        out._commit([out._segment(chunks)], [], dead, out.state["n"], out.state["dl"], source)
        return out

    # writing

    def _segment(self, chunks: DataFrame) -> dict:
        name = f"made-{uuid.uuid4().hex}"
        try:
            made(chunks).write.parquet(f"{self.folder.at}/{name}")
            rows = self.spark.read.schema(MADE).parquet(f"{self.folder.at}/{name}")
            each = rows.filter("term IS NOT NULL").select("batch", "term", "place", "tf")
            documents = rows.filter("term IS NULL").select("batch", F.posexplode(F.arrays_zip("location_uri", "corpus_id", "dl")).alias("place", "d")).select("d.*", "batch", "place")
            return self._written(each, documents)
        finally:
            self.folder.remove(name)

    def _written(self, each: DataFrame, documents: DataFrame) -> dict:
        at = f"segment-{uuid.uuid4().hex}"
        # a common word may be in a third of all documents: its batches are dealt over several files, each in order
        dealt = each.select("*", _part("term")).repartition("part", F.pmod(F.hash("batch"), F.lit(4)))
        dealt.sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{self.folder.at}/{at}/postings")
        documents.select("*", _part("location_uri")).repartition("part").sortWithinPartitions("part", "location_uri").write.partitionBy("part").parquet(f"{self.folder.at}/{at}/documents")
        found = self._documents(at).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
        return {"at": at, "number": self.state["number"] + 1, "n": found["n"], "dl": found["dl"], "form": "batches"}

    def _documents(self, at: str) -> DataFrame:
        return self.spark.read.schema("location_uri string, corpus_id string, dl int, batch string, place int, part int").parquet(f"{self.folder.at}/{at}/documents")

    def _postings(self, at: str) -> DataFrame:
        return self.spark.read.schema(f"{POSTINGS}, part int").parquet(f"{self.folder.at}/{at}/postings")

    def _kept(self, segment: dict) -> DataFrame:
        """The postings of a segment without those of what is buried."""
        rows = self._postings(segment["at"]).drop("part")
        if self._graves(segment["number"]) is None:
            return rows
        live = self._live(self._documents(segment["at"]), segment).select("batch", "place")
        left = _each(rows).join(live, ["batch", "place"]).groupBy("batch", "term").agg(F.collect_list(F.struct("place", "tf")).alias("own"))
        return left.select("batch", "term", "own.place", "own.tf")

    def _graves(self, number: int) -> DataFrame | None:
        """(location_uri) of what is buried in segments with this number."""
        own = [f"{self.folder.at}/{g['at']}" for g in self.state["graves"] if g["number"] > number]
        return self.spark.read.schema("location_uri string").parquet(*own).distinct() if own else None

    def _live(self, rows: DataFrame, segment: dict) -> DataFrame:
        graves = self._graves(segment["number"])
        return rows if graves is None else rows.join(graves, "location_uri", "left_anti")

    def _commit(self, segments: list[dict], graves: list[dict], dead: list[str], gone_n: int, gone_dl: int, source: str | None) -> None:
        """The next manifest: segments and graves on top of what isn't dead."""
        kept = [s for s in self.state["segments"] if s["at"] not in dead]
        state = {
            "number": self.state["number"] + 1, "segments": kept + segments, "graves": [g for g in self.state["graves"] if g["at"] not in dead] + graves, "old": dead,
            "n": self.state["n"] - gone_n + sum(s["n"] for s in segments), "dl": self.state["dl"] - gone_dl + sum(s["dl"] for s in segments), "source": source if source is not None else self.state["source"],
        }
        if not self.folder.put(f"index-{state['number']:09}", json.dumps(state)):
            raise Conflict(f"another writer changed {self.folder.at}")
        for name in self.state["old"]:
            self.folder.remove(name)
        self.state = state

    def change(self, rows: DataFrame | None = None, gone: DataFrame | None = None, source: str | None = None) -> None:
        """Adds or replaces the chunks in rows, and deletes those at gone (location_uri). source may name the state of the chunks that is now indexed."""
        self._check()
        uris = [df.select("location_uri") for df in (rows, gone) if df is not None]
        if not uris:
            return
        # files of a manifest that two others have followed may be gone
        if any(n > f"index-{self.state['number']:09}" for n in self.folder.names() if n.startswith("index-")):
            raise Conflict(f"another writer changed {self.folder.at}")
        touched = reduce(DataFrame.union, uris).distinct()
        at = f"graves-{uuid.uuid4().hex}"
        touched.write.parquet(f"{self.folder.at}/{at}")
        touched = self.spark.read.schema("location_uri string").parquet(f"{self.folder.at}/{at}")
        # what the touched ones counted for; Spark broadcasts them where their size allows and then reads their parts alone
        keys = touched.select("location_uri", _part("location_uri"))
        before = [self._live(self._documents(s["at"]).join(keys, ["part", "location_uri"]), s).select("dl") for s in self.state["segments"]]
        lost = reduce(DataFrame.union, before).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first() if before else {"n": 0, "dl": 0}
        made = [self._segment(rows)] if rows is not None else []
        self._commit(made, [{"at": at, "number": self.state["number"] + 1}], [], lost["n"], lost["dl"], source)
        self.merge()

    def merge(self) -> None:
        """Merges segments of one size until no size has FANOUT of them, and drops graves that no segment needs."""
        while True:
            sizes: dict[int, list[dict]] = {}
            for s in self.state["segments"]:
                sizes.setdefault(max(0, (s["dl"] // SMALL).bit_length() // 2), []).append(s)
            full = next((own for _, own in sorted(sizes.items()) if len(own) >= FANOUT), None)
            if full is None:
                break
            each = reduce(DataFrame.unionByName, [self._kept(s) for s in full])
            documents = reduce(DataFrame.unionByName, [self._live(self._documents(s["at"]).drop("part"), s) for s in full])
            merged, dead = self._written(each, documents), [s["at"] for s in full]
            oldest = min([merged["number"], *(s["number"] for s in self.state["segments"] if s["at"] not in dead)])
            dead += [g["at"] for g in self.state["graves"] if g["number"] <= oldest]
            # the merged segment counts as a new one: no grave of now concerns it
            self._commit([merged], [], dead, merged["n"], merged["dl"], None)

    # reading

    def keyword(self, query: str, limit: int = 20, position: str | None = None, corpus: str | None = None, within: DataFrame | None = None) -> DataFrame:
        """As search.keyword, for queries in which each alternative asks for a word, which all do."""
        self._check()
        asked = parse_query(query)
        if not asked.either or not self.state["segments"]:
            return self.spark.createDataFrame([], "uri string, score double, relevance double")
        number = {w: k for k, w in enumerate(asked.words)}
        part = self.spark.range(1).select(*(F.pmod(F.hash(F.lit(w)), F.lit(PARTS)) for w in number)).first()
        mine = F.col("part").isin(sorted(set(part))) & F.col("term").isin(list(number))
        own = reduce(DataFrame.unionByName, [self._live(_each(self._postings(s["at"]).filter(mine)).join(self._documents(s["at"]).drop("part"), ["batch", "place"]), s) for s in self.state["segments"]])
        tf = [F.sum(F.when(F.col("term") == w, F.col("tf")).otherwise(0)).alias(f"tf{k}") for w, k in number.items()]
        rows = own.groupBy("location_uri", "corpus_id", "dl").agg(*tf)
        df = own.agg(*(F.sum((F.col("term") == t).cast("long")).alias(f"df{number[t]}") for t in asked.terms))
        n, dl = self.state["n"], self.state["dl"]
        stats = df.select(F.lit(n).cast("long").alias("n"), F.lit(dl / n if n else 0.0).alias("avgdl"), "*")
        return ranked(rows, stats, asked, number, limit, position, corpus, within)
