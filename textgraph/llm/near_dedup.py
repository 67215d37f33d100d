"""Near-duplicate groups by an LSH forest over MinHash signatures.

1. Each text's set of five-word shingles (64-bit hashes) gives a 128-value MinHash signature and a digest of the set.
   Equal sets are one class from here on, so exact copies cost nothing, however many there are.
2. The forest has 16 trees, each the classes in the order of the signature rotated to another start. The classes that
   share a prefix of a tree are a region; depths 4 to 32 are looked at. Classes alone in all regions of depth 4 are done.
3. Pivots: a region's pivot is the class that shares the most deep regions (the text from which copies were edited has
   the commonest minima). Each class is a candidate with the pivot of each of its regions, so a dense region of m classes
   costs m candidates, not m * m.
4. Regions of depth 4 that still hold several components are compared exactly: in those of at most SMALL classes all
   pairs across components are candidates. The classes of larger ones are ordered by their rarest shingles: two sets of
   similarity 0.85 share one of the rarest n - ceil(0.85 n) + 1 of each (a prefix filter, which misses nothing), so only
   classes with such a shingle in common are compared, which a shared template isn't, unless it is all that they hold.
   Shingles of at most SMALL such classes give pairs; beyond, the classes are cut into blocks of about BLOCK, and each
   pair of blocks gets its exact intersections from one matrix product, of which the links that join components are kept.
5. Candidates whose one-byte sketches agree in LIKELY of 128 places are confirmed on full sets (100 * intersection >= 85 * union), and confirmed links give components by
   min-label propagation with pointer jumping.

Two sets of similarity 0.85 miss each other in all trees at depth 4 with probability (1 - 0.85**4)**16 < 1e-5.
Edge cases: a text of fewer than five words has its whole sequence as one shingle; a null text, or one without words,
has none and is linked with nothing; every row is a document of its own, and rows that share a doc_id and a text share
all results; a null doc_id is never the smallest; `deduplicated` keeps extra columns and one row of each group, the
smallest doc_id (of rows that share it and the text, any one; a null one where no other is); empty tables work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import UPPER, free_name, written

WORDS, PERCENT = 5, 85
VALUES, TREES = 128, 16
DEPTHS = (4, 8, 16, 32)
SMALL, BLOCK = 64, 512
#: Shingles of one matrix product.
COLUMNS = 4096
#: Sketch values that a pair worth confirming has in common: at similarity 0.85, five standard deviations below the mean.
LIKELY = 88
#: Pairs of one class are dealt over so many parts.
SALTS = 1024
#: Tables of ids (under 100 bytes a row) are broadcast up to this many rows; beyond, the join shuffles.
BROADCAST_ROWS = 100_000

_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_MIX = np.uint64(0x9E3779B97F4A7C15)
_chance = np.random.default_rng(41)
_A = _chance.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _chance.integers(0, 1 << 63, VALUES, dtype=np.uint64)


def text_mark() -> Column:
    """Tells texts that share a doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


class Shingler:
    """Shingle hashes of texts; remembers the hashes of words."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        """The distinct shingles, sorted."""
        words = (text or "").encode().translate(_LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > 400_000:
            self.known.clear()
        get, put = self.known.get, self.known.__setitem__
        hashes = np.empty(len(words), np.uint64)
        for k, w in enumerate(words):
            h = get(w)
            if h is None:
                put(w, h := xxhash.xxh3_64_intdigest(w))
            hashes[k] = h
        n = max(1, len(words) - WORDS + 1)
        with np.errstate(over="ignore"):
            out = np.full(n, len(words) if len(words) < WORDS else WORDS, np.uint64)
            for k in range(min(WORDS, len(words))):
                out = (out ^ (out >> np.uint64(29))) * _MIX + hashes[k : k + n]
            out ^= out >> np.uint64(32)
        return np.unique(out * _MIX)


def signature(shingles: np.ndarray) -> np.ndarray:
    """VALUES minima, 32 bits each."""
    low = np.full(VALUES, ~np.uint64(0))
    with np.errstate(over="ignore"):
        for k in range(0, len(shingles), 1024):
            part = shingles[k : k + 1024]
            for j in range(0, VALUES, 32):
                low[j : j + 32] = np.minimum(low[j : j + 32], (_A[j : j + 32, None] * part + _B[j : j + 32, None]).min(1))
    return (low >> np.uint64(32)).astype(np.uint32)


def prefix_keys(signatures: np.ndarray, tree: int, depths: tuple[int, ...]) -> list[np.ndarray]:
    """For each signature (row) a hash of its prefix in the tree at each depth."""
    at = np.roll(signatures.astype(np.uint64), -tree * (VALUES // TREES), axis=1)
    h, keys = np.full(len(at), tree + 1, np.uint64), []
    with np.errstate(over="ignore"):
        for d in range(max(depths)):
            h = (h ^ (h >> np.uint64(31))) * _MIX + at[:, d]
            if d + 1 in depths:
                keys.append((h ^ (h >> np.uint64(32))).astype(np.int64))
    return keys


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, digest and tops (the keys of depth DEPTHS[0], a tree each) of each row; the last two null without shingles."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own = Shingler()
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                sets = [own(t) for t in part.column("text").to_pylist()]
                sig = np.stack([signature(x) for x in sets])
                tops = np.stack([prefix_keys(sig, tree, DEPTHS[:1])[0] for tree in range(TREES)], 1)
                digest = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
                top = pa.array([t if len(x) else None for t, x in zip(tops, sets, strict=True)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array([len(x) for x in sets], pa.int64()), pa.array(digest, pa.binary()), top], names=["doc_id", "mark", "n_shingles", "digest", "tops"])

    return docs.select("doc_id", text_mark().alias("mark"), "text").mapInArrow(run, f"doc_id {kind}, mark long, n_shingles long, digest binary, tops array<long>")


def forest(sets: DataFrame) -> DataFrame:
    """(digest, n, tree, keys): each class in each tree with the hash of its prefix at each depth."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.stack([np.frombuffer(x, np.uint32) for x in batch.column("sig").to_pylist()])
            for tree in range(TREES):
                keys = prefix_keys(sig, tree, DEPTHS)
                yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("n"), pa.array(np.full(len(sig), tree, np.int32)), *map(pa.array, keys)], names=["digest", "n", "tree", *(f"k{d}" for d in DEPTHS)])

    return sets.select("digest", F.size("shingles").cast("long").alias("n"), "sig").mapInArrow(run, "digest binary, n long, tree int, " + ", ".join(f"k{d} long" for d in DEPTHS))


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each end of the links (a, b) reaches. The tables stay distributed."""
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        step = written(step, "labels-step")
        further = step.select(F.col("node").alias("via"), F.col("label").alias("far"))
        labels = written(step.join(further, step["label"] == further["via"]).select("node", "old", F.least("label", "far").alias("label")), "labels")
        if labels.filter(F.col("old") != F.col("label")).isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def _fits(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _both(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """The pairs with the values va and vb of their two classes. A class with very many pairs is dealt over SALTS parts."""
    salted = pairs.select("a", "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)))
    salted = _small(salted)
    left = salted.join(table.select(F.col("digest").alias("a"), F.col(value).alias("va")), "a")
    right = _small(salted.select("b", "salt").distinct()).join(table.select(F.col("digest").alias("b"), F.col(value).alias("vb")), "b")
    return left.join(right, ["b", "salt"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets pass. Sets are fetched only for pairs whose sketches agree in LIKELY places."""
    equal = F.aggregate(F.zip_with("va", "vb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)
    likely = written(_both(pairs, sets, "sketch").filter(equal >= LIKELY).select("a", "b"), "near-likely")
    named = written(likely.select(F.col("a").alias("digest")).union(likely.select("b")).distinct(), "near-named")
    some = sets.join(_small(named), "digest", "left_semi")
    shared = _both(likely, some, "shingles").select("a", "b", F.size(F.array_intersect("va", "vb")).alias("i"), (F.size("va") + F.size("vb")).alias("t"))
    return written(shared.filter(F.col("i") * 100 >= (F.col("t") - F.col("i")) * PERCENT).select("a", "b"), "near-links")


def block_links(rows: pa.Table) -> pa.Table:
    """Links (a, b) that join the components of the classes of side 0 with those of side 1, or of side 0 with each other."""
    lists = rows.column("shingles").combine_chunks()
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    label = np.unique(np.array([x.hex() for x in rows.column("label").to_pylist()]), return_inverse=True)[1]
    first = rows.column("side").to_numpy() == 0
    alone = bool(first.all())
    left = np.flatnonzero(first)
    right = left if alone else np.flatnonzero(~first)
    place = np.empty(len(n), np.int64)
    place[left], place[right] = np.arange(len(left)), np.arange(len(right))
    names, col = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    row = np.repeat(np.arange(len(n)), n)
    at = first[row]
    in_left = np.bincount(col[at], minlength=len(names))
    shared = in_left > 1 if alone else (in_left > 0) & (np.bincount(col[~at], minlength=len(names)) > 0)
    kept = shared[col]
    col, row = (np.cumsum(shared) - 1)[col[kept]], row[kept]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(shared.sum()), COLUMNS):
        span = slice(*np.searchsorted(col, [start, start + COLUMNS]))
        c, r = col[span] - start, row[span]
        x = np.zeros((len(left), COLUMNS), np.float32)
        x[place[r[first[r]]], c[first[r]]] = 1
        y = x
        if not alone:
            y = np.zeros((len(right), COLUMNS), np.float32)
            y[place[r[~first[r]]], c[~first[r]]] = 1
        both += x @ y.T
    i, j = np.nonzero((100 + PERCENT) * both.astype(np.int64) >= PERCENT * (n[left][:, None] + n[right][None]))
    i, j = left[i], right[j]
    i, j = i[label[i] != label[j]], j[label[i] != label[j]]
    one = np.unique(np.minimum(label[i], label[j]) * (len(n) + 1) + np.maximum(label[i], label[j]), return_index=True)[1]
    # of the links that remain, those that join what isn't joined yet
    root = list(range(len(n)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    made = []
    for k in one:
        p, q = find(int(label[i[k]])), find(int(label[j[k]]))
        if p != q:
            root[p] = q
            made.append((int(i[k]), int(j[k])))
    digest = rows.column("digest").to_pylist()
    return pa.table({"a": pa.array([digest[x] for x, _ in made], pa.binary()), "b": pa.array([digest[y] for _, y in made], pa.binary())})


def across(placed: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """The links (a, b) between components within the regions (key) of the placed classes: every pair is looked at."""
    labelled = placed.join(found, F.col("digest") == F.col("node"), "left").select("key", "digest", "n", "m", F.coalesce("label", "digest").alias("label"))
    several = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    rows = written(labelled.join(_small(written(several, "near-several")), "key"), "near-open")
    x = rows.filter(F.col("m") <= SMALL)
    y = x.select("key", F.col("digest").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    pairs = x.join(y, "key").filter((F.col("digest") < F.col("b")) & (F.col("label") != F.col("lb")) & _fits(F.col("n"), F.col("nb")))
    few = confirmed(written(pairs.select(F.col("digest").alias("a"), "b").distinct(), "near-across"), sets)
    large = rows.filter(F.col("m") > SMALL)
    if large.isEmpty():
        return few
    large = written(large.groupBy("digest").agg(F.first("n").alias("n"), F.first("label").alias("label")), "near-large")
    rare = prefixes(sets.select("digest", "shingles").join(_small(large.select("digest")), "digest", "left_semi"))
    rare = written(rare, "near-prefixes")
    sizes = rare.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    placed = rare.join(large, "digest").join(sizes, "key")
    several = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    rows = written(placed.join(written(several, "near-several"), "key", "left_semi"), "near-open")
    x = rows.filter(F.col("m") <= SMALL).select("key", "digest", "n", "label")
    y = x.select("key", F.col("digest").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    pairs = x.join(y, "key").filter((F.col("digest") < F.col("b")) & (F.col("label") != F.col("lb")) & _fits(F.col("n"), F.col("nb")))
    more = confirmed(written(pairs.select(F.col("digest").alias("a"), "b").distinct(), "near-across"), sets)
    return written(few.union(more).union(blocks(rows.filter(F.col("m") > SMALL), sets)).distinct(), "near-more")


def prefixes(sets: DataFrame) -> DataFrame:
    """(key, digest): the rarest shingles of each set, of which two sets of similarity PERCENT have one in common.

    How many sets hold a shingle is looked up for shingles that several hold; up to BROADCAST_ROWS of them go to every task, beyond, a join tells it.
    """
    each = sets.select("digest", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    held = written(each.groupBy("key").agg(F.count("*").alias("held")), "near-held")
    several = held.filter("held > 1")
    if several.count() <= BROADCAST_ROWS:
        known = several.orderBy("key").toPandas()
        sent = sets.sparkSession.sparkContext.broadcast((known["key"].to_numpy(np.int64), known["held"].to_numpy(np.int64)))

        def run(batches):
            names, counts = sent.value
            for batch in batches:
                for digest, row in zip(batch.column("digest"), batch.column("shingles"), strict=True):
                    keys = row.values.to_numpy()
                    at = np.searchsorted(names, keys)
                    shared = (at < len(names)) & (names[np.minimum(at, max(len(names) - 1, 0))] == keys) if len(names) else np.zeros(len(keys), bool)
                    order = np.lexsort((keys, np.where(shared, counts[at * shared] if len(names) else 1, 1)))
                    # a shingle of one set alone can't be shared; it takes its place in the prefix all the same
                    order = order[: len(keys) - -(-len(keys) * PERCENT // 100) + 1]
                    order = order[shared[order]]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[order]), pa.array([digest.as_py()] * len(order), pa.binary())], names=["key", "digest"])

        return sets.select("digest", "shingles").mapInArrow(run, "key long, digest binary")
    order = Window.partitionBy("digest").orderBy("held", "key")
    ranked = each.join(held, "key").withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("held") > 1) & (F.col("rank") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1)).select("key", "digest")


def blocks(large: DataFrame, sets: DataFrame) -> DataFrame:
    """The links (a, b) that join components among the classes (digest, label) of each key, by pairs of blocks."""
    # a component that fills blocks has blocks of its own, which needn't be compared with each other
    counts = large.groupBy("key", "label").agg(F.count("*").alias("c"))
    own = written(counts.filter(F.col("c") >= BLOCK), "near-own")
    rest = written(counts.filter(F.col("c") < BLOCK).groupBy("key").agg(F.sum("c").alias("r")), "near-rest")
    dealt = large.select("key", "digest", "label").join(_small(own), ["key", "label"], "left").join(_small(rest), "key", "left")
    size = F.coalesce("c", "r")
    part = F.pmod(F.xxhash64("digest"), F.ceil(size / BLOCK))
    dealt = dealt.withColumn("own", F.when(F.col("c").isNotNull(), F.col("label"))).withColumn("block", F.xxhash64("own", part))
    dealt = written(dealt.select("key", "digest", "label", "own", "block"), "near-dealt")
    each = written(dealt.select("key", "own", "block").distinct(), "near-blocks")
    other = each.select("key", F.col("own").alias("own_b"), F.col("block").alias("pb"))
    met = each.withColumnRenamed("block", "pa").join(other, "key").filter((F.col("pa") <= F.col("pb")) & F.coalesce(F.col("own") != F.col("own_b"), F.lit(True)))
    met = met.select("key", "pa", "pb")
    sides = met.select("*", F.col("pa").alias("block"), F.lit(0).alias("side")).union(met.filter("pa <> pb").select("*", F.col("pb").alias("block"), F.lit(1).alias("side")))
    sent = written(dealt.join(_small(written(sides, "near-sides")), ["key", "block"]).select("key", "pa", "pb", "side", "digest", "label"), "near-sent")
    full = sets.select("digest", "shingles").join(_small(sent), "digest")
    return full.groupBy("key", "pa", "pb").applyInArrow(block_links, "a binary, b binary")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(digest, shingles, sig, sketch) of the wanted (rep, mark, digest), once each; the sketch is the low byte of each signature value."""

    def run(batches):
        own = Shingler()
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                sets = [own(t) for t in part.column("text").to_pylist()]
                right = [xxhash.xxh3_128_digest(s.tobytes()) == d for s, d in zip(sets, part.column("digest").to_pylist(), strict=True)]
                sigs = [signature(s) for s in sets]
                sketch = pa.array([s.astype(np.uint8).view(np.int8) for s in sigs], pa.list_(pa.int8()))
                made = [part.column("digest"), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([s.tobytes() for s in sigs], pa.binary()), sketch]
                yield pa.RecordBatch.from_arrays(made, names=["digest", "shingles", "sig", "sketch"]).filter(pa.array(right))

    n = wanted.count()
    asked = wanted.withColumnRenamed("mark", "wanted_mark")
    same = docs["doc_id"].eqNullSafe(asked["rep"]) & (text_mark() == F.col("wanted_mark"))
    rows = docs.join(F.broadcast(asked) if n <= BROADCAST_ROWS else asked, same).select("digest", "text")
    found = written(rows.mapInArrow(run, "digest binary, shingles array<bigint>, sig binary, sketch array<tinyint>"), "near-sets")
    # rows that repeat a class's own row
    return found if found.count() == n else written(found.dropDuplicates(["digest"]), "near-sets")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, mark, n_shingles, component_id and kept_mark (the text, among those of component_id, that stays) of each row."""
    rows = written(signed(docs), "near-signed")
    some = rows.filter("n_shingles > 0")
    # which classes share a key with another: by 64-bit stand-ins, whose rare collisions only admit a class too many
    stand_in = F.xxhash64("digest").alias("h")
    top = some.select(stand_in, F.explode("tops").alias("key"))
    shared = top.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi").select("key")
    near = written(top.join(shared, "key", "left_semi").select("h").distinct(), "near-shared")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("r")
    classes = written(some.groupBy("digest").agg(first).select("digest", F.col("r.doc_id").alias("rep"), F.col("r.mark").alias("mark")).withColumn("h", stand_in), "near-classes")
    alike = written(classes.join(_small(near), "h", "left_semi").select("digest", "rep", "mark"), "near-alike")
    sets = shingle_sets(docs, alike)
    # every class in every region that it lies in, unless it is alone there
    trees = written(forest(sets), "near-forest")
    in_region = trees.select("digest", "n", F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), F.col(f"k{d}").alias("key")) for d in DEPTHS))).alias("r")).select("digest", "n", "r.depth", "r.key")
    sizes = written(in_region.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "near-regions")
    placed = written(in_region.join(_small(sizes), "key"), "near-placed")
    score = written(placed.filter(F.col("depth") == DEPTHS[1]).groupBy("digest").agg(F.sum("m").alias("score")), "near-score")
    ranked = placed.join(_small(score), "digest", "left").groupBy("key").agg(F.max(F.struct(F.coalesce("score", F.lit(0)).alias("score"), "digest", "n")).alias("p"))
    pivots = written(ranked.select("key", F.col("p.digest").alias("b"), F.col("p.n").alias("nb")), "near-pivots")
    pairs = placed.join(_small(pivots), "key").filter((F.col("digest") != F.col("b")) & _fits(F.col("n"), F.col("nb")))
    pairs = written(pairs.select(F.col("digest").alias("a"), "b").distinct(), "near-pairs")
    links = confirmed(pairs, sets)
    found = components(links)
    more = across(placed.filter(F.col("depth") == DEPTHS[0]).select("key", "digest", "n", "m"), found, sets)
    if not more.isEmpty():
        found = components(links.union(more))
    label = classes.select("digest", "rep", "mark").join(found, F.col("digest") == F.col("node"), "left").select("digest", "rep", "mark", F.coalesce("label", "digest").alias("label"))
    label = written(label, "near-label")
    smallest = written(label.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "mark")).alias("r")), "near-smallest")
    of = written(label.join(smallest, "label").select("digest", F.col("r.rep").alias("component_id"), F.col("r.mark").alias("kept_mark")), "near-components")
    # a third of all rows may be copies of one text: a plain join of two tables, whose hot keys adaptive execution splits
    out = rows.select("doc_id", "mark", "n_shingles", "digest").join(of, "digest", "left")
    return out.select("doc_id", "mark", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("kept_mark", "mark").alias("kept_mark"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with all its columns, one row of each group: the smallest doc_id. Rows without words are no group and stay."""
    mark = free_name(docs, "near_mark")
    out = written(groups(docs.select("doc_id", "text")), "near-groups")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("mark") == F.col("kept_mark"))
    # the rows that go are far fewer than those that stay; texts are shuffled only where even these are too many
    gone = written(out.filter(~stays).select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")).distinct(), "near-gone")
    marked = docs.withColumn(mark, text_mark())
    kept = marked.join(_small(gone), marked["doc_id"].eqNullSafe(gone["gone_id"]) & (F.col(mark) == F.col("gone_mark")), "left_anti")
    again = out.filter(stays & (F.col("n_shingles") > 0)).groupBy("doc_id", "mark").agg(F.count("*").alias("m")).filter("m > 1")
    again = written(again.select(F.col("doc_id").alias("again_id"), F.col("mark").alias("again_mark")), "near-again")
    if again.isEmpty():
        return kept.drop(mark)
    # of rows with one doc_id and text, of which the first of each partition goes on, one stays
    same = kept["doc_id"].eqNullSafe(again["again_id"]) & (F.col(mark) == F.col("again_mark"))
    once = kept.join(_small(again), same, "left_semi").dropDuplicates(["doc_id", mark])
    return kept.join(_small(again), same, "left_anti").unionByName(once).drop(mark)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return groups(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i+{WORDS - 1}], ' ')) AS shingle
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - {WORDS - 1}, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= {PERCENT} * (na.n + nb.n - i)),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
