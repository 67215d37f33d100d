"""The trie of conversation prefixes, by distributed radix partitioning from the first turn on.

Turns are dictionary-encoded: each distinct (role, text) gets a number, and conversations become arrays of numbers. Equal
conversations are one sequence with a count, so a group of copies is one row. The sequences start as one bucket, the
root. A bucket is moved along the prefix that all of its sequences share, and then dealt by the next turn. Buckets of
`LOCAL` sequences at most are local: a task finishes each by multikey quicksort and emits its nodes. Larger ones go into
the next round. When no large bucket is left, what the large ones need of their subtrees (children, leaves, tokens) is
added up from the deepest round to the root. There are as many rounds as levels at which a large bucket branches.

A bucket's shared prefix is that of its smallest and its largest sequence, so no task holds a large bucket. Ids of equal
conversations are joined in runs of one range of ids, and a stream over the sorted runs makes their digest.

Edge cases: turns without a conv_id belong to no conversation and are left out; a null role or text is empty; ties of a
turn are ordered by role and text, and repeated rows are turns of their own; turns without a number come first; an empty
table has no nodes, not even a root; other columns are left out. Texts are held by no task beyond the row at hand; the
numbers of one conversation, 8 bytes a turn, are one row.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, words, written

#: Sequences that a task finishes at once.
LOCAL = 256
#: Ids that one run of equal conversations is taken from, and rows of a partition.
RANGE = 1 << 16
FAMILY = 20
NOTHING = hashlib.sha256(b"").hexdigest()
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, bucket long, top boolean"


def encoded(conversations: DataFrame) -> DataFrame:
    """conv and seq, its turns' numbers in order, and words, how many words each has."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), "turn", empty("role").alias("role"), empty("text").alias("text"))
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "text")
    # the length of the role parts it from the text
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    turns = written(turns.withColumn("at", F.row_number().over(order)).select("conv", "at", digest.alias("digest"), F.size(words(F.col("text"))).cast("long").alias("n_words")), "turns")
    numbers = turns.groupBy("digest").agg(F.max("n_words").alias("n_words")).withColumn("number", F.monotonically_increasing_id())
    # a turn may open a third of all conversations: a plain join, whose hot keys adaptive execution splits
    joined = turns.drop("n_words").join(written(numbers, "turn-numbers"), "digest")
    rows = joined.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("at", "number", "n_words"))).alias("t"))
    return rows.select("conv", F.col("t.number").alias("seq"), F.col("t.n_words").alias("words"))


def rebuilt(own: DataFrame, family: int = FAMILY) -> DataFrame:
    """Each conversation with its first h turns from the first of its family of ids, where that exists."""
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(4)).cast("int")
    base = F.col("conv") - F.col("conv") % family
    heads = own.filter(F.col("conv") % family == 0).select(F.col("conv").alias("base"), F.slice("seq", 1, 3).alias("head"), F.slice("words", 1, 3).alias("head_words"))
    rows = own.withColumn("base", base).withColumn("h", h).join(heads, "base", "left")

    def mixed(head: str, rest: str) -> Column:
        start = F.when(F.col(head).isNull() | (F.col("h") == 0), F.array().cast("array<long>")).otherwise(F.slice(head, F.lit(1), F.greatest("h", F.lit(1))))
        return F.concat(start, F.slice(rest, F.col("h") + 1, F.greatest(F.size(rest), F.lit(1))))

    return rows.select("conv", mixed("head", "seq").alias("seq"), mixed("head_words", "words").alias("words"))


def sequences(convs: DataFrame) -> DataFrame:
    """Distinct seq with its words, n (conversations), first (smallest id) and ends (digest of the ids in order)."""
    ranged = convs.repartitionByRange(partitions(convs, RANGE), "conv").withColumn("run", F.spark_partition_id())
    runs = ranged.groupBy("seq", "run").agg(F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    runs = written(runs, "equal-runs")

    def digest(batches):
        """A running digest of each sequence over its sorted runs."""
        last, sha, state = None, None, []
        for batch in batches:
            out = []
            for seq, words_, n, first, ids in zip(*(batch.column(c).to_pylist() for c in ("seq", "words", "n", "first", "ids")), strict=True):
                if seq != last:
                    out += [(*state, sha.hexdigest())] if state else []
                    last, sha, state = seq, hashlib.sha256(ids.encode()), [seq, words_, n, first]
                else:
                    sha.update(b"," + ids.encode())
                    state[2] += n
                    state[3] = min(state[3], first)
            if out:
                yield _rows(out, kinds)
        if state:
            yield _rows([(*state, sha.hexdigest())], kinds)

    kinds = [("seq", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("n", pa.int64()), ("first", pa.int64()), ("ends", pa.string())]
    sorted_runs = runs.repartition(partitions(runs, RANGE), "seq").sortWithinPartitions("seq", "run")
    return sorted_runs.mapInArrow(digest, "seq array<long>, words array<long>, n long, first long, ends string")


def _rows(rows: list[tuple], kinds: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds, strict=True)], names=[k for k, _ in kinds])


def shared_length(low: Column, high: Column) -> Column:
    """The length of the common prefix of two different arrays."""
    return (F.array_position(F.zip_with(low, high, lambda a, b: ~a.eqNullSafe(b)), True) - 1).cast("int")


def quicksort_nodes(seqs: list, words_: list, n: list, first: list, ends: list, depth: int, parent: int) -> list[list]:
    """The nodes below a prefix of `depth` turns that all seqs share, by multikey quicksort over the turns after it.

    Rows of (conv_id, depth, parent's conv_id, n_convs, n_children, n_leaves, saved_tokens, ends), parents before children.
    """
    nodes, above = [], []

    def node(group: list[int], depth: int, up: int) -> int:
        own = min(first[i] for i in group)
        total = sum(n[i] for i in group)
        nodes.append([own, depth, nodes[up][0] if up >= 0 else parent, total, 0, 0, (total - 1) * words_[group[0]][depth - 1], NOTHING])
        above.append(up)
        if up >= 0:
            nodes[up][4] += 1
        return len(nodes) - 1

    stack = [(list(range(len(seqs))), depth, -1)]
    while stack:
        group, d, up = stack.pop()
        if len(group) == 1:
            i = group[0]
            for d in range(d, len(seqs[i])):
                up = node(group, d + 1, up)
            nodes[up][7] = ends[i]
            continue
        keys = [seqs[i][d] if d < len(seqs[i]) else -1 for i in group]
        pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
        less, more = [i for i, k in zip(group, keys) if k < pivot], [i for i, k in zip(group, keys) if k > pivot]
        equal = [i for i, k in zip(group, keys) if k == pivot]
        stack += [(part, d, up) for part in (less, more) if part]
        if pivot < 0:
            nodes[up][7] = ends[equal[0]]
        else:
            stack.append((equal, d + 1, node(equal, d + 1, up)))
    for own, up in zip(reversed(nodes), reversed(above)):
        own[5] = own[5] or 1
        if up >= 0:
            nodes[up][5] += own[5]
            nodes[up][6] += own[6]
    return nodes


_NODE_KINDS = [(c.split()[0], {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]]) for c in NODES.split(", ")]


def local_nodes(rows: DataFrame) -> DataFrame:
    """The nodes of local buckets: rows of (bucket, next, depth, above, seq, words, n, first, ends), depth being that of their parent."""

    def run(batches):
        key, held, out = None, [], []

        def finish():
            seqs, words_, n, first, ends, depth, above = map(list, zip(*held))
            made = quicksort_nodes(seqs, words_, n, first, ends, depth[0], above[0])
            return [(*row, key[0], k == 0) for k, row in enumerate(made)]

        for batch in batches:
            names = ("bucket", "next", "seq", "words", "n", "first", "ends", "depth", "above")
            for bucket, following, *row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if (bucket, following) != key:
                    out += finish() if held else []
                    key, held = (bucket, following), []
                held.append(row)
                if len(out) >= 10_000:
                    yield _rows(out, _NODE_KINDS)
                    out = []
        out += finish() if held else []
        if out:
            yield _rows(out, _NODE_KINDS)

    dealt = rows.repartition(partitions(rows, RANGE), "bucket", "next").sortWithinPartitions("bucket", "next")
    return dealt.mapInArrow(run, NODES)


def chain_nodes(large: DataFrame) -> DataFrame:
    """The nodes of large buckets along their shared prefix, from depth `top` to `depth`, with what lies below them."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                saved = r["saved_tokens"]
                for d in range(r["depth"], r["top"] - 1, -1):
                    last = d == r["depth"]
                    saved += (r["n"] - 1) * r["words"][d - 1] if d else 0
                    up = r["above"] if d == r["top"] else r["first"]
                    out.append((r["first"], d, up, r["n"], r["n_children"] if last else 1, r["n_leaves"], saved, r["ends"] if last else NOTHING, r["up"], d == r["top"]))
            if out:
                yield _rows(out, _NODE_KINDS)

    return large.mapInArrow(run, NODES)


def trie(seqs: DataFrame, local: int = LOCAL) -> DataFrame:
    """The nodes over distinct sequences (seq, words, n, first, ends)."""
    spark = seqs.sparkSession
    none = F.lit(None).cast("long")
    rows = written(seqs.withColumn("bucket", F.lit(0).cast("long")).withColumn("top", F.lit(0)).withColumn("up", none).withColumn("above", none), "trie-rows")
    larges, smalls = [], []
    while True:
        # the rows of this round's large buckets: where each bucket's shared prefix ends
        lows = rows.groupBy("bucket", "top", "up", "above").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.min(F.struct("seq", "words", "ends")).alias("low"), F.max("seq").alias("high"))
        depth = F.when(F.col("low.seq") == F.col("high"), F.size("high")).otherwise(shared_length(F.col("low.seq"), F.col("high"))).cast("int")
        lows = lows.withColumn("depth", depth).withColumn("ends", F.when(F.size("low.seq") == F.col("depth"), F.col("low.ends")).otherwise(NOTHING))
        lows = written(lows.select("bucket", "top", "up", "above", "n", "first", F.slice("low.words", F.lit(1), F.greatest("depth", F.lit(1))).alias("words"), "depth", "ends"), f"trie-large-{len(larges)}")
        larges.append(lows)
        moved = rows.select("bucket", "seq", "words", "n", "first", "ends").join(lows.select("bucket", "depth", F.col("first").alias("above")), "bucket")
        moved = moved.filter(F.size("seq") > F.col("depth")).withColumn("next", F.element_at("seq", F.col("depth") + 1))
        moved = written(moved, f"trie-moved-{len(larges)}")
        counts = moved.groupBy("bucket", "next").agg(F.count("*").alias("m")).filter(F.col("m") > local)
        counts = written(counts.select("bucket", "next", F.monotonically_increasing_id().alias("new")), f"trie-split-{len(larges)}")
        # large buckets alone: Spark broadcasts them where their size allows
        marked = moved.join(counts, ["bucket", "next"], "left")
        smalls.append(marked.filter(F.col("new").isNull()).drop("new"))
        if counts.isEmpty():
            break
        rows = written(marked.filter(F.col("new").isNotNull()).select(F.col("new").alias("bucket"), (F.col("depth") + 1).alias("top"), F.col("bucket").alias("up"), "above", "seq", "words", "n", "first", "ends"), f"trie-rows-{len(larges)}")
    nodes, below = [], None
    for large, small in zip(reversed(larges), reversed(smalls)):
        own = written(local_nodes(small), "trie-local")
        tops = own.filter("top") if below is None else own.filter("top").unionByName(below.filter("top"))
        # parents are told apart within their round: both kinds of children carry the bucket that they lie in
        sums = tops.groupBy("bucket").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        whole = large.join(sums, "bucket", "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "n_leaves": F.coalesce("n_leaves", F.lit(1)), "saved_tokens": F.coalesce("saved_tokens", F.lit(0))})
        below = written(chain_nodes(whole), "trie-chains")
        nodes += [own, below]
    return reduce(DataFrame.unionByName, nodes).drop("bucket", "top") if nodes else spark.createDataFrame([], NODES)


def query(spark: SparkSession, conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    return trie(sequences(written(rebuilt(encoded(conversations)), "rebuilt")), local)


#: A fold through a table of 256 values is the CRC-32, as in the SQL of sharding.
SQL = f"""
WITH c AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c, hex(encode(c::VARCHAR)) AS x FROM o),
h AS (SELECT c, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda a, y: xor(a >> 8, tab[1 + (xor(a, y) & 255)]))) % 4 AS h FROM ids, c),
t AS (SELECT h.c, o.i, o.role, o.text FROM h JOIN o ON o.c = h.c AND o.i > h.h UNION ALL SELECT h.c, o.i, o.role, o.text FROM h JOIN o ON o.c = h.c - h.c % {FAMILY} AND o.i <= h.h),
n AS (SELECT c, i, dense_rank() OVER (ORDER BY role, text) AS k, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w FROM t),
s AS (SELECT ids.c, list(n.k ORDER BY n.i) FILTER (WHERE n.k IS NOT NULL) AS seq, list(n.w ORDER BY n.i) FILTER (WHERE n.k IS NOT NULL) AS w FROM ids LEFT JOIN n ON n.c = ids.c GROUP BY 1),
p AS (SELECT c, coalesce(seq, []) AS seq, coalesce(w, []) AS w, unnest(range(len(coalesce(seq, [])) + 1)) AS d FROM s),
node AS (SELECT d, seq[1:d] AS pre, min(c) AS conv_id, count(*) AS n, coalesce(max(w[d]), 0) AS w, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len(seq) = d), '') AS ends FROM p GROUP BY 1, 2),
kids AS (SELECT pre[1:d - 1] AS pre, d - 1 AS d, count(*) AS k FROM node WHERE d > 0 GROUP BY 1, 2),
whole AS (SELECT node.*, coalesce(k, 0) AS k FROM node LEFT JOIN kids ON kids.d = node.d AND kids.pre = node.pre),
up AS (SELECT pre, d, (n - 1) * w AS saved, k = 0 AS leaf, unnest(range(d + 1)) AS a FROM whole),
sums AS (SELECT pre[1:a] AS pre, a AS d, sum(saved)::BIGINT AS saved, count(*) FILTER (WHERE leaf) AS leaves FROM up GROUP BY 1, 2)
SELECT whole.conv_id, whole.d AS depth, above.conv_id AS parent_conv_id, whole.n AS n_convs, whole.k AS n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(whole.ends) AS ends_sha256
FROM whole JOIN sums ON sums.d = whole.d AND sums.pre = whole.pre LEFT JOIN node above ON above.d = whole.d - 1 AND above.pre = whole.pre[1:whole.d - 1]
"""
