"""Steps whose cost at size was found too high: what they write and how often they read, beside right results."""

import os
import random
import re
from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from textgraph import catalogue, catalogue_index
from textgraph import schema as schemas
from textgraph.functions import edge_id
from textgraph.operators import ancestry, graph, history, names
from textgraph.operators import collections as coll
from textgraph.plans import artifact_passes, model
from textgraph.sources import code
from textgraph.schema import schema
from textgraph.storage import Catalog, honest_sizes
from textgraph.streaming import watch


def _scans(df, column: str) -> int:
    """How often a plan reads tables with a column of this name."""
    return len(re.findall(rf"Relation ?\[[^\]]*\b{column}#", df._jdf.queryExecution().analyzed().toString()))


def test_edges_are_written_as_keys(spark, tmp_path):
    at = str(tmp_path)
    spark.sql("SELECT * FROM VALUES (1, 7), (1, 7), (NULL, 8) t(o_orderkey, o_custkey)").write.parquet(f"{at}/orders.parquet")
    spark.sql("SELECT * FROM VALUES (1, 2, 3, 'R'), (1, 2, 3, 'A'), (1, 2, 3, 'A'), (1, 2, 4, NULL) t(l_orderkey, l_partkey, l_suppkey, l_returnflag)").write.parquet(f"{at}/lineitem.parquet")
    spark.sql("SELECT * FROM VALUES (7, 0), (CAST(NULL AS INT), 0) t(c_custkey, c_nationkey)").write.parquet(f"{at}/customer.parquet")
    spark.sql("SELECT * FROM VALUES (3, 0), (CAST(NULL AS INT), 0) t(s_suppkey, s_nationkey)").write.parquet(f"{at}/supplier.parquet")
    m = model.Model(spark, at)
    found = sorted(m.edges.select("from_entity_id", "to_entity_id", "kind", "location_uri").collect(), key=repr)
    o = "text://star/order/1"
    assert found == sorted([
        ("customer:7", "order:1", "placed", o), ("customer:8", None, "placed", None), ("order:1", "part:2", "verified_by", o), ("order:1", "part:2", "contains", o), ("part:2", "supplier:3", "supplied_by", o),
        ("part:2", "supplier:4", "supplied_by", o), ("customer:7", "nation:0", "located_in", "text://star/customer/7"), ("supplier:3", "nation:0", "located_in", "text://star/supplier/3"), (None, "nation:0", "located_in", None),
    ], key=repr)
    stored = model._EDGES[(at, spark.sparkContext.applicationId)]
    assert "id" not in stored.columns and {t for c, t in stored.dtypes if c in "xyz"} == {"int"}


def test_ends_of_edges_are_joined_as_numbers(spark, tmp_path):
    """Also where orders, parts or keys are missing; no text is put together below a join."""
    at = str(tmp_path)
    spark.sql("SELECT * FROM VALUES (1, 7), (2, 9), (NULL, 7), (3, NULL), (1, 7) t(o_orderkey, o_custkey)").write.parquet(f"{at}/orders.parquet")
    spark.sql("SELECT * FROM VALUES (1, 2, 3, 'R'), (1, 2, 3, 'A'), (1, 5, 3, 'A'), (4, 2, 4, 'A'), (4, 2, 3, 'A'), (1, 2, NULL, NULL), (NULL, 2, 3, 'R') t(l_orderkey, l_partkey, l_suppkey, l_returnflag)").write.parquet(f"{at}/lineitem.parquet")
    spark.sql("SELECT * FROM VALUES (7, 0, 'a'), (CAST(NULL AS INT), 0, 'b') t(c_custkey, c_nationkey, c_name)").write.parquet(f"{at}/customer.parquet")
    spark.sql("SELECT * FROM VALUES (3, 0, 'a') t(s_suppkey, s_nationkey, s_name)").write.parquet(f"{at}/supplier.parquet")
    spark.sql("SELECT * FROM VALUES (2, 'p') t(p_partkey, p_name)").write.parquet(f"{at}/part.parquet")
    spark.sql("SELECT * FROM VALUES (0, 'n') t(n_nationkey, n_name)").write.parquet(f"{at}/nation.parquet")
    m = model.Model(spark, at)
    for without in ((), ("nation",)):
        ends = m.plain_entities.filter("kind <> 'module'") if without else m.plain_entities
        want = graph.guarded(m.edges, m.plain_entities).join(ends.select(F.col("id").alias("to_entity_id")), "to_entity_id", "left_semi").select(*m.edges.columns)
        found = m.guarded_edges(without)
        assert found.columns == want.columns and sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() == (6 if without else 8)
    joins = re.findall(r"Join LeftSemi, (.*)", catalogue.QUERIES["edge_guard_semi"](spark, at)._jdf.queryExecution().optimizedPlan().toString())
    assert len(joins) == 8 and all(re.fullmatch(r"\(([xy])#\d+L? = \1#\d+L?\)", j) for j in joins), joins


def test_a_cascade_reads_the_edges_once(spark, tmp_path):
    edges = spark.sql("SELECT * FROM VALUES ('1', 'a', 'b', 'u'), ('2', 'b', 'a', 'v'), ('3', 'c', 'c', 'w'), ('4', NULL, NULL, NULL), ('5', 'c', 'c', 'u') t(id, from_entity_id, to_entity_id, location_uri)")
    edges.write.parquet(f"{tmp_path}/edges-once")
    entities = spark.sql("SELECT * FROM VALUES ('a', 'u', 'x'), ('b', 'y', 'z'), ('c', 'w', NULL) t(id, first_location_uri, last_location_uri)")
    gone, touched = history.cascade(entities, spark.read.parquet(f"{tmp_path}/edges-once"), spark.sql("SELECT * FROM VALUES ('u'), ('u'), ('x') t(uri)"))
    assert [r.id for r in gone.collect()] == ["a"]
    assert sorted(r.id for r in touched.select("id").collect()) == ["1", "2", "5"]
    assert touched.columns == edges.columns and _scans(touched, "from_entity_id") == 1
    assert touched.select("id").filter(F.col("id") == "5").count() == 1


def test_rows_that_hold_values_are_told_without_a_shuffle(spark, tmp_path, monkeypatch):
    """By bits; what these tell wrong is known, and beyond the limits rows are joined."""
    rows = spark.sql("SELECT id, IF(id % 7 = 0, NULL, CONCAT('v', id % 50)) AS a, CONCAT('v', id % 33) AS b FROM RANGE(300)")
    rows.write.parquet(f"{tmp_path}/rows")
    rows, values = spark.read.parquet(f"{tmp_path}/rows"), spark.sql("SELECT CONCAT('v', id % 40) AS v FROM RANGE(3, 90, 4) UNION ALL SELECT NULL")
    known = {r.v for r in values.collect()} - {None}
    want = sorted((r.id, r.a in known or r.b in known) for r in rows.collect())
    found = history.Held(values).marked(rows, "hit", "a", "b")
    assert found.columns == ["id", "a", "b", "hit"] and sorted((r.id, r.hit) for r in found.collect()) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and _scans(found, "b") == 1
    assert not history.Held(values.filter("v = 'none'")).marked(rows, "hit", "a").filter("hit").count()
    for name, value in (("_places", lambda h, n: [np.zeros(len(h), np.uint64)]), ("WRONG", 0), ("HELD", 0)):
        monkeypatch.setattr(history, name, value)
        assert sorted((r.id, r.hit) for r in history.Held(values).marked(rows, "hit", "a", "b").collect()) == want


def test_rows_once_each(spark, monkeypatch):
    rows = spark.createDataFrame([(k // 2 if k < 6 else k, None if k % 3 == 0 else "x") for k in range(20)] * 2 + [(99, "y")], "a int, b string")
    want = sorted(map(repr, rows.dropDuplicates(["a", "b"]).collect()))
    assert sorted(map(repr, history.once(rows, ["a", "b"]).collect())) == want
    monkeypatch.setattr(history, "WRONG", 0)
    assert sorted(map(repr, history.once(rows, ["a", "b"]).collect())) == want


def test_a_sweep_rewrites_what_loses_many_rows(spark, tmp_path, monkeypatch):
    """In both ways the same rows go and stay, those of other corpora too; edges are stored without ids that their columns give."""
    def made(corpus, k):
        u, e = f"{corpus}/u{k}", f"{corpus}:e{k}"
        return {
            "chunks": (f"{corpus}c{k}", corpus, u, "v1"), "entities": (e, corpus, u, f"{corpus}/u{k + 1}", "v1"), "summaries": (f"{corpus}s{k}", corpus, "chunk", f"{corpus}c{k}", "m", "v1"),
            "edges": (f"{corpus}own{k}", corpus, e, f"{corpus}:e{k + 1}", "calls", u, "v1"), "embeddings": (f"{corpus}m{k}", corpus, f"{corpus}c{k}", "v1"), "entity_purposes": (e, corpus, "m", "v1"),
        }
    columns = {"chunks": "id corpus_id location_uri", "entities": "id corpus_id first_location_uri last_location_uri", "summaries": "id corpus_id target_kind target_id model", "edges": "id corpus_id from_entity_id to_entity_id kind location_uri", "embeddings": "id corpus_id chunk_id", "entity_purposes": "entity_id corpus_id model"}
    every = [made(c, k) for c in ("c", "d") for k in range(12)]
    tables = {n: artifact_passes.as_table(spark.createDataFrame([r[n] for r in every], ", ".join(f"{x} string" for x in (of + " derived_at_version").split())), n) for n, of in columns.items()}
    given = edge_id(*(F.col(c) for c in columns["edges"].split()[1:]))
    tables["edges"] = tables["edges"].withColumn("id", F.when(F.col("from_entity_id") == "c:e3", F.col("id")).otherwise(given))
    dirty = spark.createDataFrame([("cc3",), ("cc3",), ("dc5",)], "id string")
    gone = history.cascade_all({n: tables.get(n, spark.createDataFrame([], schema(n))) for n in schemas.VERSIONED}, "c", dirty)
    for share in (10**6, 0):
        monkeypatch.setattr(history, "REWRITTEN", share)
        catalog = Catalog(spark, f"{tmp_path}/{share}")
        catalog.commit(**tables)
        assert history.swept(catalog, "c", dirty, "v2") == 2
        entries = catalog._manifest(2)
        assert bool(entries["edges"]["deltas"]) == (not share)
        for n, df in tables.items():
            keys = schemas.VERSIONED[n]
            ids = lambda rows: sorted(map(tuple, rows.select(*keys).collect()))
            assert ids(catalog.table(f"{n}_history")) == ids(gone[n]) and ids(gone[n])
            assert ids(catalog.table(n)) == ids(df.join(gone[n], keys, "left_anti"))
        stored = spark.read.parquet(*[p for _, p, _ in catalog._manifest(1)["edges"]["parts"]])
        assert stored.filter("id is null").count() == 23 and stored.filter("id = 'cown3'").count() == 1


def test_names_are_looked_up_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(names, "BLOCK", 2)
    texts = ["The quick brown fox", "a quick brown bird", "Brown", "", None, "ab", "The quick brown foxes jump"]
    entities = spark.createDataFrame([(f"e{k}", t, k % 3) for k, t in enumerate(texts)], "id string, canonical_name string, appearance_count int")
    asked = ["quick brown ", "the quick brown fox", "BROWN", "ab", "a", "q", "quick brown b", "none of these", "", None]
    found = names.resolved(spark.createDataFrame([(k, n) for k, n in enumerate(asked)], "key int, name string"), entities, 2)
    want = []
    for k, n in enumerate(asked):
        hits = sorted((-(e % 3), f"e{e}") for e, t in enumerate(texts) if n and t and n.lower() in t.lower())
        want += [(k, n, e) for _, e in hits[:2]]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_long_runs_are_looked_up_in_one_pass(spark, monkeypatch):
    """By their hashes, across pieces, batches and characters of any width; runs that hash alike are told apart by what is asked."""
    monkeypatch.setattr(names, "BLOCK", 2)
    monkeypatch.setattr(names, "PIECE", 20)
    texts = ["The quick brown fox jumps over the quick brown fox " * 3, None, "", "ab\U0001f600cdefghijkl\u00e9mnopqrstuvwxyz", "quick brown ", "elevenchars"]
    asked = ["QUICK BROWN ", "over the qui", "\U0001f600cdefghijkl", "ghijkl\u00e9mnopq", "none of this", "mps over the"]
    found = names.resolved(spark.createDataFrame([(k, n) for k, n in enumerate(asked)], "key int, name string"), spark.createDataFrame([(f"e{k}", t, k) for k, t in enumerate(texts)], "id string, canonical_name string, appearance_count int"))
    assert found._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 1
    assert sorted((r.key, r.id) for r in found.collect()) == sorted((k, f"e{e}") for k, n in enumerate(asked) for e, t in enumerate(texts) if t and n.lower() in t.lower())
    monkeypatch.setattr(names, "hashes", lambda text, n: np.zeros(max(0, len(text) - n + 1), np.uint64))
    assert names.runs_among(["abcdef", None], 4, np.zeros(1, np.uint64)) == [(0, "abcd"), (0, "bcde"), (0, "cdef")]


def test_a_pass_sends_no_table_for_its_small_file(spark, tmp_path):
    spark.range(300000).select(F.col("id"), F.lit("x" * 1000).alias("content")).write.parquet(f"{tmp_path}/packed")
    packed = spark.read.parquet(f"{tmp_path}/packed")
    plan = lambda: spark.range(10**9).join(packed, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan()
    with honest_sizes(spark):
        packed = spark.read.parquet(f"{tmp_path}/packed")
        assert "BroadcastHashJoin" not in plan()
    assert spark.conf.get("spark.sql.sources.fileCompressionFactor") == "1.0"


def test_summaries_of_many_groups_are_those_of_the_sql(spark, tmp_path, monkeypatch):
    """More groups than lines of a prompt, over several ranges: the groups are cut by position in the whole, and once."""
    monkeypatch.setattr(artifact_passes, "LINES", 3)
    monkeypatch.setattr(artifact_passes, "RANGE", 8)
    turns = spark.range(40).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("said "), "id").alias("text"))
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    found = catalogue.QUERIES["summarize_pass"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    sql = catalogue.SQL["summarize_pass"].replace("// 200", "// 3").replace("% 200", "% 3").replace("> 200", "> 3").replace("<= 200", "<= 3")
    assert sorted(tuple(r) for r in found) == sorted(con.sql(sql).fetchall())


def test_tools_write_what_they_read(spark, tmp_path):
    """A list of blocks needs no edges, and writes none."""
    for t in os.listdir("/root/testdata/sf0.001"):
        os.symlink(f"/root/testdata/sf0.001/{t}", f"{tmp_path}/{t}")
    assert catalogue.QUERIES["block_list"](spark, str(tmp_path)).count() == 25
    assert (str(tmp_path), spark.sparkContext.applicationId) not in model._EDGES
    assert catalogue.QUERIES["tool_corpus_list"](spark, str(tmp_path)).count()


class _State:
    """A value or list state that counts how often it is read."""

    def __init__(self):
        self.rows, self.reads = [], 0

    def get(self):
        self.reads += 1
        return tuple(self.rows)

    def exists(self):
        return bool(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    update = put

    def appendList(self, rows):
        self.rows += rows

    def clear(self):
        self.rows = []


class _Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getListState(self, name, schema):
        return self.states.setdefault(name, _State())

    getValueState = getListState

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_a_path_with_many_events_is_decided_at_once():
    """One timer a path, and its state is read once however many of its events are over; batches and order don't matter."""
    at = [pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=10 * k - (7 if k % 5 == 4 else 0)) for k in range(1000)]
    events = pd.DataFrame({"path": "a", "at": at, "content": [None if k % 7 == 0 else f"c{k % 3}" for k in range(1000)]})
    found = []
    for sizes in ([1000], [400, 600]):
        handle, watcher, out = _Handle(), watch.Debounce(5000), []
        watcher.init(handle)
        own, k = events.sample(frac=1, random_state=len(sizes)), 0
        for n in sizes:
            watcher.handleInputRows(("a",), iter([own[k : k + n]]), None)
            k += n
            assert len(handle.timers) == 1
        over = int(at[700].timestamp() * 1000) + 1
        for now in (over, 1 << 50):
            timers = SimpleNamespace(getCurrentWatermarkInMs=lambda now=now: now)
            while handle.timers and min(handle.timers) <= now:
                first = min(handle.timers)
                out += list(watcher.handleExpiredTimer(("a",), timers, SimpleNamespace(getExpiryTimeInMs=lambda first=first: first)))
                handle.timers.remove(first)
        assert sum(s.reads for s in handle.states.values()) < 12 and not handle.timers
        found.append([tuple(r) for p in out for r in p[["change", "content", "at"]].astype(object).where(lambda p: p.notna(), None).itertuples(index=False)])
    last, want = None, []
    for k, (t, c) in enumerate(zip(events["at"], events["content"])):
        if not any(t < other <= t + pd.Timedelta(seconds=5) for other in at[max(0, k - 3) : k + 4]) and c != last:
            want.append(("deleted" if c is None else "added" if last is None else "modified", c, t))
            last = c
    assert found[0] == found[1] == want


def test_code_edges_lex_once_over_all_tasks(spark):
    """Six kinds of edges are taken from one reading of the items, and parts of one small file are dealt over all tasks."""
    m = model.Model(spark, "/root/testdata/sf0.001")
    files = catalogue_index._code_files(m)
    assert files.rdd.getNumPartitions() == 4
    out = code.edges(code.structure(files), "c")
    assert len(re.findall(r"MapIn(?:Arrow|Pandas)", out._jdf.queryExecution().optimizedPlan().toString())) == 1
    none = spark.createDataFrame([], code.structure(files).schema)
    assert code.edges(none, "c").count() == 0


def test_a_location_groups_the_edges_of_its_own_entities_alone(spark):
    edges = spark.sql("SELECT * FROM VALUES ('a', 'v'), ('a', 'u'), ('a', 'w'), ('b', 'v'), ('b', 'v'), ('c', 'w'), (NULL, 'v'), ('d', NULL), ('e', 'v'), ('e', 'x') t(to_entity_id, location_uri)")
    found = graph.seen_with(edges, "v")
    assert sorted(map(tuple, found.filter("id is not null").collect())) == [("a", "u", "w"), ("b", "v", "v"), ("e", "v", "x")]
    assert graph.seen_with(edges, "none").isEmpty()
    # which ones these are is a written table, so the edges meet it before they are grouped
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")


def test_degrees_meet_the_entities_in_one_join(spark):
    entities = spark.sql("SELECT * FROM VALUES ('a', 'x'), ('b', 'y'), ('b', 'y'), ('c', 'z'), (NULL, 'z') t(id, kind)")
    edges = spark.sql("SELECT * FROM VALUES ('a', 'b'), ('a', 'b'), ('b', 'b'), ('b', NULL), (NULL, 'a') t(from_entity_id, to_entity_id)")
    found = graph.degrees(entities, edges)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([("a", "x", 1, 2), ("b", "y", 3, 2), ("b", "y", 3, 2), ("c", "z", 0, 0), (None, "z", 0, 0)], key=repr)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_places_are_cut_down_by_their_numbers(spark, tmp_path):
    at = str(tmp_path)
    keys = [3, 20, 100, 7, 19, 1000, -5, -10, -4, None]
    spark.createDataFrame([(k, 7) for k in keys], "o_orderkey long, o_custkey long").write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame([(k, 2, 4 + (k or 0) % 2, "R" if k and k > 50 else "N") for k in keys], "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{at}/lineitem.parquet")
    spark.sql("SELECT * FROM VALUES (7, 0), (40, 0), (CAST(NULL AS INT), 0) t(c_custkey, c_nationkey)").write.parquet(f"{at}/customer.parquet")
    spark.sql("SELECT * FROM VALUES (4, 0), (CAST(NULL AS INT), 1) t(s_suppkey, s_nationkey)").write.parquet(f"{at}/supplier.parquet")
    m = model.Model(spark, at)
    edges = m.edges.select("from_entity_id", "to_entity_id", "kind", "location_uri").toPandas()
    con = duckdb.connect()
    con.register("edges", edges)
    want = lambda sql: sorted(con.execute(sql).fetchall(), key=repr)
    both = "SELECT id, count(*), min(u), max(u) FROM (SELECT to_entity_id AS id, location_uri AS u FROM edges UNION ALL SELECT from_entity_id, location_uri FROM edges) GROUP BY 1"
    assert sorted(map(tuple, m.places().collect()), key=repr) == want(both)
    into = "SELECT to_entity_id, count(*), min(location_uri), max(location_uri) FROM edges WHERE kind IN ('contains', 'verified_by') GROUP BY 1"
    assert sorted(map(tuple, m.places(False, ("contains", "verified_by")).collect()), key=repr) == want(into)
    # ends are met in a hash; only what is left of them is sorted
    plan = m.places()._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("SortAggregate") < plan.index("HashAggregate") and plan.rindex("SortAggregate") < plan.index("HashAggregate")


def test_link_candidates_meet_each_pair_once(spark):
    r = random.Random(3)
    made = lambda n: [(str(k), "".join(r.choice("abé") for _ in range(r.randint(0, 7))), r.choice(["x", "x", "y", "", None])) for k in range(n)]
    a, b, types = made(120), [*made(120), ("t", "abéabé", "x"), ("u", "béabéa", "x")], "id string, canonical_name string, abstract_kind string"
    found = coll.link_candidates(spark.createDataFrame(a, types), spark.createDataFrame(b, types))

    def edits(s, t):
        row = list(range(len(t) + 1))
        for i, c in enumerate(s):
            last, row = row, [i + 1]
            for j, d in enumerate(t):
                row.append(min(last[j] + (c != d), last[j + 1] + 1, row[j] + 1))
        return row[-1]

    pairs = [(x, y) for x in a for y in b if x[1] and y[1]]
    want = [(x[0], y[0], "HIGH") for x, y in pairs if x[1] == y[1]] + [(x[0], y[0], "MEDIUM") for x, y in pairs if x[1] != y[1] and x[2] and x[2] == y[2] and edits(x[1], y[1]) <= 2]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    # pairs that differ at one or two places, nearly all of those of numbered names, are told apart by no step and looked up by none
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" in plan and plan.index("j#") < plan.index("levenshtein")


def test_what_is_behind_commits_comes_from_drawn_together_ones(spark, monkeypatch):
    monkeypatch.setattr(ancestry, "FEW", 5)
    monkeypatch.setattr(ancestry, "ROUNDS", 2)
    r = random.Random(1)
    up = {f"c{k}": f"c{r.randrange(max(0, k - 4), k)}" for k in range(1, 60)} | {"z1": "z0"}
    nodes = set(up) | set(up.values()) | {"alone"}

    def way(n):
        k = 0
        while n in up:
            n, k = up[n], k + 1
        return n, k

    size = lambda n: 1 + sum(size(c) for c, p in up.items() if p == n)
    edges = spark.createDataFrame(list(up.items()), "id string, up string")
    found = ancestry._behind(spark.createDataFrame([(n,) for n in nodes], "id string"), edges)
    assert sorted(map(tuple, found.collect())) == sorted((n, size(n)) for n in nodes)
    ended = ancestry._ended(edges.select("id", F.col("up").alias("to"), F.lit(1).cast("long").alias("pos")))
    assert sorted(map(tuple, ended.select("id", "to", "pos").collect())) == sorted((n, *way(n)) for n in up)
