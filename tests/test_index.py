"""Ancestry labels, resolved names, running digests and the search index against brute force."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from textgraph.operators import ancestry, hashes, names, postings, search
from textgraph.operators.postings import Postings
from textgraph.storage import Conflict


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_ancestry_of_a_random_history(spark):
    r = random.Random(3)
    parents = {0: [], 1: []}
    for k in range(2, 160):
        parents[k] = r.sample(range(max(0, k - 30), k), min(k, r.choice([1, 1, 1, 2, 3])))
    above = {}
    for k in range(160):
        above[k] = {k}.union(*(above[p] for p in parents[k]))
    commits = [(f"c{k}", f"c{p}", n) for k, ps in parents.items() for n, p in enumerate(ps)] + [("c0", None, 0), ("c1", None, 0)]
    df = spark.createDataFrame(commits, "id string, parent string, nth int")
    for labels in (ancestry.labelled(df), ancestry.labelled(df.drop("nth"))):
        assert labels.places.count() == 160 and labels.places.groupBy("chain", "pos").count().filter("count > 1").isEmpty()
        for t in (0, 40, 159):
            assert {s["sha"] for s in ancestry.ancestors(labels, f"c{t}").collect()} == {f"c{k}" for k in above[t]}
            assert {s["sha"] for s in ancestry.descendants(labels, f"c{t}").collect()} == {f"c{k}" for k in above if t in above[k]}
    assert ancestry.ancestors(labels, "none").count() == 0
    pairs = [(f"c{a}", f"c{d}") for a in range(0, 160, 7) for d in range(0, 160, 11)] + [("none", "c3"), ("c3", "none")]
    found = ancestry.related(labels, spark.createDataFrame(pairs, "ancestor string, descendant string"))
    assert {(x["ancestor"], x["descendant"]): x["holds"] for x in found.collect()} == {(a, d): a != "none" and d != "none" and int(a[1:]) in above[int(d[1:])] for a, d in pairs}


def test_names_by_substring(spark):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abAB é") for _ in range(n))
    entities = [(f"e{k:03}", word(r.randint(0, 9)), r.randint(0, 5)) for k in range(300)]
    asked = [(k % 7, word(r.randint(0, 5))) for k in range(120)] + [(1, "abab"), (1, "zzz"), (2, "")]
    found = names.resolved(spark.createDataFrame(asked, "key int, name string"), spark.createDataFrame(entities, "id string, canonical_name string, appearance_count int"), 6)
    want = set()
    for key, name in asked:
        hits = sorted((-n, i) for i, text, n in entities if name and name.lower() in text.lower())
        want |= {(key, name, i) for _, i in hits[:6]}
    assert set(map(tuple, found.collect())) == want and len(want) > 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_running_digests(spark):
    r = random.Random(7)
    data = [(k % 3 if k % 11 else None, r.randint(0, 50), r.choice([None, "", "é", "text " * r.randint(0, 40)])) for k in range(2000)]
    out = hashes.running_sha256(spark.createDataFrame(data, "k int, p int, c string").repartition(5), "k", "p", "c")
    assert out.columns == ["k", "hash"]
    for key, digest in map(tuple, out.collect()):
        own = sorted((p, c is not None, (c or "").encode()) for k, p, c in data if k == key)
        assert digest == hashlib.sha256(b"".join(c for *_, c in own)).hexdigest()
    assert out.count() == 4 and hashes.running_sha256(spark.createDataFrame([], "k int, p int, c string"), "k", "p", "c").count() == 0
    # a group of 300 MB in one task, whose workers hold a batch
    big = spark.range(3000).select(F.lit(1).alias("k"), "id", F.repeat(F.lit("x"), 100_000).alias("c"))
    assert hashes.running_sha256(big, "k", "id", "c").first()["hash"] == hashlib.sha256(b"x" * 300_000_000).hexdigest()


def test_index_follows_changes(spark, tmp_path):
    r = random.Random(9)
    words = "cat dog bird zebra whale the and of".split()
    text = lambda: " ".join(r.choice(words) for _ in range(r.randint(0, 12)))
    live = {f"u{k}": text() for k in range(60)}
    table = lambda d: spark.createDataFrame([(u, "c", t) for u, t in d.items()], "location_uri string, corpus_id string, content string")
    index = Postings.build(table(live), f"{tmp_path}/index")
    stale = Postings(spark, f"{tmp_path}/index")
    for k in range(6):
        changed = {u: text() for u in r.sample(sorted(live), 5)} | {f"n{k}{j}": text() for j in range(4)}
        gone = r.sample(sorted(set(live) - set(changed)), 4)
        live = {u: t for u, t in live.items() if u not in gone} | changed
        index.change(table(changed), spark.createDataFrame([(u,) for u in gone], "location_uri string"))
    assert index.state["n"] == len(live) and index.state["dl"] == sum(len(t.split()) for t in live.values()) and len(index.state["segments"]) < 7
    again = Postings(spark, f"{tmp_path}/index")
    for q in ("cat dog", "whale OR zebra NOT bird", "the AND of", "nothing"):
        want = rows(search.keyword(table(live), q, 100), "uri", "score", "relevance")
        assert rows(again.keyword(q, 100), "uri", "score", "relevance") == want, q
    with pytest.raises(Conflict):
        stale.change(table({"x": "cat"}))
    plan = again.keyword("cat")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [(part" in plan or "part#" in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert "EqualTo(term,cat)" in plan or "In(term" in plan


def test_index_is_dealt_out_by_words_of_batches(spark, tmp_path):
    """A row of postings is a word in all documents of a batch, whether it was just made or merged without what is buried."""
    texts = {f"u{k}": " ".join(f"w{j}" for j in range(50) if j % 10 or k % 2) for k in range(400)}
    table = lambda d: spark.createDataFrame([(u, "c", t) for u, t in d.items()], "location_uri string, corpus_id string, content string")
    index = Postings.build(table(texts), f"{tmp_path}/index")
    segment = lambda: spark.read.parquet(f"{tmp_path}/index/{index.state['segments'][-1]['at']}/postings")
    assert segment().count() <= 50 * 8
    for k in range(3):
        index.change(table({f"u{j}": "new word" for j in range(k, 300, 3)}))
    assert len(index.state["segments"]) == 1 and segment().count() <= 50 * 8 + 2 * 24
    assert (index.state["n"], index.state["dl"]) == (400, 300 * 2 + sum(len(texts[f"u{k}"].split()) for k in range(300, 400)))
    now = table({u: "new word" if int(u[1:]) < 300 else t for u, t in texts.items()})
    for q in ("new", "w10 w1", "w3 NOT w20", "w7 OR word"):
        assert rows(index.keyword(q, 500), "uri", "score", "relevance") == rows(search.keyword(now, q, 500), "uri", "score", "relevance")
    assert not [n for n in index.folder.names() if n.startswith("made-")]


def test_words_of_batches(spark):
    r = random.Random(11)
    odd = [None, "", " ", "a", "A", "é", "aé b", "\u212a\u0130\u017f", "x\x00y", "z" * 300, "0", "  a  ", "naïve-Café_9"]
    texts = odd + ["".join(r.choice("abAB0 -é\n\u4e2d\U0001f600") for _ in range(r.randint(0, 60))) for _ in range(300)] + odd
    data = [(f"u{k}", None if k % 7 == 0 else "c", t) for k, t in enumerate(texts)]
    chunks = spark.createDataFrame(data, "location_uri string, corpus_id string, content string").repartition(3)
    want = {r["location_uri"]: r["w"] for r in chunks.select("location_uri", search.tokens(F.coalesce("content", F.lit(""))).alias("w")).collect()}
    assert all(w == re.findall("[a-z0-9]+", (texts[int(u[1:])] or "").lower()) for u, w in want.items())
    for size in (1, 100, postings.BATCH):
        out = postings.made(chunks, size).collect()
        listed = {x["batch"]: x for x in out if x["term"] is None}
        assert len(out) - len(listed) == len({(x["batch"], x["term"]) for x in out if x["term"] is not None})
        assert sorted((u, c, n) for x in listed.values() for u, c, n in zip(x["location_uri"], [c or "" for c in x["corpus_id"]], x["dl"])) == sorted((u, c or "", len(want[u])) for u, c, _ in data)
        found = sorted((listed[x["batch"]]["location_uri"][p], x["term"], n) for x in out if x["term"] is not None for p, n in zip(x["place"], x["tf"]))
        assert found == sorted((u, t, w.count(t)) for u, w in want.items() for t in set(w))
    assert postings.made(chunks.filter("false")).count() == 0


def test_an_index_of_an_older_form_is_built_anew(spark, tmp_path):
    (tmp_path / "segment-1").mkdir()
    (tmp_path / "index-000000003").write_text(json.dumps({"number": 3, "segments": [{"at": "segment-1", "number": 3, "n": 1, "dl": 2}], "graves": [], "n": 1, "dl": 2, "old": [], "source": "4"}))
    chunks = spark.createDataFrame([("u", "c", "cat dog")], "location_uri string, corpus_id string, content string")
    was = Postings(spark, f"{tmp_path}")
    assert was.state["source"] is None
    for use in (lambda: was.change(chunks), lambda: was.keyword("cat")):
        with pytest.raises(ValueError):
            use()
    index = Postings.build(chunks, f"{tmp_path}")
    assert [x["uri"] for x in index.keyword("cat").collect()] == ["u"] and index.state["number"] == 4 and not (tmp_path / "segment-1").exists()
