"""Golden cases of the operators on small tables of our own."""

import zipfile

import pytest
from pyspark.sql import functions as F

from textgraph import functions as fn
from textgraph.operators import artifacts, extraction, graph, history, lookups, overlay, postings, search
from textgraph.operators import collections as coll
from textgraph.plans import passes, tools
from textgraph.plans.provider import DryRun, TokenBudget
from textgraph.schema import HEAD, TAXONOMY, schema
from textgraph.sources import books, code, exports, wiki
from textgraph.storage import Catalog
from textgraph.streaming import reindex


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def ids(df, column="id"):
    return [r[column] for r in df.collect()]


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, fn.sanitize_query(lit("A::B  (x)* a_b a-b"))) == "A B x a_b a-b" and one(spark, fn.sanitize_query(lit("!?*"))) == ""
    assert [one(spark, fn.normalise_name(lit(s))) for s in ("Hello, World!", "  foo   BAR  ", "foo-bar")] == ["hello world", "foo bar", "foobar"]
    assert one(spark, fn.slugify(lit("  My Great -- Title! "))) == "my-great-title" and one(spark, fn.heading_slug(lit("Early Life, 2nd"))) == "early-life-2nd"
    assert [one(spark, fn.word_number(lit(s))) for s in ("seven", "Twenty", "12", "many")] == [7, 20, 12, None]
    assert one(spark, fn.parse_location(lit("text://c1/ch/1")))["path"] == "ch/1" and one(spark, fn.parse_location(lit("text:///x"))) is None
    assert one(spark, fn.file_path(lit("text://c1/src/a.rs#f"))) == "src/a.rs" and one(spark, fn.source_path(lit("src/a.rs#f"))) == "a.rs"
    assert [one(spark, fn.model_tier(lit(m))) for m in ("x-opus-2", "Sonnet", "haiku", "other")] == ["opus", "sonnet", "haiku", "unknown"]
    assert one(spark, fn.fenced_json(lit('text\n```json\n{"a": 1}\n```\nmore'))) == '{"a": 1}' and one(spark, fn.fenced_json(lit("so [1, 2] it is"))) == "[1, 2]"
    assert [one(spark, fn.language_of(lit(p))) for p in ("src/a.rs#f", "b.vue", "c.txt")] == ["rust", "typescript", None]
    import hashlib

    assert int(one(spark, fn.prompt_seed(lit("hi")))) == int.from_bytes(hashlib.sha256(b"hi").digest()[:8], "little")
    assert one(spark, fn.clamped_cosine(F.array(lit(1.0), lit(0.0)), F.array(lit(-1.0), lit(0.0)))) == 0.0
    for glob, path, hit in (("**/target/**", "a/target/b/c", True), ("src/*.rs", "src/a.rs", True), ("src/*.rs", "src/x/a.rs", False), ("**/*.lock", "x.lock", True)):
        assert one(spark, fn.matches_any(lit(path), [glob])) is hit


def chunk_table(spark, *rows):
    return spark.createDataFrame([(f"h{k}", c, u, t) for k, (c, u, t) in enumerate(rows)], "id string, corpus_id string, location_uri string, content string")


def test_search(spark):
    chunks = chunk_table(spark, ("c1", "text://c1/ch/1", "the sailor met a whale"), ("c1", "text://c1/ch/2", "the captain slept"), ("c2", "text://c2/ch/1", "a captain and a sailor"))
    hit = search.keyword(chunks, "whale").collect()
    assert [(r["uri"], r["relevance"]) for r in hit] == [("text://c1/ch/1", 1.0)]
    assert search.keyword(chunks, "nothing").count() == 0 and search.keyword(chunks, "?!").count() == 0
    assert ids(search.keyword(chunks, "captain sailor"), "uri") == ["text://c2/ch/1"] and search.keyword(chunks, "whale OR slept").count() == 2
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.7071, 0.7071]), ("c", [0.0, 1.0])], "uri string, vector array<float>")
    near = search.semantic(vectors, [1.0, 0.0]).collect()
    assert [r["uri"] for r in near] == ["a", "b", "c"] and near[0]["score"] > 0.999 and near[2]["score"] < 0.01
    assert ids(search.semantic(vectors, [1.0, 0.0], position="b"), "uri") == ["a", "b"]
    v = chunks.select(F.col("location_uri").alias("uri"), F.array(F.lit(1.0), (F.length("content") % 3).cast("double")).cast("array<float>").alias("vector"))
    assert ids(search.hybrid(chunks, v, "captain", [1.0, 0.0], alpha=1.0), "uri") == ids(search.semantic(v, [1.0, 0.0]), "uri")
    keyed = search.hybrid(chunks, v, "captain", [1.0, 0.0], alpha=0.0).filter("score > 0")
    assert set(ids(keyed, "uri")) <= set(ids(search.keyword(chunks, "captain"), "uri"))


EDGES = "id string, from_entity_id string, to_entity_id string, kind string, location_uri string"


def test_graph(spark):
    edges = spark.createDataFrame([("1", "a", "b", "calls", "u1"), ("2", "b", "c", "calls", "u1"), ("3", "c", "a", "calls", "u2"), ("4", "c", "d", "calls", "u2"), ("5", "d", "e", "calls", "u3"), ("6", "x", "b", "mentions", "u3")], EDGES)
    entities = spark.createDataFrame([(k,) for k in "abcdex"], "id string")
    assert set(ids(graph.unreached(entities, edges, "calls"))) == {"x"}
    assert {r["id"]: r["depth"] for r in graph.walk(edges, entities.filter("id = 'a'"), ["calls"], 3).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert graph.guarded(edges, entities.filter("id <> 'e'")).count() == 5
    assert ids(graph.meet(edges, ["a"], ["c"]), "location_uri") == ["u1", "u2"]
    assert graph.related(edges, "u1").first()["jaccard"] == 0.5 and graph.related(edges, "nowhere").count() == 0
    links = spark.createDataFrame([("a", "b"), ("c", "b"), ("x", "y"), ("z", "z")], "a string, b string")
    assert {r["node"]: r["label"] for r in graph.components(links).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}
    merges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("p", "q"), ("q", "p")], "absorbed string, canonical string")
    roots = {r["absorbed"]: r["root"] for r in graph.roots(merges).collect()}
    assert [roots[k] for k in "abc"] == ["d"] * 3 and roots["p"] == roots["q"] == "p"
    commits = spark.createDataFrame([("c1", None), ("c2", "c1"), ("c3", "c2"), ("s1", "c1")], "id string, parent string")
    assert graph.ancestry(commits).count() == 8 and ids(graph.first_parent_chain(commits, "c3")) == ["c1", "c2", "c3"]
    long = spark.range(1000).selectExpr("concat('k', id) as id", "if(id > 0, concat('k', id - 1), null) as parent")
    chain = graph.first_parent_chain(long, "k999", "k3").collect()
    assert [(r["id"], r["position"]) for r in chain] == [(f"k{k}", k - 3) for k in range(3, 1000)]
    counts = spark.createDataFrame([("a", 1), ("b", 2), ("d", 5), ("p", 7)], "id string, appearance_count long")
    assert {r["id"]: r["appearance_count"] for r in graph.merged_entities(counts, merges.filter("absorbed < 'p'")).collect()} == {"d": 8, "p": 7}


def test_search_operators(spark, tmp_path):
    texts = {"1": "cat dog", "2": "cat bird", "3": "dog zebra", "4": "cat, zebra dog", "5": "nothing"}
    chunks = spark.createDataFrame([(u, "c", t) for u, t in texts.items()], "location_uri string, corpus_id string, content string")
    index = postings.Postings.build(chunks, f"{tmp_path}/index")
    want = {"cat NOT dog": {"2"}, "dog cat OR zebra": {"1", "3", "4"}, "cat AND dog NOT zebra": {"1"}, "zebra OR cat NOT dog": {"2", "3", "4"}, "NOT dog": set(), "dog NOT": {"1", "3", "4"}, "OR": set(), "cat dog AND zebra": {"4"}, "not": set(), "cat NOT dog zebra": {"1", "2"}}
    for q, uris in want.items():
        one, two = ([tuple(r) for r in x.collect()] for x in (search.keyword(chunks, q), index.keyword(q)))
        assert one == two and {r[0] for r in one} == uris, q


def entity_table(spark, *rows):
    return spark.createDataFrame([(i, n, a, c) for i, n, a, c in rows], "id string, canonical_name string, aliases array<string>, appearance_count long")


def test_overlay(spark):
    e = entity_table(spark, ("a", "Anna", [], 30), ("b", "Annie", ["Ann"], 20), ("c", "Carl", [], 5))
    fix = [("1", "c1", None, "merge", '{"type":"merge","absorbed":"b","canonical":"a"}', "2026-01-01"), ("2", "c1", None, "rename", '{"type":"rename","entity_id":"b","new_name":"Anya"}', "2026-01-02"), ("3", "c1", None, "alias", '{"type":"alias_add","entity_id":"c","alias":"Charles"}', "2026-01-03"), ("4", "c1", None, "alias", '{"type":"alias_remove","entity_id":"a","alias":"Ann"}', "2026-01-04")]
    out = {r["id"]: r for r in overlay.apply_corrections(e, spark.createDataFrame(fix, HEAD["corrections"])).collect()}
    assert set(out) == {"a", "c"} and out["a"]["appearance_count"] == 50 and out["a"]["canonical_name"] == "Anya"
    assert out["a"]["aliases"] == ["Annie"] and out["c"]["aliases"] == ["Charles"]
    gone = overlay.apply_merges(e.filter("id <> 'a'"), spark.createDataFrame([("b", "a")], "absorbed string, canonical string"))
    assert ids(gone) == ["c"]
    s = spark.createDataFrame([("chunk", "x", "old", "t")], "target_kind string, target_id string, text string, generated_at string")
    edits = spark.createDataFrame([("chunk", "x", "new", "1", "i"), ("chunk", "x", "newer", "2", "j")], "target_kind string, target_id string, text string, applied_at string, id string")
    assert overlay.overridden(s, edits).first()["text"] == "newer"


def test_collections(spark):
    members = spark.createDataFrame([("top", "sub", "collection"), ("top", "c9", "corpus"), ("sub", "c1", "corpus"), ("sub", "top", "collection"), ("sub", "c9", "corpus")], "collection_id string, member_id string, member_type string")
    assert sorted((r["position"], r["corpus_id"]) for r in coll.resolved(members, "top").collect()) == [(0, "c9"), (1, "c1")]
    links = spark.createDataFrame([("a", "b", "same_as"), ("b", "c", "same_as"), ("a", "d", "implements")], "a string, b string, link_kind string")
    assert {r["node"] for r in coll.same_as(links).collect()} == {"a", "b", "c"} and coll.linked(links, ["implements"]).count() == 2
    out = {r["id"]: r for r in coll.resolve_entity(spark.createDataFrame([("a",), ("d",)], "id string"), links).collect()}
    assert set(out) == {"a"} and out["a"]["same_as"] == ["b", "c"] and out["a"]["related"] == ["implements:d"]
    left = spark.createDataFrame([("1", "Alpha", "process"), ("2", "sunday", "x"), ("3", "cat", "x"), ("4", "ab", "x")], "id string, canonical_name string, abstract_kind string")
    right = spark.createDataFrame([("5", "alpha!", ""), ("6", "saturday", "x"), ("7", "cut", "x"), ("8", "sundays", "x"), ("9", "b", "x"), ("10", "sunday", "y")], "id string, canonical_name string, abstract_kind string")
    assert {tuple(r) for r in coll.link_candidates(left, right).collect()} == {("1", "5", "HIGH"), ("2", "10", "HIGH"), ("2", "8", "MEDIUM"), ("3", "7", "MEDIUM"), ("4", "9", "MEDIUM")}


def test_artifacts(spark):
    rows = [("e", "m-haiku", "haiku", "3", False, False, [], None), ("e", "m-sonnet", "sonnet", "1", True, False, [], None), ("f", "m-x", "unknown", "1", False, False, ["r"], None), ("g", "m-opus", "opus", "2", False, True, ["r"], None), ("g", "m-haiku", "haiku", "2", True, True, [], None)]
    t = spark.createDataFrame(rows, "entity_id string, model string, model_tier string, generated_at string, is_incomplete boolean, is_fallible boolean, risks array<string>, intent_gap string")
    assert {(r["entity_id"], r["model"]) for r in artifacts.best_of(t, ["entity_id"]).collect()} == {("e", "m-sonnet"), ("f", "m-x"), ("g", "m-opus")}
    assert [(r["entity_id"], r["model"]) for r in artifacts.inconsistencies(t).collect()] == [("e", "m-sonnet"), ("f", "m-x"), ("g", "m-haiku")]
    lit = F.lit
    tier = lambda **k: one(spark, artifacts.routed_tier(*(lit(v) for v in ({"unsafe": False, "fallible": False, "public": False, "mutating": False, "panics": 0, "debt": False, "i": 0, "o": 0, "kind": "function", "lines": 1} | k).values())))
    assert tier(unsafe=True) == "opus" and tier(i=20, fallible=True) == "sonnet" and tier(i=21, fallible=True) == "opus" and tier(lines=151) == "sonnet" and tier() == "haiku"
    assert tier(mutating=True, fallible=True) == tier(panics=1) == tier(debt=True) == tier(kind="class") == tier(public=True, fallible=True) == "sonnet" and tier(mutating=True) == "haiku"
    assert tier(public=True, panics=4) == tier(kind="module", o=16) == "opus" and one(spark, artifacts.routed_tier(*[lit(True)] * 10, enabled=False, default="sonnet")) == "sonnet"
    hits, misses = artifacts.cached(spark.createDataFrame([("k1",), ("k2",)], "cache_key string"), spark.createDataFrame([("k1", '{"a":1}'), ("k2", "oops {")], "cache_key string, payload string"))
    assert ids(hits, "cache_key") == ["k1"] and ids(misses, "cache_key") == ["k2"]


def test_history(spark):
    head = spark.createDataFrame([("a", "v1", 1), ("b", "v1", 2), ("c", None, 3)], "id string, derived_at_version string, x int")
    new = spark.createDataFrame([("a", "v2", 10), ("b", "v1", 20), ("c", "v2", 30), ("d", None, 40)], "id string, derived_at_version string, x int")
    assert [(r["id"], r["superseded_at_version"]) for r in history.superseded(head, new, ["id"]).collect()] == [("a", "v2")]
    merged = history.upserted(head, new, ["id"])
    assert {(r["id"], r["derived_at_version"], r["x"]) for r in merged.collect()} == {("a", "v2", 10), ("b", "v1", 20), ("c", "v2", 30), ("d", None, 40)}
    assert sorted(map(tuple, history.upserted(merged, new, ["id"]).collect())) == sorted(map(tuple, merged.collect()), key=lambda r: r[0])
    tables = {f"t{k}": spark.createDataFrame([(f"sha{i}", f"2026-0{i}") for i in range(1, 6)], "superseded_at_sha string, superseded_at string") for k in range(8)}
    counts = history.prune_counts(tables, 3).collect()
    assert {r["pruned"] for r in counts} == {2} and all(r["pruned"] == 0 for r in history.prune_counts(tables, 9).collect())
    left = history.pruned(tables["t0"], history.pruned_shas(list(tables.values()), 3))
    assert set(ids(left, "superseded_at_sha")) == {"sha3", "sha4", "sha5"}
    order = ["c1", "c2", "c3", "c4"]
    ancestry = spark.createDataFrame([(a, b) for i, a in enumerate(order) for b in order[i:]], "ancestor string, descendant string")
    columns = "id string, name string, derived_at_version string, derived_at_sha string, derived_at_kind string"
    head = spark.createDataFrame([("x", "x3", None, "c3", "concrete"), ("y", "y4", None, "c4", "range_predating")], columns)
    past = spark.createDataFrame([("x", "x1", None, "c1", "concrete", "t1")], columns + ", superseded_at string")
    dead = spark.createDataFrame([("x", "c4")], "artifact_id string, derived_at_sha string")
    at = lambda c: sorted(ids(history.present_at(head, past, dead, ancestry, c, ["id"]), "name"))
    assert at("c1") == ["x1", "y4"] and at("c3") == ["x3", "y4"] and at("c4") == ["y4"]
    lit = F.lit
    r = lambda *a: one(spark, history.refined(*map(lit, a)))
    assert not r("concrete", "a", "concrete", "b")["changed"] and r("range_predating", "a", "concrete", "b")["kind"] == "concrete" and not r("range_predating", "a", "range_predating", "a")["changed"]


def test_reindex_keeps_other_paths(spark):
    chunks = spark.createDataFrame([("a", "h1"), ("a", "h2"), ("b", "h3")], "path string, id string")
    out, orphans = reindex.reindexed(chunks, spark.createDataFrame([("a",)], "path string"), spark.createDataFrame([("a", "h1"), ("a", "h9")], "path string, id string"))
    assert sorted(ids(out)) == ["h1", "h3", "h9"] and ids(orphans) == ["h2"]
    assert reindex.since_strategy("2026-01-02", None, True) == ("mtime", "2026-01-02") and reindex.since_strategy("main", None, True) == ("git", "main") and reindex.since_strategy("main", None, False)[0] == "full"


def test_books(spark):
    long = " ".join(f"Sentence number {k} is here." for k in range(300))
    text = f"Chapter one.\n\n\n{'first scene ' * 30}\n\n\nsmall\n\n\nnext\n\n\n\n\n\n\n\n{long}"
    out = books.text_chunks(spark.createDataFrame([("c1", text)], "corpus_id string, content string")).collect()
    assert [r["path"] for r in out if r["kind"] == "chapter"] == ["ch/1", "ch/2"]
    scenes = [r for r in out if r["kind"] == "scene"]
    assert all(len(r["content"].encode()) <= 4000 for r in scenes) and {r["parent_path"] for r in scenes} == {"ch/1", "ch/2"}
    assert any(r["content"].startswith("Chapter one.\n\nfirst") for r in scenes) and any(r["content"] == "small\n\nnext" for r in scenes)
    md = books.markdown_chunks(spark.createDataFrame([("c1", "# One\nx\n## A\ny\n## B\nz\n# Two\nw")], "corpus_id string, content string")).collect()
    assert sorted(r["path"] for r in md) == ["ch/1", "ch/1/sc/1", "ch/1/sc/2", "ch/2"]
    assert books.identified(books.text_chunks(spark.createDataFrame([("c1", "x")], "corpus_id string, content string"))).first()["location_uri"] == "text://c1/ch/1"


def test_epub(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("o/c.opf", '<package><manifest><item id="a" href="a.html"/><item id="b" href="b.html"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>')
        z.writestr("o/a.html", "<html><head><title>t</title></head><body><p>Last &amp; least</p></body></html>")
        z.writestr("o/b.html", "<p>First</p>")
    files = books.read_texts(spark, str(tmp_path / "b.epub"))
    assert files.first()["kind"] == "epub"
    assert [r["content"] for r in books.epub_texts(files).orderBy("k").collect()] == ["First", "Last & least"]


PAGE = "---\ntitle: The Crew\ntype: character\ntags: [sea, ship]\naliases:\n  - Sailors\n  - \"Hands\"\n---\n# Crew\nintro text long enough to be kept as a section by itself, surely.\n## Early Life\nBorn near [[Harbour Town|the town]] and [more](docs/more.md#x), see [out](https://e.org). John Smith lived here.\n## No\nx\n"


def test_wiki(spark, tmp_path):
    (tmp_path / "w" / "_images").mkdir(parents=True)
    (tmp_path / "w" / "crew.md").write_text(PAGE)
    (tmp_path / "w" / "_images" / "no.md").write_text("x")
    pages = wiki.read_pages(spark, str(tmp_path / "w"), "w1")
    assert ids(pages, "path") == ["crew"]
    made = wiki.page_chunks(pages).collect()
    assert sorted(r["path"] for r in made) == ["wiki/crew", "wiki/crew#early-life", "wiki/crew#intro"]
    m = pages.select(extraction.front_matter(F.col("content")).alias("m")).first()["m"]
    assert (m["title"], m["type"], m["tags"], m["aliases"]) == ("The Crew", "character", ["sea", "ship"], ["Sailors", "Hands"])
    e = extraction.page_entities(pages).first()
    assert (e["id"], e["canonical_name"], e["kind"]) == ("page:crew", "The Crew", "character")
    edges = {(r["kind"], r["to_entity_id"]) for r in extraction.page_edges(pages).collect()}
    assert {("references", "page:Harbour Town"), ("references", "page:docs/more"), ("mentions", "mention:John Smith")} <= edges and not any("e.org" in t for _, t in edges)


PYTHON = '"""Doc."""\nimport os\n\n\nclass Base(Other):\n    """A base of some length, so that it is a chunk of its own and isn\'t dropped for size."""\n\n    x = 1\n\n\ndef run(a):\n    """Runs."""\n    return helper(a) + os.getcwd()\n'


def test_code(spark):
    rust = "use std::fs;\n\n/// Greets.\npub fn greet(name: &str) -> Result<String> {\n    let text = format(name);\n    // TODO: later\n    let value = text.unwrap();\n    helper(value)\n}\n" + "\npub struct Thing;\n"
    files = spark.createDataFrame([("a.py", PYTHON), ("src/b.rs", rust), ("c.yaml", "k: v")], "path string, content string")
    items = code.structure(files.filter("path not like '%.yaml'"))
    found = {(r["symbol"], r["kind"]): r for r in items.collect()}
    assert found[("Base", "class")]["bases"] == ["Other"] and set(found[("run", "function")]["calls"]) == {"helper", "getcwd"}
    assert {"format", "unwrap", "helper"} <= set(found[("greet", "function")]["calls"]) and ("Thing", "class") in found
    chunks = {r["path"] for r in code.file_chunks(files, "c").collect()}
    assert {"src/a.py", "src/a.py#Base", "src/src/b.rs", "src/src/b.rs#greet"} <= chunks and code.passthrough(files, "c").count() == 1
    edges = {(r["from_entity_id"], r["kind"], r["to_entity_id"]) for r in code.edges(items, "c").collect()}
    assert {("c:a_py", "defines", "c:base"), ("c:run", "calls", "c:helper"), ("c:base", "extends", "c:other"), ("c:a_py", "imports", "c:os")} <= edges
    assert {"c:a_py", "c:run", "c:os"} <= set(ids(code.entities(items, "c")))
    s = files.filter("path like '%.rs'").select(extraction.signals(F.lit("rust"), F.col("content")).alias("s")).first()["s"]
    assert s["is_public"] and s["is_fallible"] and s["panic_call_count"] == 1 and s["debt_markers"] == ["// TODO: later"] and not s["is_test"]
    php = one(spark, extraction.signals(F.lit("php"), F.lit("public function a(): ?int { $this->x = 1; return User::findOrFail(1); }")))
    assert php["is_public"] and php["is_nullable"] and php["mutates_state"] and php["is_fallible"]
    assert one(spark, code.vue_script(F.lit("<template/><script setup>a</script><script lang='ts'>b</script>"))) == "a\nb"
    assert one(spark, extraction.discarded_callee(F.lit("  let _ = db::save(x);"))) == "save"


def test_lookups(spark):
    e = spark.createDataFrame([("e1", "c1", "Run", "function", ["go"], 3), ("e2", "c1", "run", "file", [], 5)], "id string, corpus_id string, canonical_name string, kind string, aliases array<string>, appearance_count long")
    assert ids(lookups.entities_named(e, "RUN")) == ["e2", "e1"] and ids(lookups.entities_named(e, "go")) == ["e1"]
    tax = spark.createDataFrame(TAXONOMY, "concrete_kind string, corpus_kind string, abstract_kind string")
    corpora = spark.createDataFrame([("c1", "code")], "id string, kind string")
    assert {r["id"]: r["abstract_kind"] for r in lookups.with_abstract_kind(e, corpora, tax).collect()} == {"e1": "process", "e2": ""}
    with pytest.raises(ValueError):
        lookups.edges_of(e, "e1", "sideways")


def test_passes_and_provider(spark):
    assert passes.parse_passes("embed, chunk") == ["chunk", "embed"]
    with pytest.raises(ValueError):
        passes.parse_passes("nope")
    assert passes.missing_prerequisites(["purpose"], set()) == ["purpose"] and passes.missing_prerequisites(["structure", "purpose"], {"chunks"}) == []
    wanted = spark.createDataFrame([("e1", "h", "s", "p1"), ("e2", "h2", "s", "p2")], "entity_id string, content_hash string, shape string, prompt string")
    cache = spark.createDataFrame([], "cache_key string, payload string")
    answers, new = passes.memoised(wanted, cache, DryRun(), "purpose")
    assert answers.count() == 2 and new.count() == 2
    assert passes.memoised(wanted, spark.createDataFrame(new.collect(), new.schema), DryRun(), "purpose")[1].count() == 0
    up = passes.roll_up(spark.createDataFrame([("p", 2, "scene", "b"), ("p", 1, "scene", "a")], "parent string, position int, kind string, summary string"), DryRun())
    assert up.first()["text"] == "[dry-run]"
    budget = TokenBudget(1000)
    assert budget.admits(0, 0)
    for k in range(30):
        budget.observe(30, k)
    assert abs(budget.mean - 30) < 1e-9 and budget.p95() == 30 and budget.admits(31, 0)
    budget.refused(31, 10)
    assert not budget.admits(35, 0)


def filled(spark, tmp_path):
    def table(name, *rows):
        s = schema(name)
        return spark.createDataFrame([tuple(r.get(f.name) for f in s.fields) for r in rows], s)

    catalog = Catalog(spark, str(tmp_path / "catalog"))
    chunk = lambda n, text: {"id": f"h{n}", "corpus_id": "c1", "kind": "chapter", "location_uri": f"text://c1/ch/{n}", "content": text}
    entity = lambda i, name, kind="function", n=1: {"id": i, "corpus_id": "c1", "canonical_name": name, "kind": kind, "aliases": [], "appearance_count": n, "first_location_uri": "text://c1/ch/1"}
    edge = lambda i, a, b, kind, u: {"id": i, "corpus_id": "c1", "from_entity_id": a, "to_entity_id": b, "kind": kind, "location_uri": f"text://c1/ch/{u}"}
    catalog.commit(
        corpora=table("corpora", {"id": "c1", "name": "C", "kind": "code", "created_at": "1"}), chunks=table("chunks", chunk(1, "the whale"), chunk(2, "a captain"), chunk(3, "nothing")),
        entities=table("entities", entity("e1", "Ahab", n=9), entity("e2", "Ahab Junior", n=2), entity("e3", "ship", "class"), entity("e4", "ship", "file")),
        edges=table("edges", edge("1", "e1", "e3", "calls", 1), edge("2", "e1", "e2", "calls", 2), edge("3", "e3", "e1", "appears", 2), edge("4", "e2", "e3", "verified_by", 3)),
        kind_taxonomy=table("kind_taxonomy", *({"concrete_kind": a, "corpus_kind": b, "abstract_kind": c} for a, b, c in TAXONOMY)), collections=table("collections", {"id": "k", "name": "K"}), collection_members=table("collection_members", {"collection_id": "k", "member_id": "c1", "member_type": "corpus"}),
        summaries=table("summaries", {"id": "s", "corpus_id": "c1", "target_kind": "chunk", "target_id": "text://c1/ch/1", "text": "about a whale", "model": "m-opus", "model_tier": "opus", "generated_at": "1"}),
    )
    return catalog


def test_tools(spark, tmp_path):
    catalog = filled(spark, tmp_path)
    t = tools.Tools(catalog)
    assert len(t.names()) == 27
    assert t.call("corpus_list").data.first()["chunk_count"] == 3 and t.call("corpus_overview", corpus_id="c1").data.first()["top_entities"][0] == "Ahab"
    assert ids(t.call("search", corpus_id="c1", query="whale").data, "uri") == ["text://c1/ch/1"]
    assert t.call("search", corpus_id="c1", query="x", mode="odd").status == "invalid_input"
    assert t.call("entity", corpus_id="c1", name_or_id="e1").status == "ok" and t.call("entity", corpus_id="c1", name_or_id="ahab").status == "ambiguous"
    assert t.call("entity", corpus_id="c1", name_or_id="zzz").status == "not_found" and ids(t.call("entity", corpus_id="c1", name_or_id="ship").data) == ["e3"]
    assert ids(t.call("entity", corpus_id="c1", name_or_id="ship", kind="file").data) == ["e4"]
    assert ids(t.call("entity_meet", corpus_id="c1", a="Ahab", b="ship").data, "location_uri")[0] == "text://c1/ch/1"
    read = t.call("read", uri="text://c1/ch/1", depth="full").data.first()
    assert read["content"] == "the whale" and read["summary"] == "about a whale"
    assert t.call("chapter_summary", corpus_id="c1", chapter="one").data.first()["summary"] == "about a whale"
    assert ids(t.call("find_unreachable", corpus_id="c1").data) == ["e1", "e4"] and ids(t.call("entities_without_tests", corpus_id="c1").data) == ["e1", "e2", "e4"]
    assert t.call("explain_component", corpus_id="c1").status == "invalid_input" and t.call("explain_component", corpus_id="c1", entity_id="e1").data.count() == 3
    assert t.call("collection_list").data.first()["corpus_count"] == 1 and t.call("collection_search", collection_id="k", query="captain").data.count() == 1
    assert t.call("collection_entity_resolve", collection_id="k", name="ahab").data.count() == 2
    assert t.call("apply_scholion", id="x", kind="merge", payload='{"type":"merge","absorbed":"e2","canonical":"e1"}', applied_at="2", corpus_id="c1").status == "ok"
    assert t.call("list_scholia", corpus_id="c1").data.count() == 1 and t.call("entity", corpus_id="c1", name_or_id="ahab").status == "ok"
    assert t.call("nope").status == "error" and t.call("list_abstract_kinds").data.count() == 8
    assert catalog.version() == 2 and catalog.table("corrections", 1).count() == 0


def test_exports(spark, tmp_path):
    catalog = filled(spark, tmp_path)
    out = str(tmp_path / "out")
    exports.write_json_lines(out, chunk=catalog.table("chunks"), entity=catalog.table("entities"), edge=catalog.table("edges"))
    lines = [r[0] for r in spark.read.text(out).collect()]
    assert len(lines) == 11 and sum('"record_type":"entity"' in x for x in lines) == 4


def test_watch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one")
    seen = []
    for more in ("b", "c"):
        (tmp_path / "in" / f"{more}.txt").write_text(more)
        q = reindex.watch(spark, str(tmp_path / "in"), lambda df, k: seen.append(sorted(r["content"] for r in df.collect())), str(tmp_path / "cp"), once=True)
        q.awaitTermination()
    assert seen == [["b", "one"], ["c"]]


def test_walks(spark, tmp_path):
    from textgraph.plans import walk

    catalog = Catalog(spark, str(tmp_path / "walk"))
    states = {"c1": {"a": "1"}, "c2": {"a": "1", "b": "1"}, "c3": {"b": "2"}}
    s = schema("entities")

    def table(sha):
        rows = [{"id": i, "corpus_id": "c", "canonical_name": v, "derived_at_kind": "concrete", "derived_at_sha": f"v{v}"} for i, v in states[sha].items()]
        return spark.createDataFrame([tuple(r.get(f.name) for f in s.fields) for r in rows], s)

    commits = spark.createDataFrame([("c1", None), ("c2", "c1"), ("c3", "c2")], "id string, parent string")
    chain = walk.last_commits(commits, "c3")
    assert chain == ["c1", "c2", "c3"] and walk.last_commits(commits, "c3", back=2) == ["c2", "c3"] and walk.last_commits(commits, "c3", since="c2") == ["c3"]
    walk.forward(catalog, "c", chain, lambda sha, head: {"entities": table(sha)})
    assert ids(catalog.table("entities")) == ["b"]
    past = catalog.table("entities_history").collect()
    assert sorted((r["id"], r["canonical_name"], r["superseded_at_sha"]) for r in past) == [("a", "1", "c3"), ("b", "1", "c3")]
    assert [(r["artifact_id"], r["derived_at_sha"]) for r in catalog.table("tombstones").collect()] == [("a", "c3")]


def test_writes(spark):
    from textgraph.operators import writes

    t = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int")
    new = spark.createDataFrame([("b", 3), ("c", 4), ("c", 4)], "id string, x int")
    assert sorted(map(tuple, writes.inserted(t, new, ["id"]).collect())) == [("a", 1), ("b", 2), ("c", 4)]
    assert sorted(map(tuple, writes.replaced(t, new.distinct(), ["id"]).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert ids(writes.deleted(t, new, ["id"])) == ["a"] and writes.updated(t, F.col("id") == "a", x=F.lit(9)).filter("x = 9").count() == 1


def test_small_operators(spark):
    from textgraph.operators import writes

    corpora = spark.createDataFrame([("a", 0), ("a-2", 3)], "id string, pipeline_version int")
    assert writes.free_id(corpora, "a") == "a-3" and writes.free_id(corpora, "b") == "b"
    ran = []
    assert writes.upgraded(corpora, "a", {k: lambda k=k: ran.append(k) for k in (1, 2, 3)}).filter("pipeline_version = 3").count() == 2 and ran == [1, 2, 3]
    blocks = spark.createDataFrame([("b1", "e", "v1"), ("b2", "e", "v2")], "id string, entity_id string, derived_at_version string")
    themes = spark.createDataFrame([("t", None)], "id string, derived_at_version string")
    assert sorted(map(tuple, lookups.head_versions(entity_blocks=blocks, themes=themes).collect())) == [("entity_blocks", "e", "v2"), ("themes", "t", "")]
    php = F.lit("class A { public function run() { return new \\App\\Thing(); } function &go () {} }")
    assert one(spark, extraction.php_methods(php)) == ["run", "go"] and one(spark, extraction.instantiated(php)) == ["Thing"]
