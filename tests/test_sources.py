"""Adapters, their data sources, ingest and reindex, and the watching stream."""

import datetime

import pytest
from pyspark.sql import functions as F

from textgraph.plans import ingest as plans
from textgraph.plans.artifact_passes import Setting, run_pass
from textgraph.plans.provider import Digest
from textgraph.plans.tools import Tools
from textgraph.sources import adapters
from textgraph.storage import Catalog
from textgraph.streaming import watch

PAGE = '<html><head><title>A &amp; B</title></head><body><nav><a href="/x">x</a></nav><h1>One</h1><p>Two<br>three</p><h2>Four</h2><p>A section with more than fifty characters in it, all told.</p><!-- no --><script>no()</script></body></html>'


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("pages") / "pages.parquet")
    df = spark.createDataFrame([(k, f"https://h.example/p{k % 3}.html?q={k}#f", PAGE.replace("One", f"One {k}")) for k in range(40)] + [(None, None, None), (99, "x", None)], "page_id long, url string, html string")
    df.coalesce(1).sortWithinPartitions("page_id").write.option("parquet.block.size", 2048).parquet(at)
    return at


def test_registry(spark):
    r = adapters.default_registry()
    assert r.list() == ["book", "code", "pages-as-wiki", "wiki"] and r.get("nope") is None and r.require("wiki").summary_levels == ("section", "page")
    with pytest.raises(ValueError):
        r.require("nope")
    own = adapters.WikiAdapter()
    r.register(own)
    assert r.get("wiki") is own
    at = spark.range(1).select(own.parse_location(F.lit("text://c/a/b")).alias("p"), own.parse_location(F.lit("plain")).alias("q"), own.format_location(F.lit("c"), F.lit("x")).alias("u")).first()
    assert tuple(at["p"]) == ("c", "a/b") and tuple(at["q"]) == ("", "plain") and at["u"] == "text://c/x"


def test_pages_source(spark, pages):
    adapters.Registry.install(spark)
    df = spark.read.format("pages-as-wiki").option("corpus", "c").load(pages)
    native = adapters.html_pages(spark.read.parquet(pages), "c")
    assert rows(df, "page_id", "path", "content", "corpus_id") == rows(native, "page_id", "path", "content", "corpus_id") and df.count() == 42
    one = df.filter("page_id = 4").first()
    assert one["path"] == "h.example/p1~4" and one["content"].startswith("---\ntitle: A & B\n---\n## Navigation\n[[x|x]]\n# One 4\n\nTwo\nthree\n\n## Four\n")
    few = df.filter("page_id >= 30 and page_id < 33")
    assert [r["page_id"] for r in few.orderBy("page_id").collect()] == [30, 31, 32]
    source = adapters.PagesSource({"path": pages})
    from pyspark.sql.datasource import GreaterThanOrEqual

    reader = source.reader(None)
    everything = len(reader.partitions())
    assert list(reader.pushFilters([GreaterThanOrEqual(("page_id",), 90)])) == [] and len(reader.partitions()) <= everything
    assert adapters.WikiAdapter().chunks(native.filter("page_id = 4").drop("page_id")).filter("kind = 'section'").count() == 1


def test_file_sources(spark, tmp_path):
    adapters.Registry.install(spark)
    (tmp_path / "w" / "_images").mkdir(parents=True)
    (tmp_path / "w" / "sub").mkdir()
    for name, text in {"a.md": "# A\nsee [[b]]", "sub/b.md": "# B", "_images/c.md": "no", "d.txt": "no"}.items():
        (tmp_path / "w" / name).write_text(text)
    read = lambda: spark.read.format("textgraph-wiki").option("corpus", "w").load(str(tmp_path / "w"))
    assert rows(read(), "path", "content") == [("a", "# A\nsee [[b]]"), ("sub/b", "# B")] and read().filter("path = 'a'").count() == 1
    with pytest.raises(Exception):
        spark.read.format("textgraph-wiki").load().count()
    seen = []
    for more in ("", "e.md"):
        if more:
            (tmp_path / "w" / more).write_text("# E")
        stream = spark.readStream.format("textgraph-wiki").option("corpus", "w").load(str(tmp_path / "w"))
        q = stream.writeStream.foreachBatch(lambda df, k: seen.append(sorted(r["path"] for r in df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
    assert [s for s in seen if s] == [["a", "sub/b"], ["e"]]
    (tmp_path / "code" / "vendor").mkdir(parents=True)
    for name in ("x.py", "vendor/y.py"):
        (tmp_path / "code" / name).write_text("def f(): pass")
    assert rows(spark.read.format("textgraph-code").load(str(tmp_path / "code")), "path") == [("x.py",)]


def test_ingest_and_reindex(spark, tmp_path):
    root = tmp_path / "wiki"
    root.mkdir()
    texts = {"a": "# Alpha\nsee [[b]] and a whale", "b": "# Beta\n\n## Part\nA section that is long enough to be one of its own, with a captain.", "c": "# Gamma\nnothing"}
    for n, t in texts.items():
        (root / f"{n}.md").write_text(t)
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    corpus = plans.ingest(spark, catalog, "wiki", "My Wiki!", str(root), at="1")
    assert corpus == "my-wiki" and plans.ingest(spark, catalog, "wiki", "other name", str(root), at="2") == "my-wiki"
    chunk = lambda: {r["location_uri"]: r["id"] for r in catalog.table("chunks").collect()}
    first = chunk()
    assert {u.removeprefix("text://my-wiki/wiki/") for u in first} == {"a", "b", "b#part", "c"} and catalog.table("chunks_history").count() == 0
    edges = {(r["from_entity_id"], r["kind"], r["to_entity_id"]) for r in catalog.table("edges").collect()}
    assert ("page:a", "references", "page:b") in edges
    assert catalog.table("corpora").first()["status"] == "ready"
    tools = Tools(catalog)
    found = lambda q: [r["uri"] for r in tools.call("search", corpus_id=corpus, query=q).data.collect()]
    assert found("whale") == ["text://my-wiki/wiki/a"]
    (root / "a.md").write_text("# Alpha\nsee [[b]] and a dolphin")
    (root / "c.md").unlink()
    (root / "d.md").write_text("# Delta\nmore of it")
    adapter = adapters.WikiAdapter()
    counts = plans.reindex(catalog, corpus, adapter.discover(spark, str(root), corpus), adapter, "3")
    assert counts == {"added": 1, "modified": 1, "deleted": 1}
    second = chunk()
    assert {u.removeprefix("text://my-wiki/wiki/") for u in second} == {"a", "b", "b#part", "d"}
    assert second["text://my-wiki/wiki/b"] == first["text://my-wiki/wiki/b"] and second["text://my-wiki/wiki/a"] != first["text://my-wiki/wiki/a"]
    assert catalog.table("chunks_history").count() == 2
    assert found("whale") == [] and found("dolphin") == ["text://my-wiki/wiki/a"] and found("more") == ["text://my-wiki/wiki/d"]
    at = catalog.version()
    assert plans.reindex(catalog, corpus, adapter.discover(spark, str(root), corpus), adapter, "4") == {"added": 0, "modified": 0, "deleted": 0} and catalog.version() == at
    # as if from nothing
    fresh = Catalog(spark, str(tmp_path / "fresh"))
    plans.ingest(spark, fresh, "wiki", "My Wiki!", str(root), at="5")
    assert chunk() == {r["location_uri"]: r["id"] for r in fresh.table("chunks").collect()}
    with pytest.raises(ValueError):
        plans.ingest(spark, catalog, "wiki", "x", str(tmp_path / "none"))
    with pytest.raises(ValueError):
        plans.ingest(spark, Catalog(spark, str(tmp_path / "new")), "book", "y", str(root), passes="summarize")


def test_changes_by_git_and_time(spark, tmp_path):
    import subprocess

    root = tmp_path / "repo"
    root.mkdir()
    git = lambda *what: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.com", *what], check=True, capture_output=True)
    for n in "abc":
        (root / f"{n}.md").write_text(f"# {n}\none")
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "one")
    catalog, adapter = Catalog(spark, str(tmp_path / "catalog")), adapters.WikiAdapter()
    corpus = plans.ingest(spark, catalog, "wiki", "w", str(root), at="2024-01-01T00:00:00+00:00")
    (root / "a.md").write_text("# a\ntwo")
    (root / "b.md").unlink()
    (root / "d.md").write_text("# d\nnew")
    how, sources, partial = plans.changed_since(spark, catalog, corpus, str(root), adapter, "HEAD")
    assert how == "git" and partial and rows(sources, "path", "content") == [("a", "# a\ntwo"), ("b", None), ("d", "# d\nnew")]
    assert plans.reindex(catalog, corpus, sources, adapter, "2024-01-02", partial=True) == {"added": 1, "modified": 1, "deleted": 1}
    assert {r["path"] for r in catalog.table("sources").collect()} == {"a", "c", "d"}
    assert plans.changed_since(spark, catalog, corpus, str(root), adapter)[0] == "mtime"
    assert plans.changed_since(spark, catalog, corpus, str(root), adapter, "2999-01-01")[1].count() == 0
    with pytest.raises(ValueError):
        plans.changed_since(spark, catalog, corpus, str(root), adapter, "no-such-ref")


def test_passes_ask_once(spark, tmp_path):
    root = tmp_path / "code"
    root.mkdir()
    (root / "a.rs").write_text("pub fn alpha(a: &str) -> Result<A, B> {\n" + "    step();\n" * 20 + "}\n")
    (root / "b.rs").write_text("fn beta() {\n" + "    alpha(1);\n" * 12 + "}\n")
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    corpus = plans.ingest(spark, catalog, "code", "code", str(root), at="1")
    own = lambda at, **k: Setting(corpus, {t: Digest(f"digest-{t}") for t in ("haiku", "sonnet", "opus")}, at, "v1", **k)
    assert [run_pass(catalog, p, own("1")) for p in ("purpose", "contract")] == [2, 2]
    assert {r["model"] for r in catalog.table("entity_purposes").collect()} == {"digest-sonnet", "digest-haiku"}
    n = catalog.table("layer2_cache").count()
    assert [run_pass(catalog, p, own("2")) for p in ("purpose", "contract")] == [0, 0] and catalog.table("layer2_cache").count() == n
    assert run_pass(catalog, "purpose", own("3", full=True)) == 2 and catalog.table("layer2_cache").count() == n  # the memo answers
    assert run_pass(catalog, "purpose", own("4", full=True, dirty=spark.createDataFrame([("a.rs",)], "path string"))) == 1
    assert run_pass(catalog, "theme", own("5")) == 0 and catalog.table("runs").filter("status = 'finished'").count() == 7


def test_failures_cost_their_own_prompt(spark):
    from textgraph.plans.artifact_passes import answered
    from textgraph.plans.provider import Refused

    # within the test, so that workers get it by value
    class Odd:
        """Refuses once, fails on one prompt."""

        model = "odd"

        def complete(self, prompt):
            import os

            if "bad" in prompt:
                raise RuntimeError("no")
            seen = f"/tmp/textgraph-odd-{os.getpid()}"
            if not os.path.exists(seen):
                open(seen, "w").close()
                raise Refused(0.01)
            os.unlink(seen)
            return prompt.upper()

    prompts = spark.createDataFrame([("1", "odd", "good"), ("2", "odd", "bad"), ("3", "odd", "fine")], "key string, model string, prompt string").coalesce(1)
    assert rows(answered(prompts, [Odd()]), "key", "answer") == [("1", "GOOD"), ("2", None), ("3", "FINE")]


def test_summaries_follow_what_changed(spark, tmp_path):
    from textgraph.catalogue_index import _chat_catalog

    class M:
        pass

    m = M()
    m.spark = spark
    talk = spark.createDataFrame([(c, t, "user", f"text {c} {t}") for c in range(3) for t in range(2)], "conv_id long, turn long, role string, text string")
    catalog = _chat_catalog(m, talk)
    own = lambda at, **k: Setting("chat", {t: Digest(f"digest-{t}") for t in ("haiku", "sonnet", "opus")}, at, **k)
    levels = ("scene", "chapter")
    assert run_pass(catalog, "summarize", own("1"), levels) == 6 + 3 + 1 and run_pass(catalog, "summarize", own("2"), levels) == 0
    before = {r["target_id"]: r["text"] for r in catalog.table("summaries").collect()}
    chunks = catalog.table("chunks")
    new = chunks.filter("location_uri = 'text://chat/ch/1/sc/0'").withColumn("content", F.lit("changed")).withColumn("id", F.sha2(F.lit("changed"), 256))
    catalog.write(changed={"chunks": (new, chunks.filter("location_uri = 'text://chat/ch/1/sc/0'").select("id"))})
    assert run_pass(catalog, "summarize", own("3"), levels) == 3  # the turn, its conversation, the corpus
    after = {r["target_id"]: r["text"] for r in catalog.table("summaries").collect()}
    assert sum(after.get(k) != v for k, v in before.items()) == 2


def test_paths_settle(spark, tmp_path):
    watch.with_state_store(spark)
    t = lambda s: datetime.datetime(2024, 1, 1, 12, 0, 0) + datetime.timedelta(seconds=s)
    kind = "path string, at timestamp, content string"
    batches = [
        [("a", t(0), "1"), ("a", t(2), "3"), ("a", t(1), "2"), ("b", t(0), "x"), ("b", t(1), None), ("c", t(0), "y")],
        [("c", t(30), "y"), ("a", t(31), "4"), ("d", t(32), "z")],
        [("c", t(60), None), ("a", t(61), "5"), ("a", t(62), "4")],
        [("~", t(3000), "end")],
        [("~", t(6000), "end")],
    ]
    (tmp_path / "in").mkdir()
    out = str(tmp_path / "out")
    for k, b in enumerate(batches):
        spark.createDataFrame(b, kind).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in" / "*"))
        q = watch.settled(stream, datetime.timedelta(seconds=5), "1 second").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    found = rows(spark.read.schema(watch.SETTLED).parquet(out).filter("path <> '~'"), "path", "change", "content")
    assert found == [("a", "added", "3"), ("a", "modified", "4"), ("c", "added", "y"), ("c", "deleted", None), ("d", "added", "z")]
    every = spark.createDataFrame([r for b in batches for r in b], kind)
    assert rows(watch.settled_batch(every).filter("path <> '~'"), "path", "content") == [("a", "4"), ("d", "z")]


def test_watching_keeps_a_corpus_up_to_date(spark, tmp_path):
    catalog, adapter = Catalog(spark, str(tmp_path / "catalog")), adapters.WikiAdapter()
    corpus = plans.register_or_find(catalog, "wiki", "w", "stream://w", "1")
    kind = watch.SETTLED
    for k, changes in enumerate([[("a", "added", "# A\none", None), ("b", "added", "# B\ntwo", None)], [("a", "modified", "# A\nthree", None), ("b", "deleted", None, None)]]):
        spark.createDataFrame(changes, kind).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in" / "*"))
        plans.watched(catalog, corpus, adapter, stream, str(tmp_path / "cp"), once=True).awaitTermination()
    assert {r["location_uri"]: r["content"] for r in catalog.table("chunks").collect()} == {"text://w/wiki/a": "# A\nthree"}
    assert catalog.table("chunks_history").count() == 2
