"""The catalog's versions, deltas and conflicts, walks that write what changed, and the sweep of all kinds."""

import hashlib
import os
import threading

import pytest
from pyspark.sql import functions as F

from textgraph.operators import history
from textgraph.plans import walk
from textgraph.schema import VERSIONED, schema
from textgraph.storage import Catalog, Conflict


def table(spark, name, *rows):
    s = schema(name)
    return spark.createDataFrame([tuple(r.get(f.name) for f in s.fields) for r in rows], s)


def names(catalog, version=None):
    return {r["id"]: r["canonical_name"] for r in catalog.table("entities", version).collect()}


def entity(i, name, **more):
    return {"id": i, "corpus_id": "c", "canonical_name": name, **more}


def test_changes_are_deltas(spark, tmp_path):
    catalog, want = Catalog(spark, str(tmp_path)), {f"e{k}": "0" for k in range(400)}
    catalog.commit(entities=table(spark, "entities", *(entity(i, n) for i, n in want.items())))
    states = {1: dict(want)}
    for k in range(1, 12):
        rows = table(spark, "entities", entity(f"e{k}", str(k)), entity("last", str(k)))
        gone = table(spark, "entities", entity(f"e{100 + k}", ""))
        version = catalog.write(changed={"entities": (rows, gone)})
        want |= {f"e{k}": str(k), "last": str(k)}
        want.pop(f"e{100 + k}")
        states[version] = dict(want)
    assert all(names(catalog, v) == s for v, s in states.items()) and names(catalog) == want
    row = catalog.info().first()
    assert row["table"] == "entities" and row["version"] == 12 and row["snapshots"] < 8 and row["bytes"] > 0 and row["schema_version"] == 3
    # another session, from the files alone
    assert names(Catalog(spark, str(tmp_path))) == want


def test_two_writers(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    catalog.commit(entities=table(spark, "entities", entity("a", "1")), corpora=table(spark, "corpora", {"id": "c"}))
    one, two = catalog.reading(), Catalog(spark, str(tmp_path)).reading()
    assert one.table("entities").count() == two.table("entities").count() == 1
    one.commit(changed={"entities": (table(spark, "entities", entity("a", "one")), None)})
    with pytest.raises(Conflict):
        two.commit(changed={"entities": (table(spark, "entities", entity("a", "two")), None)})
    assert names(catalog) == {"a": "one"}
    # tables that the other neither read nor wrote are no conflict
    three = Catalog(spark, str(tmp_path)).reading()
    three.table("corpora")
    catalog.commit(entities=table(spark, "entities", entity("b", "")))
    assert three.commit(replaced={"corpora": table(spark, "corpora", {"id": "d"})}) == 4 and names(catalog) == {"b": ""}


def test_writers_at_once_get_different_versions(spark, tmp_path):
    done, failed = [], []

    def write(k):
        try:
            done.append(Catalog(spark, str(tmp_path)).write(appended={"corrections": table(spark, "corrections", {"id": str(k)})}))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and sorted(done) == [1, 2, 3, 4, 5, 6]
    assert Catalog(spark, str(tmp_path)).table("corrections").count() == 6


def written_bytes(path):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(path) for f in files if f.endswith(".parquet"))


def test_a_commit_writes_what_changed(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    text = lambda k: "".join(hashlib.sha256(f"{k} {i}".encode()).hexdigest() for i in range(6))
    catalog.commit(entities=table(spark, "entities", *(entity(f"e{k}", text(k), derived_at_kind="concrete", derived_at_sha="v0") for k in range(3000))))
    base = written_bytes(tmp_path)

    def step(sha, before):
        k = int(sha[1:])
        return {"entities": (table(spark, "entities", entity(f"e{k}", f"new {k}", derived_at_kind="concrete", derived_at_sha=sha)), table(spark, "entities", entity(f"e{1000 + k}", "")))}

    spent = []
    for k in range(12):
        before = written_bytes(tmp_path)
        walk.forward(catalog, "c", [f"v{k + 1}"], step)
        spent.append(written_bytes(tmp_path) - before)
    assert max(spent) < base / 10
    head = names(catalog)
    assert len(head) == 2988 and all(head[f"e{k}"] == f"new {k}" for k in range(1, 13)) and "e1001" not in head
    past = catalog.table("entities_history")
    assert past.count() == 24 and past.filter("superseded_at_sha = 'v7'").count() == 2 and catalog.table("tombstones").count() == 12
    # the same walk again finds nothing to archive
    walk.forward(catalog, "c", ["v12"], step)
    assert catalog.table("entities_history").count() == 24


def test_sweep_of_all_kinds(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    of = lambda name, *rows: table(spark, name, *({"corpus_id": "c", "derived_at_version": "v1"} | r for r in rows))
    catalog.commit(
        chunks=of("chunks", {"id": "h1", "location_uri": "u1"}, {"id": "h2", "location_uri": "u2"}), entities=of("entities", entity("a", "A", first_location_uri="u1"), entity("b", "B", last_location_uri="u1"), entity("d", "D", first_location_uri="u2")),
        edges=of("edges", {"id": "1", "from_entity_id": "a", "to_entity_id": "d"}, {"id": "2", "from_entity_id": "d", "to_entity_id": "d", "location_uri": "u1"}), summaries=of("summaries", {"id": "s1", "target_kind": "entity", "target_id": "a", "model": "m"}, {"id": "s2", "target_kind": "chunk", "target_id": "h1", "model": "m"}, {"id": "s3", "target_kind": "chunk", "target_id": "h2", "model": "m"}),
        entity_purposes=of("entity_purposes", {"entity_id": "a", "model": "m"}, {"entity_id": "d", "model": "m"}), entity_contracts=of("entity_contracts", {"entity_id": "b", "model": "m"}), entity_blocks=of("entity_blocks", {"id": "k", "entity_id": "a"}), embeddings=of("embeddings", {"id": "v", "chunk_id": "h1"}),
    )
    assert history.swept(catalog, "c", spark.createDataFrame([("h1",)], "id string"), "v2") == 2
    left = {n: catalog.table(n).count() for n in VERSIONED}
    gone = {n: catalog.table(f"{n}_history").count() for n in VERSIONED}
    assert left == {"chunks": 1, "entities": 1, "edges": 1, "summaries": 1, "entity_purposes": 1, "entity_contracts": 0, "entity_blocks": 0, "embeddings": 0, "themes": 0}
    assert gone == {"chunks": 1, "entities": 2, "edges": 1, "summaries": 2, "entity_purposes": 1, "entity_contracts": 1, "entity_blocks": 1, "embeddings": 1, "themes": 0}
    assert {(r["superseded_at_version"], r["derived_at_sha"]) for r in catalog.table("entities_history").collect()} == {("v2", "v1")}
    assert names(catalog) == {"d": "D"} and catalog.table("entities", 1).filter(F.col("id") == "a").count() == 1
