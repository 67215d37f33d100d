"""Packing, whitening, the prefix trie, and texts that once failed, against brute force."""

import hashlib
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textgraph.llm import line_dedup, packing, prefix_trie, token_store, whitening

SPECIAL = "<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_store.default_tokenizer())


@pytest.fixture(scope="module")
def own():
    with open(token_store.default_tokenizer(), encoding="utf-8") as f:
        return token_store.encoding(f.read())


@pytest.mark.parametrize("white", [" ", "\n", "\t", "　", " \n", "  \t\x85"])
@pytest.mark.parametrize("n", [9_999, 10_001, 1_000_000])
def test_long_white_space_has_the_library_s_ids(own, library, white, n):
    run = (white * n)[:n]
    texts = [run, f"x {run}a", f"{run}\n", f"a{run}", f"{run}{SPECIAL}{run} b", f"1{run}'s {run[: n // 2]}é"] if n < 1_000_000 else [f"x {run}a", run]
    for text in texts:
        assert token_store.token_ids(own, text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_ten_million_spaces(own):
    ids = token_store.token_ids(own, " " * 10_000_000 + "a")
    assert len(ids) == 10_000_000 and len(set(ids[:-1].tolist())) == 1


def test_token_files_of_long_white_space(spark, library):
    texts = {1: "x " + " " * 1_000_000 + "a", 2: "\n" * 1_000_000, 3: "plain"}
    out = {r["doc_id"]: r for r in token_store.query(spark, spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()}
    for doc, text in texts.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert (out[doc]["n_tokens"], out[doc]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def packed_docs(spark):
    r = np.random.default_rng(5)
    texts = {k: " ".join(f"w{v}" for v in r.integers(0, 50, n)) for k, n in enumerate([0, 1, 2, 600, 700, 1023, 2500, 9000])}
    rows = [(k, t, "x", 1) for k, t in texts.items()] + [(20, None, None, None), (None, "no id of its own", "x", 2), (3, texts[3], "x", 3), (21, f"{SPECIAL} a" + " " * 20_000, "x", 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, length string, offset int").repartition(3)


@pytest.mark.parametrize("most", [2048, 64])
def test_packing(spark, library, tmp_path, most, monkeypatch):
    monkeypatch.setattr(packing, "HELD", 3000)
    docs = packed_docs(spark)
    packed = packing.pack(docs, most=most)
    rows = packed.collect()
    by_doc = defaultdict(list)
    for r in rows:
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= most and r["offset"] == 0
        by_doc[r["doc_no"]].append(r)
    found = []
    for own in by_doc.values():
        own.sort(key=lambda r: r["start"])
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
        short = [r["length"] for r in own if r["length"] < most]
        assert short == sorted(set(short), reverse=True)  # each binary digit once
        ids = np.concatenate([np.frombuffer(bytes(r["ids"]), "<u4") for r in own]).tolist()
        assert all(r["doc_tokens"] == len(ids) for r in own)
        found.append((own[0]["doc_id"], ids))
    want = [(r["doc_id"], [*library.encode(r["text"] or "", add_special_tokens=False).ids, packing.END]) for r in docs.collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    # gapless, and longer sequences first
    assert [r["sequence_id"] for r in sorted(rows, key=lambda r: r["sequence_id"])] == list(range(len(rows)))
    lengths = [r["length"] for r in sorted(rows, key=lambda r: r["sequence_id"])]
    assert lengths == sorted(lengths, reverse=True)
    at = f"{tmp_path}/sequences"
    packing.save(packed, at)
    assert spark.read.parquet(at).groupBy("length").count().count() == len(set(lengths)) and spark.read.parquet(at).count() == len(rows)


def test_packing_edges(spark):
    assert packing.query(spark, packed_docs(spark).limit(0)).count() == 0
    out = packing.query(spark, packed_docs(spark)).collect()
    assert {(r["start"], r["length"], r["doc_tokens"]) for r in out if r["doc_id"] in (0, 20)} == {(0, 1, 1)}
    with pytest.raises(ValueError):
        packing.pack(packed_docs(spark), most=1000)


def vectors(spark, n=400, d=20, dtype="array<float>"):
    r = np.random.default_rng(7)
    base = (r.standard_normal((n, 5)) @ r.standard_normal((5, d)) + 0.3 * r.standard_normal((n, d)) + 5).astype(np.float32)
    rows = [(i, [float(x) for x in v], i) for i, v in enumerate(base)]
    rows += [(1000 + k, rows[3][1], 0) for k in range(200)]  # a third are copies
    bad = [float("nan"), float("inf"), float("-inf"), None]
    rows += [(2000 + k, [b, *rows[0][1][1:]], 0) for k, b in enumerate(bad)] + [(3000, None, 0), (3001, [], 0), (3002, [1.0], 0), (None, rows[5][1], None), (7, rows[9][1], 1)]
    return rows, spark.createDataFrame(rows, f"vec_id long, embedding {dtype}, component int").repartition(4)


def test_whitening(spark):
    rows, df = vectors(spark)
    out = whitening.query(spark, df).collect()
    keep = [(i, np.floor(np.array(v, np.float32).astype(float) * 64).astype(np.int64) + 1_000_000) for i, v, _ in rows if v and len(v) == 20 and all(x is not None and np.isfinite(x) for x in v)]
    fit = np.array(sorted({tuple(x.tolist()) for _, x in keep}))
    n, total = len(fit), [sum(int(x) for x in c) for c in fit.T]
    centred = fit - fit.mean(0)
    v = centred.T @ centred / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(out) == 16 * len(keep) and {r["n"] for r in out} == {n}
    found = defaultdict(dict)
    for r in out:
        found[r["vec_id"], r["deviation"]][r["component"]] = r
        assert abs(r["explained"] / (values[r["component"] - 1] / np.trace(v)) - 1) < 1e-9 and r["identity_error"] < 1e-9
    signs = {}
    for i, x in keep:
        deviation = sum((n * int(a) - s) ** 2 for a, s in zip(x, total))
        own = found[i, deviation]
        for k in range(16):
            want = float((x - np.array(total) / n) @ axes[:, k] / np.sqrt(values[k]))
            sign = signs.setdefault(k, 1.0 if own[k + 1]["whitened"] * want >= 0 else -1.0)
            assert abs(own[k + 1]["whitened"] - sign * want) < 1e-7


def test_whitening_edges(spark):
    _, df = vectors(spark)
    empty = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue"]
    for none in (df.limit(0), df.filter("vec_id = 3"), df.filter("vec_id = 3000")):
        out = whitening.query(spark, none)
        assert out.columns == empty and out.count() == 0
    # fewer directions than components; entries so large that longs don't do for what comes of them
    few = spark.createDataFrame([(k, [float(k) * 2.0**40, 1.0, -float(k) ** 2 * 2.0**40]) for k in range(6)], "vec_id long, embedding array<double>")
    out = whitening.query(spark, few).collect()
    assert {r["component"] for r in out} == {1, 2} and all(r["deviation"] is None and r["identity_error"] < 1e-4 for r in out)
    rows = whitening.integer_rows(few, "embedding")
    exact = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(rows, whitening.fit(rows)).collect()}
    x = {k: [int(k * 2.0**46) + 1_000_000, 1_000_064, -(k**2) * 2**46 + 1_000_000] for k in range(6)}
    total = [sum(c) for c in zip(*x.values())]
    assert exact == {k: sum((6 * a - s) ** 2 for a, s in zip(v, total)) for k, v in x.items()}


def brute_trie(rows):
    """Nodes by their definition, from (conv, turn, role, text)."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    own_saved = {p: (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0 for p, m in members.items()}
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = own_saved[p] + sum(saved[q] for q in children[p])
    end = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(made[c]) == len(p)).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], end(p)) for p, m in members.items()), key=repr)


def talk():
    r = np.random.default_rng(11)
    rows = []
    for c in range(0, 900):
        kind = r.integers(0, 6)
        if c % 20 == 0 and kind == 0:
            continue  # a family without its first
        n = int(r.integers(1, 7)) if kind < 5 else int(r.integers(20, 60))
        for t in range(n):
            rows.append((c, t, ["user", "assistant"][t % 2], f"say {r.integers(0, 3)}" if t < 4 else f"then {r.integers(0, 2)} of  it"))
    rows += [(2000 + k, t, "user", f"the same {t}") for k in range(200) for t in range(5)]  # copies
    rows += [(3000 + k, t, "user", "again") for k in range(12) for t in range(k + 4)]  # each a prefix of the next
    rows += [(-7, 0, "user", "below zero"), (5, None, None, None), (5, None, "z", "a"), (5, 2, "user", ""), (5, 2, "user", ""), (None, 1, "user", "nobody's"), (41, None, "user", None), (7001, 0, "user", "goes"), (6, 1, "ab", "c"), (8, 1, "a", "bc")]
    return rows


@pytest.mark.parametrize("local", [3, 256])
def test_trie(spark, local):
    rows = talk()
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, seq string").repartition(5)
    out = prefix_trie.query(spark, df, local)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert out.columns == columns
    assert sorted(map(tuple, out.collect()), key=repr) == brute_trie(rows)


def test_trie_edges(spark):
    kind = "conv_id long, turn long, role string, text string"
    one = [(7, 1, "user", "a b c")]
    for rows in ([], [(None, 1, "user", "a")], one, [(7, k, "user", f"t{k}") for k in range(3000)]):
        out = prefix_trie.query(spark, spark.createDataFrame(rows, kind))
        assert sorted(map(tuple, out.collect()), key=repr) == brute_trie(rows)


def test_quicksort_nodes_of_a_deep_prefix():
    seqs = [[1] * k for k in range(1, 1500)]
    nodes = prefix_trie.quicksort_nodes(seqs, [[2] * len(s) for s in seqs], [1] * len(seqs), list(range(len(seqs))), ["e"] * len(seqs), 0, 0)
    assert len(nodes) == 1499 and nodes[0][3] == 1499 and nodes[0][6] == 2 * sum(range(1499)) and all(r[7] == "e" for r in nodes)


def test_line_dedup_is_linear_and_leaves_nothing_in_the_catalog(spark):
    text = "\n".join(f"line {k} of a long log that many documents hold as it is" for k in range(200_000))
    df = spark.createDataFrame([(k, f"own {k}\n{text}") for k in range(5)], "doc_id long, text string")
    before = {t.name for t in spark.catalog.listTables()}
    began = time.time()
    out = {r["doc_id"]: r for r in line_dedup.query(spark, df).collect()}
    assert time.time() - began < 60
    assert {t.name for t in spark.catalog.listTables()} == before
    for k in range(5):
        kept = f"own {k}\n{text}" if k == 4 else f"own {k}"
        assert (out[k]["n_lines"], out[k]["n_dropped"]) == (200_001, 0 if k == 4 else 200_000) and out[k]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


def test_rarest_shingles_both_ways(spark, monkeypatch):
    from textgraph.llm import near_dedup

    r = np.random.default_rng(4)
    sets = spark.createDataFrame([(bytes([k]), sorted({int(v) for v in r.integers(0, 40 + 3 * k, 5 + k)})) for k in range(60)] + [(b"z", [1])], "digest binary, shingles array<long>").repartition(3)
    found = []
    for most in (100_000, -1):
        monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", most)
        found.append(sorted((x["key"], bytes(x["digest"])) for x in near_dedup.prefixes(sets).collect()))
    assert found[0] == found[1] and len(found[0]) > 100


def test_merged_line_runs_are_deleted(spark, tmp_path):
    import os

    store = line_dedup.LineRuns(spark, f"{tmp_path}/runs", fanout=2)
    for b in range(5):
        store.add(spark.createDataFrame([(100 - 10 * b, bytes([b]))], "doc long, key binary"))
    live = {path.rsplit("/", 1)[-1] for level in store.levels for path, _ in level}
    found = {n for n in os.listdir(f"{tmp_path}/runs") if not n.startswith(("levels-", ".", "_"))}
    assert live <= found and len(found) <= len(live) + 2 and store.totals().agg(F.count("*")).first()[0] == 5
