"""Each operator on small tables that hold nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textgraph.llm import decontamination, language_model, line_dedup, near_dedup, pii, quality_rules, sentencepiece_codec, sharding, token_store, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, source string, words string, score double, doc string, key string, base string, spans string, n_dropped string"


def lower(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{r.integers(0, 9)}" for i in r.integers(0, len(WORDS), n))


LINE = "This line of more than forty characters is shared by MANY documents"
TEXTS = {
    0: None, 1: "", 2: "   \n\t ", 3: "one two", 4: "ONE two", 5: prose(1, 80), 6: prose(1, 80), 7: prose(1, 80).replace(" ", "\n", 3), 8: prose(2, 4000), 9: prose(2, 4000).rpartition(" ")[0] + " changed",
    **{10 + k: f"{prose(10 + k, 30)}\n{LINE if k % 2 else LINE.upper()}  \nshort\n{LINE}" for k in range(8)},
    20: "Écrivez à jean.x@mail.example.com ou +33 1 23 45 67 89, carte 4111 1111 1111 1111, ip 10.0.0.256 et 10.0.0.25 🙂 fin", 21: "a" * 3000, 22: "1 2 3 1 2 3 1 2 3 4", 23: "<|endoftext|> ▁ x  y   z",
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 3}" if i else None, "w", 0.5, "d", "k", "b", "s", "n") for i, t in TEXTS.items()]
    rows += [(None, "nobody's text of some words", "s1", "w", 0.5, "d", "k", "b", "s", "n"), rows[5], rows[5]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 0 if i in (21, 22) else 1, 1 if i in (10, 11, 12) else 0) for i in TEXTS] + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def text_of(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def test_statistics():
    s = dict(zip(quality_rules.COUNTS, quality_rules.statistics("1 2 3 1 2 3 1 2 3 4"), strict=True))
    assert (s["n_words"], s["n_repeat_words"], s["n_distinct"]) == (10, 9, 4)
    s = dict(zip(quality_rules.COUNTS, quality_rules.statistics("é # $\n\né # $\n \nx y"), strict=True))
    assert (s["n_words"], s["word_chars"], s["n_symbols"], s["n_dup_lines"]) == (7, 9, 4, 1)
    assert quality_rules.statistics("") == [0] * len(quality_rules.COUNTS)


def test_repeated_words_brute_force():
    r = np.random.default_rng(3)
    for n in range(0, 40):
        words = [b"%d" % k for k in r.integers(0, 3, n)]
        windows = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
        covered = {i + k for i in range(n - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        assert quality_rules.repeated_words(words) == len(covered)


def test_rules_learn_a_conjunction():
    r = np.random.default_rng(0)
    x = r.random((3000, len(quality_rules.FEATURES))) * 100
    bad = (x[:, 1] > 70) & (x[:, 2] < 40)
    rules = quality_rules.learn(x, bad)
    found = np.zeros(len(x), bool)
    for rule in rules:
        found |= quality_rules.covers(rule, x)
    assert rules and (found & ~bad).sum() <= 0.05 * bad.sum() and (found & bad).sum() >= 0.9 * bad.sum()


def test_quality_query(spark, docs, labels, empty):
    out = rows_of(quality_rules.query(spark, docs, labels))
    assert len(out) == docs.count()
    for r in out:
        n = len(tokens(TEXTS.get(r["doc_id"], "nobody's text of some words")))
        assert r["n_words"] == n and r["base_failed"] == (n < 50 or 100 * r["n_repeat_words"] > 50 * n)
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.query(spark, empty, labels).count() == 0
    assert quality_rules.query(spark, docs, labels.limit(0)).count() == len(out)


def test_quality_brute_force(spark, docs, labels):
    """Every column of the result: the counts by their definition, the verdict by the rules one by one."""
    rules = quality_rules.fit(docs, labels)
    rules = rules or [(quality_rules.Condition("symbols", True, 30.0), quality_rules.Condition("n_words", False, 500.0)), (quality_rules.Condition("repeats", True, 900.0),)]
    columns = ["doc_id", *quality_rules.COUNTS]
    found = quality_rules.with_statistics(docs, ["doc_id"]).withColumn("kept", quality_rules.verdict(rules)).select(*columns, "kept").collect()
    assert len(found) == docs.count()
    text = text_of(docs)
    for r in found:
        t = text[r["doc_id"]]
        words, lines = tokens(t), [x for x in t.split("\n") if tokens(x)]
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        repeated = len({i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)})
        want = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeated, "n_digits": sum(c in "0123456789" for c in t), "n_lines": len(lines), "n_distinct": len(set(words))}
        assert {k: r[k] for k in want} == want
        ratio = lambda a, b: want[a] * 1000 / want[b] if want[b] else 0.0
        value = {f: ratio(a, b) if b else want[a] for f, (a, b) in quality_rules.FEATURES.items()}
        rejected = any(all(value[c.feature] >= c.cut if c.at_least else value[c.feature] <= c.cut for c in rule) for rule in rules)
        assert r["kept"] == (not rejected)


def test_sharding(spark, docs, empty):
    out = rows_of(sharding.query(spark, docs))
    assert len(out) == docs.count()
    text = text_of(docs)
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
        raw = text[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    many = rows_of(sharding.positions(spark.range(1000).selectExpr("id as doc_id", "'x' as text", "if(id < 333, 'hot', concat('s', id % 7)) as source"), 10))
    sizes = Counter(r["shard"] for r in many)
    hot = Counter(r["shard"] for r in many if r["doc_id"] < 333)
    assert set(sizes.values()) == {100} and max(hot.values()) - min(hot.values()) <= 3
    assert sharding.query(spark, empty).count() == 0


def brute_places(rows, shards):
    """(doc_id, shard, slot) of rows of (doc_id, text, source), by the definition."""
    strata = defaultdict(list)
    for d, t, src in rows:
        crc = zlib.crc32((t or "").encode())
        digest = hashlib.md5(f"{sharding.SEED}:{'' if d is None else d}:{crc}".encode()).hexdigest()
        strata["null" if src is None else f"s:{src}"].append((int(digest[:15], 16), d is not None, d or 0, crc, d))
    order = sorted(((2 * r + 1) / (2 * len(v)), s, r, x[4]) for s, v in strata.items() for r, x in enumerate(sorted(v)))
    n = len(order)
    return sorted(((x[3], g * shards // n, g - -(-(g * shards // n * n) // shards)) for g, x in enumerate(order)), key=repr)


def test_sharding_brute_force_and_hot_ids(spark, docs, monkeypatch):
    import duckdb

    monkeypatch.setattr(sharding, "COPIES", 70)
    place = lambda df: sorted(((r["doc_id"], r["shard"], r["slot"]) for r in sharding.query(spark, df).collect()), key=repr)
    plain = lambda df: [(r["doc_id"], r["text"], r["source"]) for r in df.select("doc_id", "text", "source").collect()]
    assert place(docs) == brute_places(plain(docs), sharding.SHARDS)
    hot = spark.createDataFrame([(None, f"t{k % 150}", "a") for k in range(300)] + [(7, "same", "a")] * 300 + [(k, f"x{k}", f"s{k % 3}") for k in range(300)], "doc_id long, text string, source string")
    assert place(hot) == brute_places(plain(hot), sharding.SHARDS)
    con = duckdb.connect()
    con.register("documents", hot.toPandas().astype({"doc_id": "Int64"}))
    columns = "doc_id, size, text_crc32, law, shard, slot, grown_shard"
    assert sorted(con.sql(f"SELECT {columns} FROM ({sharding.SQL})").fetchall(), key=repr) == sorted(map(tuple, sharding.query(spark, hot).selectExpr(*columns.split(", ")).collect()), key=repr)


def shingles(text):
    w = tokens(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(texts):
    sets, parent = [shingles(t) for _, t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(texts)):
        members[find(i)].append(texts[i][0])
    least = {k: min((d for d in v if d is not None), default=None) for k, v in members.items()}
    return [(texts[i][0], len(sets[i]), least[find(i)]) for i in range(len(texts))]


def compare_groups(spark, df):
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows_of(near_dedup.query(spark, df))), key=repr)
    assert found == sorted(brute_components([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]), key=repr)


def test_near_dedup_edges(spark, docs, empty):
    compare_groups(spark, docs)
    assert near_dedup.query(spark, empty).count() == 0
    kept = near_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    groups = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    stay = {c for _, n, c in groups if n} | {d for d, n, _ in groups if not n}
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(stay, key=repr)


def test_near_dedup_rows_without_ids_and_repeated_rows(spark):
    a, b, c = prose(31, 90), prose(32, 90), prose(33, 90)
    rows = [(None, a)] * 40 + [(None, f"{prose(40 + k, 60)}") for k in range(30)] + [(5, a)] * 20 + [(6, b), (6, c), (6, c), (7, c), (None, b + " end"), (None, "x" * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    compare_groups(spark, df)
    kept = [(r["doc_id"], r["text"]) for r in near_dedup.deduplicated(df).collect()]
    assert sorted(kept, key=repr) == sorted({(5, a), (6, b), (6, c), (None, "x" * 30), *((None, prose(40 + k, 60)) for k in range(30))}, key=repr)


@pytest.mark.parametrize(("clusters", "size", "edits", "own"), [(100, 4, 12, 2), (120, 3, 16, 2), (100, 4, 6, 2)])
def test_near_dedup_loses_no_link_in_dense_regions(spark, clusters, size, edits, own):
    """Clusters of near copies, all edited from one frame: alike to each other, but not as much as within a cluster."""
    r, frame, rows = np.random.default_rng(clusters + edits), prose(55, 300).split(), []
    for c in range(clusters):
        base = list(frame)
        for at in r.choice(300, edits, replace=False):
            base[at] = f"c{c}x{at}"
        for k in range(size):
            w = list(base)
            for at in r.choice(300, own, replace=False):
                w[at] = f"o{c}y{k}z{at}"
            rows.append((len(rows), " ".join(w)))
    compare_groups(spark, spark.createDataFrame(rows, "doc_id long, text string"))


def test_near_dedup_dense_groups(spark):
    r = np.random.default_rng(5)
    base = prose(77, 300).split()
    rows = [(0, " ".join(base))]
    for k in range(1, 121):  # copies alike to the base, most not to each other
        w = list(base)
        for at in r.choice(300, 5, replace=False):
            w[at] = f"edit{k}x{at}"
        rows.append((k, " ".join(w)))
    chain = prose(88, 200).split()
    for k in range(40):  # each alike to the next only
        chain = chain[3:] + [f"new{k}a", f"new{k}b", f"new{k}c"]
        rows.append((1000 + k, " ".join(chain)))
    rows += [(2000 + k, rows[k % 7][1]) for k in range(300)]
    rows += [(5000 + k, prose(900 + k, 120)) for k in range(100)]
    compare_groups(spark, spark.createDataFrame(rows, "doc_id long, text string"))


def template_rows(n, planted):
    """n texts that share a passage, a similarity of about 0.80 to each other, and pairs of about 0.87 among them."""
    passage, rows = prose(66, 180), []
    for k in range(n):
        own = prose(7000 + k, 22).split()
        if k % 2 and k < 2 * planted:
            own = rows[-1][1].split()[180:188] + own[8:]
        rows.append((k, f"{passage} {' '.join(own)}"))
    return rows


def test_near_dedup_template(spark):
    rows = template_rows(500, 60)
    found = [r for r in brute_components(rows) if r[0] != r[2]]
    assert 50 <= len(found) <= 70
    compare_groups(spark, spark.createDataFrame(rows, "doc_id long, text string"))


def test_near_dedup_blocks(spark, monkeypatch):
    for name, value in {"SMALL": 8, "BLOCK": 16}.items():
        monkeypatch.setattr(near_dedup, name, value)
    rows = template_rows(160, 30)
    rows += [(1000 + k, rows[7][1] + f" end{k}") for k in range(40)]
    compare_groups(spark, spark.createDataFrame(rows, "doc_id long, text string"))


def test_decontamination_shared_prompt(spark):
    """A line that all items share, and many documents, brings no pairs together; items of it alone are found."""
    prompt = "please answer the following question about this passage in one short sentence and give reasons"
    items = [(k, f"{prompt} {prose(k, 40)}") for k in range(300)] + [(1000, prompt)]
    rows = [(k, f"{prose(5000 + k, 30)} {prompt} {prose(6000 + k, 30)}") for k in range(200)] + [(900 + k, f"start {items[k][1]} end") for k in range(5)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.query(spark, docs, bench).collect()}
    assert found == {(d, 1000) for d, _ in rows} | {(900 + k, k) for k in range(5)}
    sets = decontamination.shingles(F.col("text"))
    sets = bench.select("item_id", F.explode(sets).alias("shingle")).withColumn("hash", F.xxhash64("shingle"))
    sketch = decontamination.sketches(sets, 80).join(sets.groupBy("hash").agg(F.count("*").alias("held")), "hash")
    assert sketch.filter("held > 2").select("item_id").distinct().collect() == [(1000,)]


def test_language_model(spark, docs, empty):
    out = rows_of(language_model.query(spark, docs))
    assert len(out) == docs.count()
    every = [(r["doc_id"], tokens(lower(r["text"] or "")) + [" "]) for r in docs.collect()]
    crc = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10
    counts = Counter(w for d, ws in every if crc(d) for w in ws)
    n = sum(counts.values())
    z = math.log10(n + 0.1 * (len(counts) + 1))
    want = {d: (sum(math.log10(counts.get(w, 0) + 0.1) for w in ws) - len(ws) * z, len(ws), sum(w in counts for w in ws)) for d, ws in every}
    for r in out:
        base, length, known = want[r["doc_id"]]
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and (r["n_tokens"], r["n_known"], r["train_tokens"]) == (length, known, n)
        assert r["held_out"] == (crc(r["doc_id"]) == 0) and r["score"] < 0
    assert language_model.query(spark, empty).count() == 0


def test_language_model_is_a_distribution_and_learns():
    model = language_model.Model([f"w{k}" for k in range(200)], np.arange(200, 0, -1.0), np.ones(language_model.RARE), 5)
    n = 201 + language_model.RARE
    h = np.random.default_rng(1).standard_normal((1, language_model.HIDDEN)).astype(np.float32)
    total = np.exp(model.output(np.repeat(h, n, 0), np.arange(n))).sum()
    assert abs(total - 1) < 1e-3
    cycle = [np.append(np.tile(np.arange(60, 64), 30), 0) for _ in range(600)]
    before = model.log10(cycle[:1])[0]
    model.train(cycle)
    assert model.log10(cycle[:1])[0] > before / 3
    # the state is carried: windows of any width give the same
    assert np.allclose(model.log10(cycle[:3], window=7), model.log10(cycle[:3], window=64), rtol=1e-4)


def test_language_model_learns_from_every_training_document(spark):
    words = [f"own{k}" for k in range(60)]
    table = language_model.chunks(spark.createDataFrame([(k, f"{w} " * 60) for k, w in enumerate(words)], "doc_id long, text string").coalesce(1))
    make = lambda: language_model.Model(words, np.ones(60), np.ones(language_model.RARE), 5)
    before, after = make(), language_model.fit(table, make(), 3000)
    changed = [bool((before.p["emb"][before.index[w]] != after.p["emb"][after.index[w]]).any()) for w in words]
    assert changed == [zlib.crc32(str(k).encode()) % 10 != 0 for k in range(60)]
    assert make().train([np.array([60, 61, 0])] * 101) == 303


def test_language_model_scores_like_a_plain_recurrence_and_whatever_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(language_model, "GROUP_TOKENS", 2500)
    monkeypatch.setattr(language_model, "FAN_IN", 2)
    r = np.random.default_rng(6)
    texts = {k: " ".join(WORDS[i] for i in np.cumsum(r.integers(0, 3, 1 + k % 90)) % len(WORDS)) for k in range(400)}
    df = spark.createDataFrame([*texts.items(), (900, None), (None, "nobody's words"), (7, texts[7])], "doc_id long, text string")
    made = [{r["doc_id"]: r["score"] for r in rows_of(language_model.query(spark, df.repartition(n)))} for n in (1, 5)]
    assert all(math.isclose(made[0][d], made[1][d], rel_tol=1e-6) for d in made[0])
    model = language_model.Model(WORDS[:15], np.arange(15, 0, -1.0), np.ones(language_model.RARE), 5)
    model.train([np.append(np.arange(60, 64), 0)] * 500)
    p = {k: v.astype(float) for k, v in model.p.items()}
    H = language_model.HIDDEN
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for doc in ([0], [60, 61, 5, 62, 0], [*r.integers(1, 64, 100), 0]):
        h, last, total = np.zeros(H), 0, 0.0
        for s in doc:
            gates, u = p["emb"][last] @ p["wx"] + p["b"], h @ p["wh"]
            z, g = sigmoid(gates[:H] + u[:H]), sigmoid(gates[H : 2 * H] + u[H : 2 * H])
            n = np.tanh(gates[2 * H :] + g * u[2 * H :])
            h = (1 - z) * n + z * h
            c = model.kls[s]
            of_class, within = np.exp(h @ p["wc"] + p["bc"]), np.exp(h @ p["ww"][c] + p["bw"][c])
            total += np.log10(of_class[c] / of_class.sum() * within[model.slot[s]] / within.sum())
            last = s
        assert math.isclose(model.log10([np.array(doc)])[0], total, rel_tol=1e-4)


def test_language_model_reads_documents_once_and_hashes_endings_once(monkeypatch):
    class Counted(np.ndarray):
        def __getitem__(self, at):
            reads.append(1)
            return super().__getitem__(at)

    reads, hashed, classes = [], [], language_model.rare_class
    model = language_model.Model([f"w{k}" for k in range(30)], np.arange(30, 0, -1.0), np.ones(language_model.RARE), 5)
    model.train([np.append(np.arange(50, 70), 0)] * 300)
    before, r = model.vector(), np.random.default_rng(2)
    docs = [np.append(r.integers(1, 79, n), 0) for n in (900, 0, 400, 33, 64, 1)]
    alone = [model.log10([d])[0] for d in docs]
    assert np.allclose(model.log10([d.view(Counted) for d in docs], batch=4), alone, rtol=1e-5)
    assert len(reads) <= len(docs) and (model.vector() == before).all()
    monkeypatch.setattr(language_model, "rare_class", lambda w: hashed.append(w) or classes(w))
    words = [f"{k}{e}" for k in range(100) for e in ("ab", "cd", "ñ")] + ["w3", "z"]
    assert language_model._symbols(model, words).tolist() == [model.index.get(w) or 1 + classes(w) for w in words]
    assert len(hashed) <= 2 + 10 + 1


def test_language_model_gives_the_same_by_folded_and_by_added_biases():
    model = language_model.Model([f"w{k}" for k in range(200)], np.arange(200, 0, -1.0), np.ones(language_model.RARE), 5)
    r = np.random.default_rng(3)
    for w in ("wc", "ww"):
        model.p[w] += r.standard_normal(model.p[w].shape).astype(np.float32) * 0.3
    h, s = np.tanh(r.standard_normal((700, language_model.HIDDEN))).astype(np.float32), r.integers(0, 249, 700)
    logp, gh, g = model.output(h, s, grad=True)
    # a softmax is the same when all its logits grow by as much
    model.p["bc"] += 55
    model.p["bw"] += 55
    logp2, gh2, g2 = model.output(h, s, grad=True)
    assert np.allclose(logp, logp2, atol=1e-4) and np.allclose(logp, model.output(h, s), atol=1e-4) and np.allclose(gh, gh2, atol=1e-6)
    assert all(np.allclose(g[k], g2[k], atol=1e-6) for k in g)
    step = np.zeros_like(h)
    step[:, 5] = 0.01
    slope = (model.output(h - step, s) - model.output(h + step, s)) / (0.02 * len(h))
    assert np.allclose(slope, gh[:, 5], atol=2e-5)


def test_sentencepiece(spark, docs, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    text = text_of(docs)
    for r in rows_of(sentencepiece_codec.query(spark, docs)):
        ids = library.encode(text[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert sentencepiece_codec.query(spark, empty).count() == 0


def test_sentencepiece_random_strings():
    import random

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    with open(sentencepiece_codec.default_model(), "rb") as f:
        own = sentencepiece_codec.Codec(f.read())
    r = random.Random(4)
    texts = ["".join(r.choice("abe  \nthinréßñ▁1.,日😀") for _ in range(r.randint(0, 60))) for _ in range(500)] + ["x" * 5000, " " * 3500, "ab" * 2500]
    assert list(own.encode(texts)) == [library.encode(t) for t in texts]
    long = ["".join(r.choice(c) for _ in range(n)) for c, n in (("abcdefghijklmnopqrstuvwxyz", 20_000), ("ab", 9000), ("thein", 9000), ("0123456789", 9000), ("aAeé日本▁ the", 9000), ("TGCA", 9000))]
    long += ["a" * 100_001, "aab" * 5000, "\u4e2d\u56fd" * 4000, "-=" * 4000, "ing" * 3500 + "x" + "ation" * 2500]
    assert list(own.encode(long)) == [library.encode(t) for t in long]
    ids = [[r.randrange(32000) if r.random() < 0.5 else r.randrange(3, 259) for _ in range(r.randint(0, 8))] for _ in range(500)]
    assert [own.decode(i) for i in ids] == [library.decode(i) for i in ids]


def test_pii(spark, docs, empty):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def valid(kind, s):
        d = [int(c) for c in s if c.isdigit()]
        luhn = sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(d[::-1])) % 10 == 0
        return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in s.split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    odd = "a@b.c_d@e.f a@b.c.d@e.f x@y +1 23 999.1.1.1 1.2.3.4.5.6.7.8 é42.144.35.254 call (212) 555-0199 mail joe.x at mail dot com"
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(900, odd), (901, "9" * 20000 + "a" * 20000)], "doc_id long, text string"))
    text = text_of(more)
    for r in rows_of(pii.query(spark, more)):
        t = text[r["doc_id"]]
        base = [f"{k}:{m.start()}:{m.end()}" for k, p in patterns.items() for m in re.finditer(p, t) if valid(k, m.group())]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(filter(None, r["spans"].split(",")))
        assert [r[f"n_{k}"] for k in patterns] == [sum(b.startswith(k) for b in base) for k in patterns]
        if r["doc_id"] == 900:
            assert {"phone", "email"} <= {s.split(":")[0] for s in set(r["spans"].split(",")) - set(base)}
    assert pii.query(spark, empty).count() == 0
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(docs).collect()}
    assert "[email]" in clean[20] and "@" not in clean[20] and clean[3] == "one two"
    assert pii.with_spans(docs).columns == [*docs.columns, "base_", "spans_"]


def test_toxicity(spark, empty):
    r = np.random.default_rng(9)
    texts = []
    for k in range(900):
        w = [f"{WORDS[i]}{r.integers(0, 40)}" for i in r.integers(0, len(WORDS), 40)]
        if k % 8 == 0:
            w[int(r.integers(0, 40))] = r.choice(["vilest", "rotten", "grimly"])
        texts.append((k, " ".join(w)))
    df = spark.createDataFrame([*texts, (1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 8 == 0)) for k in range(900)], "doc_id long, toxic int")
    out = rows_of(toxicity.query(spark, df, labels))
    held = [x for x in out if x["held_out"] and x["doc_id"] < 900]
    assert len(out) == 902 and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.7) for x in out)
    assert np.mean([x["predicted"] == (x["doc_id"] % 8 == 0) for x in held]) > 0.97
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1) for x in out)
    kept = toxicity.without_toxic(df, toxicity.fit(df, labels))
    assert {x["doc_id"] for x in kept.collect()} == {x["doc_id"] for x in out if not x["predicted"]}
    assert toxicity.query(spark, empty, labels).count() == 0
    assert toxicity.query(spark, df, labels.limit(0)).count() == 902


def test_toxicity_learns_from_positives_and_unlabelled_text_alone(spark):
    r = np.random.default_rng(19)
    text = lambda k: " ".join([*(f"{WORDS[i]}{r.integers(0, 40)}" for i in r.integers(0, len(WORDS), 30)), *(["vilest"] if k % 8 == 0 else [])])
    df = spark.createDataFrame([(k, text(k)) for k in range(600)] + [(700, " ".join(f"long{k}" for k in range(200_000))), (None, "vilest of all"), (None, None)], "doc_id long, text string")
    share = lambda flip: spark.createDataFrame([(k, int(k % 8 == 0)) for k in range(600) if k % 8 == 0 or (k % 3 == flip)], "doc_id long, toxic int")
    a, b = (toxicity.fit(df, share(flip).union(spark.createDataFrame([(k, 0) for k in range(10_000, 10_100)], "doc_id long, toxic int"))) for flip in (0, 1))
    assert set(a.weights) == set(b.weights)  # which texts are labelled 0 plays no part, only how many
    out = {x["doc_id"]: x["predicted"] for x in toxicity.query(spark, df, share(0)).collect() if x["doc_id"] is not None}
    assert np.mean([out[k] == (k % 8 == 0) for k in range(600)]) > 0.97 and out[700] == 0
    again = {x["doc_id"]: x["score"] for x in toxicity.query(spark, df.repartition(7), share(0)).collect()}
    first = {x["doc_id"]: x["score"] for x in toxicity.query(spark, df.repartition(2), share(0)).collect()}
    assert all(math.isclose(again[k], first[k], rel_tol=1e-9) for k in first if k is not None)


def test_nnpu_minimises_the_corrected_risk():
    xp, xu, n = np.array([[1.0, 0], [1, 1]]), np.array([[1.0, 0], [0, 1], [0, 0], [1, 1]]), np.array([5.0, 40, 50, 5])
    w = toxicity.nnpu(xp, xu, n, 0.1, steps=3000, rate=0.01, l2=1e-2)

    def risk(w):
        z = lambda x: np.c_[x, np.ones(len(x))] @ w
        up, down = np.logaddexp(0, -z(xp)).mean(), np.logaddexp(0, z(xp)).mean()
        return 0.1 * up + max(0.0, (n / n.sum()) @ np.logaddexp(0, z(xu)) - 0.1 * down) + 5e-3 * (w[:-1] @ w[:-1])

    r = np.random.default_rng(0)
    assert all(risk(w) <= risk(w + 0.05 * r.standard_normal(3)) + 1e-6 for _ in range(200))


def brute_lines(rows):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(-1 if d is None else d)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) in gone and (-1 if d is None else d) < gone[key(x)])]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_line_dedup(spark, docs, empty):
    out = line_dedup.query(spark, docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")
    want = brute_lines([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(map(tuple, out.collect()), key=repr) == want and any(w[2] for w in want)
    assert line_dedup.query(spark, empty).count() == 0
    whole = line_dedup.dedup_lines(docs)
    assert whole.columns == [*docs.columns, "n_lines", "n_dropped_"]


def test_line_runs_are_levelled_and_reopen(spark, tmp_path):
    at, fresh = f"{tmp_path}/runs", 0
    for b in range(5):  # each batch in a store opened anew
        store = line_dedup.LineRuns(spark, at, fanout=2)
        run = store.add(spark.createDataFrame([(100 - 10 * b - k, bytes([k % 3, b % 2])) for k in range(6)], "doc long, key binary"))
        fresh += run.filter("fresh").count()
    assert [len(level) for level in store.levels] == [1, 0, 1] and fresh == 6
    totals = {bytes(r["key"]): (r["n_docs"], r["holder"]) for r in line_dedup.LineRuns(spark, at).totals().collect()}
    assert totals[b"\x00\x00"] == (6, 100) and totals[b"\x01\x01"] == (4, 89) and len(totals) == 6


def test_line_runs_are_merged_in_order(spark):
    store = line_dedup.LineRuns(spark)
    pairs = spark.range(1000).select((2000 - F.col("id")).alias("doc"), F.unhex(F.md5((F.col("id") % 300).cast("string"))).alias("key"))
    run = store.add(pairs)
    with line_dedup.sorted_scans(spark):
        other = store.add(pairs.withColumn("doc", F.col("doc") - 1000))
        plan = other.select("key").join(run.hint("merge").select("key"), "key", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    assert other.filter("fresh").count() == 0 and run.filter("fresh").count() == 300


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_store.default_tokenizer())
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    out = token_store.query(spark, docs).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, out.collect()), key=lambda r: r[1]) == want
    assert token_store.query(spark, empty).count() == 0
    small = token_store.read_files(token_store.write_files(docs, file_tokens=300)).collect()
    assert sorted((r["start"], r["ids_crc32"]) for r in small) == [(w[1], w[3]) for w in want]


def test_token_files_with_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    from textgraph.llm.queries import queries

    t = Tokenizer.from_file(token_store.default_tokenizer())
    r = np.random.default_rng(8)
    texts = ["a <|endoftext|> b", "<|endoftext|>", *TEXTS.values()] + ["".join(r.choice(["<|endoftext|>", " ", "\n", "word", "<|", "1", "é"], 12)) for _ in range(100)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, start = [], 0
    for d, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    out = queries()["op9_addressable_token_files"](spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, out.collect())) == want


def test_token_file_access():
    ids = np.random.default_rng(2).integers(0, 1 << 20, 5000).astype(np.uint32)
    ids[::3] %= 256
    file = token_store.TokenFile(token_store.pack([4, None, 9], np.array([0, 0, 1700, 5000]), ids))
    assert [file.token(i) for i in range(0, 5000, 7)] == ids[::7].tolist()
    assert file.doc_ids == [4, None, 9] and len(file.ids(0)) == 0
    assert (file.ids(1) == ids[:1700]).all() and (file.ids(2) == ids[1700:]).all()


def test_decontamination(spark, docs, empty):
    part = tokens(TEXTS[8])[100:140]
    mixed = [*part[:36], "other", "words", "end", "here"]
    items = [(1, " ".join(part)), (2, " ".join(part).upper()), (3, " ".join(mixed)), (4, "one TWO"), (5, None), (6, ""), (7, prose(555, 30)), (8, " ".join([*part[:20], *prose(3, 20).split()])), (1, " ".join(part))]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, words string")
    sets, own = defaultdict(set), defaultdict(set)
    for i, t in items:
        sets[i] |= shingles(t)
    for r in docs.collect():
        if r["doc_id"] is not None:
            own[r["doc_id"]] |= shingles(r["text"])
    want = sorted((d, i, len(s & v), len(v)) for d, s in own.items() for i, v in sets.items() if v and 100 * len(s & v) >= 80 * len(v))
    found = decontamination.query(spark, docs, bench).select("doc_id", "item_id", "n_shared", "n_item")
    assert sorted(map(tuple, found.collect())) == want and {(8, 1), (9, 2), (8, 3), (3, 4)} <= {w[:2] for w in want}
    assert decontamination.query(spark, empty, bench).count() == 0 and decontamination.query(spark, docs, bench.limit(0)).count() == 0
    clean = decontamination.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == docs.filter("doc_id is null or doc_id not in (3, 4, 8, 9)").count()


def test_toxicity_marks_found_as_defined():
    texts = [None, "", "Straße_été 3x ΣΑΣ’Σ İstanbul naïve½ª ²x日本 語_aͅb", "a-b idiots\x85idiotic IDIO Kelvin", "x" * 50_000 + " idiot", "idiot " * 20_000]
    shown = lambda t: {m for w in set(toxicity.WORD.findall((t or "").lower())) for m in toxicity.marks(w)}
    wanted = sorted({m for t in texts for m in shown(t)})
    for own in (wanted, wanted[::2], []):
        find = toxicity.Finder(own)
        for text in texts * 2:
            assert {own[k] for k in find(text)} == shown(text) & set(own)


def test_sentencepiece_merges_few_words_at_once(monkeypatch):
    """However many new words a batch brings, what lies in memory beside their ids is bounded; ids are 32-bit numbers."""
    own = sentencepiece_codec.Codec(sentencepiece_codec._read(sentencepiece_codec.default_model()))
    sizes, rounds = [], own._rounds
    monkeypatch.setattr(own, "_rounds", lambda words: sizes.append(len(words)) or rounds(words))
    texts = [" ".join(f"w{k}x{k * k}é" for k in range(n, n + 5000)) for n in range(0, 25000, 5000)]
    found = list(own.encode(texts))
    assert sum(sizes) == 25000 and max(sizes) <= 10_000
    assert all(len(ids) % 4 == 0 and isinstance(ids, bytes) for ids in own.known.values())
    assert [own.decode(ids) for ids in found] == texts


def test_language_model_joins_counts_of_words_of_several_chunks(spark, monkeypatch):
    """Words of one chunk alone keep its count; a word that other chunks train on is known where it is held out."""
    monkeypatch.setattr(language_model, "CHUNK_TOKENS", 1)
    monkeypatch.setattr(language_model.chunks, "__defaults__", (1,))
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0)
    train = [k for k in range(100) if zlib.crc32(str(k).encode()) % 10][:3]
    df = spark.createDataFrame([(train[0], "alpha beta"), (train[1], "alpha gamma"), (train[2], "delta"), (held, "alpha beta omega")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_model.scores(df).collect()}
    count, total = {"alpha": 2, "beta": 1, "gamma": 1, "delta": 1}, 8
    for k, text in df.collect():
        z = np.log10(total + 0.1 * 6)
        base = sum(np.log10(count.get(w, 0) + 0.1) - z for w in text.split()) + np.log10(3 + 0.1) - z
        assert abs(got[k]["base_score"] - base) < 1e-9
        assert got[k]["n_known"] == sum(w in count for w in text.split()) + 1 and got[k]["train_tokens"] == total
    table = language_model.chunks(df)
    assert dict(table.dtypes)["n_train"] == "array<int>"
