"""The pipeline on a small corpus, stage by stage against brute force."""

import hashlib

import numpy as np
import pytest
from test_operators import LINE, WORDS, brute_components, lower, prose, shingles, tokens

import corpus_pipeline
from textgraph.llm import sentencepiece_codec

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_dropped string"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    r = np.random.default_rng(1)
    item = prose(321, 40)
    texts = []
    for k in range(300):
        w = [f"{WORDS[i]}{r.integers(0, 60)}" for i in r.integers(0, len(WORDS), 60)]
        if k % 10 == 0:
            w[int(r.integers(0, 60))] = "vilest"
        text = " ".join(w)
        if k % 10 in (1, 2):
            text += f"\n{LINE}\nend {k}"
        if k % 50 == 3:
            text += f"\n{item}"
        texts.append(text)
    texts += [texts[4], texts[4], texts[5].replace(" ", "  ") + " more", None, ""]
    rows = [(k, t, "en", f"s{k % 3}", len(t) if t else 0, "x") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(300)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item), (2, prose(99, 30))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def as_dict(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(spark, sf_dir):
    import sentencepiece

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    docs = corpus_pipeline.documents(spark, sf_dir)
    seen = [as_dict(docs)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, sf_dir), f"test-{name}")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = out
        seen.append(as_dict(docs))
    start, clean, lines, near, apart = seen
    toxic = {d for d in start if d < 300 and d % 10 == 0}
    assert len((set(start) - set(clean)) ^ toxic) <= 1
    key = lambda x: lower(x.strip())
    holders = [d for d, t in clean.items() if LINE in (t or "")]
    assert set(lines) == set(clean)
    for d, t in clean.items():
        kept = [x for x in (t or "").split("\n") if not (key(x) == key(LINE) and d != max(holders)) and not (x == prose(321, 40) and d != max(e for e, u in clean.items() if prose(321, 40) in (u or "")))]
        assert (lines[d] or "") == "\n".join(kept)
    n_chars = {r["doc_id"]: r["n_chars"] for r in docs.collect()}
    assert all(n_chars[d] == len(apart[d] or "") for d in apart)
    groups = brute_components(list(lines.items()))
    assert set(near) == {d for d, _, c in groups if d == c} and len(near) < len(lines)
    bench = [shingles(prose(321, 40)), shingles(prose(99, 30))]
    leak = {d for d, t in near.items() if any(100 * len(shingles(t) & b) >= 80 * len(b) for b in bench)}
    assert leak and set(apart) == set(near) - leak
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    last = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()}
    assert set(last) == set(apart)
    for d, t in apart.items():
        assert last[d]["ids_sha256"] == hashlib.sha256(",".join(map(str, library.encode(t or ""))).encode()).hexdigest()


def test_run_and_empty(spark, sf_dir, tmp_path):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_edges(spark, sf_dir, tmp_path):
    """Null ids, repeated rows, columns with the names of helpers, very long texts: each stage by its definition."""
    long = prose(7, 30_000)
    clean = [(k, prose(1000 + k, 40)) for k in range(40)]
    rows = [*clean, (50, long), (51, f"{long} {prose(8, 20)}"), (52, "w" * 200_000), (None, prose(60, 50)), (None, prose(60, 50)), (None, None), (None, prose(321, 40)), (53, prose(61, 50)), (53, prose(61, 50)), (54, f"{prose(62, 30)} {prose(321, 40)}"), (55, "")]
    rows += [(60 + k, f"{prose(70 + k, 30)}\n{LINE}") for k in range(6)]
    more = "near_mark string, drop_keys string, held_lines string, n_dropped string, p__text string, gone_id string, score double, marks string, hash string"
    df = spark.createDataFrame([(*r, "en", "s", len(r[1] or ""), *("abcdef"), 0.5, "m", "h") for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {more}")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").filter("true" if t == "benchmark" else "toxic = 0").write.parquet(f"{tmp_path}/{t}.parquet")
    docs = corpus_pipeline.documents(spark, str(tmp_path))
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), f"edge-{name}")
        assert out.dtypes == docs.dtypes
        docs = out
        seen.append([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(seen[0], key=repr) == sorted(rows, key=repr)  # nothing is labelled toxic
    lines = [(d, t.replace(f"\n{LINE}", "") if t and d is not None and 60 <= d < 65 else t) for d, t in rows]
    assert sorted(seen[1], key=repr) == sorted(lines, key=repr)
    once = [r for r in lines if r[0] != 51]
    once.remove((None, prose(60, 50)))
    once.remove((53, prose(61, 50)))
    assert sorted(seen[2], key=repr) == sorted(once, key=repr)
    assert sorted(seen[3], key=repr) == sorted([r for r in once if r[0] != 54], key=repr)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(seen[3])
