"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import functions as fn
from .operators import artifacts as art
from .operators import collections as coll
from .operators import extraction as ext
from .operators import graph, history, lookups, overlay, search
from .operators.ancestry import labelled
from .plans.model import Model, with_tables
from .sources import books, code, exports
from .streaming import reindex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *tables: str):
    """Registers a function of a Model as a query, with its SQL over the model's tables."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Model(spark, sf_dir))
        if sql:
            SQL[f.__name__] = with_tables(sql, *tables) if tables else sql
        return f

    return add


# lookups and counts


@query("SELECT c.id, c.kind, coalesce(n, 0) AS chunks_count, coalesce(e, 0) AS entities_count, coalesce(d, 0) AS edges_count FROM corpora c LEFT JOIN (SELECT corpus_id, count(*) n FROM chunks GROUP BY 1) x ON x.corpus_id = c.id LEFT JOIN (SELECT corpus_id, count(*) e FROM plain_entities GROUP BY 1) y ON y.corpus_id = c.id LEFT JOIN (SELECT corpus_id, count(*) d FROM edges GROUP BY 1) z ON z.corpus_id = c.id", "corpora", "chunks", "plain_entities", "edges")
def corpus_list(m):
    return lookups.counts(m.corpora, chunks=m.chunks, entities=m.plain_entities, edges=m.edges)


@query("SELECT id, canonical_name, appearance_count FROM entities ORDER BY appearance_count DESC, id LIMIT 10", "entities")
def corpus_overview_top_entities(m):
    return lookups.top_entities(m.entities).select("id", "canonical_name", "appearance_count")


@query("SELECT * FROM taxonomy UNION ALL SELECT DISTINCT lower(p_type), 'catalog', 'product' FROM part", "taxonomy")
def taxonomy_list(m):
    """The fixed rows, and a corpus kind of its own for the types of parts."""
    return lookups.taxonomy(m.taxonomy.union(m.part_kinds))


_ABSTRACT = "SELECT e.*, coalesce(t.abstract_kind, '') AS abstract_kind FROM entities e LEFT JOIN corpora c ON c.id = e.corpus_id LEFT JOIN taxonomy t ON t.concrete_kind = e.kind AND t.corpus_kind = c.kind"


@query(f"SELECT id, abstract_kind FROM ({_ABSTRACT})", "entities", "corpora", "taxonomy")
def abstract_kind_resolution(m):
    return lookups.with_abstract_kind(m.entities, m.corpora, m.taxonomy).select("id", "abstract_kind")


@query(f"SELECT id, canonical_name, appearance_count FROM ({_ABSTRACT}) WHERE abstract_kind = 'component' AND corpus_id IN ('star', 'web') ORDER BY appearance_count DESC, id LIMIT 50", "entities", "corpora", "taxonomy")
def entities_by_abstract_kind(m):
    found = lookups.of_abstract_kind(lookups.with_abstract_kind(m.entities, m.corpora, m.taxonomy), "component", ["star", "web"])
    return found.select("id", "canonical_name", "appearance_count")


@query("SELECT id, canonical_name, appearance_count FROM entities WHERE contains(lower(canonical_name), 'blue') ORDER BY appearance_count DESC, id LIMIT 20", "entities")
def entity_find_by_name(m):
    return lookups.entities_named(m.entities, "Blue").select("id", "canonical_name", "appearance_count")


_STATUS = "WITH q(name) AS (VALUES ('red widget'), ('Supplier#000000001'), ('no such thing'), ('nation_7')), h AS (SELECT q.name, count(e.id) AS n FROM q LEFT JOIN plain_entities e ON lower(e.canonical_name) = lower(q.name) GROUP BY 1) SELECT name, n AS matches, CASE WHEN n = 0 THEN 'not_found' WHEN n = 1 THEN 'ok' ELSE 'ambiguous' END AS status FROM h"


@query(_STATUS, "plain_entities")
def entity_status(m):
    q = m.spark.sql("SELECT * FROM VALUES ('red widget'), ('Supplier#000000001'), ('no such thing'), ('nation_7') AS t(name)")
    n = F.count("id").alias("matches")
    hits = q.join(m.plain_entities, F.lower("canonical_name") == F.lower("name"), "left").groupBy("name").agg(n)
    return hits.withColumn("status", F.when(F.col("matches") == 0, "not_found").when(F.col("matches") == 1, "ok").otherwise("ambiguous"))


@query("SELECT id, doc_id FROM chunks WHERE corpus_id = 'src3'", "chunks")
def chunks_of_corpus(m):
    return lookups.chunks_of(m.chunks, "src3").select("id", "doc_id")


@query("SELECT id, min(doc_id) AS doc_id FROM chunks GROUP BY id", "chunks")
def chunk_dedup_first_wins(m):
    return lookups.first_content(m.chunks.drop("content"), "doc_id").select("id", "doc_id")


@query("SELECT corpus_id, id, min(doc_id) AS doc_id FROM chunks GROUP BY ALL", "chunks")
def chunk_dedup_in_corpus(m):
    return lookups.first_content(m.chunks.drop("content"), "doc_id", "corpus").select("corpus_id", "id", "doc_id")


@query("SELECT user_id, arg_min(event_type, event_id) AS canonical_name, count(*) AS appearance_count, max(value) AS confidence FROM events GROUP BY user_id")
def entity_upsert_merge(m):
    e = m.raw("events")
    rows = e.select(F.col("user_id").alias("id"), F.lit("log").alias("corpus_id"), F.col("event_type").alias("canonical_name"), F.lit("user").alias("kind"), F.lit(None).cast("string").alias("first_location_uri"), F.lit(None).cast("string").alias("last_location_uri"), F.lit(None).cast("string").alias("description"), F.lit(1).alias("appearance_count"), F.col("value").alias("confidence"), F.array().cast("array<string>").alias("aliases"), "event_id")
    return lookups.merge_repeated(rows, "event_id").select(F.col("id").alias("user_id"), "canonical_name", "appearance_count", "confidence")


@query("SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS started_at, event_type AS pass FROM events ORDER BY 2 DESC, 1 DESC LIMIT 20")
def run_log_latest(m):
    runs = m.raw("events").select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("started_at"), F.col("event_type").alias("pass"))
    return lookups.latest_runs(runs)


@query("SELECT event_type AS pass, sum((props::JSON ->> 'k')::BIGINT) AS processed FROM events GROUP BY 1")
def run_totals(m):
    runs = m.raw("events").select(F.col("event_type").alias("pass"), F.regexp_replace("props", '"k"', '"processed"').alias("stats"))
    return lookups.run_totals(runs).select("pass", "processed")


@query("SELECT event_id AS id, CASE WHEN event_type = 'view' THEN 'failed' ELSE event_type END AS status FROM events")
def run_log_stale(m):
    return lookups.stale_as_failed(m.raw("events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", "running").otherwise(F.col("event_type")).alias("status")))


# graph


@query("SELECT e.id FROM plain_entities e WHERE NOT EXISTS (SELECT 1 FROM edges x WHERE x.kind = 'contains' AND x.to_entity_id = e.id)", "plain_entities", "edges")
def unreachable(m):
    return graph.unreached(m.plain_entities, m.edges, "contains").select("id")


@query("SELECT e.id FROM plain_entities e WHERE NOT EXISTS (SELECT 1 FROM edges x WHERE x.kind = 'verified_by' AND x.to_entity_id = e.id)", "plain_entities", "edges")
def untested(m):
    return graph.unreached(m.plain_entities, m.edges, "verified_by").select("id")


@query("SELECT id, kind FROM edges WHERE from_entity_id IN (SELECT id FROM plain_entities) AND to_entity_id IN (SELECT id FROM plain_entities WHERE kind <> 'module')", "edges", "plain_entities")
def edge_guard_semi(m):
    return m.guarded_edges(without=("nation",)).select("id", "kind")  # nations are the modules


@query("SELECT e.id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM plain_entities e LEFT JOIN (SELECT to_entity_id AS id, count(*) n FROM edges GROUP BY 1) i ON i.id = e.id LEFT JOIN (SELECT from_entity_id AS id, count(*) n FROM edges GROUP BY 1) o ON o.id = e.id", "plain_entities", "edges")
def in_out_degree(m):
    return graph.degrees(m.plain_entities.select("id"), m.edges)


@query("SELECT id, kind, from_entity_id, to_entity_id FROM edges WHERE from_entity_id = 'supplier:3' OR to_entity_id = 'supplier:3' ORDER BY id LIMIT 50", "edges")
def entity_edges_both(m):
    return lookups.edges_of(m.edges, "supplier:3").select("id", "kind", "from_entity_id", "to_entity_id")


@query("SELECT id, kind FROM edges WHERE to_entity_id = 'nation:4' AND kind = 'located_in' ORDER BY id LIMIT 50", "edges")
def entity_edges_inbound_kind(m):
    return lookups.edges_of(m.edges, "nation:4", "inbound", "located_in").select("id", "kind")


@query("SELECT location_uri FROM edges WHERE from_entity_id = 'supplier:1' OR to_entity_id = 'supplier:1' INTERSECT SELECT location_uri FROM edges WHERE from_entity_id = 'supplier:2' OR to_entity_id = 'supplier:2'", "edges")
def entity_meet(m):
    return graph.meet(m.edges, ["supplier:1"], ["supplier:2"])


_RELATED = """WITH p AS (SELECT location_uri, from_entity_id AS e FROM edges UNION SELECT location_uri, to_entity_id FROM edges), t AS (SELECT e FROM p WHERE location_uri = 'text://star/order/7'),
o AS (SELECT location_uri, count(*) AS k FROM p WHERE e IN (SELECT e FROM t) AND location_uri <> 'text://star/order/7' GROUP BY 1), n AS (SELECT location_uri, count(*) AS n FROM p GROUP BY 1)
SELECT location_uri, round(k / (n + (SELECT count(*) FROM t) - k), 6) AS jaccard, 'shared_entities' AS relationship FROM o JOIN n USING (location_uri) ORDER BY jaccard DESC, location_uri LIMIT 10"""


@query(_RELATED, "edges")
def related_jaccard(m):
    return graph.related(m.edges, "text://star/order/7")


@query("SELECT DISTINCT location_uri, entity_id FROM (SELECT location_uri, from_entity_id AS entity_id FROM edges UNION SELECT location_uri, to_entity_id FROM edges) WHERE location_uri LIKE 'text://star/supplier/%'", "edges")
def entities_at_location(m):
    return graph.ends(m.edges).filter(F.col("location_uri").startswith("text://star/supplier/"))


_WALK = """WITH RECURSIVE s AS (SELECT from_entity_id AS id, to_entity_id AS nxt FROM (SELECT *, row_number() OVER (PARTITION BY from_entity_id ORDER BY id) AS k FROM edges WHERE kind IN ('placed', 'contains', 'verified_by', 'supplied_by', 'located_in')) WHERE k <= 50),
w AS (SELECT 'customer:5' AS id, 0 AS depth UNION SELECT s.nxt, w.depth + 1 FROM w JOIN s ON s.id = w.id WHERE w.depth < 3)
SELECT id, min(depth) AS depth FROM w GROUP BY id"""


@query(_WALK, "edges")
def explain_bfs_depth(m):
    seeds = m.spark.sql("SELECT 'customer:5' AS id")
    return graph.walk(m.edges, seeds, ["placed", "contains", "verified_by", "supplied_by", "located_in"]).select("id", "depth")


_SAME = """WITH RECURSIVE l AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM (SELECT doc_id, sha256(text) AS h FROM documents) a JOIN (SELECT doc_id, sha256(text) AS h FROM documents) b ON a.h = b.h AND a.doc_id <> b.doc_id),
r AS (SELECT a AS node, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node) SELECT node, min(root) AS label FROM r GROUP BY node"""


@query(_SAME)
def same_as_components(m):
    rows = m.chunks.select("id", "doc_id")
    first = rows.groupBy("id").agg(F.min("doc_id").alias("a"))
    return graph.components(rows.join(first, "id").filter("a <> doc_id").select("a", F.col("doc_id").alias("b")))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN (SELECT event_type FROM events WHERE value > 480) GROUP BY 1")
def set_difference(m):
    e = m.raw("events")
    keep = e.select("event_type").distinct().subtract(e.filter("value > 480").select("event_type"))
    return e.join(keep, "event_type", "left_semi").groupBy("event_type").agg(F.count("*").alias("n"))


_COMMITS = "SELECT 'c' || n_nationkey AS id, CASE WHEN n_nationkey > 0 THEN 'c' || (n_nationkey - 1) END AS parent FROM nation"


def _commits(m):
    k = F.col("n_nationkey")
    return m.raw("nation").select(F.concat(F.lit("c"), k).alias("id"), F.when(k > 0, F.concat(F.lit("c"), k - 1)).alias("parent"))


@query("SELECT 'c' || a.n_nationkey AS ancestor, 'c' || b.n_nationkey AS descendant FROM nation a JOIN nation b ON a.n_nationkey <= b.n_nationkey")
def commit_ancestry(m):
    return graph.ancestry(_commits(m))


@query("SELECT 'k' || c_custkey AS id, c_custkey - (SELECT min(c_custkey) FROM customer) AS position FROM customer WHERE c_custkey <= 140")
def first_parent_chain(m):
    k = F.col("c_custkey")
    customers = m.raw("customer")
    root = customers.agg(F.min(k)).first()[0]
    commits = customers.select(F.concat(F.lit("k"), k).alias("id"), F.when(k > root, F.concat(F.lit("k"), k - 1)).alias("parent"))
    return graph.first_parent_chain(commits, "k140").select("id", F.col("position").cast("long").alias("position"))


_KEPT = "CASE WHEN {0} LIKE 'supplier:%' THEN 'supplier:' || (replace({0}, 'supplier:', '')::BIGINT - replace({0}, 'supplier:', '')::BIGINT % 2) ELSE {0} END"


def _pairs_of_suppliers(m):
    k = F.col("s_suppkey")
    return m.raw("supplier").filter(k % 2 == 1).select(F.concat(F.lit("supplier:"), k).alias("absorbed"), F.concat(F.lit("supplier:"), k - 1).alias("canonical"))


@query(f"SELECT id, {_KEPT.format('from_entity_id')} AS from_entity_id, {_KEPT.format('to_entity_id')} AS to_entity_id FROM edges", "edges")
def entity_merge_edges(m):
    return graph.merged_edges(m.edges, _pairs_of_suppliers(m)).select("id", "from_entity_id", "to_entity_id")


@query(f"SELECT e.id, g.n AS appearance_count FROM (SELECT {_KEPT.format('id')} AS id, sum(appearance_count)::BIGINT AS n FROM entities GROUP BY 1) g JOIN entities e USING (id)", "entities")
def entity_merge_counts(m):
    return graph.merged_entities(m.entities, _pairs_of_suppliers(m)).select("id", "appearance_count")


# artifacts


@query("SELECT entity_id, model, generated_at FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY tier_rank DESC, generated_at DESC, model DESC) AS k FROM artifacts) WHERE k = 1", "artifacts")
def best_tier_artifact(m):
    return art.best_of(m.artifacts, ["entity_id"]).select("entity_id", "model", "generated_at")


_TIES = "WITH r AS (SELECT *, max(tier_rank) OVER (PARTITION BY entity_id) AS top FROM contracts), b AS (SELECT *, max(CASE WHEN tier_rank = top THEN generated_at END) OVER (PARTITION BY entity_id) AS latest FROM r), best AS (SELECT * FROM b WHERE generated_at = latest)"


@query(f"{_TIES} SELECT entity_id, model, event_id FROM best", "contracts")
def best_per_entity_ties(m):
    return art.best_with_ties(m.contracts, "entity_id").select("entity_id", "model", "event_id")


@query(f"{_TIES} SELECT entity_id, model FROM best WHERE is_incomplete OR intent_gap IS NOT NULL OR (NOT is_fallible AND len(risks) > 0)", "contracts")
def inconsistencies(m):
    return art.inconsistencies(m.contracts).select("entity_id", "model")


@query("SELECT model_tier, count(*) AS n FROM artifacts GROUP BY 1", "artifacts")
def tier_distribution(m):
    return art.tier_counts(m.artifacts)


_ROUTER = """WITH d AS (SELECT e.id, e.kind, coalesce(i.n, 0) AS i, coalesce(o.n, 0) AS o FROM plain_entities e LEFT JOIN (SELECT to_entity_id AS id, count(*) n FROM edges GROUP BY 1) i ON i.id = e.id LEFT JOIN (SELECT from_entity_id AS id, count(*) n FROM edges GROUP BY 1) o ON o.id = e.id)
SELECT id, CASE WHEN k % 97 = 5 THEN 'opus' WHEN i > 20 AND k % 3 = 0 THEN 'opus' WHEN k % 2 = 0 AND greatest(k % 9 - 3, 0) > 3 THEN 'opus' WHEN kind = 'module' AND i > 15 THEN 'opus'
  WHEN k % 2 = 0 AND k % 3 = 0 THEN 'sonnet' WHEN k % 5 = 0 AND k % 3 = 0 THEN 'sonnet' WHEN greatest(k % 9 - 3, 0) > 0 THEN 'sonnet' WHEN k % 11 = 0 THEN 'sonnet' WHEN kind IN ('class', 'module') THEN 'sonnet' WHEN i > 10 THEN 'sonnet' WHEN k % 200 > 150 THEN 'sonnet' ELSE 'haiku' END AS tier FROM (SELECT *, split_part(id, ':', 2)::BIGINT AS k FROM d)"""


@query(_ROUTER, "plain_entities", "edges")
def tier_router(m):
    d = graph.degrees(m.plain_entities.select("id", "kind"), m.edges)
    k = F.split_part(F.col("id"), F.lit(":"), F.lit(2)).cast("long")
    # modules have no outbound edges in these tables: their inbound ones stand in
    signals = [k % 97 == 5, k % 3 == 0, k % 2 == 0, k % 5 == 0, F.greatest(k % 9 - 3, F.lit(0)), k % 11 == 0, F.col("in_degree"), F.col("in_degree"), F.col("kind"), k % 200]
    return d.select("id", art.routed_tier(*signals).alias("tier"))


@query("SELECT first_uri AS uri, sha256(string_agg(id, chr(10) ORDER BY id) || chr(10)) AS shape FROM (SELECT DISTINCT location_uri AS first_uri, to_entity_id AS id FROM edges) GROUP BY 1", "edges")
def file_shape_hash(m):
    return art.file_shapes(m.edges.select(F.col("to_entity_id").alias("id"), F.col("location_uri").alias("first_location_uri")))


@query("SELECT 'conv/' || conv_id AS source, sha256(string_agg(text, '' ORDER BY turn, text)) AS hash FROM conversations GROUP BY 1")
def source_hash(m):
    rows = m.raw("conversations").select(F.concat(F.lit("conv/"), "conv_id").alias("source"), "turn", F.col("text").alias("content"))
    return art.source_hashes(rows, "source", "turn")


@query("SELECT 'v1-tree:' || sha256(string_agg(url || chr(0) || sha256(html) || chr(10), '' ORDER BY url || chr(0) || sha256(html) || chr(10))) AS version FROM pages")
def tree_version(m):
    return art.tree_version(m.raw("pages").select(F.col("url").alias("path"), F.sha2("html", 256).alias("hash")))


_THEMES = "SELECT t.id, t.confidence, e.edge_kind, e.from_entity_id FROM (SELECT 'nation:' || n_nationkey AS id, n_nationkey / 100.0::DOUBLE AS confidence FROM nation) t LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY to_entity_id, edge_kind ORDER BY id) AS k FROM (SELECT id, to_entity_id, from_entity_id, CASE WHEN from_entity_id LIKE 'customer:%' THEN 'upheld_by' ELSE 'violated_by' END AS edge_kind FROM edges)) e ON e.to_entity_id = t.id AND e.k <= 200"


@query(_THEMES, "edges")
def theme_edges_topn(m):
    themes = m.raw("nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"), (F.col("n_nationkey") / F.lit(100.0)).alias("confidence"))
    edges = m.edges.withColumn("kind", F.when(F.col("from_entity_id").startswith("customer:"), "upheld_by").otherwise("violated_by"))
    return art.themes_with_edges(themes, edges).select("id", "confidence", "edge_kind", "from_entity_id")


# search


def _bm25_term(k: int) -> str:
    return f"greatest(ln((n - df{k} + 0.5) / (df{k} + 0.5)), 1e-6) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * dl / avgdl))"


def _bm25(terms: list[str], joined: str) -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}'))::DOUBLE AS tf{k}" for k, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (WHERE tf{k} > 0)::DOUBLE AS df{k}" for k in range(len(terms)))
    score = " + ".join(map(_bm25_term, range(len(terms))))
    hit = joined.join(f" tf{k} > 0 " for k in range(len(terms)))
    return f"w AS (SELECT location_uri, list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM chunks), r AS (SELECT location_uri, len(w)::DOUBLE AS dl, {tf} FROM w), s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, {df} FROM r), k AS (SELECT location_uri AS uri, round({score}, 6) AS score FROM r, s WHERE {hit})"


_NORMAL = "round(CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1 END, 6) AS relevance"


@query(f"WITH {_bm25(['the', 'and'], 'AND')}, t AS (SELECT * FROM k ORDER BY score DESC, uri LIMIT 20) SELECT uri, score, {_NORMAL} FROM t", "chunks")
def keyword_search_bm25(m):
    return search.keyword(m.chunks, "The, and!")


@query(f"WITH {_bm25(['trash', 'license', 'stupid'], 'OR')}, t AS (SELECT * FROM k ORDER BY score DESC, uri LIMIT 30), u AS (SELECT uri, score, {_NORMAL} FROM t) SELECT * FROM u WHERE uri <= 'text://src5'", "chunks")
def keyword_search_scoped(m):
    return search.keyword(m.chunks, "trash OR license OR stupid", 30, "text://src5")


_MIXED = _bm25(["trash", "stupid", "the", "license"], "OR").replace("WHERE  tf0 > 0 OR tf1 > 0 OR tf2 > 0 OR tf3 > 0 ", "WHERE (tf0 > 0 AND NOT tf3 > 0) OR (tf1 > 0 AND tf2 > 0)").replace(f" + {_bm25_term(3)}", "")


@query(f"WITH {_MIXED}, t AS (SELECT * FROM k ORDER BY score DESC, uri LIMIT 40) SELECT uri, score, {_NORMAL} FROM t", "chunks")
def keyword_search_mixed(m):
    return search.keyword(m.chunks, "trash NOT license OR stupid AND the", 40)


@query(f"WITH {_bm25(['the', 'and'], 'AND')}, t AS (SELECT * FROM k ORDER BY score DESC, uri LIMIT 20) SELECT uri, score, {_NORMAL} FROM t", "chunks")
def keyword_search_postings(m):
    """As keyword_search_bm25, from a search index that is built once for the tables in a session."""
    return m.postings.keyword("The, and!")


_COS = "round(greatest(0, least(1, list_cosine_similarity(e.embedding::DOUBLE[], q.v))), 6)"
_VEC = "'vec/' || lpad(vec_id::VARCHAR, 8, '0')"


@query(f"WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) SELECT {_VEC} AS uri, {_COS} AS score FROM embeddings e, q ORDER BY score DESC, uri LIMIT 20")
def semantic_search(m):
    return search.semantic(m.vectors, m.query_vector())


_HYBRID = f"""WITH {_bm25(['the', 'of'], 'AND')}, t AS (SELECT * FROM k ORDER BY score DESC, uri LIMIT 80), kw AS (SELECT uri, {_NORMAL} FROM t),
q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
sem AS (SELECT uri, score FROM (SELECT c.location_uri AS uri, {_COS} AS score FROM embeddings e JOIN chunks c ON c.doc_id = e.vec_id, q) ORDER BY score DESC, uri LIMIT 80)
SELECT uri, round(0.3 * coalesce(sem.score, 0) + 0.7 * coalesce(relevance, 0), 6) AS score FROM kw FULL JOIN sem USING (uri) ORDER BY score DESC, uri LIMIT 20"""


@query(_HYBRID, "chunks")
def hybrid_search(m):
    vectors = m.raw("embeddings").join(m.chunks.select("doc_id", F.col("location_uri").alias("uri")), F.col("vec_id") == F.col("doc_id")).select("uri", F.col("embedding").alias("vector"))
    return search.hybrid(m.chunks, vectors, "the of", m.query_vector(), alpha=0.3)


_SNIPPET = f"WITH {_bm25(['trash'], 'AND')}, t AS (SELECT * FROM k ORDER BY score DESC, uri LIMIT 20), x AS (SELECT t.uri, c.content, greatest(instr(lower(c.content), 'trash') - 80, 1) AS a FROM t JOIN chunks c ON c.location_uri = t.uri) SELECT uri, CASE WHEN a > 1 THEN '...' ELSE '' END || substr(content, a, 160) || CASE WHEN a + 160 <= length(content) THEN '...' ELSE '' END AS snippet FROM x"


@query(_SNIPPET, "chunks")
def snippet(m):
    hits = search.keyword(m.chunks, "trash")
    return hits.join(m.chunks, hits["uri"] == m.chunks["location_uri"]).select("uri", fn.snippet(F.col("content"), F.lit("trash")).alias("snippet"))


# overlay


_DUPES = "SELECT doc_id::VARCHAR AS absorbed, (min(doc_id) OVER (PARTITION BY sha256(text)))::VARCHAR AS canonical FROM documents"


def _duplicate_docs(m):
    return m.chunks.select(F.col("doc_id").cast("string").alias("id"), F.col("id").alias("hash"), F.lit("book").alias("kind"), F.col("location_uri").alias("canonical_name"), F.array().cast("array<string>").alias("aliases"), F.lit(1).cast("long").alias("appearance_count"), "doc_id")


def _merges(m):
    d = _duplicate_docs(m)
    first = d.groupBy("hash").agg(F.min("doc_id").alias("first"))
    return d.join(first, "hash").filter("doc_id <> first").select(F.col("id").alias("absorbed"), F.col("first").cast("string").alias("canonical"))


@query(f"SELECT canonical AS id, count(*)::BIGINT AS appearance_count FROM ({_DUPES}) GROUP BY 1")
def merge_overlay(m):
    return overlay.apply_merges(_duplicate_docs(m).drop("hash", "doc_id"), _merges(m)).select("id", "appearance_count")


_RENAMES = "WITH e AS (SELECT DISTINCT 'user:' || user_id AS id FROM events), l AS (SELECT 'user:' || user_id AS id, arg_max(event_type || '-' || event_id, (strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), event_id)) AS n FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT e.id, coalesce(l.n, e.id) AS canonical_name FROM e LEFT JOIN l USING (id)"


@query(_RENAMES)
def rename_overlay(m):
    a = m.artifacts
    entities = a.select(F.col("entity_id").alias("id"), F.col("entity_id").alias("canonical_name")).distinct()
    renames = a.filter("event_type = 'signup'").select(F.col("event_id").alias("id"), F.col("generated_at").alias("applied_at"), "entity_id", F.concat_ws("-", "event_type", "event_id").alias("new_name"))
    return overlay.apply_renames(entities, renames)


@query("WITH s AS (SELECT doc_id, text FROM documents), x AS (SELECT user_id AS doc_id, arg_max(event_type, event_id) AS t FROM events GROUP BY 1) SELECT coalesce(s.doc_id, x.doc_id) AS doc_id, coalesce(x.t, sha256(s.text)) AS text FROM s FULL JOIN x USING (doc_id)")
def summary_override(m):
    kind = F.lit("chunk").alias("target_kind")
    summaries = m.chunks.select(kind, F.col("doc_id").alias("target_id"), F.col("id").alias("text"), F.lit("2024").alias("generated_at"))
    edits = m.raw("events").select(kind, F.col("user_id").alias("target_id"), F.col("event_type").alias("text"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("applied_at"), F.col("event_id").alias("id"))
    return overlay.overridden(summaries, edits).select(F.col("target_id").alias("doc_id"), "text")


# collections


def _members(m):
    n = m.raw("nation").select(F.concat(F.lit("region:"), "n_regionkey").alias("collection_id"), F.concat(F.lit("nation:"), "n_nationkey").alias("member_id"), F.lit("corpus").alias("member_type"))
    r = m.raw("region").select(F.lit("world").alias("collection_id"), F.concat(F.lit("region:"), "r_regionkey").alias("member_id"), F.lit("collection").alias("member_type"))
    back = m.raw("region").filter("r_regionkey = 2").select(F.lit("region:2").alias("collection_id"), F.lit("world").alias("member_id"), F.lit("collection").alias("member_type"))
    return n.union(r).union(back)


@query("SELECT 'nation:' || n_nationkey AS corpus_id, row_number() OVER (ORDER BY 'region:' || n_regionkey, 'nation:' || n_nationkey) - 1 AS position FROM nation")
def collection_resolve_corpora(m):
    return coll.resolved(_members(m), "world").select("corpus_id", F.col("position").cast("long").alias("position"))


def _links(m):
    k = F.col("p_partkey")
    # classes of three
    s = m.raw("part").filter(F.expr("p_partkey div 10 % 3 < 2")).select(F.concat(F.lit("part:"), k).alias("a"), F.concat(F.lit("part:"), k + 10).alias("b"), F.lit("same_as").alias("link_kind"))
    i = m.raw("part").filter(k % 4 == 0).select(F.concat(F.lit("part:"), k).alias("a"), F.concat(F.lit("part:"), k + 1).alias("b"), F.lit("implements").alias("link_kind"))
    return s.union(i)


_LINKS = "SELECT 'part:' || p_partkey AS a, 'part:' || (p_partkey + 10) AS b, 'same_as' AS link_kind FROM part WHERE p_partkey // 10 % 3 < 2 UNION ALL SELECT 'part:' || p_partkey, 'part:' || (p_partkey + 1), 'implements' FROM part WHERE p_partkey % 4 = 0"


@query(f"SELECT count(DISTINCT n_nationkey) AS corpora, count(c_custkey) AS customer_count, (SELECT to_json(map_from_entries(list((link_kind, n) ORDER BY link_kind)))::VARCHAR FROM (SELECT link_kind, count(*) AS n FROM ({_LINKS}) GROUP BY 1)) AS links FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey")
def collection_overview(m):
    counts = m.raw("nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"))
    customers = m.raw("customer").select(F.concat(F.lit("nation:"), "c_nationkey").alias("corpus_id"))
    return coll.overview(_members(m), lookups.counts(counts, customer=customers), _links(m), "world")


_CLASS = f"WITH RECURSIVE l AS ({_LINKS}), u AS (SELECT a, b FROM l WHERE link_kind = 'same_as' UNION SELECT b, a FROM l WHERE link_kind = 'same_as'), r AS (SELECT a AS node, a AS m FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.m)"


@query(f"{_CLASS} SELECT e.id, array_to_string(list_sort(list_filter(coalesce((SELECT list(DISTINCT m) FROM r WHERE r.node = e.id), []), lambda x: x <> e.id)), ',') AS same_as, array_to_string(coalesce((SELECT list_sort(list('implements:' || b)) FROM l WHERE a = e.id AND link_kind = 'implements'), []), ',') AS related FROM plain_entities e WHERE contains(lower(canonical_name), 'widget') AND e.kind = 'function' AND e.id NOT IN (SELECT b FROM l WHERE link_kind = 'implements' AND a IN (SELECT id FROM plain_entities WHERE contains(lower(canonical_name), 'widget')))", "plain_entities")
def collection_entity_resolve(m):
    named = m.plain_entities.filter(F.lower("canonical_name").contains("widget") & (F.col("kind") == "function")).select("id")
    out = coll.resolve_entity(named, _links(m))
    return out.select("id", F.array_join("same_as", ",").alias("same_as"), F.array_join("related", ",").alias("related"))


@query(f"{_CLASS}, s1 AS (SELECT m FROM r WHERE node = 'part:1' UNION SELECT 'part:1'), s2 AS (SELECT m FROM r WHERE node = 'part:2' UNION SELECT 'part:2') SELECT location_uri FROM edges WHERE from_entity_id IN (FROM s1) OR to_entity_id IN (FROM s1) INTERSECT SELECT location_uri FROM edges WHERE from_entity_id IN (FROM s2) OR to_entity_id IN (FROM s2)", "edges")
def collection_entity_meet(m):
    one = lambda k: m.spark.sql(f"SELECT 'part:{k}' AS id")
    return coll.meet_across(m.edges, one(1), one(2), _links(m))


_CAND = "WITH a AS (SELECT 'supplier:' || s_suppkey AS id, lower(replace(s_name, '#', '')) AS n FROM supplier), b AS (SELECT 'customer:' || c_custkey AS id, lower(replace(replace(c_name, 'Customer', 'Supplier'), '#', '')) AS n FROM customer) SELECT a.id AS id_a, b.id AS id_b, CASE WHEN a.n = b.n THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM a, b WHERE levenshtein(a.n, b.n) <= 2"


@query(_CAND)
def link_candidates(m):
    a = m.raw("supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"), F.col("s_name").alias("canonical_name"), F.lit("process").alias("abstract_kind"))
    b = m.raw("customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("id"), F.regexp_replace("c_name", "Customer", "Supplier").alias("canonical_name"), F.lit("process").alias("abstract_kind"))
    return coll.link_candidates(a, b)


# history


def _versions(m):
    a = m.artifacts
    own = Window.partitionBy("entity_id", "model").orderBy("generated_at", "event_id")
    return a.select("entity_id", "model", "event_id", "value", "generated_at", F.col("day").alias("derived_at_version"), F.lead("generated_at").over(own).alias("superseded_at"), F.lead("day").over(own).alias("next_day"))


_VERSIONS = "SELECT entity_id, model, event_id, value, generated_at, day, lead(generated_at) OVER w AS superseded_at, lead(day) OVER w AS next_day FROM artifacts WINDOW w AS (PARTITION BY entity_id, model ORDER BY generated_at, event_id)"


@query(f"SELECT event_id, superseded_at FROM ({_VERSIONS}) WHERE superseded_at IS NOT NULL AND day <> next_day", "artifacts")
def snapshot_history(m):
    return _versions(m).filter(F.col("superseded_at").isNotNull() & (F.col("derived_at_version") != F.col("next_day"))).select("event_id", "superseded_at")


@query("WITH h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, model ORDER BY event_id) AS k FROM artifacts WHERE day <= '15') WHERE k = 1), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, model ORDER BY event_id) AS k FROM artifacts WHERE day > '15') WHERE k = 1) SELECT h.event_id, n.day AS superseded_at_version FROM h JOIN n USING (entity_id, model) WHERE h.day <> n.day", "artifacts")
def snapshot_on_change(m):
    def one(rows):
        return rows.groupBy("entity_id", "model").agg(F.min_by(F.struct("event_id", F.col("day").alias("derived_at_version")), "event_id").alias("r")).select("entity_id", "model", "r.*")

    a = m.artifacts
    return history.superseded(one(a.filter("day <= '15'")), one(a.filter("day > '15'")), ["entity_id", "model"]).select("event_id", "superseded_at_version")


@query("WITH h AS (SELECT user_id AS id, min(event_id) AS v FROM events WHERE event_type <> 'click' GROUP BY 1), n AS (SELECT user_id AS id, max(event_id) AS v FROM events WHERE event_type = 'click' GROUP BY 1) SELECT id, coalesce(n.v, h.v) AS value FROM h FULL JOIN n USING (id)")
def upsert(m):
    e = m.raw("events")
    version = F.lit("1").alias("derived_at_version")
    head = e.filter("event_type <> 'click'").groupBy(F.col("user_id").alias("id")).agg(F.min("event_id").alias("value")).withColumn("derived_at_version", version)
    new = e.filter("event_type = 'click'").groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("value")).withColumn("derived_at_version", F.lit(None).cast("string"))
    return history.upserted(head, new, ["id"]).select("id", "value")


def _presence(m):
    """Head: the latest version of each (entity, model); history: the others; commits are days; tombstones are error events."""
    v = _versions(m).withColumn("id", F.concat_ws("/", "entity_id", "model")).withColumn("derived_at_sha", F.col("derived_at_version")).withColumn("derived_at_kind", F.lit("concrete"))
    columns = ["id", "event_id", "derived_at_version", "derived_at_sha", "derived_at_kind"]
    head = v.filter("superseded_at is null").select(*columns)
    past = v.filter("superseded_at is not null").select(*columns, "superseded_at")
    dead = m.artifacts.filter("event_type = 'error' and value > 300").select(F.concat_ws("/", "entity_id", F.lit("view")).alias("artifact_id"), F.col("day").alias("derived_at_sha"))
    return head, past, dead


_AT = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, model ORDER BY superseded_at IS NULL DESC, superseded_at DESC) AS k FROM (SELECT * FROM v WHERE day <= '12')) WHERE k = 1"


@query(f"WITH v AS ({_VERSIONS}), p AS ({_AT}) SELECT entity_id || '/' || model AS id, event_id FROM p WHERE NOT (model = 'view' AND entity_id IN (SELECT entity_id FROM artifacts WHERE event_type = 'error' AND value > 300 AND day <= '12'))", "artifacts")
def point_in_time(m):
    """By labels of the days as commits, each after the one before."""
    head, past, dead = _presence(m)
    days = m.artifacts.select(F.col("day").alias("id")).distinct().withColumn("parent", F.lag("id").over(Window.orderBy("id")))
    return history.present_at(head, past, dead, labelled(days), "12", ["id"]).select("id", "event_id")


@query("SELECT DISTINCT entity_id FROM artifacts WHERE entity_id NOT IN (SELECT entity_id FROM artifacts WHERE event_type = 'error' AND value > 250 AND day <= '10')", "artifacts")
def tombstone_filter(m):
    a = m.artifacts
    dead = a.filter("event_type = 'error' and value > 250").select(F.col("entity_id").alias("artifact_id"), F.col("day").alias("derived_at_sha"))
    up = a.select(F.col("day").alias("sha")).distinct().filter("sha <= '10'")
    return history.without_buried(a.select("entity_id").distinct(), dead, up, "entity_id")


_PRUNE = f"WITH h AS (SELECT next_day AS sha, superseded_at AS happened, model FROM ({_VERSIONS}) WHERE superseded_at IS NOT NULL), s AS (SELECT sha, row_number() OVER (ORDER BY max(happened) DESC, sha DESC) AS k FROM h GROUP BY 1) SELECT model AS \"table\", count(s.sha) AS pruned FROM h LEFT JOIN (SELECT * FROM s WHERE k > 5) s USING (sha) GROUP BY 1"


@query(_PRUNE, "artifacts")
def prune_history_counts(m):
    v = _versions(m).filter("superseded_at is not null").withColumn("superseded_at_sha", F.col("next_day"))
    return history.prune_counts({k: v.filter(F.col("model") == k) for k in ("opus-1", "sonnet-1", "haiku-1", "view", "error")}, 5)


_MANIFEST = "WITH o AS (SELECT url AS path, max(sha256(html)) AS h FROM pages WHERE page_id % 3 <> 0 GROUP BY 1), n AS (SELECT url AS path, max(CASE WHEN page_id % 5 = 0 THEN sha256(html || 'x') ELSE sha256(html) END) AS h FROM pages WHERE page_id % 4 <> 0 GROUP BY 1) SELECT path, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM o FULL JOIN n USING (path) WHERE o.h IS NULL OR n.h IS NULL OR o.h <> n.h"


@query(_MANIFEST)
def manifest_diff(m):
    p = m.raw("pages")

    def one(rows, text):
        return rows.groupBy(F.col("url").alias("path")).agg(F.max(F.sha2(text, 256)).alias("hash"))

    old = one(p.filter("page_id % 3 <> 0"), F.col("html"))
    new = one(p.filter("page_id % 4 <> 0"), F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html")))
    return reindex.dirty(old, new)


_CASCADE = "WITH d AS (SELECT 'text://star/order/' || o_orderkey AS u FROM orders WHERE o_orderpriority LIKE '1%'), e AS (SELECT to_entity_id AS id, min(location_uri) AS a, max(location_uri) AS b FROM edges GROUP BY 1), g AS (SELECT id FROM e WHERE a IN (FROM d) OR b IN (FROM d)), x AS (SELECT id FROM edges WHERE (from_entity_id IN (FROM g) OR to_entity_id IN (FROM g) OR location_uri IN (FROM d))) SELECT (SELECT count(*) FROM g) AS entities, (SELECT count(*) FROM x) AS edges"


@query(_CASCADE, "edges")
def cascade_sweep_counts(m):
    dirty = m.raw("orders").filter(F.col("o_orderpriority").startswith("1")).select(F.concat(F.lit("text://star/order/"), "o_orderkey").alias("uri"))
    entities = m.places(False).drop("appearance_count")
    gone, edges = history.cascade(entities, m.edges, dirty)
    return gone.agg(F.count("*").alias("entities")).crossJoin(edges.agg(F.count("*").alias("edges")))


@query("SELECT event_id, CASE WHEN event_type = 'view' AND (value > 100 OR day <> '07') THEN 'concrete' WHEN event_type = 'view' THEN 'range_predating' ELSE 'concrete' END AS kind FROM artifacts", "artifacts")
def provenance_refine(m):
    a = m.artifacts
    is_range = F.col("event_type") == "view"
    new_kind = F.when((F.col("value") > 100) | (F.col("day") != "07"), "concrete").otherwise("range_predating")
    r = history.refined(F.when(is_range, "range_predating").otherwise("concrete"), F.lit("07"), new_kind, F.lit("07"))
    return a.select("event_id", r["kind"].alias("kind"))


@query("WITH b AS (SELECT DISTINCT 'user:' || user_id AS id FROM events WHERE event_type = 'view'), a AS (SELECT DISTINCT 'user:' || user_id AS id FROM events WHERE value > 300) SELECT id AS artifact_id, 'entity' AS artifact_kind, 's9' AS derived_at_sha FROM b WHERE id NOT IN (FROM a)")
def tombstones_of_step(m):
    rows = m.raw("events").select(F.lit("log").alias("corpus_id"), F.concat(F.lit("user:"), "user_id").alias("id"), "event_type", "value")
    out = history.tombstones_for(rows.filter("event_type = 'view'").select("corpus_id", "id").distinct(), rows.filter("value > 300"), "entity", "s9")
    return out.select("artifact_id", "artifact_kind", "derived_at_sha")


# text and extraction


@query("SELECT doc_id, k - 1 AS line_no, sha256(line) AS hash FROM (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)) WHERE trim(line) <> ''")
def chunk_lines(m):
    rows = m.chunks.select("doc_id", F.posexplode(F.split("content", "\n")).alias("n", "line")).filter(F.trim("line") != "")
    return rows.select("doc_id", F.col("n").cast("long").alias("line_no"), F.sha2("line", 256).alias("hash"))


@query("WITH l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)) SELECT doc_id, (k - 1) // 10 AS part, sha256(string_agg(line, chr(10) ORDER BY k)) AS hash FROM l GROUP BY ALL")
def large_item_split(m):
    out = code.line_parts(m.chunks.select("doc_id", "content"), "doc_id", "content", 10)
    return out.select("doc_id", F.col("part").cast("long").alias("part"), F.sha2("content", 256).alias("hash"))


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS target FROM pages")
def link_extract(m):
    return ext.hrefs(m.raw("pages"), "page_id")


@query("SELECT DISTINCT doc_id, unnest(regexp_extract_all(regexp_replace(text, '[\\x{C0}-\\x{24F}]', '0', 'g'), '\\b[A-Z][a-z]+(?:\\s[A-Z][a-z]+)+\\b')) AS mention FROM documents")
def mention_extract(m):
    return ext.mentions(m.chunks, "doc_id")


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, 'TODO|FIXME|HACK|XXX')))::BIGINT AS n_markers, (len(text) - len(replace(text, 'Licensed', ''))) // 8 AS n_licensed FROM documents")
def debt_markers(m):
    c = F.col("content")
    return m.chunks.select("doc_id", F.size(ext.debt_markers(c)).cast("long").alias("n_markers"), ext.occurrences(c, "Licensed").cast("long").alias("n_licensed"))


_TS = {
    "is_public": "regexp_matches(html, '(?m)^\\s*export\\b')", "is_fallible": "regexp_matches(html, '\\bthrow\\b|Promise<|\\basync\\b')", "is_nullable": "regexp_matches(html, '\\|\\s*(?:null|undefined)\\b')",
    "mutates_state": "regexp_matches(html, 'this\\.\\w+\\s*=[^=]|\\$?emit\\(')", "is_deprecated": "contains(html, '@deprecated')", "is_incomplete": "regexp_matches(html, '[Nn]ot implemented')", "is_test": "regexp_matches(html, '\\b(?:describe|it|test)\\(')",
    "panic_call_count": "len(regexp_extract_all(html, '\\w!\\.')) + len(regexp_extract_all(html, '\\bas any\\b'))", "branch_count": "len(regexp_extract_all(html, '\\b(?:if|for|while|switch|catch)\\s*\\('))",
}


@query(f"SELECT page_id, {', '.join(f'{v} AS {k}' for k, v in _TS.items())} FROM pages")
def ts_signals(m):
    s = ext.typescript_signals(F.col("html"))
    return m.raw("pages").select("page_id", *(s[c].alias(c) for c in _TS))


#: What a bit of a part's number puts into its text, and the signal that this sets.
_RUST = [
    ("#[must_use]\n", "must_use"), ("#[deprecated]\n", "is_deprecated"), ("#[tokio::test]\n", "is_test"), ("pub ", "is_public"), ("fn f(&mut self) ", "mutates_state"), ("-> Result<A, B> ", "is_fallible"),
    ("{ x.unwrap();\n", "has_panic_risk"), (" unsafe { y }\n", "is_unsafe"), (" todo!();\n", "is_incomplete"), ("-> Option<A>", "is_nullable"), ("-> !", "is_diverging"),
]
_BITS = ", ".join(f"(p_partkey >> {k}) & 1 = 1 AS {name}" for k, (_, name) in enumerate(_RUST))


@query(f"SELECT p_partkey, {_BITS}, p_size AS branch_count, CASE WHEN p_size > 25 THEN 'Call' || p_size END AS discarded FROM part")
def rust_signals(m):
    """The thirteen signals and counts, from texts that each part's number makes."""
    k = F.col("p_partkey")
    parts = [F.when(F.shiftright(k, i).bitwiseAND(1) == 1, text).otherwise("") for i, (text, _) in enumerate(_RUST)]
    text = F.concat(*parts, F.lit("\n"), F.repeat(F.lit("if a {}\n"), F.col("p_size")), F.when(F.col("p_size") > 25, F.concat(F.lit("let _ = own::Call"), "p_size", F.lit("(1);\n"))).otherwise(""))
    s = ext.signals(F.lit("rust"), text)
    return m.raw("part").select("p_partkey", *(s[name].alias(name) for _, name in _RUST), s["branch_count"].alias("branch_count"), F.array_join(s["discarded"], ",").alias("d")).withColumn("discarded", F.nullif("d", F.lit(""))).drop("d")


@query("SELECT item_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '-', 'g'), '-') AS slug FROM benchmark")
def slugify(m):
    return m.raw("benchmark").select("item_id", fn.slugify(F.col("text")).alias("slug"))


@query("SELECT item_id, trim(regexp_replace(text, '[^A-Za-z0-9_-]+', ' ', 'g')) AS query FROM benchmark")
def sanitize_query(m):
    return m.raw("benchmark").select("item_id", fn.sanitize_query(F.col("text")).alias("query"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g')) AS name, 'star:' || regexp_replace(lower(p_name || p_brand), '[^\\p{L}\\p{N}_]', '_', 'g') AS entity_id FROM part")
def entity_ids(m):
    p = m.raw("part")
    return p.select("p_partkey", fn.normalise_name(F.concat_ws(" ", "p_name", "p_brand")).alias("name"), fn.code_entity_id(F.lit("star"), F.concat("p_name", "p_brand")).alias("entity_id"))


@query("SELECT location_uri, split_part(replace(location_uri, 'text://', ''), '/', 1) AS corpus_id, 'doc/' || doc_id AS path FROM chunks", "chunks")
def location_parse(m):
    p = fn.parse_location(F.col("location_uri"))
    return m.chunks.select("location_uri", p["corpus_id"].alias("corpus_id"), p["path"].alias("path"))


@query("SELECT record_type, count(*) AS n FROM (SELECT 'chunk' AS record_type FROM documents UNION ALL SELECT 'entity' FROM plain_entities UNION ALL SELECT 'edge' FROM edges) GROUP BY 1", "plain_entities", "edges")
def export_jsonl_counts(m):
    lines = exports.json_lines(chunk=m.chunks.drop("content"), entity=m.plain_entities, edge=m.edges)
    return lines.groupBy(F.get_json_object("line", "$.record_type").alias("record_type")).agg(F.count("*").alias("n"))


_SYMBOLS = """WITH e AS (SELECT p.id, p.kind, min(x.location_uri) AS first FROM edges x JOIN plain_entities p ON p.id = x.to_entity_id GROUP BY ALL),
r AS (SELECT from_entity_id AS id, string_agg('calls>' || t, ',' ORDER BY t) AS relations FROM (SELECT DISTINCT from_entity_id, to_entity_id AS t FROM edges) GROUP BY 1)
SELECT f.location_uri, e.id AS symbol, e.kind, r.relations FROM (SELECT DISTINCT location_uri FROM edges) f LEFT JOIN e ON e.first = f.location_uri LEFT JOIN r ON r.id = e.id"""


@query(_SYMBOLS, "edges", "plain_entities")
def export_symbol_index(m):
    files = m.edges.select(F.lit("file").alias("kind"), "location_uri").distinct()
    entities = m.plain_entities.join(m.places(False).select("id", "first_location_uri"), "id")
    out = exports.symbol_index(files, entities, m.edges.withColumn("kind", F.lit("calls")))
    each = out.select("location_uri", F.explode_outer("occurrences").alias("o"))
    relations = F.array_join(F.transform("o.relations", lambda r: F.concat_ws(">", r["kind"], r["target"])), ",")
    return each.select("location_uri", "o.symbol", "o.kind", relations.alias("relations"))


@query()
def scene_fold(m):
    made = m.chunks.select("corpus_id", F.regexp_replace("content", "\n", "\n\n\n").alias("content"))
    return books.text_chunks(made).select("corpus_id", "path", "parent_path", "kind", F.octet_length("content").alias("bytes"))


_NARRATIVE = """WITH s AS (SELECT to_entity_id AS id, row_number() OVER (ORDER BY id) AS k FROM edges WHERE from_entity_id = 'customer:5' AND kind = 'placed' QUALIFY k <= 50)
SELECT '# Diegesis of ' || c.canonical_name || chr(10) || chr(10) || '## ' || c.canonical_name || ' (`character`)' || chr(10) || 'buys' || chr(10) || '  1. one: first' || chr(10) || '  2. two: second' || chr(10)
  || (SELECT coalesce(string_agg(chr(10) || '  ## ' || e.canonical_name || ' (`interface`)' || chr(10) || '  about ' || e.id || chr(10), '' ORDER BY s.k), '') FROM s JOIN plain_entities e ON e.id = s.id).rtrim(chr(10)) AS narrative
FROM plain_entities c WHERE c.id = 'customer:5'"""


@query(_NARRATIVE, "edges", "plain_entities")
def narrative(m):
    nodes = graph.walk(m.edges, m.spark.sql("SELECT 'customer:5' AS id"), ["placed"], 1).join(m.plain_entities, "id")
    seed = F.col("depth") == 0
    told = [F.when(seed, "buys").alias("purpose"), F.when(~seed, F.concat(F.lit("about "), "id")).alias("summary"), F.when(seed, F.array(F.lit("one: first"), F.lit("two: second"))).alias("blocks")]
    return graph.narrative(nodes.select("depth", "position", F.col("canonical_name").alias("name"), "kind", *told))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def event_windows(m):
    return reindex.event_windows(m.raw("events")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@query("SELECT 'text://chat/conv/1/turn/' || turn AS location_uri, role AS kind FROM conversations WHERE conv_id = 1")
def children(m):
    c = m.raw("conversations")
    parent = F.concat(F.lit("conv/"), "conv_id")
    chunks = c.select(parent.alias("parent_path"), fn.location_uri(F.lit("chat"), F.concat(parent, F.lit("/turn/"), "turn")).alias("location_uri"), F.col("role").alias("kind"))
    return lookups.children(chunks, "conv/1").select("location_uri", "kind")


@query("SELECT id FROM (SELECT to_entity_id AS id, min(location_uri) AS a, max(location_uri) AS b FROM edges GROUP BY 1) WHERE a = 'text://star/order/1' OR b = 'text://star/order/1'", "edges")
def read_location(m):
    uri = "text://star/order/1"
    return lookups.entities_at(graph.seen_with(m.edges, uri), uri).select("id")


@query("SELECT id, string_agg(k, ',' ORDER BY k) AS aliases FROM (SELECT DISTINCT 'user:' || user_id AS id, event_type AS k FROM events WHERE event_type <> 'error') GROUP BY 1")
def alias_overlay(m):
    e = m.raw("events")
    entities = e.select(F.concat(F.lit("user:"), "user_id").alias("id"), F.array(F.lit("error")).alias("aliases")).distinct()
    who = e.select(F.concat(F.lit("user:"), "user_id").alias("entity_id"), "event_type", "event_id")
    added = who.filter("event_type <> 'error'").select(F.lit("alias_add").alias("type"), "entity_id", F.col("event_type").alias("alias"), F.lit("1").alias("applied_at"), F.col("event_id").alias("id"))
    gone = who.select(F.lit("alias_remove").alias("type"), "entity_id", F.lit("error").alias("alias"), F.lit("2").alias("applied_at"), F.col("event_id").alias("id"))
    out = overlay.apply_aliases(entities, added.union(gone))
    return out.select("id", F.array_join(F.array_sort("aliases"), ",").alias("aliases")).filter("aliases <> ''")


# the queries of the tools, of single functions and of indexing register themselves here too
from . import catalogue_index as catalogue_index  # noqa: E402
from . import catalogue_tools as catalogue_tools  # noqa: E402
