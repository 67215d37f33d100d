"""The passes that ask a model, as rows and edges: aliases, summaries, purposes, contracts, themes.

A pass reads a version of a catalog and gives what it changes: rows by key for the heads, and new rows of the memo. What to ask is
a DataFrame of prompts; only what neither the heads nor the memo have is asked, in batches within tasks, and no prompt
holds more than a bounded number of lines. Ids are digests of what they name, so a second run makes no second rows.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cache_key, edge_id, fenced_json, language_of, model_tier, slugify
from ..operators import artifacts as art
from ..operators import extraction, graph, history, lookups, names
from ..operators.hashes import running_sha256
from ..schema import VERSIONED, schema
from ..storage import Catalog, honest_sizes, written
from .provider import Provider, Refused

# fixed values: kinds of entities that get purposes and contracts, and the least number of entities for themes
KINDS = ["function", "method", "class", "interface", "module"]
THEME_ENTITIES = 20
CONFIDENCE = 0.5
RETRIES = 8
#: Lines that one prompt takes at most: names of a theme, entities that may be the same, summaries of a group.
LINES = 200
#: Rows of a range of positions that one task sorts.
RANGE = 100_000


@dataclass
class Setting:
    """What a pass runs with: one corpus, a provider for each tier, and the time and version that its rows are stamped with."""

    corpus: str
    providers: dict[str, Provider]
    at: str
    version: str | None = None
    #: Asks again for what the heads have; the memo still answers.
    full: bool = False
    #: (path) of what changed; all counts as changed without it.
    dirty: DataFrame | None = None
    router: bool = True
    #: How often a corpus of more than LINES top summaries is summed up in groups first; as often as it takes, where None.
    rounds: int | None = None
    tiers: dict[str, str] = field(init=False)

    def __post_init__(self):
        self.tiers = {tier: p.model for tier, p in self.providers.items()}

    def model_of(self, tier: Column) -> Column:
        pairs = [F.lit(x) for kv in self.tiers.items() for x in kv]
        return F.element_at(F.create_map(*pairs), tier)

    def stamped(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({"generated_at": F.lit(self.at), "derived_at_version": F.lit(self.version).cast("string")})


def answered(prompts: DataFrame, providers: list[Provider]) -> DataFrame:
    """prompts (key, model, prompt) with the answer of the provider of that model, null where it failed; a refusal is tried again after a while."""
    by_model = {p.model: p for p in providers}

    def ask(model: str, prompt: str) -> str | None:
        for attempt in range(RETRIES):
            try:
                return by_model[model].complete(prompt)
            except Refused as e:
                time.sleep(e.seconds * 2**attempt)
            except Exception:  # noqa: BLE001  a prompt that fails costs its own answer alone
                return None
        return None

    def run(batches):
        for pdf in batches:
            yield pdf[["key"]].assign(answer=[ask(m, p) for m, p in zip(pdf["model"], pdf["prompt"], strict=True)])

    return prompts.select("key", "model", "prompt").mapInPandas(run, "key string, answer string")


def memoised(wanted: DataFrame, memo: DataFrame, setting: Setting, kind: str) -> tuple[DataFrame, DataFrame]:
    """(answers, new memo rows) for wanted (subject, content_hash, shape, model, prompt): answers are (subject, model, answer, known), each asked for once."""
    key = cache_key(F.lit(kind), F.coalesce("subject", F.lit("")), F.col("content_hash"), F.col("shape"), F.col("model"), F.lit(True))
    keyed = written(wanted.withColumn("cache_key", key), f"wanted-{kind}")
    hits, misses = art.cached(keyed, memo)
    once = misses.dropDuplicates(["cache_key"]).select(F.col("cache_key").alias("key"), "model", "prompt")
    new = written(answered(once, list(setting.providers.values())).filter("answer is not null"), f"answers-{kind}")
    back = misses.join(new.withColumnRenamed("key", "cache_key"), "cache_key", "left").select("subject", "model", "answer", F.lit(False).alias("known"))
    back = back.unionByName(hits.select("subject", "model", F.get_json_object("payload", "$.answer").alias("answer"), F.lit(True).alias("known")))
    rows = misses.dropDuplicates(["cache_key"]).join(new.withColumnRenamed("key", "cache_key"), "cache_key")
    memo_rows = rows.select("cache_key", F.lit(kind).alias("artifact_kind"), F.col("subject").alias("entity_id"), "content_hash", F.col("shape").alias("file_shape_hash"), "model", F.lit(True).alias("stable_sampling"), F.to_json(F.struct("answer")).alias("payload"), F.lit(setting.version or "").alias("first_seen_at_sha"), F.lit(setting.at).alias("created_at"), F.lit(0).cast("long").alias("hit_count"))
    return back, memo_rows


def as_table(rows: DataFrame, table: str) -> DataFrame:
    """rows with the columns of a table, null where they have none."""
    s = schema(table)
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in s.fields))


def edge_rows(pairs: DataFrame, kind: str, setting: Setting) -> DataFrame:
    """Edges of pairs (a, b), without a place of their own."""
    c, nowhere = F.lit(setting.corpus), F.lit("")
    rows = pairs.select("a", "b").distinct().select(edge_id(c, F.col("a"), F.col("b"), F.lit(kind), nowhere).alias("id"), c.alias("corpus_id"), F.col("a").alias("from_entity_id"), F.col("b").alias("to_entity_id"), F.lit(kind).alias("kind"), nowhere.alias("location_uri"), F.lit(CONFIDENCE).alias("confidence"), F.lit(setting.version).alias("derived_at_version"))
    return as_table(rows, "edges")


def _own(tables, name: str, setting: Setting) -> DataFrame:
    return tables(name).filter(F.col("corpus_id") == setting.corpus)


def _candidates(tables, setting: Setting) -> tuple[DataFrame, DataFrame]:
    """(entities with content, tier, model and the shape of their file; entities without content) of KINDS in changed files."""
    every = _own(tables, "entities", setting)
    wanted = every.filter(F.col("kind").isin(KINDS))
    if setting.dirty is not None:
        from ..functions import file_path, source_path

        # of an entity without a place nothing is known, so it counts as changed
        at = F.coalesce(source_path(file_path(F.col("first_location_uri"))), F.lit(""))
        wanted = wanted.withColumn("path", at).join(setting.dirty.select("path").union(setting.dirty.sparkSession.range(1).select(F.lit(""))).distinct(), "path", "left_semi").select(*every.columns)
    content = _own(tables, "chunks", setting).select(F.col("location_uri").alias("first_location_uri"), "content")
    held = wanted.join(content, "first_location_uri", "left")
    shapes = art.file_shapes(every.filter("first_location_uri is not null")).withColumnRenamed("uri", "first_location_uri")
    own = held.filter("content is not null").join(shapes, "first_location_uri", "left").join(graph.degrees(wanted.select("id"), _own(tables, "edges", setting)), "id")
    s = extraction.signals(language_of(F.regexp_replace("first_location_uri", "#.*$", "")), F.col("content"))
    own = own.withColumn("s", s).withColumn("lines", F.size(F.split("content", "\n")))
    tier = art.routed_tier(extraction.is_unsafe(F.col("content")), F.col("s.is_fallible"), F.col("s.is_public"), F.col("s.mutates_state"), F.col("s.panic_call_count"), F.size("s.debt_markers") > 0, F.col("in_degree"), F.col("out_degree"), F.col("kind"), F.col("lines"), setting.router)
    return own.withColumn("tier", tier).withColumn("model", setting.model_of(F.col("tier"))), held.filter("content is null").select(*every.columns)


def _asked(own: DataFrame, done: DataFrame, setting: Setting) -> DataFrame:
    """Candidates whose model hasn't made a row for them yet."""
    return own if setting.full else own.join(done.select(F.col("entity_id").alias("id"), "model").distinct(), ["id", "model"], "left_anti")


def _told(tables, setting: Setting) -> DataFrame:
    best = art.best_of(_own(tables, "summaries", setting).filter("target_kind = 'entity'"), ["target_id"])
    return best.select(F.col("target_id").alias("id"), F.col("text").alias("told"))


def _subject(*more: Column) -> Column:
    head = F.concat(F.lit("Entity: "), "canonical_name", F.lit("\nKind: "), "kind")
    return F.concat(head, *more, F.lit("\nSource:\n"), "content")


def _line(title: str, column: str) -> Column:
    return F.coalesce(F.concat(F.lit(f"\n{title}: "), column), F.lit(""))


def purposes(tables, setting: Setting) -> dict:
    """Why each entity is there, and the blocks that it consists of, with an entity and an edge for each block."""
    own, _ = _candidates(tables, setting)
    wanted = _asked(own, _own(tables, "entity_purposes", setting), setting).join(_told(tables, setting), "id", "left")
    ask = F.when((F.col("lines") >= 20), F.lit("with two to five blocks")).otherwise(F.lit("without blocks"))
    prompt = F.concat(F.lit("What is this entity for? Answer in JSON with purpose and blocks (label, description), "), ask, F.lit(".\n"), _subject(_line("Summary", "told")))
    back, memo = memoised(wanted.select(F.col("id").alias("subject"), F.lit("").alias("content_hash"), F.coalesce("shape", F.lit("")).alias("shape"), "model", prompt.alias("prompt")), tables("layer2_cache"), setting, "purpose")
    said = back.withColumn("j", F.from_json(fenced_json(F.col("answer")), "purpose string, blocks array<struct<label:string,description:string>>")).filter("j.purpose is not null")
    said = written(said.select(F.col("subject").alias("entity_id"), "model", "j.*"), "purposes")
    rows = setting.stamped(said.select("entity_id", F.lit(setting.corpus).alias("corpus_id"), "purpose", "model", model_tier(F.col("model")).alias("model_tier")))
    blocks = said.select("entity_id", F.posexplode("blocks").alias("position", "b")).select("entity_id", F.col("position").cast("long").alias("position"), "b.*")
    block = F.concat("entity_id", F.lit(":block:"), "position")
    of_block = blocks.select(F.sha2(block, 256).alias("id"), F.lit(setting.corpus).alias("corpus_id"), "entity_id", "label", "description", "position", F.lit(setting.version).alias("derived_at_version"))
    nodes = blocks.select(block.alias("id"), F.lit(setting.corpus).alias("corpus_id"), F.col("label").alias("canonical_name"), F.lit("block").alias("kind"), F.array().cast("array<string>").alias("aliases"), F.lit(1).alias("appearance_count"), F.lit(CONFIDENCE).alias("confidence"), F.lit(setting.version).alias("derived_at_version"))
    defines = edge_rows(blocks.select(F.col("entity_id").alias("a"), block.alias("b")), "defines", setting)
    return {"changed": {"entity_purposes": as_table(rows, "entity_purposes"), "entity_blocks": as_table(of_block, "entity_blocks"), "entities": as_table(nodes, "entities"), "edges": defines}, "memo": memo, "done": said}


CONTRACT = "assumptions array<string>, risks array<string>, intent_gap string, caller_notes string, verified_by_names array<string>, discards_result_callees array<string>"


def contracts(tables, setting: Setting) -> dict:
    """What each entity promises: signals of its text and what the model infers, with verified_by edges, and discards_result edges to what may fail.

    Entities without content, and those whose model fails or gives no JSON, get the default row.
    """
    own, bare = _candidates(tables, setting)
    had = _own(tables, "entity_contracts", setting)
    wanted = _asked(own, had, setting).join(_told(tables, setting), "id", "left")
    why = art.best_of(_own(tables, "entity_purposes", setting), ["entity_id"]).select(F.col("entity_id").alias("id"), "purpose")
    wanted = written(wanted.join(why, "id", "left"), "contract-candidates")
    prompt = F.concat(F.lit(f"What does this entity promise? Answer in JSON with {CONTRACT}.\n"), _subject(_line("Summary", "told"), _line("Purpose", "purpose"), F.lit("\nSignals: "), F.to_json("s")))
    back, memo = memoised(wanted.select(F.col("id").alias("subject"), F.lit("").alias("content_hash"), F.coalesce("shape", F.lit("")).alias("shape"), "model", prompt.alias("prompt")), tables("layer2_cache"), setting, "contract")
    said = written(back.withColumn("j", F.from_json(fenced_json(F.col("answer")), CONTRACT)).select(F.col("subject").alias("id"), "model", "j"), "contracts")
    none = F.array().cast("array<string>")
    full = wanted.join(said.filter("j is not null"), ["id", "model"])
    signs = ["is_public", "is_fallible", "is_nullable", "mutates_state", "is_deprecated", "is_incomplete", "is_test", "panic_call_count", "debt_markers"]
    lists = [F.coalesce(F.col(f"j.{c}"), none).alias(c) for c in ("assumptions", "risks")]
    rows = full.select(F.col("id").alias("entity_id"), "corpus_id", *(F.col(f"s.{c}").alias(c) for c in signs), extraction.is_unsafe(F.col("content")).alias("is_unsafe"), F.col("content").contains("#[must_use").alias("must_use"), (F.size(F.coalesce("j.discards_result_callees", none)) > 0).alias("discards_result"), *lists, "j.intent_gap", "j.caller_notes", "model", model_tier(F.col("model")).alias("model_tier"))
    failed = wanted.join(said.filter("j is not null").select("id"), "id", "left_anti").select("id", "corpus_id").unionByName(bare.select("id", "corpus_id"))
    # a default row gives way to a model's: it is only for entities without any
    failed = failed.join(had.select(F.col("entity_id").alias("id")), "id", "left_anti")
    default = lookups.default_contracts(failed, "unknown").withColumn("model_tier", F.lit("unknown"))
    made = as_table(setting.stamped(rows), "entity_contracts").unionByName(as_table(setting.stamped(default), "entity_contracts"))
    made = written(made, "contract-rows")
    targets = _own(tables, "entities", setting)
    asked = said.select("id", F.explode(F.concat(F.transform(F.coalesce("j.verified_by_names", none), lambda n: F.struct(F.lit("verified_by").alias("kind"), n.alias("name"))), F.transform(F.coalesce("j.discards_result_callees", none), lambda n: F.struct(F.lit("discards_result").alias("kind"), n.alias("name"))))).alias("x"))
    asked = asked.select(F.struct("id", "x.kind").alias("key"), "x.name").distinct()
    hits = written(names.resolved(asked, targets).select(F.col("key.id").alias("a"), F.col("key.kind").alias("kind"), F.col("id").alias("b")), "contract-targets")
    verified = edge_rows(hits.filter("kind = 'verified_by'"), "verified_by", setting)
    now = had.join(made.select("entity_id", "model"), ["entity_id", "model"], "left_anti").select(*made.columns).unionByName(made)
    discards = graph.to_fallible(edge_rows(hits.filter("kind = 'discards_result'"), "discards_result", setting), now)
    return {"changed": {"entity_contracts": made, "edges": verified.unionByName(discards)}, "memo": memo, "done": said}


def entity_set_hash(entities: DataFrame) -> DataFrame:
    """One row: the digest of the sorted ids, themes' own apart, each with a newline."""
    rows = entities.filter("kind <> 'theme'").select(F.lit(1).alias("corpus"), "id", F.concat("id", F.lit("\n")).alias("line")).distinct()
    return running_sha256(rows, "corpus", "id", "line")


def themes(tables, setting: Setting) -> dict:
    """What holds throughout a corpus, by its top entities, with upheld_by and violated_by edges; nothing under THEME_ENTITIES entities."""
    every = _own(tables, "entities", setting)
    few = every.filter("kind <> 'theme'").orderBy(F.desc("appearance_count"), "id").limit(LINES)
    lines = few.agg(F.count("*").alias("n"), F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("appearance_count", "canonical_name", "kind")))), lambda e: F.concat(e["canonical_name"], F.lit(" ["), e["kind"], F.lit("]"))), "\n").alias("names"))
    prompt = F.concat(F.lit("Themes of these, in JSON: themes (title, statement, confidence, upheld_by_entity_names, violated_by_entity_names).\n"), "names")
    model = setting.tiers.get("sonnet") or next(iter(setting.tiers.values()))
    wanted = lines.filter(F.col("n") >= THEME_ENTITIES).crossJoin(entity_set_hash(every).select("hash"))  # one row each
    back, memo = memoised(wanted.select(F.lit(None).cast("string").alias("subject"), F.col("hash").alias("content_hash"), F.lit("").alias("shape"), F.lit(model).alias("model"), prompt.alias("prompt")), tables("layer2_cache"), setting, "theme")
    kind = "themes array<struct<title:string,statement:string,confidence:double,upheld_by_entity_names:array<string>,violated_by_entity_names:array<string>>>"
    said = back.withColumn("j", F.from_json(fenced_json(F.col("answer")), kind)).select("model", F.explode("j.themes").alias("t")).select("model", "t.*").filter("title is not null")
    said = written(said.withColumn("id", F.concat(F.lit(f"{setting.corpus}:theme:"), slugify(F.col("title")))).dropDuplicates(["id"]), "themes")
    rows = setting.stamped(said.select("id", F.lit(setting.corpus).alias("corpus_id"), "title", "statement", "confidence", "model", model_tier(F.col("model")).alias("model_tier")))
    nodes = said.select("id", F.lit(setting.corpus).alias("corpus_id"), F.col("title").alias("canonical_name"), F.lit("theme").alias("kind"), F.array().cast("array<string>").alias("aliases"), F.lit(1).alias("appearance_count"), F.lit(CONFIDENCE).alias("confidence"), F.lit(setting.version).alias("derived_at_version"))
    edges = None
    for column, how in (("upheld_by_entity_names", "upheld_by"), ("violated_by_entity_names", "violated_by")):
        hits = names.resolved(said.select(F.col("id").alias("key"), F.explode(column).alias("name")), every.filter("kind <> 'theme'"))
        own = edge_rows(hits.select(F.col("id").alias("a"), F.col("key").alias("b")), how, setting)
        edges = own if edges is None else edges.unionByName(own)
    return {"changed": {"themes": as_table(rows, "themes"), "entities": as_table(nodes, "entities"), "edges": edges}, "memo": memo, "done": said}


def aliases(tables, setting: Setting) -> dict:
    """Entities that the model takes for one: (keep, absorb) merges, and what they change of entities and edges.

    Entities are asked about together where their names share a last word, LINES of them at a time in the order of their names.
    """
    every = _own(tables, "entities", setting)
    word = F.element_at(F.split(F.trim(F.lower("canonical_name")), r"\s+"), -1)
    order = Window.partitionBy("word").orderBy("canonical_name", "id")
    dealt = every.filter(F.trim("canonical_name") != "").select("id", "canonical_name", "kind", "aliases", word.alias("word")).withColumn("part", F.floor((F.row_number().over(order) - 1) / LINES))
    line = F.concat(F.lit("- "), "canonical_name", F.lit(" ["), "kind", F.lit("]"), F.when(F.size("aliases") > 0, F.concat(F.lit(" (aliases: "), F.array_join("aliases", ", "), F.lit(")"))).otherwise(""))
    groups = dealt.groupBy("word", "part").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines")).filter("n > 1")
    model = setting.tiers.get("haiku") or next(iter(setting.tiers.values()))
    prompt = F.concat(F.lit("Which of these are the same? Answer in JSON: merges (keep, absorb, reason), by name.\n"), "lines")
    subject = F.concat_ws("/", F.lit(setting.corpus), "word", "part")
    back, memo = memoised(groups.select(subject.alias("subject"), F.sha2("lines", 256).alias("content_hash"), F.lit("").alias("shape"), F.lit(model).alias("model"), prompt.alias("prompt")), tables("layer2_cache"), setting, "aliases")
    said = back.withColumn("j", F.from_json(fenced_json(F.col("answer")), "merges array<struct<keep:string,absorb:string,reason:string>>")).select("subject", F.explode("j.merges").alias("m")).select("subject", "m.keep", "m.absorb")
    ids = dealt.groupBy(subject.alias("subject"), "canonical_name").agg(F.min("id").alias("id"))
    pairs = said.join(ids.select("subject", F.col("canonical_name").alias("keep"), F.col("id").alias("canonical")), ["subject", "keep"]).join(ids.select("subject", F.col("canonical_name").alias("absorb"), F.col("id").alias("absorbed")), ["subject", "absorb"])
    merges = written(pairs.filter("canonical <> absorbed").groupBy("absorbed").agg(F.min("canonical").alias("canonical")), "alias-merges")
    to = written(graph.roots(merges).filter("absorbed <> root"), "alias-roots")
    gone = every.join(to.select(F.col("absorbed").alias("id")), "id", "left_semi").select("id")
    kept = graph.merged_entities(every, merges).join(to.select(F.col("root").alias("id")).distinct(), "id", "left_semi").select(*every.columns)
    edges = _own(tables, "edges", setting)
    moved = edges.join(to.select(F.col("absorbed").alias("from_entity_id")), "from_entity_id", "left_semi").select(*edges.columns).union(edges.join(to.select(F.col("absorbed").alias("to_entity_id")), "to_entity_id", "left_semi").select(*edges.columns)).dropDuplicates(["id"])
    return {"changed": {"entities": kept, "edges": graph.merged_edges(moved, merges)}, "gone": {"entities": gone}, "memo": memo, "done": merges}


def summaries(tables, setting: Setting, levels: tuple[str, ...], touched: DataFrame | None = None) -> dict:
    """Summaries of the chunks of each level, leaves first, and of the corpus.

    A chunk is asked about when it has no summary or when one of its children has been asked about; touched (location_uri) names
    further ones, such as parents of chunks that went. Its text is the summaries of its children in order, or its own.
    The memo knows a chunk by this text, so a parent whose children say the same costs nothing. A corpus of more than LINES top summaries is
    summed up in groups of LINES first, as often as that takes.
    """
    chunks, memo = _own(tables, "chunks", setting), tables("layer2_cache")
    known = art.best_of(_own(tables, "summaries", setting), ["target_kind", "target_id"]).select("target_kind", "target_id", "text")
    of_chunk = written(known.filter("target_kind = 'chunk'").select(F.col("target_id").alias("id"), F.col("text").alias("said")), "summaries-known")
    made, memos, asked_before, level_before = [], [], None, None
    for level in levels:
        own = chunks.filter(F.col("kind") == level)
        missing = own if setting.full else own.join(of_chunk.select("id"), "id", "left_anti").select(*own.columns)
        if touched is not None:
            missing = missing.union(own.join(touched.select("location_uri").distinct(), "location_uri", "left_semi").select(*own.columns))
        if asked_before is not None:
            above = asked_before.filter("parent_path is not null").select(F.col("parent_path").alias("location_uri")).distinct()
            missing = missing.union(own.join(above, "location_uri", "left_semi").select(*own.columns))
        missing = written(missing.dropDuplicates(["id", "location_uri"]), f"summaries-{level}")
        texts = missing.select("id", "location_uri", F.col("content").alias("input"), F.lit(0).alias("n_children"))
        if level_before is not None:
            below = chunks.filter(F.col("kind") == level_before).join(of_chunk, "id").select(F.col("parent_path").alias("location_uri"), F.col("location_uri").alias("at"), "said")
            below = below.join(missing.select("location_uri").distinct(), "location_uri", "left_semi")
            joined = below.groupBy("location_uri").agg(F.count("*").cast("int").alias("k"), _joined(level_before, "at").alias("children"))
            texts = missing.join(joined, "location_uri", "left").select("id", "location_uri", F.coalesce("children", "content").alias("input"), F.coalesce("k", F.lit(0)).alias("n_children"))
        none, no = F.lit(0), F.lit(False)
        debt = F.col("input").rlike("FIXME|HACK|TODO")
        tier = art.routed_tier(no, no, no, no, none, debt, none, F.col("n_children"), F.lit(level), F.size(F.split("input", "\n")), setting.router)
        said, new = _summarised(texts.select("id", "input", setting.model_of(tier).alias("model")), level, memo, setting)
        memos.append(new)
        made.append(said.select(F.lit("chunk").alias("target_kind"), F.col("id").alias("target_id"), F.lit(level).alias("depth"), F.col("answer").alias("text"), "model"))
        of_chunk = written(of_chunk.join(said.select("id"), "id", "left_anti").unionByName(said.select("id", F.col("answer").alias("said"))), "summaries-known")
        asked_before, level_before = missing, level
    top = chunks.filter(F.col("kind") == levels[-1]) if levels else chunks.limit(0)
    if levels and (setting.full or touched is not None or not asked_before.isEmpty() or known.filter("target_kind = 'corpus'").isEmpty()):
        rows = top.join(of_chunk, "id").select("location_uri", "said").withColumnRenamed("location_uri", "at")
        said, new = _of_corpus(rows, levels[-1], memo, setting)
        memos += new
        made.append(said.select(F.lit("corpus").alias("target_kind"), F.lit(setting.corpus).alias("target_id"), F.lit("corpus").alias("depth"), F.col("answer").alias("text"), "model"))
    every = written(_all(made).filter("text is not null").dropDuplicates(["target_kind", "target_id", "model"]), "summary-rows")
    key = F.concat_ws("|", F.lit(setting.corpus), "target_kind", "target_id", "model")
    rows = setting.stamped(every.select(F.sha2(key, 256).alias("id"), F.lit(setting.corpus).alias("corpus_id"), "*", model_tier(F.col("model")).alias("model_tier")))
    return {"changed": {"summaries": as_table(rows, "summaries")}, "memo": _all(memos), "done": every}


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _joined(kind: str, order: str) -> Column:
    """The summaries of a group in order, numbered."""
    parts = F.array_sort(F.collect_list(F.struct(order, "said")))
    return F.array_join(F.transform(parts, lambda c, k: F.concat(F.lit(f"{kind} "), (k + 1).cast("string"), F.lit(": "), c["said"])), "\n\n")


def _summarised(texts: DataFrame, level: str, memo: DataFrame, setting: Setting) -> tuple[DataFrame, DataFrame]:
    """(id, answer, model) of texts (id, input, model)."""
    subject = F.concat(F.lit(f"{level}:"), "id")
    prompt = F.concat(F.lit(f"Sum up this {level}.\n"), "input")
    back, new = memoised(texts.select(subject.alias("subject"), F.sha2("input", 256).alias("content_hash"), F.lit("").alias("shape"), "model", prompt.alias("prompt")), memo, setting, "summary")
    said = back.filter("answer is not null").select(F.substring("subject", len(level) + 2, 1 << 20).alias("id"), "answer", "model").dropDuplicates(["id"])
    return written(said, f"summaries-of-{level}"), written(new, "summary-memo")


def _of_corpus(rows: DataFrame, kind: str, memo: DataFrame, setting: Setting) -> tuple[DataFrame, list[DataFrame]]:
    """The corpus's summary of rows (at, said), in groups of LINES by position until one group holds them, or for as many rounds as the setting allows."""
    model = setting.tiers.get("sonnet") or next(iter(setting.tiers.values()))
    memos, n, rounds = [], rows.count(), 0
    while n > LINES and (setting.rounds is None or rounds < setting.rounds):
        rounds += 1
        # ranges by position, each numbered from where the one before ends: no window over the whole
        parts = written(rows.repartitionByRange(-(-n // RANGE), "at").sortWithinPartitions("at", "said").withColumn("k", F.monotonically_increasing_id()), "corpus-level")
        k, p = F.col("k").bitwiseAND((1 << 33) - 1), F.shiftright("k", 33)
        starts, first = [], 0
        for r in sorted(parts.groupBy(p.alias("p")).agg(F.count("*").alias("n")).collect()):  # one row a range
            starts, first = [*starts, (r["p"], first)], first + r["n"]
        place = parts.select("at", "said", p.alias("p"), k.alias("k")).join(F.broadcast(rows.sparkSession.createDataFrame(starts, "p long, first long")), "p")
        groups = place.groupBy(F.floor((F.col("first") + F.col("k")) / LINES).alias("g")).agg(F.min("at").alias("at"), _joined(kind, "at").alias("input"))
        said, new = _summarised(groups.select(F.col("at").alias("id"), "input", F.lit(model).alias("model")), "part", memo, setting)
        memos.append(new)
        rows, kind = said.select(F.col("id").alias("at"), F.col("answer").alias("said")), "part"
        n = rows.count()
    whole = rows.agg(F.count("*").alias("n"), _joined(kind, "at").alias("input")).filter("n > 0")
    said, new = _summarised(whole.select(F.lit(setting.corpus).alias("id"), "input", F.lit(model).alias("model")), "corpus", memo, setting)
    return said, [*memos, new]


PASSES = {"aliases": aliases, "purpose": purposes, "contract": contracts, "theme": themes}


def logged(catalog: Catalog, name: str, setting: Setting, status: str, done: int = 0) -> DataFrame:
    """The row of the log of a run: running, finished or failed."""
    row = (f"{setting.corpus}/{name}/{setting.at}", setting.corpus, name, setting.at, None if status == "running" else setting.at, status, f'{{"processed": {done}}}', ",".join(sorted(set(setting.tiers.values()))))
    return catalog.spark.createDataFrame([row], "id string, corpus_id string, pass string, started_at string, finished_at string, status string, stats string, provider string")


def run_pass(catalog: Catalog, name: str, setting: Setting, levels: tuple[str, ...] = ("scene", "chapter"), touched: DataFrame | None = None) -> int:
    """Runs a pass on a catalog: its rows, what they replace as history, memo and log are one version; another writer's change of what it has read is a Conflict. How many things were done.

    The log says that it runs, and then that it has finished or failed.
    """
    catalog.write(changed={"runs": (logged(catalog, name, setting, "running"), None)})
    try:
        with honest_sizes(catalog.spark):
            return _run(catalog, name, setting, levels, touched)
    except Exception:
        catalog.write(changed={"runs": (logged(catalog, name, setting, "failed"), None)})
        raise


def _run(catalog: Catalog, name: str, setting: Setting, levels: tuple[str, ...], touched: DataFrame | None) -> int:
    work = catalog.reading()
    out = summaries(work.table, setting, levels, touched) if name == "summarize" else PASSES[name](work.table, setting)
    done = out["done"].count()
    gone, past = out.get("gone", {}), {}
    for n, df in out["changed"].items():
        old = history.superseded(work.table(n), df, VERSIONED[n]).withColumns({"superseded_at": F.lit(setting.at), "superseded_at_sha": F.col("superseded_at_version")})
        past[f"{n}_history"] = history.not_archived(work.table(f"{n}_history"), old, [*VERSIONED[n], "derived_at_kind", "derived_at_sha", "derived_at_version"])
    changed = {n: (df, gone.get(n)) for n, df in out["changed"].items()} | {"runs": (logged(catalog, name, setting, "finished", done), None)}
    work.commit(changed=changed, appended={**past, "layer2_cache": out["memo"]})
    return done
