"""Links, mentions, front matter, sections, contract signals and structure, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import heading_slug

# fixed value: capitalised words in a row; (?U) counts letters of all scripts as parts of words, as the pattern's own engine does
MENTION = r"(?U)\b[A-Z][a-z]+(?:\s[A-Z][a-z]+)+\b"
WIKI_LINK = r"\[\[([^\]|#]+)(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]"
MARKDOWN_LINK = r"\[[^\]]*\]\(([^)\s]+)\)"
HREF = r"href=\"([^\"]+)\""

# fixed values
DEBT = ["TODO", "FIXME", "HACK", "XXX"]


def links(df: DataFrame, key: str, text: str = "content") -> DataFrame:
    """(key, target, external): wiki and markdown links, without their .md ending."""
    wiki = F.transform(F.regexp_extract_all(text, F.lit(WIKI_LINK), 1), lambda t: F.trim(t))
    plain = F.regexp_extract_all(text, F.lit(MARKDOWN_LINK), 1)
    found = df.select(key, F.explode(F.concat(wiki, plain)).alias("t"))
    target = F.regexp_replace(F.regexp_replace("t", "#.*$", ""), r"\.md$", "")
    return found.select(key, target.alias("target"), F.col("t").rlike("^[a-z]+://").alias("external")).filter("target <> ''").distinct()


def hrefs(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    return pages.select(key, F.explode(F.regexp_extract_all(html, F.lit(HREF), 1)).alias("target"))


def mentions(df: DataFrame, key: str, text: str = "content") -> DataFrame:
    """(key, mention): distinct runs of capitalised words."""
    return df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(MENTION), 0))).alias("mention"))


def front_matter(text: Column) -> Column:
    """struct<title, type, category, topic, tags, aliases, body> of a page that may start with a fenced block."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n?", 1)

    def scalar(name):
        return F.nullif(F.btrim(F.regexp_extract(block, rf"(?m)^{name}:[ \t]*([^\n]+)$", 1), F.lit(" \"'")), F.lit(""))

    def listed(name):
        inline = F.regexp_extract(block, rf"(?m)^{name}:[ \t]*\[([^\]]*)\]", 1)
        items = F.regexp_extract(block, rf"(?m)^{name}:[ \t]*\n((?:[ \t]*- [^\n]*\n?)+)", 1)
        each = F.concat(F.split(inline, ","), F.regexp_extract_all(items, F.lit(r"- ([^\n]*)"), 1))
        return F.filter(F.transform(each, lambda t: F.btrim(t, F.lit(" \"'"))), lambda t: t != "")

    body = F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n?", "")
    return F.struct(*(scalar(n).alias(n) for n in ("title", "type", "category", "topic")), listed("tags").alias("tags"), listed("aliases").alias("aliases"), body.alias("body"))


def sections(df: DataFrame, key: str, body: str, least: int = 50, most: int = 3000) -> DataFrame:
    """(key, slug, heading, content): the intro and each heading of level two or more, cut at most characters; short ones go."""
    parts = F.split(F.concat(F.lit("\n"), F.col(body)), r"\n(?=#{2,6} )")
    rows = df.select(key, F.posexplode(parts).alias("k", "part"))
    heading = F.trim(F.regexp_extract("part", r"^#{2,6} ([^\n]*)", 1))
    text = F.when(F.col("k") == 0, F.trim("part")).otherwise(F.trim(F.regexp_replace("part", r"^#{2,6} [^\n]*\n?", F.concat(F.lit("## "), F.regexp_replace(heading, r"([\\$])", r"\\$1"), F.lit("\n\n")))))
    out = rows.select(key, F.when(F.col("k") == 0, "intro").otherwise(heading_slug(heading)).alias("slug"), heading.alias("heading"), text.alias("t"))
    return out.filter(F.octet_length("t") >= least).select(key, "slug", "heading", F.substring("t", 1, most).alias("content"))


def page_entities(pages: DataFrame) -> DataFrame:
    """A page's entity, of (corpus_id, path, content): its title, first heading or path, and its kind by front matter."""
    m = pages.withColumn("m", front_matter(F.col("content")))
    h1 = F.nullif(F.trim(F.regexp_extract("m.body", r"(?m)^# ([^\n]+)$", 1)), F.lit(""))
    return m.select(F.concat(F.lit("page:"), "path").alias("id"), "corpus_id", F.coalesce("m.title", h1, "path").alias("canonical_name"), F.coalesce("m.type", "m.category", F.lit("topic")).alias("kind"), F.col("m.aliases").alias("aliases"), F.lit(0.9).alias("confidence"))


def page_edges(pages: DataFrame) -> DataFrame:
    """references (0.8) to linked pages and mentions (0.4) of names, of (corpus_id, path, content)."""
    source = F.concat(F.lit("page:"), "path").alias("from_entity_id")
    refs = links(pages, "path").filter("not external").select(source, F.concat(F.lit("page:"), "target").alias("to_entity_id"), F.lit("references").alias("kind"), F.lit(0.8).alias("confidence"))
    names = mentions(pages, "path").select(source, F.concat(F.lit("mention:"), "mention").alias("to_entity_id"), F.lit("mentions").alias("kind"), F.lit(0.4).alias("confidence"))
    return refs.union(names)


def debt_markers(text: Column) -> Column:
    """Trimmed lines that hold a marker of debt."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: x.rlike("|".join(DEBT)))


def occurrences(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _more(text: Column, **own: Column) -> list[Column]:
    """The signals that a language may lack, by name, in the order that all share."""
    none = {"must_use": F.lit(False), "is_unsafe": F.lit(False), "is_diverging": F.lit(False), "branch_count": F.lit(0).cast("long"), "discarded": F.array().cast("array<string>")}
    return [*((own.get(k, v)).alias(k) for k, v in none.items()), (F.size(F.split(text, "\n")) - 1).cast("long").alias("body_lines")]


def _flagged(text: Column, panics: Column, **more: Column) -> list[Column]:
    return [panics.cast("long").alias("panic_call_count"), (panics > 0).alias("has_panic_risk"), debt_markers(text).alias("debt_markers"), *_more(text, **more)]


def typescript_signals(text: Column) -> Column:
    return F.struct(
        text.rlike(r"(?m)^\s*export\b").alias("is_public"),
        (text.rlike(r"\bthrow\b|Promise<|\basync\b")).alias("is_fallible"),
        text.rlike(r"\|\s*(?:null|undefined)\b").alias("is_nullable"),
        text.rlike(r"this\.\w+\s*=[^=]|\$?emit\(").alias("mutates_state"),
        text.contains("@deprecated").alias("is_deprecated"),
        text.rlike(r"[Nn]ot implemented").alias("is_incomplete"),
        text.rlike(r"\b(?:describe|it|test)\(").alias("is_test"),
        *_flagged(text, occurrences(text, r"\w!\.") + occurrences(text, r"\bas any\b"), branch_count=occurrences(text, r"\b(?:if|for|while|switch|catch)\s*\(").cast("long")),
    )


def php_signals(text: Column) -> Column:
    return F.struct(
        text.rlike(r"\bpublic function\b").alias("is_public"),
        text.rlike(r"\bthrow\b|findOrFail|firstOrFail").alias("is_fallible"),
        text.rlike(r":\s*\?\w|\|\s*null\b").alias("is_nullable"),
        text.rlike(r"\$this->\w+\s*=[^=]|->save\(").alias("mutates_state"),
        text.contains("@deprecated").alias("is_deprecated"),
        text.rlike(r"[Nn]ot implemented").alias("is_incomplete"),
        text.rlike(r"extends \w*TestCase|function test\w*\(").alias("is_test"),
        *_flagged(text, occurrences(text, r"OrFail\(") + occurrences(text, r"\b(?:die|exit)\("), branch_count=occurrences(text, r"\b(?:if|for|foreach|while|switch|match|catch)\s*\(").cast("long")),
    )


def rust_signals(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), discarded_callee), lambda c: c.isNotNull())
    return F.struct(
        text.rlike(r"(?m)^\s*pub\b").alias("is_public"),
        text.rlike(r"->\s*(?:\w+::)*Result\b").alias("is_fallible"),
        text.rlike(r"->\s*Option\b").alias("is_nullable"),
        text.contains("&mut self").alias("mutates_state"),
        text.contains("#[deprecated").alias("is_deprecated"),
        text.rlike(r"\b(?:todo|unimplemented)!").alias("is_incomplete"),
        text.rlike(r"#\[(?:\w+::)?test\]").alias("is_test"),
        *_flagged(
            text, occurrences(text, r"\.unwrap\(\)|\.expect\(|\bpanic!"), must_use=text.contains("#[must_use"), is_unsafe=is_unsafe(text), is_diverging=text.rlike(r"->\s*!"),
            branch_count=occurrences(text, r"\b(?:if|match|loop|for|while)\b").cast("long"), discarded=lines,
        ),
    )


def signals(language: Column, text: Column) -> Column:
    """The signals of a language; of an unknown one, those that no text shows."""
    none = F.lit("")
    by = F.when(language == "rust", rust_signals(text)).when(language == "php", php_signals(text)).when(language.isin("typescript", "javascript"), typescript_signals(text))
    return by.otherwise(rust_signals(none))


def is_unsafe(text: Column) -> Column:
    return text.rlike(r"\bunsafe\b")


def discarded_callee(line: Column) -> Column:
    """The function whose result a line throws away, or null."""
    return F.nullif(F.regexp_extract(line, r"let _ = (?:\w+(?:::|\.))*(\w+)\(", 1), F.lit(""))


def php_methods(text: Column) -> Column:
    """Names of a PHP class's methods."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\bfunction\s+&?([A-Za-z_]\w*)\s*\("), 1))


def instantiated(text: Column) -> Column:
    """Classes that a text makes instances of, by their last name."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\bnew\s+(?:\w*\\)*([A-Za-z_]\w*)"), 1))
