"""Text, location, hash and model-tier expressions."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Locations are SCHEME + corpus + "/" + path.
SCHEME = "text://"

# fixed values
NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty"]
LANGUAGES = {"rs": "rust", "ts": "typescript", "tsx": "typescript", "vue": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "py": "python", "go": "go", "php": "php"}
DOLLARS_IN, DOLLARS_OUT = 3.0, 15.0


def sanitize_query(q: Column) -> Column:
    """Words of ASCII letters, digits, _ and - with one space between; all else separates."""
    return F.trim(F.regexp_replace(q, "[^A-Za-z0-9_-]+", " "))


def normalise_name(name: Column) -> Column:
    """Lower case, letters and digits and single spaces only."""
    kept = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}\s]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def slugify(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), F.lit("-"))


def heading_slug(text: Column) -> Column:
    """Lower case, spaces to dashes, other signs dropped."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"\s", "-"), r"[^\p{L}\p{N}_-]", "")


def code_entity_id(corpus: Column, name: Column) -> Column:
    return F.concat(corpus, F.lit(":"), F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}_]", "_"))


def book_entity_id(name: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(name), " ", "_"), "['\",.]", "")


def location_uri(corpus: Column, path: Column) -> Column:
    return F.concat(F.lit(SCHEME), corpus, F.lit("/"), path)


def parse_location(uri: Column) -> Column:
    """struct<corpus_id, path>; null where the scheme or the corpus is missing."""
    parts = [F.regexp_extract(uri, f"^{SCHEME}([^/]+)/(.*)$", k) for k in (1, 2)]
    return F.when(uri.rlike(f"^{SCHEME}[^/]+/"), F.struct(parts[0].alias("corpus_id"), parts[1].alias("path")))


def file_path(uri: Column) -> Column:
    """The path without scheme, corpus and fragment."""
    return F.regexp_extract(uri, f"^(?:{SCHEME}[^/]+/)?([^#]*)", 1)


def source_path(path: Column) -> Column:
    """A chunk's path as its source has it: without the code prefix and the fragment."""
    return F.regexp_replace(F.regexp_replace(path, "#.*$", ""), "^src/", "")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def edge_id(corpus: Column, source: Column, target: Column, kind: Column, location: Column) -> Column:
    return F.sha2(F.concat_ws("|", corpus, source, target, kind, location), 256)


def cache_key(kind: Column, entity: Column, content: Column, shape: Column, model: Column, stable: Column) -> Column:
    return F.sha2(F.concat_ws("|", kind, entity, content, shape, model, F.when(stable, "1").otherwise("0")), 256)


def glob_regex(glob: str) -> str:
    """A glob as an anchored regular expression: ** crosses folders, * and ? don't."""
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out, k = out + "(?:[^/]*/)*", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[k]) or re.escape(glob[k])
            k += 1
    return f"^{out}$"


def matches_any(path: Column, globs: list[str]) -> Column:
    return path.rlike("|".join(map(glob_regex, globs))) if globs else F.lit(False)


def model_tier(model: Column) -> Column:
    m = F.lower(model)
    return F.when(m.contains("opus"), "opus").when(m.contains("sonnet"), "sonnet").when(m.contains("haiku"), "haiku").otherwise("unknown")


def tier_rank(tier: Column) -> Column:
    return F.when(tier == "opus", 3).when(tier == "sonnet", 2).when(tier == "haiku", 1).otherwise(0)


def word_number(word: Column) -> Column:
    """one .. twenty, or digits, as an int; else null."""
    known = F.create_map(*chain.from_iterable((F.lit(w), F.lit(k)) for k, w in enumerate(NUMBER_WORDS, 1)))
    w = F.lower(F.trim(word))
    return F.coalesce(F.get(F.map_values(F.map_filter(known, lambda k, v: k == w)), F.lit(0)), w.try_cast("int"))


def language_of(path: Column) -> Column:
    """By the file's extension; null where none is known."""
    known = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in LANGUAGES.items()))
    return F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)(?:#.*)?$", 1)))


def fenced_json(text: Column) -> Column:
    """The JSON in a model's answer: a fenced block, else from the first brace to the last, else from bracket to bracket."""
    tries = [F.regexp_extract(text, p, 1) for p in (r"(?s)```(?:json)?\s*\n(.*?)```", r"(?s)(\{.*\})", r"(?s)(\[.*\])")]
    return F.coalesce(*(F.nullif(F.btrim(t, F.lit(" \t\r\n")), F.lit("")) for t in tries))


def prompt_seed(prompt: Column) -> Column:
    """The first eight bytes of its SHA-256, as an unsigned little-endian number."""
    h = F.sha2(prompt, 256)
    return F.conv(F.concat(*(F.substring(h, 2 * k + 1, 2) for k in reversed(range(8)))), 16, 10).cast("decimal(20,0)")


def cost_dollars(tokens_in: Column, tokens_out: Column) -> Column:
    return (tokens_in * DOLLARS_IN + tokens_out * DOLLARS_OUT) / 1e6


def valid_id(text: Column) -> Column:
    return text.rlike("^[a-z0-9]+(-[a-z0-9]+)*$")


def snippet(text: Column, term: Column, width: int = 80) -> Column:
    """A window around the first occurrence of term, with dots where the text goes on."""
    at = F.greatest(F.instr(F.lower(text), F.lower(term)) - width, F.lit(1))
    cut = F.substring(text, at, F.lit(2 * width))
    return F.concat(F.when(at > 1, "...").otherwise(""), cut, F.when(at + 2 * width <= F.length(text), "...").otherwise(""))
