"""Code: file enumeration, file and symbol chunks, structure by parser or pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code_entity_id, edge_id, language_of, location_uri, matches_any

LEAST, MOST, PART_LINES, PASSTHROUGH = 100, 4000, 100, 256 * 1024
# fixed values
EXCLUDED = [".git/**", ".claude/**", "vendor/**", "node_modules/**", "storage/**", "bootstrap/cache/**", "public/build/**", "target/**", "dist/**", "build/**"]
TEXT_TYPES = ["json", "yaml", "yml", "toml", "tf", "tfvars", "hcl", "sql", "ftl", "html", "sh", "css", "scss", "md"]
KINDS = {"fn": "function", "function": "function", "func": "function", "class": "class", "struct": "class", "enum": "class", "impl": "class", "trait": "interface", "interface": "interface", "type": "interface", "mod": "module"}


def read_files(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(path, content) below root, by globs of the relative path; those to exclude come on top of EXCLUDED."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base, name = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/"), root.rstrip("/")
    rel = F.when(base.startswith(f"{name}/"), F.substr(base, F.lit(len(name) + 2))).otherwise(base)
    out = files.select(rel.alias("path"), F.decode("content", "UTF-8").alias("content")).filter(~matches_any(F.col("path"), [*EXCLUDED, *(exclude or [])]))
    return out.filter(matches_any(F.col("path"), include)) if include else out


def item_kind(keyword: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), keyword), F.lit("item"))


def symbol_of(text: Column) -> Column:
    """The name after the first item keyword, else the first identifier."""
    named = F.regexp_extract(text, r"\b(?:fn|function|func|def|class|struct|enum|trait|interface|mod|type)\s+([A-Za-z_]\w*)", 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(F.regexp_extract(text, r"([A-Za-z_]\w*)", 1), F.lit("")))


def vue_script(text: Column) -> Column:
    """The script blocks of a single-file component, one after another."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)<script\b[^>]*>(.*?)</script>"), 1), lambda s: F.trim(s)), "\n")


def passthrough(files: DataFrame, corpus: str) -> DataFrame:
    """File chunks of plain text types, cut at 256 KiB with a mark; byte_length is that of the whole."""
    rows = files.filter(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(TEXT_TYPES))
    cut = F.when(F.octet_length("content") > PASSTHROUGH, F.concat(F.substring("content", 1, PASSTHROUGH), F.lit("\n[truncated]"))).otherwise(F.col("content"))
    return rows.select(F.lit(corpus).alias("corpus_id"), F.concat(F.lit("src/"), "path").alias("path"), F.lit(None).cast("string").alias("parent_path"), F.lit("file").alias("kind"), cut.alias("content"), F.octet_length("content").cast("long").alias("byte_length"))


def line_parts(df: DataFrame, key: str, text: str, lines: int = PART_LINES) -> DataFrame:
    """(key, part, content): parts of so many lines."""
    each = F.split(text, "\n")
    starts = F.sequence(F.lit(0), F.floor((F.size(each) - 1) / lines).cast("int"))
    return df.select(key, F.posexplode(F.transform(starts, lambda k: F.array_join(F.slice(each, k * lines + 1, lines), "\n"))).alias("part", "content"))


STRUCTURE = "path string, symbol string, kind string, start int, end int, calls array<string>, imports array<string>, bases array<string>, implements array<string>, instantiates array<string>, owner string, doc string"


def structure(files: DataFrame) -> DataFrame:
    """The file and its items as rows of STRUCTURE: Python by its parser, other languages by the lexer; methods have an owner. Files in no known language give none."""

    def run(batches):
        import ast

        import pandas as pd

        from ..functions.text import LANGUAGES as BY_ENDING
        from .lexer import LANGUAGES, items

        def python(path, text):
            try:
                tree = ast.parse(text)
            except (SyntaxError, ValueError, RecursionError):
                return
            imports = [a.name for n in tree.body if isinstance(n, ast.Import) for a in n.names] + [n.module or "" for n in tree.body if isinstance(n, ast.ImportFrom)]
            inside = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
            calls = lambda nodes: list(dict.fromkeys(getattr(c.func, "id", getattr(c.func, "attr", "")) for n in nodes for c in ast.walk(n) if isinstance(c, ast.Call)))
            yield path, None, "file", 0, text.count("\n") + 1, calls([n for n in tree.body if not isinstance(n, inside)]), imports, [], [], [], None, ast.get_docstring(tree)
            for n in tree.body:
                if isinstance(n, inside):
                    bases = [ast.unparse(b) for b in n.bases] if isinstance(n, ast.ClassDef) else []
                    yield path, n.name, "class" if isinstance(n, ast.ClassDef) else "function", n.lineno - 1, n.end_lineno, calls([n]), [], bases, [], [], None, ast.get_docstring(n)

        def rows(path, text):
            language = BY_ENDING.get(path.rpartition(".")[2].lower())
            if language == "python":
                yield from python(path, text)
            elif language in LANGUAGES:
                for i in items(text, language):
                    yield path, i.symbol, i.kind, i.start, i.end, i.calls, i.imports, i.extends, i.implements, i.instantiates if language == "php" else [], i.owner, i.doc

        for pdf in batches:
            made = [r for path, text in zip(pdf["path"], pdf["content"], strict=True) for r in rows(path, text or "")]
            out = pd.DataFrame(made, columns=[c.split()[0] for c in STRUCTURE.split(", ")])
            out["calls"] = [[c for c in dict.fromkeys(x) if len(c) >= 2 and not c[0].isdigit()] for x in out["calls"]]
            yield out

    return files.select("path", "content").mapInPandas(run, STRUCTURE)


def file_chunks(files: DataFrame, corpus: str) -> DataFrame:
    """file, symbol and part chunks of files in known languages; symbols under LEAST bytes go, those over MOST are parted by lines. An item without a name goes by its line."""
    known = files.filter(language_of(F.col("path")).isNotNull())
    where = F.concat(F.lit("src/"), "path")
    whole = known.select(F.lit(corpus).alias("corpus_id"), where.alias("path"), F.lit(None).cast("string").alias("parent_path"), F.lit("file").alias("kind"), "content")
    parsed = known.withColumn("content", F.when(F.col("path").endswith(".vue"), vue_script(F.col("content"))).otherwise(F.col("content")))
    items = structure(parsed).filter("kind <> 'file' and owner is null").join(parsed, "path")
    body = F.array_join(F.slice(F.split("content", "\n"), F.col("start") + 1, F.col("end") - F.col("start")), "\n")
    name = F.coalesce("symbol", F.concat(F.lit("item_"), F.col("start")))
    items = items.select("path", F.concat(where, F.lit("#"), name).alias("at"), "kind", body.alias("body")).filter(F.octet_length("body") >= LEAST)
    parent = location_uri(F.lit(corpus), where)
    short = items.filter(F.octet_length("body") <= MOST).select(F.lit(corpus), "at", parent, "kind", "body")
    long = items.filter(F.octet_length("body") > MOST).withColumn("key", F.struct("path", "at", "kind"))
    parts = line_parts(long, "key", "body").filter(F.octet_length("content") >= LEAST)
    return whole.union(short).union(parts.select(F.lit(corpus), F.concat("key.at", F.lit("/part"), F.col("part") + 1), location_uri(F.lit(corpus), F.concat(F.lit("src/"), "key.path")), "key.kind", "content"))


def _symbol() -> Column:
    return F.coalesce("symbol", F.concat(F.lit("anonymous_"), F.col("start") + 1))


def entities(items: DataFrame, corpus: str) -> DataFrame:
    """File, symbol, method and import entities of structure()."""
    c = F.lit(corpus)
    uri = location_uri(c, F.concat(F.lit("src/"), "path"))
    files = items.filter("kind = 'file'").select(code_entity_id(c, F.col("path")).alias("id"), F.col("path").alias("canonical_name"), "kind", uri.alias("first_location_uri"), F.lit(1.0).alias("confidence"))
    symbols = items.filter(OWN).select(code_entity_id(c, _symbol()), _symbol(), "kind", F.concat(uri, F.lit("#"), _symbol()), F.lit(0.9))
    imports = items.select(F.explode("imports").alias("i"), uri.alias("u")).select(code_entity_id(c, F.col("i")), "i", F.lit("import"), "u", F.lit(0.95))
    every = files.union(symbols).union(imports)
    one = every.groupBy("id").agg(F.min_by(F.struct(*every.columns[1:]), F.struct(-F.col("confidence"), "first_location_uri", "canonical_name")).alias("r"), F.count("*").alias("appearance_count"))
    return one.select("id", c.alias("corpus_id"), "r.*", "appearance_count")


#: Items, and the methods of PHP classes alone.
OWN = "kind <> 'file' and (owner is null or lower(path) like '%.php')"


def edges(items: DataFrame, corpus: str) -> DataFrame:
    """defines, calls, imports, extends, implements and instantiates edges, with hashed ids."""
    c = F.lit(corpus)
    uri = location_uri(c, F.concat(F.lit("src/"), "path"))
    own = code_entity_id(c, F.when(F.col("kind") == "file", F.col("path")).otherwise(_symbol()))
    edge = lambda a, b, kind: F.struct(a.alias("a"), b.alias("b"), F.lit(kind).alias("kind"))
    none = F.array().cast("array<struct<a:string,b:string,kind:string>>")
    # the items are read once: to lex them is what takes time
    found = [F.when(F.expr(OWN), F.array(edge(code_entity_id(c, F.coalesce("owner", "path")), own, "defines"))).otherwise(none)]
    for column, kind in (("calls", "calls"), ("imports", "imports"), ("bases", "extends"), ("implements", "implements"), ("instantiates", "instantiates")):
        found.append(F.coalesce(F.transform(column, lambda x: edge(own, code_entity_id(c, x), kind)), none))
    out = items.select(F.explode(F.concat(*found)).alias("e"), uri.alias("location_uri")).select("e.a", "e.b", "e.kind", "location_uri")
    out = out.distinct()
    return out.select(edge_id(c, F.col("a"), F.col("b"), F.col("kind"), F.col("location_uri")).alias("id"), c.alias("corpus_id"), F.col("a").alias("from_entity_id"), F.col("b").alias("to_entity_id"), "kind", "location_uri", F.lit(0.9).alias("confidence"))


def listed_files(spark: SparkSession, root: str, use_git: bool = True) -> DataFrame:
    """(path) of a repository's tracked files, else of all files below root. The list of names is made on the driver; contents are not."""
    import subprocess

    if use_git:
        out = subprocess.run(["git", "-C", root, "ls-files", "-z"], capture_output=True, text=True)
        if out.returncode == 0:
            return spark.createDataFrame([(p,) for p in out.stdout.split("\0") if p], "path string")
    return read_files(spark, root).select("path")
