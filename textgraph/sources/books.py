"""Books: plain text, markdown and EPUB into chapter and scene chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCENE_LEAST, SCENE_MOST = 200, 4000
CHUNK = "corpus_id string, path string, parent_path string, kind string, content string"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, content) of text files; an unknown ending counts as text."""
    files = spark.read.format("binaryFile").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ext == "epub", "epub").when(ext == "md", "markdown").otherwise("text")
    return files.select("path", kind.alias("kind"), "content")


def sentences(text: Column, most: int = SCENE_MOST) -> Column:
    """Sentences packed greedily into parts of most bytes at most; a longer sentence is a part of its own."""
    each = F.regexp_extract_all(text, F.lit(r"(?s)[^.!?]*[.!?]|[^.!?]+$"), 0)
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("part"))

    def add(t, s):
        full = (F.octet_length(t["part"]) + F.octet_length(s) > most) & (t["part"] != "")
        return F.struct(F.when(full, F.array_append(t["done"], t["part"])).otherwise(t["done"]).alias("done"), F.when(full, s).otherwise(F.concat(t["part"], s)).alias("part"))

    packed = F.aggregate(each, empty, add, lambda t: F.array_append(t["done"], t["part"]))
    return F.filter(F.transform(packed, lambda p: F.trim(p)), lambda p: p != "")


def scenes(text: Column) -> Column:
    """Parts between two blank lines; a part under SCENE_LEAST bytes takes in the next, one over SCENE_MOST is cut at sentences."""
    parts = F.filter(F.transform(F.split(text, "\n\n\n"), lambda p: F.trim(p)), lambda p: p != "")
    empty = F.array().cast("array<string>")

    def add(t, p):
        last = F.element_at(t, -1)
        glued = F.concat(F.slice(t, 1, F.size(t) - 1), F.array(F.concat(last, F.lit("\n\n"), p)))
        return F.when((F.size(t) > 0) & (F.octet_length(last) < SCENE_LEAST), glued).otherwise(F.array_append(t, p))

    # F.element_at of an empty array is never evaluated: the size is tested first
    folded = F.aggregate(parts, empty, lambda t, p: F.when(F.size(t) == 0, F.array(p)).otherwise(add(t, p)))
    return F.flatten(F.transform(folded, lambda p: F.when(F.octet_length(p) > SCENE_MOST, sentences(p)).otherwise(F.array(p))))


def text_chunks(books: DataFrame) -> DataFrame:
    """chapter and scene chunks of (corpus_id, content): three blank lines part chapters, which are numbered without empty ones."""
    chapters = F.filter(F.split("content", "\n\n\n\n"), lambda p: F.trim(p) != "")
    ch = books.select("corpus_id", F.posexplode(chapters).alias("k", "content")).withColumn("path", F.concat(F.lit("ch/"), F.col("k") + 1))
    sc = ch.select("corpus_id", F.col("path").alias("parent_path"), F.posexplode(scenes(F.col("content"))).alias("m", "content"))
    sc = sc.select("corpus_id", F.concat("parent_path", F.lit("/sc/"), F.col("m") + 1).alias("path"), "parent_path", F.lit("scene").alias("kind"), "content")
    return ch.select("corpus_id", "path", F.lit(None).cast("string").alias("parent_path"), F.lit("chapter").alias("kind"), F.trim("content").alias("content")).union(sc)


def markdown_chunks(books: DataFrame) -> DataFrame:
    """Level-one headings begin chapters, level-two headings scenes."""
    chapters = F.filter(F.split(F.concat(F.lit("\n"), "content"), r"\n(?=# )"), lambda p: F.trim(p) != "")
    ch = books.select("corpus_id", F.posexplode(chapters).alias("k", "content")).withColumn("path", F.concat(F.lit("ch/"), F.col("k") + 1))
    parts = F.filter(F.split("content", r"\n(?=## )"), lambda p: p.startswith("## "))
    sc = ch.select("corpus_id", F.col("path").alias("parent_path"), F.posexplode(parts).alias("m", "content"))
    sc = sc.select("corpus_id", F.concat("parent_path", F.lit("/sc/"), F.col("m") + 1).alias("path"), "parent_path", F.lit("scene").alias("kind"), "content")
    return ch.select("corpus_id", "path", F.lit(None).cast("string").alias("parent_path"), F.lit("chapter").alias("kind"), F.trim("content").alias("content")).union(sc)


def epub_texts(files: DataFrame) -> DataFrame:
    """(path, k, content): the plain text of each spine item of EPUB files (path, content binary), in order."""

    def run(batches):
        import html
        import io
        import re
        import zipfile

        import pandas as pd

        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    names = z.namelist()
                    opf = next((n for n in names if n.endswith(".opf")), None)
                    if opf is None:
                        continue
                    meta, base = z.read(opf).decode("utf-8", "replace"), opf.rpartition("/")[0]
                    items = {m["id"]: m["href"] for tag in re.findall(r"<item\b[^>]*>", meta) if (m := {k: v for k, v in re.findall(r'(\w+)="([^"]*)"', tag)}).keys() >= {"id", "href"}}
                    for k, ref in enumerate(re.findall(r'<itemref\b[^>]*idref="([^"]*)"', meta)):
                        name = "/".join(filter(None, [base, items.get(ref, "")]))
                        if name in names:
                            page = re.sub(r"(?s)<(script|style|head)\b.*?</\1>", "", z.read(name).decode("utf-8", "replace"))
                            page = re.sub(r"(?i)</(p|div|h[1-6]|li)>|<br\s*/?>", "\n", page)
                            text = html.unescape(re.sub(r"<[^>]+>", "", page)).strip()
                            if text:
                                rows.append((path, k, text))
            yield pd.DataFrame(rows, columns=["path", "k", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, k int, content string")


def identified(chunks: DataFrame) -> DataFrame:
    """Chunks with their id, location and size."""
    from ..functions import content_hash, location_uri

    return chunks.withColumn("id", content_hash(F.col("content"))).withColumn("location_uri", location_uri(F.col("corpus_id"), F.col("path"))).withColumn("byte_length", F.octet_length("content").cast("long"))
