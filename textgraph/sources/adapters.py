"""Source adapters: what one kind of corpus needs on its way from a source to chunks, entities and edges, and a registry of them.

Each adapter is also a Python data source: once installed, spark.read.format(name) gives the rows of `discover`, and
spark.readStream.format(name) those of files that are new since the last batch. Partitions are single files, or row groups of Parquet
files; filters on the columns of a file's name or the row groups' statistics are pushed into the scan.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from ..functions import location_uri, parse_location
from ..operators import extraction as ext
from ..operators.artifacts import tree_version
from ..streaming.reindex import dirty, manifest
from . import books, code, wiki

SOURCE = "corpus_id string, path string, content string"


class SourceAdapter:
    """The extension point of a kind of corpus. Every step takes and gives tables.

    discover gives (corpus_id, path, content) of each source; chunks gives books.CHUNK rows; structure gives entities and
    edges without a model's help. Kinds without a step leave it as it is here.
    """

    kind = ""
    version = "1.0.0"
    #: Chunk kinds to summarise, leaves first.
    summary_levels: tuple[str, ...] = ()

    def discover(self, spark: SparkSession, source: str, corpus: str) -> DataFrame:
        raise NotImplementedError

    def chunks(self, sources: DataFrame) -> DataFrame:
        raise NotImplementedError

    def structure(self, sources: DataFrame) -> tuple[DataFrame, DataFrame] | None:
        return None

    def source_of(self, file: Column) -> Column:
        """A source's path, of the path of its file below the root."""
        return file

    def format_location(self, corpus: Column, path: Column) -> Column:
        return location_uri(corpus, path)

    def parse_location(self, uri: Column) -> Column:
        """struct<corpus_id, path>; a plain path has no corpus."""
        return F.coalesce(parse_location(uri), F.struct(F.lit("").alias("corpus_id"), uri.alias("path")))

    def current_version(self, sources: DataFrame) -> DataFrame:
        """One row: the version of the tree of sources."""
        return tree_version(manifest(sources))

    def changed_sources(self, old: DataFrame | None, sources: DataFrame) -> DataFrame:
        """(path, change) against an earlier manifest (path, hash); all of them where there is none."""
        return dirty(old, manifest(sources))


class BookAdapter(SourceAdapter):
    kind = "book"
    summary_levels = ("scene", "chapter")

    def discover(self, spark: SparkSession, source: str, corpus: str) -> DataFrame:
        files = books.read_texts(spark, source)
        texts = files.filter("kind <> 'epub'").select(F.lit(corpus).alias("corpus_id"), "path", F.decode("content", "UTF-8").alias("content"))
        spine = books.epub_texts(files.filter("kind = 'epub'"))
        return texts.union(spine.select(F.lit(corpus), F.concat("path", F.lit("#"), F.format_string("%06d", "k")), "content"))

    def chunks(self, sources: DataFrame) -> DataFrame:
        marked = F.lower("path").endswith(".md")
        return books.text_chunks(sources.filter(~marked)).union(books.markdown_chunks(sources.filter(marked)))


class WikiAdapter(SourceAdapter):
    kind = "wiki"
    summary_levels = ("section", "page")

    def discover(self, spark: SparkSession, source: str, corpus: str) -> DataFrame:
        return wiki.read_pages(spark, source, corpus)

    def source_of(self, file: Column) -> Column:
        return F.regexp_replace(file, r"\.md$", "")

    def chunks(self, sources: DataFrame) -> DataFrame:
        return wiki.page_chunks(sources)

    def structure(self, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
        return ext.page_entities(sources), ext.page_edges(sources)


class PagesAdapter(WikiAdapter):
    """HTML pages in a table (page_id, url, html) as a wiki."""

    kind = "pages-as-wiki"

    def discover(self, spark: SparkSession, source: str, corpus: str) -> DataFrame:
        return html_pages(spark.read.parquet(source), corpus)


class CodeAdapter(SourceAdapter):
    kind = "code"
    summary_levels = ("function", "class", "file")

    def discover(self, spark: SparkSession, source: str, corpus: str) -> DataFrame:
        return code.read_files(spark, source).select(F.lit(corpus).alias("corpus_id"), "path", "content")

    def _corpus(self, sources: DataFrame) -> str:
        row = sources.select("corpus_id").first()
        return row[0] if row else ""

    def chunks(self, sources: DataFrame) -> DataFrame:
        corpus = self._corpus(sources)
        return code.file_chunks(sources.select("path", "content"), corpus).unionByName(code.passthrough(sources.select("path", "content"), corpus).select("corpus_id", "path", "parent_path", "kind", "content"))

    def structure(self, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
        items, corpus = code.structure(sources.select("path", "content")), self._corpus(sources)
        return code.entities(items, corpus), code.edges(items, corpus)


class Registry:
    """Adapters by kind."""

    def __init__(self, *adapters: SourceAdapter):
        self._of: dict[str, SourceAdapter] = {}
        for a in adapters:
            self.register(a)

    def register(self, adapter: SourceAdapter) -> None:
        """An adapter of a kind that is there already takes its place."""
        self._of[adapter.kind] = adapter

    def get(self, kind: str) -> SourceAdapter | None:
        return self._of.get(kind)

    def require(self, kind: str) -> SourceAdapter:
        if kind not in self._of:
            raise ValueError(f"no adapter for {kind}; there are {', '.join(self.list())}")
        return self._of[kind]

    def list(self) -> list[str]:
        return sorted(self._of)

    @staticmethod
    def install(spark: SparkSession) -> list[str]:
        """Makes the data sources known to the session, which then pushes filters into them: their names."""
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        for source in FORMATS:
            spark.dataSource.register(source)
        return [s.name() for s in FORMATS]


def default_registry() -> Registry:
    return Registry(BookAdapter(), WikiAdapter(), PagesAdapter(), CodeAdapter())


# HTML pages as wiki pages

#: Patterns and replacements ($1), in order, that Java's, Python's and RE2's engines read alike: what tidies text, and what makes markdown of HTML.
TIDY = [
    ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"),
    (r"[ \t]*\n[ \t]*", "\n"), (r"\n{3,}", "\n\n"), (r"^[ \t\r\n]+|[ \t\r\n]+$", ""),
]
MARKDOWN = [
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<(?:script)\b.*?</script>", ""),
    (r"(?is)<style\b.*?</style>", ""),
    (r"(?is)<head\b.*?</head>", ""),
    (r"(?i)<a\b[^>]*href=\"/?([^\"]*)\"[^>]*>([^<]*)</a>", "[[$1|$2]]"),
    (r"(?i)<nav\b[^>]*>", "\n## Navigation\n"),
    (r"(?i)<footer\b[^>]*>", "\n## Footer\n"),
    (r"(?i)<h1\b[^>]*>", "\n# "),
    (r"(?i)<h2\b[^>]*>", "\n## "),
    (r"(?i)<h3\b[^>]*>", "\n### "),
    (r"(?i)<h[456]\b[^>]*>", "\n#### "),
    (r"(?i)<li\b[^>]*>", "\n- "),
    (r"(?i)</?(?:p|br|div|article|section|ul|ol|table|tr)\b[^>]*>|</h[1-6]>", "\n"),
    (r"<[^>]*>", ""),
    *TIDY,
]
#: A page's path: its address without scheme, query, fragment and ending.
ADDRESS = [(r"^[a-z]+://", ""), (r"[?#].*$", ""), (r"\.html?$", ""), (r"/+$", "")]


def _replaced(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, to in rules:
        text = F.regexp_replace(text, pattern, to)
    return text


def html_pages(pages: DataFrame, corpus: str) -> DataFrame:
    """(corpus_id, path, content, page_id): the page's address and number, and its title and text as markdown."""
    title = F.regexp_extract("html", r"(?is)<title\b[^>]*>(.*?)</title>", 1)
    text = F.concat(F.lit("---\ntitle: "), _replaced(title, TIDY), F.lit("\n---\n"), _replaced(F.col("html"), MARKDOWN))
    path = F.concat(_replaced(F.col("url"), ADDRESS), F.lit("~"), "page_id")
    return pages.select(F.lit(corpus).alias("corpus_id"), path.alias("path"), text.alias("content"), "page_id")


def _text_replaced(text: str, rules: list[tuple[str, str]]) -> str:
    for pattern, to in rules:
        text = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", to), text)
    return text


def page_markdown(url: str | None, page_id: int | None, text: str | None) -> tuple[str | None, str | None]:
    """(path, content) of one page, as in html_pages."""
    title = re.search(r"(?is)<title\b[^>]*>(.*?)</title>", text or "")
    path = f"{_text_replaced(url, ADDRESS)}~{page_id}" if url is not None and page_id is not None else None
    content = f"---\ntitle: {_text_replaced(title[1] if title else '', TIDY)}\n---\n{_text_replaced(text, MARKDOWN)}" if text is not None else None
    return path, content


# data sources


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match("^[a-z0-9]+:/", path) else (pafs.LocalFileSystem(), path)


def _files(root: str, suffixes: tuple[str, ...]) -> list[tuple[str, float]]:
    """(path, time of change) of files below root with one of the endings, in order."""
    files, at = _opened(root)
    found = files.get_file_info(at) if files.get_file_info(at).type == pafs.FileType.File else None
    rows = [found] if found else files.get_file_info(pafs.FileSelector(at, recursive=True))
    own = [i for i in rows if i.type == pafs.FileType.File and i.path.lower().endswith(suffixes) and not i.base_name.startswith(("_", "."))]
    return sorted((i.path, i.mtime_ns / 1e9 if i.mtime_ns else 0.0) for i in own)


class FilePart(InputPartition):
    def __init__(self, path: str, group: int = -1):
        super().__init__((path, group))
        self.path, self.group = path, group


class _Reader(DataSourceReader):
    def __init__(self, source: CorpusSource):
        self.source, self.tests = source, []

    def pushFilters(self, filters):
        """Filters that the source can decide for a whole part or row are taken; the others go back to Spark."""
        for f in filters:
            if self.source.takes(f):
                self.tests.append(f)
            else:
                yield f

    def partitions(self):
        return self.source.parts(_files(self.source.root, self.source.suffixes), self.tests)

    def read(self, partition):
        return self.source.rows(partition, self.tests)


class _StreamReader(DataSourceStreamReader):
    """Offsets are times of change and names: a batch holds the files after the last one."""

    def __init__(self, source: CorpusSource):
        self.source = source

    def initialOffset(self):
        return {"time": -1.0, "path": ""}

    def latestOffset(self):
        found = max(((t, p) for p, t in _files(self.source.root, self.source.suffixes)), default=(-1.0, ""))
        return {"time": found[0], "path": found[1]}

    def partitions(self, start, end):
        low, high = ((o["time"], o["path"]) for o in (start, end))
        return self.source.parts([(p, t) for p, t in _files(self.source.root, self.source.suffixes) if low < (t, p) <= high], [])

    def read(self, partition):
        return self.source.rows(partition, [])


class CorpusSource(DataSource):
    """Files below a root as rows of SOURCE."""

    suffixes: tuple[str, ...] = ()
    columns = SOURCE

    def __init__(self, options):
        super().__init__(options)
        self.root, self.corpus = options.get("path", ""), options.get("corpus", self.name())
        if not self.root:
            raise ValueError("load() needs the path of the corpus")

    def schema(self):
        return self.columns

    def reader(self, schema):
        return _Reader(self)

    def streamReader(self, schema):
        return _StreamReader(self)

    def path_of(self, file: str) -> str:
        base = _opened(self.root)[1].rstrip("/")
        return file[len(base) + 1 :] if file.startswith(f"{base}/") else file.rpartition("/")[2]

    def takes(self, f) -> bool:
        return isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute == ("path",)

    def _kept(self, path: str, tests) -> bool:
        test = {EqualTo: lambda f: path == f.value, In: lambda f: path in f.value, StringStartsWith: lambda f: path.startswith(f.value)}
        return all(test[type(f)](f) for f in tests)

    def parts(self, files, tests):
        return [FilePart(p) for p, _ in files if self._kept(self.path_of(p), tests)]

    def rows(self, part, tests):
        files, _ = _opened(self.root)
        with files.open_input_stream(part.path) as f:
            yield self.corpus, self.path_of(part.path), f.read().decode("utf-8", "replace")


class WikiSource(CorpusSource):
    """Markdown pages below a folder."""

    suffixes = (".md",)

    @classmethod
    def name(cls):
        return "textgraph-wiki"

    def path_of(self, file: str) -> str:
        return re.sub(r"\.md$", "", super().path_of(file))

    def parts(self, files, tests):
        return [p for p in super().parts(files, tests) if not self.path_of(p.path).startswith(tuple(wiki.EXCLUDED))]


class CodeSource(CorpusSource):
    """Files of a source tree, without those that are excluded by default."""

    suffixes = ("",)

    @classmethod
    def name(cls):
        return "textgraph-code"

    def parts(self, files, tests):
        from ..functions.text import glob_regex

        out = [re.compile(glob_regex(g)) for g in code.EXCLUDED]
        return [p for p in super().parts(files, tests) if not any(r.match(self.path_of(p.path)) for r in out)]


class PagesSource(CorpusSource):
    """A Parquet table of HTML pages (page_id, url, html), a part for each row group, as wiki pages in markdown.

    Comparisons of page_id are decided by the row groups' statistics first, and then row by row.
    """

    suffixes = (".parquet",)
    columns = f"{SOURCE}, page_id long"

    @classmethod
    def name(cls):
        return "pages-as-wiki"

    _BOUNDS = {EqualTo: ("==", True), GreaterThan: (">", True), GreaterThanOrEqual: (">=", True), LessThan: ("<", True), LessThanOrEqual: ("<=", True)}

    def takes(self, f) -> bool:
        return type(f) in self._BOUNDS and f.attribute == ("page_id",)

    def _holds(self, f, low: int, high: int) -> bool:
        """Whether a row with a number from low to high may pass."""
        return {EqualTo: low <= f.value <= high, GreaterThan: high > f.value, GreaterThanOrEqual: high >= f.value, LessThan: low < f.value, LessThanOrEqual: low <= f.value}[type(f)]

    def parts(self, files, tests):
        out = []
        for path, _ in files:
            store, _ = _opened(self.root)
            meta = pq.ParquetFile(store.open_input_file(path)).metadata
            place = meta.schema.to_arrow_schema().get_field_index("page_id")
            for k in range(meta.num_row_groups):
                s = meta.row_group(k).column(place).statistics
                if s is None or not s.has_min_max or all(self._holds(f, s.min, s.max) for f in tests):
                    out.append(FilePart(path, k))
        return out

    def rows(self, part, tests):
        store, _ = _opened(self.root)
        with store.open_input_file(part.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=1000, row_groups=[part.group], columns=["page_id", "url", "html"]):
                rows = [r for r in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True) if all(r[0] is not None and self._holds(t, r[0], r[0]) for t in tests)]
                made = [page_markdown(url, k, text) for k, url, text in rows]
                yield pa.RecordBatch.from_arrays([pa.array([self.corpus] * len(rows), pa.string()), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.string()), pa.array([r[0] for r in rows], pa.int64())], names=["corpus_id", "path", "content", "page_id"])


FORMATS = [WikiSource, CodeSource, PagesSource]
