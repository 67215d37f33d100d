"""Tables as immutable Parquet snapshots, and the shared folder for intermediate ones."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterable
from contextlib import contextmanager
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import edge_id
from .schema import HEAD, KEYS, PIPELINE_VERSION, schema

GONE = "delta__gone"
#: How tables are compressed: ids are hexadecimal digests, which it halves.
CODEC = "zstd"
#: How much larger than its files a table may be: repeated text takes a hundredth.
UNPACKED = 100.0

_OWN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application in spark.checkpoint.dir, which all executors share; it goes when the driver ends.

    Where the session names none, a local one serves a local master, as in tests; a cluster must name one.
    """
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        known = context._jsc.sc().getCheckpointDir()
        if known.isEmpty():
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="textgraph-"))
            known = context._jsc.sc().getCheckpointDir()
        at = known.get()
    own = f"{at.rstrip('/')}/textgraph-{context.applicationId}"
    if own not in _OWN:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _OWN.add(own)
    return own


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=CODEC)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int, order: bool = False, path: str | None = None) -> DataFrame:
    """df as a table in the shared folder, in buckets by key (each sorted by it, if so wanted): joins on key with as many partitions don't shuffle it."""
    made = f"{name}-{uuid.uuid4().hex}"
    path, table = path or f"{shared_dir(df.sparkSession)}/{made}", made.replace("-", "_")
    writer = df.write.format("parquet").bucketBy(buckets, key)
    (writer.sortBy(key) if order else writer).option("path", path).saveAsTable(table)
    return _unlisted(df.sparkSession, table)


def _unlisted(spark: SparkSession, table: str) -> DataFrame:
    """A table of files at a path of its own, without its entry in the catalog: what is read stays readable, in buckets, while the files do."""
    df = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return df


def reopened(spark: SparkSession, path: str, columns: str, key: str, buckets: int) -> DataFrame:
    """A table that `bucketed` wrote in order, with the names and types of its columns."""
    table = f"{path.rstrip('/').rsplit('/', 1)[-1]}-{uuid.uuid4().hex}".replace("-", "_")
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return _unlisted(spark, table)


@contextmanager
def sorted_scans(spark: SparkSession):
    """Within, plans trust the order of bucketed tables, so that merge joins of them don't sort again."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def honest_sizes(spark: SparkSession):
    """Within, plans take tables for UNPACKED times their files, which compress well: no table goes through the driver because its file is small."""
    name = "spark.sql.sources.fileCompressionFactor"
    before = spark.conf.get(name)
    spark.conf.set(name, str(UNPACKED))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Conflict(RuntimeError):
    """Another writer was first."""


class Folder:
    """Small files in a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, at: str):
        self.at, self._path = at.rstrip("/"), spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.at).getFileSystem(spark._jsc.hadoopConfiguration())
        self._read = spark._jvm.org.apache.hadoop.io.IOUtils
        self._buffer = spark._jvm.java.io.ByteArrayOutputStream
        self._gateway, self._rename = spark.sparkContext._gateway, getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        self._context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.at).toUri(), spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        at = self._path(self.at)
        return sorted(s.getPath().getName() for s in self._files.listStatus(at)) if self._files.exists(at) else []

    def put(self, name: str, text: str) -> bool:
        """Writes a file as a whole, by a rename that replaces nothing; false where another writer was first."""
        temporary = self._path(f"{self.at}/_{name}-{uuid.uuid4().hex}")
        out = self._files.create(temporary)
        out.write(bytearray(text.encode()))
        out.close()
        options = self._gateway.new_array(self._rename, 1)
        options[0] = getattr(self._rename, "NONE")
        try:
            self._context.rename(temporary, self._path(f"{self.at}/{name}"), options)
        except Py4JJavaError as e:
            self._files.delete(temporary, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        return True

    def remove(self, name: str) -> None:
        """Deletes a file or folder, if there."""
        self._files.delete(self._path(f"{self.at}/{name}"), True)

    def exists(self) -> bool:
        return self._files.exists(self._path(self.at))

    def size(self) -> int:
        """Bytes of all files below."""
        return self._files.getContentSummary(self._path(self.at)).getLength()

    def get(self, name: str) -> str:
        source, to = self._files.open(self._path(f"{self.at}/{name}")), self._buffer()
        self._read.copyBytes(source, to, 4096, True)
        return bytes(to.toByteArray()).decode()


#: Deltas of one level that are merged into one of the next.
FANOUT = 8


def _packed(name: str, df: DataFrame) -> DataFrame:
    """A table as it is stored: digests don't compress, so ids that edges' other columns give are left out."""
    given = _given_id(name, df)
    return df if given is None else df.withColumn("id", F.when(~F.col("id").eqNullSafe(given), F.col("id")))


def _unpacked(name: str, df: DataFrame) -> DataFrame:
    given = _given_id(name, df)
    return df if given is None else df.withColumn("id", F.coalesce("id", given))


def _given_id(name: str, df: DataFrame):
    parts = ["corpus_id", "from_entity_id", "to_entity_id", "kind", "location_uri"]
    return edge_id(*map(F.col, parts)) if name.removesuffix("_history") == "edges" and {"id", *parts} <= set(df.columns) else None


class Catalog:
    """Head and history tables under one folder, by version.

    A version is one manifest, a small file that names the files of every table, so readers see all of a version or
    nothing. It is put in place by a rename that replaces nothing: of two writers on one version the second goes on
    from the first's, unless that changed a table which the second has read or writes, which is a Conflict.

    A table is a base and deltas: rows that replace those of their key, or mark it as gone. Deltas merge in levels, and
    into the base when they hold half as many rows, so a change costs what changed and a logarithm. Tables without a key
    only grow, by parts that merge in levels. Keys are never null.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._versions = Folder(spark, f"{self.root}/_versions")
        self._known: dict[int, dict] = {0: {}}

    # reading

    def version(self) -> int:
        names = self._versions.names()
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _manifest(self, version: int) -> dict:
        """The entries of a version by table; manifests never change."""
        if version not in self._known:
            self._known[version] = json.loads(self._versions.get(f"{version:012}"))
        return self._known[version]

    def table(self, name: str, version: int | None = None) -> DataFrame:
        entry = self._manifest(self.version() if version is None else version).get(name)
        return self._read(name, entry) if entry else self.spark.createDataFrame([], schema(name))

    def changed_at(self, name: str) -> int:
        """The last version that changed a table, 0 where none did."""
        entry = self._manifest(self.version()).get(name)
        return entry["changed"] if entry else 0

    def _files(self, name: str, paths: list[str]) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_unpacked(name, self.spark.read.parquet(p)) for p in paths])

    def _read(self, name: str, entry: dict) -> DataFrame:
        base = self._files(name, [p for _, p, _ in entry["parts"]]) if entry["parts"] else self.spark.createDataFrame([], schema(name))
        if not entry["deltas"]:
            return base
        keys, last = KEYS[name], self._last(name, entry["deltas"])
        # deltas are small beside the base, or have become part of it
        kept = base.join(last.select(*keys), keys, "left_anti").select(*base.columns)
        return kept.unionByName(last.filter(~F.col(GONE)).drop(GONE), allowMissingColumns=True).select(*base.columns)

    def _last(self, name: str, deltas: list) -> DataFrame:
        """The last row of each key among deltas."""
        every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_unpacked(name, self.spark.read.parquet(p)).withColumn("delta__no", F.lit(k)) for k, (_, p, _) in enumerate(deltas)])
        order = Window.partitionBy(*KEYS[name]).orderBy(F.desc("delta__no"))
        return every.withColumn("delta__k", F.row_number().over(order)).filter("delta__k = 1").drop("delta__k", "delta__no")

    # writing

    def _write(self, name: str, df: DataFrame) -> tuple[str, int]:
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        _packed(name, df).write.parquet(path, compression=CODEC)
        return path, self.spark.read.parquet(path).count()

    def _merged(self, name: str, parts: list, keyed: bool) -> list:
        """parts with the last FANOUT of one level as one of the next, as often as there are so many."""
        while len(parts) >= FANOUT and len({level for level, _, _ in parts[-FANOUT:]}) == 1:
            few = parts[-FANOUT:]
            rows = self._last(name, few) if keyed else self._files(name, [p for _, p, _ in few])
            parts = [*parts[:-FANOUT], [few[0][0] + 1, *self._write(name, rows.coalesce(max(1, sum(n for *_, n in few) // 1_000_000)))]]
        return parts

    def commit(self, base: int | None = None, **tables: DataFrame) -> int:
        """The next version, with these tables as a whole. base is the version that the writer has read, if it has."""
        return self.write(replaced=tables, base=base)

    def write(self, replaced: dict[str, DataFrame] | None = None, changed: dict[str, tuple[DataFrame | None, DataFrame | None]] | None = None, appended: dict[str, DataFrame] | None = None, base: int | None = None, reads: Iterable[str] = ()) -> int:
        """The next version: whole tables, changes (rows, keys that go) of tables with a key, and rows for tables that only grow.

        With a base, a table that is read or changed here and has changed since is a Conflict; rows that are appended, and the log, are none.
        """
        replaced, changed, appended = replaced or {}, changed or {}, appended or {}
        for name in [*replaced, *changed, *appended]:
            assert name.removesuffix("_history") in HEAD, name
        made = {name: ("replaced", [0, *self._write(name, df)]) for name, df in replaced.items()}
        for name, (rows, gone) in changed.items():
            marked = [] if rows is None else [rows.withColumn(GONE, F.lit(False))]
            marked += [] if gone is None else [gone.select(*KEYS[name]).withColumn(GONE, F.lit(True))]
            delta = [0, *self._write(name, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked))]
            if delta[2]:
                made[name] = ("changed", delta)
        for name, df in appended.items():
            part = [0, *self._write(name, df)]
            if part[2]:
                made[name] = ("appended", part)
        touched = ({n for n, (how, _) in made.items() if how != "appended"} | set(reads)) - {"runs"}
        while True:
            now = self.version()
            entries = dict(self._manifest(now))
            if base is not None and (others := sorted(n for n in touched if n in entries and entries[n]["changed"] > base)):
                raise Conflict(f"changed since version {base}: {', '.join(others)}")
            for name, (how, part) in made.items():
                entries[name] = self._entry(name, how, part, entries.get(name, {"parts": [], "deltas": []}), now + 1)
            if self._versions.put(f"{now + 1:012}", json.dumps(entries)):
                return now + 1

    def _entry(self, name: str, how: str, part: list, old: dict, version: int) -> dict:
        if how == "replaced":
            return {"parts": [part], "deltas": [], "changed": version}
        if how == "appended":
            return {"parts": self._merged(name, [*old["parts"], part], False), "deltas": old["deltas"], "changed": version}
        entry = {"parts": old["parts"], "deltas": self._merged(name, [*old["deltas"], part], True), "changed": version}
        if 2 * sum(n for *_, n in entry["deltas"]) >= sum(n for *_, n in entry["parts"]):
            entry |= {"parts": [[0, *self._write(name, self._read(name, entry))]], "deltas": []}
        return entry

    def reading(self) -> Transaction:
        return Transaction(self)

    def info(self) -> DataFrame:
        """Tables with the version that last changed them, their files, bytes and rows before deltas are applied, and the version of the schema."""
        rows = []
        for name, entry in sorted(self._manifest(self.version()).items()):
            parts = [*entry["parts"], *entry["deltas"]]
            rows.append((name, entry["changed"], len(parts), sum(Folder(self.spark, p).size() for _, p, _ in parts), sum(n for *_, n in parts), PIPELINE_VERSION))
        return self.spark.createDataFrame(rows, "table string, version long, snapshots long, bytes long, rows long, schema_version int")


class Transaction:
    """Reads of one version, and a commit that fails if what was read has changed since."""

    def __init__(self, catalog: Catalog):
        self.catalog, self.base, self.reads = catalog, catalog.version(), set()

    def table(self, name: str) -> DataFrame:
        self.reads.add(name)
        return self.catalog.table(name, self.base)

    def commit(self, **what) -> int:
        """As Catalog.write: replaced, changed, appended."""
        return self.catalog.write(**what, base=self.base, reads=self.reads)
