"""Proportional stratified interleaving into shards whose row counts differ by one at most.

Rows are shuffled by a seeded hash and ranked within their source; rank r of n becomes the fraction (2r + 1) / 2n. In the
order of these fractions each source is spread evenly, so every contiguous cut holds the sources in the corpus's mixture.

No source is ranked in one task: the shuffled order is cut into hash buckets, a small table of bucket counts gives each
bucket its offset, and rows are numbered inside a bucket. The global order of the fractions is numbered the same way.
Rows with the same doc_id and text in one source can't be told apart: they are counted first, numbered as one, and take
the places of their number, so that no bucket holds more of them than its hashes allow.

Law: `rows`. Equal texts are separate rows, so copies are spread like all else. Edge cases: a null source is a source
of its own, a null text has size 16 and the CRC of the empty string, a null doc_id counts as no characters; an empty
table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slots

SHARDS = 40
SEED = 20
ROWS_PER_BUCKET = 200_000
#: Rows that can't be told apart, in one piece.
COPIES = 100_000


def shuffle_hash(doc_id: Column, text_crc32: Column, seed: int) -> Column:
    """60 bits of MD5, which any SQL engine can repeat. The text's part of it parts rows without an id."""
    of = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text_crc32.cast("string"))
    return F.conv(F.substring(F.md5(of), 1, 15), 16, 10).cast("long")


def _offsets(rows: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """Rows before each bucket, within the keys; a table of one row a bucket."""
    counts = rows.groupBy(*keys, bucket).agg(F.sum("copies").alias("n"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*keys, bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))


def positions(docs: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row; docs needs doc_id, text and source."""
    text = F.coalesce("text", F.lit(""))
    stratum = F.coalesce(F.concat(F.lit("s:"), F.col("source").cast("string")), F.lit("null"))
    rows = docs.select("doc_id", stratum.alias("stratum"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.groupBy("stratum", "doc_id", "text_crc32", "size").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("h", shuffle_hash(F.col("doc_id"), F.col("text_crc32"), seed))
    strata = rows.groupBy("stratum").agg(F.sum("copies").alias("n_source"))
    total = strata.agg(F.sum("n_source")).first()[0] or 0
    n = max(4 * slots(docs.sparkSession), -(-total // ROWS_PER_BUCKET))
    n = 1 << (n - 1).bit_length()
    width = (1 << 60) // n
    rows = rows.withColumn("bucket", F.expr(f"h div {width}"))
    order = Window.partitionBy("stratum", "bucket").orderBy("h", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.join(_offsets(rows, ["stratum"], "bucket"), ["stratum", "bucket"]).join(strata, "stratum")
    ranked = ranked.withColumn("r", F.coalesce(F.sum("copies").over(order), F.lit(0)) + F.col("offset"))
    # each copy has a rank of its own; very many are dealt over the tasks before they become rows
    many = ranked.filter(F.col("copies") > COPIES).withColumn("from", F.explode(F.expr(f"sequence(0L, copies - 1, {COPIES}L)")))
    many = many.repartition(slots(docs.sparkSession), "h", "from").withColumn("copies", F.least(F.col("copies") - F.col("from"), F.lit(COPIES)))
    ranked = ranked.filter(F.col("copies") <= COPIES).withColumn("from", F.lit(0).cast("long")).unionByName(many)
    ranked = ranked.withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)"))).withColumn("r", F.col("r") + F.col("from") + F.col("copy")).withColumn("copies", F.lit(1).cast("long"))
    # compared as integers: floor((2r + 1) * n / 2n_source) is monotone in the fraction
    spread = ranked.withColumn("part", F.expr(f"((2 * r + 1) * {n}) div (2 * n_source)")).drop("bucket", "offset", "from", "copy")
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.expr("(2 * r + 1) / (2D * n_source)"), "stratum", "r")) - 1
    whole = spread.join(_offsets(spread, [], "part"), "part").withColumn("g", place + F.col("offset"))
    total = max(total, 1)
    shard = whole.withColumn("shard", F.expr(f"cast((g * {shards}) div {total} as int)"))
    return shard.select("doc_id", "size", "text_crc32", "shard", F.expr(f"g - (shard * {total}L + {shards - 1}) div {shards}").alias("slot"))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = positions(docs, SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The CRC-32 of the bytes is a fold through a table of 256 values, which the first two lines make; buckets play no part.
SQL = f"""
WITH c AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
b AS (SELECT doc_id, coalesce('s:' || source, 'null') AS stratum, hex(encode(coalesce(text, ''))) AS x FROM documents),
t AS (SELECT doc_id, stratum, length(x) // 2 + 16 AS size, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda a, y: xor(a >> 8, tab[1 + (xor(a, y) & 255)]))) AS text_crc32 FROM b, c),
h AS (SELECT *, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || text_crc32), 1, 15))::BIGINT AS h FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id NULLS FIRST, text_crc32, size) - 1 AS r, count(*) OVER (PARTITION BY stratum) AS n FROM h),
g AS (SELECT *, row_number() OVER (ORDER BY (2 * r + 1) / (2 * n)::DOUBLE, stratum, r) - 1 AS g, count(*) OVER () AS total FROM r),
s AS (SELECT *, g * {SHARDS} // total AS shard FROM g)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INTEGER AS shard, g - (shard * total + {SHARDS - 1}) // {SHARDS} AS slot, NULL::INTEGER AS grown_shard FROM s
"""
