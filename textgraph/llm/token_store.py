"""Token ids in files of directly addressable codes (DACs).

An id is split into 8-bit chunks, low chunk first. Level k holds the k-th chunks of the ids that have one, a bitmap that
tells which of them continue in level k + 1, and a rank directory (set bits before each 512-bit block), so the position
in the next level is one directory entry plus the set bits of one block: any token is read without decoding others.

File (little-endian): magic "DAC1", u32 levels, u64 documents, u64 tokens; i64 doc_id and u8 "has an id" of each
document, u64 start of each document and the end; then for each level u64 n, n chunk bytes, ceil(n / 8) bitmap bytes
and ceil(n / 512) u64 directory entries. Files are cells of a Parquet table (file_no, first_token, data), which any
store that Spark writes can hold and whose commit survives lost executors. They follow each other in ascending doc_id.

Edge cases: a null or empty text has only the end id; a null doc_id comes first; rows of equal doc_id follow each other,
ordered by text; an empty table gives no files; other columns aren't stored;
texts of any length, such as millions of spaces, are encoded whole. Added tokens of the tokenizer file
(<|endoftext|>) that occur in a text get their own ids, as in the tokenizers library, or without `added` are ordinary text.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, written

END = 2
FILE_TOKENS = 1 << 20
#: Documents of one range of ids, which one task encodes.
RANGE_DOCS = 1 << 15
#: Starts of this many files at most are broadcast; beyond, the join shuffles.
BROADCAST_FILES = 500_000
BLOCK = 512
#: Runs of so much white space are cut before the pattern sees them.
WHITE_RUN = 10_000
# fixed values: what the pattern takes for white space
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_WHITE = re.compile(f"[{WHITE}]{{{WHITE_RUN},}}")
# fixed values: the word pattern of byte-level BPE
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def pack(doc_ids: list, starts: np.ndarray, ids: np.ndarray) -> bytes:
    """One file of documents whose ids lie one after another."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more.astype(np.uint64), np.arange(0, len(more), BLOCK)) if len(more) else np.zeros(0, np.uint64)
        before = (np.cumsum(ones) - ones).astype("<u8")
        levels += [struct.pack("<Q", len(rest)), (rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), before.tobytes()]
        rest = rest[more] >> 8
        if not len(rest):
            break
    head = [b"DAC1", struct.pack("<IQQ", len(levels) // 4, len(doc_ids), len(ids))]
    head += [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is not None for d in doc_ids], np.uint8).tobytes(), starts.astype("<u8").tobytes()]
    return b"".join(head + levels)


class TokenFile:
    """Reads a file: documents, single tokens and ranges."""

    def __init__(self, data: bytes):
        data = memoryview(data)
        assert bytes(data[:4]) == b"DAC1"
        n_levels, n_docs, self.n = struct.unpack_from("<IQQ", data, 4)
        at = 24
        ids = np.frombuffer(data, "<i8", n_docs, at)
        has = np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs)
        at += 9 * n_docs
        self.doc_ids = [int(i) if h else None for i, h in zip(ids, has)]
        self.starts = np.frombuffer(data, "<u8", n_docs + 1, at).astype(np.int64)
        at += 8 * (n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            bits = np.frombuffer(data, np.uint8, -(-n // 8), at + 8 + n)
            blocks = -(-n // BLOCK)
            at += 8 + n + len(bits)
            self.levels.append((chunks, bits, np.frombuffer(data, "<u8", blocks, at)))
            at += 8 * blocks

    def token(self, i: int) -> int:
        """The i-th id of the file, by one directory entry and one bitmap block a level."""
        value = shift = 0
        for chunks, bits, before in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            part = np.unpackbits(bits[block * BLOCK // 8 : (i >> 3) + 1], bitorder="little")[: i - block * BLOCK]
            i, shift = int(before[block]) + int(part.sum()), shift + 8
        return value

    def ids(self, doc: int) -> np.ndarray:
        """The ids of the doc-th document, and of no other."""
        at, end = int(self.starts[doc]), int(self.starts[doc + 1])
        out, place, shift = np.zeros(end - at, np.uint32), np.arange(end - at), 0
        for chunks, bits, before in self.levels:
            out[place] |= chunks[at:end].astype(np.uint32) << np.uint32(shift)
            first = at // BLOCK * BLOCK
            flags = np.unpackbits(bits[first // 8 : -(-end // 8)], bitorder="little")[: end - first]
            own = flags[at - first :].astype(bool)
            if not own.any():
                break
            ahead = int(before[at // BLOCK]) + int(flags[: at - first].sum())
            place, at, shift = place[own], ahead, shift + 8
            end = at + len(place)
        return out


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoding(spec: str):
    """The tokenizer of a byte-level BPE file of the tokenizers library, whose ids are in merge order, as tiktoken's (the same ids, several times as fast)."""
    import tiktoken

    whole = json.loads(spec)
    model, tokens = whole["model"], whole.get("added_tokens") or []
    if any(t.get(k) for t in tokens for k in ("single_word", "lstrip", "rstrip")) or any(c in WHITE for t in tokens for c in t["content"]):
        raise ValueError("added tokens that take in or depend on what surrounds them aren't supported")
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
    merged = {"".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]}
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in model["vocab"].items() if len(piece) == 1 or piece in merged}
    return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in tokens})


def token_ids(own, text: str, added: bool = True) -> np.ndarray:
    """The ids of a text of any length.

    The pattern's look-ahead runs out of stack on some 700,000 characters of white space. A long run is cut as the
    pattern would cut it: all but its last character before other text, the whole run before an added token or the end.
    """
    allowed = "all" if added else set()
    plain = lambda t: own.encode_to_numpy(t, allowed_special=allowed, disallowed_special=())
    if len(text) < WHITE_RUN or not LONG_WHITE.search(text):
        return np.asarray(plain(text), np.uint32)
    out, at, tokens = [], 0, tuple(own.special_tokens_set) if added else ()
    for run in LONG_WHITE.finditer(text):
        end = run.end()
        stop = end if end == len(text) or tokens and text.startswith(tokens, end) else end - 1
        out += [plain(text[at : run.start()]), own._encode_single_piece(text[run.start() : stop].encode())]
        at = stop
    return np.concatenate([np.asarray(x, np.uint32) for x in [*out, plain(text[at:])]])


def write_files(docs: DataFrame, path: str | None = None, end: int = END, file_tokens: int = FILE_TOKENS, added: bool = True) -> DataFrame:
    """The table of files (file_no, n_tokens, first_token, data) in ascending doc_id order."""
    with open(path or default_tokenizer(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        from pyspark import TaskContext

        own = encoding(spec.value)
        part, seq = TaskContext.get().partitionId(), 0
        ids, docs_in, held = [], [], 0

        def file():
            nonlocal seq, ids, docs_in, held
            starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            data = pack(docs_in, starts, np.concatenate(ids))
            row = pa.RecordBatch.from_arrays([pa.array([(part << 32) + seq], pa.int64()), pa.array([held], pa.int64()), pa.array([data], pa.binary())], names=["file_no", "n_tokens", "data"])
            seq, ids, docs_in, held = seq + 1, [], [], 0
            return row

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                x = np.append(token_ids(own, text or "", added), np.uint32(end))
                ids.append(x)
                docs_in.append(doc_id)
                held += len(x)
                if held >= file_tokens:
                    yield file()
        if docs_in:
            yield file()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(partitions(rows, RANGE_DOCS), "doc_id").sortWithinPartitions("doc_id", "text")
    files = written(ordered.mapInArrow(run, "file_no long, n_tokens long, data binary"), "token-files")
    # the tokens before each partition of documents, and before each file within its partition
    sizes = files.select("file_no", "n_tokens", F.shiftright("file_no", 32).alias("part"))
    earlier = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    parts = parts.select("part", earlier(Window.orderBy("part")).alias("of_part"))
    within = sizes.select("file_no", "part", earlier(Window.partitionBy("part").orderBy("file_no")).alias("of_file"))
    starts = within.join(F.broadcast(parts), "part").select("file_no", (F.col("of_part") + F.col("of_file")).alias("first_token"))
    # 16 bytes a file; the files themselves stay where they are unless there are too many
    few = files.count() <= BROADCAST_FILES
    return files.join(F.broadcast(starts) if few else starts, "file_no")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from its file."""

    def run(batches):
        for batch in batches:
            for data, first in zip(batch.column("data"), batch.column("first_token").to_pylist(), strict=True):
                own = TokenFile(data.as_buffer())
                n = len(own.doc_ids)
                crc = [zlib.crc32(own.ids(k).astype("<u4").tobytes()) for k in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(own.doc_ids, pa.int64()), pa.array(own.starts[:-1] + first), pa.array(np.diff(own.starts)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("data", "first_token").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, docs: DataFrame, added: bool = True) -> DataFrame:
    return read_files(write_files(docs, added=added))
