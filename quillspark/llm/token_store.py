"""Token ids in patched frame-of-reference blocks (operator 2).

A file is a row of sections, each `kind` (1 byte), payload length (8 bytes), payload, and a closing newline byte that
belongs to the format. Sections B hold blocks of 128 ids: minimum (4 bytes), width (1), number of exceptions (1), the
differences' low `width` bits packed into 64-bit words, exceptions' places (1 byte each) and high parts (4 bytes each).
The last section, F, is the index: shard number, ids, documents, blocks, then the byte offset of every block's start,
the document ids and each document's number of ids. All integers are little-endian. Files are written and read through
Spark's own file systems, so the folder can lie in any store that Spark knows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _common as C
from .bpe import by_library, shared_coder

BLOCK = 128
#: Share of a block's differences that the packed width must hold; the others are exceptions.
PERCENTILE = 90


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit lengths of unsigned 32-bit values."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def pack(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """Whole blocks of ids (the last may be short: it is filled up with its own last id) and each block's offset."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return b"", np.zeros(0, np.int64)
    full = np.full(n * BLOCK, ids[-1], np.uint32)
    full[: len(ids)] = ids
    full = full.reshape(n, BLOCK)
    least = full.min(1)
    diff = full - least[:, None]
    bits = _bits(diff)
    k = min(BLOCK - 1, BLOCK * percentile // 100)
    width = np.partition(bits, k, axis=1)[:, k].astype(np.int64)
    over = bits > width[:, None]
    counts = over.sum(1)
    sizes = 6 + 8 * (-(-width * BLOCK // 64)) + 5 * counts
    at = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    out[at[:, None] + np.arange(4)] = least.astype("<u4").view(np.uint8).reshape(n, 4)
    out[at + 4], out[at + 5] = width, counts
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        if w:
            low = (diff[rows] & np.uint32((1 << w) - 1 if w < 32 else 0xFFFFFFFF)).astype(np.uint64).T.copy()
            words = np.zeros((w * BLOCK // 64, len(rows)), np.uint64)
            for j in range(BLOCK):
                q, r = divmod(j * w, 64)
                words[q] |= low[j] << np.uint64(r)
                if r + w > 64:
                    words[q + 1] |= low[j] >> np.uint64(64 - r)
            packed = words.T.copy().astype("<u8").view(np.uint8).reshape(len(rows), -1)
            out[at[rows, None] + 6 + np.arange(packed.shape[1])] = packed
    row, col = np.nonzero(over)
    if len(row):
        begin = at[row] + 6 + 8 * (width[row] * BLOCK // 64)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        out[begin + nth] = col
        high = (diff[row, col] >> width[row].astype(np.uint32)).astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(begin + counts[row] + 4 * nth)[:, None] + np.arange(4)] = high
    return out.tobytes(), at


def unpack(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at the offsets `at` of data, 128 each."""
    n = len(at)
    out = np.zeros((n, BLOCK), np.uint32)
    if not n:
        return out.reshape(-1)
    least = data[at[:, None] + np.arange(4)].copy().view("<u4").reshape(-1)
    width, counts = data[at + 4].astype(np.int64), data[at + 5].astype(np.int64)
    for w in np.unique(width).tolist():
        if not w:
            continue
        rows = np.flatnonzero(width == w)
        words = data[at[rows, None] + 6 + np.arange(8 * (w * BLOCK // 64))].copy().view("<u8").T.copy()
        mask = np.uint64((1 << w) - 1)
        low = np.empty((BLOCK, len(rows)), np.uint32)
        for j in range(BLOCK):
            q, r = divmod(j * w, 64)
            x = words[q] >> np.uint64(r)
            if r + w > 64:
                x = x | (words[q + 1] << np.uint64(64 - r))
            low[j] = x & mask
        out[rows] = low.T
    if counts.any():
        row = np.repeat(np.arange(n), counts)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = at[row] + 6 + 8 * (width[row] * BLOCK // 64)
        high = data[(begin + counts[row] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").reshape(-1)
        out[row, data[begin + nth]] |= high << width[row].astype(np.uint32)
    return (out + least[:, None]).reshape(-1)


def _section(kind: bytes, payload: bytes) -> bytes:
    return kind + struct.pack("<Q", len(payload)) + payload


class Shard:
    """A file's bytes: its index, and ids of any range from the blocks that hold them."""

    def __init__(self, content: bytes):
        self.data = np.frombuffer(content, np.uint8)
        end = len(content) - 1
        (back,) = struct.unpack_from("<Q", content, end - 8)
        at = end - back
        if content[at : at + 1] != b"F" or content[end:] != b"\n":
            raise ValueError("not a file of token blocks, or cut short")
        self.number, self.n_ids, n_docs, n_blocks = struct.unpack_from("<4Q", content, at + 9)
        p = at + 9 + 32
        self.blocks = np.frombuffer(content, "<i8", n_blocks, p)
        self.doc_ids = np.frombuffer(content, "<i8", n_docs, p + 8 * n_blocks)
        self.known = np.frombuffer(content, np.uint8, n_docs, p + 8 * (n_blocks + n_docs)).astype(bool)
        self.counts = np.frombuffer(content, "<i8", n_docs, p + 8 * (n_blocks + n_docs) + n_docs)
        self.starts = np.cumsum(self.counts) - self.counts

    def ids(self, start: int, n: int) -> np.ndarray:
        a, b = start // BLOCK, -(-(start + n) // BLOCK)
        return unpack(self.data, self.blocks[a:b])[start - a * BLOCK : start - a * BLOCK + n]


def write_shards(df: DataFrame, path: str, tokenizer: str, end_id: int, shards: int | None = None) -> None:
    """Encodes every whole text, appends end_id, and writes the ids in ascending doc_id order, a file per range of ids.

    Columns doc_id and text are read. Null texts count as empty; a null doc_id comes first, marked as null in the
    index; rows of the same doc_id follow in the order of their texts' hashes. An empty table writes no file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared_coder(tokenizer, lambda: by_library, "library")
        rest, at, docs, known, counts, blocks, n = np.zeros(0, np.uint32), 0, [], [], [], [], 0

        def section(ids: np.ndarray) -> bytes:
            nonlocal at
            payload, starts = pack(ids)
            blocks.append(starts + at + 9)
            at += len(payload) + 10
            return _section(b"B", payload)

        def rows(*values: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], ["value"])

        for b in C.steps(batches, "text", keep=True):
            ids, sizes = coder.encode(b.column(1))
            ids = np.insert(ids, np.cumsum(sizes), end_id)
            docs.append(np.asarray(b.column(0).fill_null(0), np.int64))
            known.append(~np.asarray(b.column(0).is_null()))
            counts.append(sizes + 1)
            n += int(counts[-1].sum())
            stream = np.concatenate([rest, ids])
            whole = len(stream) // BLOCK * BLOCK
            rest = stream[whole:]
            if whole:
                yield rows(section(stream[:whole]))
        if docs:
            last = [section(rest)] if len(rest) else []
            starts = np.concatenate(blocks).astype("<i8")
            d, k, c = np.concatenate(docs).astype("<i8"), np.concatenate(known), np.concatenate(counts).astype("<i8")
            payload = struct.pack("<4Q", TaskContext.get().partitionId(), n, len(d), len(starts)) + starts.tobytes() + d.tobytes() + k.astype(np.uint8).tobytes() + c.tobytes()
            yield rows(*last, _section(b"F", payload + struct.pack("<Q", len(payload) + 8 + 9)))

    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tie = F.xxhash64("text")
    shards = shards or C.spread(docs)
    laid = docs.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    laid.mapInArrow(run, "value binary").selectExpr("CAST(value AS STRING) AS value").write.option("compression", "none").text(path)


def read_documents(spark, path: str) -> DataFrame:
    """From the files: a row per document with shard, place, start within the shard, n_tokens and crc32 of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                s = Shard(content.as_buffer().to_pybytes())
                crcs = np.zeros(len(s.counts), np.int64)
                a = 0
                while a < len(s.counts):  # a stretch of documents at a time, in whole
                    b = max(a + 1, int(np.searchsorted(s.starts, s.starts[a] + (1 << 20))))
                    lo, hi = int(s.starts[a]), int(s.starts[b - 1] + s.counts[b - 1])
                    raw = memoryview(s.ids(lo, hi - lo).astype("<u4").tobytes())
                    for k in range(a, b):
                        i = 4 * (int(s.starts[k]) - lo)
                        crcs[k] = zlib.crc32(raw[i : i + 4 * int(s.counts[k])])
                    a = b
                n = len(s.counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, s.number, np.int64)), pa.array(np.arange(n)), pa.array(s.doc_ids, mask=~s.known), pa.array(s.starts), pa.array(s.counts), pa.array(crcs)], ["shard", "place", "doc_id", "at", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").load(path)
    return files.select("content").mapInArrow(run, "shard long, place long, doc_id long, at long, n_tokens long, ids_crc32 long")


def stored(df: DataFrame, tokenizer: str, end_id: int, shards: int | None = None) -> DataFrame:
    """Writes df's texts with write_shards, reads the files back, and gives each document its start in the whole.

    Returns doc_id, start, n_tokens, ids_crc32, shard. The starts of shards are sums over one row per file.
    """
    spark = df.sparkSession
    if df.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")
    path = C.new_path(spark, "tokens")
    write_shards(df, path, tokenizer, end_id, shards)
    docs = C.written(read_documents(spark, path), "token-index")
    ends = docs.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = ends.select(F.col("shard").alias("of"), (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return docs.join(before, F.col("shard") == F.col("of")).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard")
