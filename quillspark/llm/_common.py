"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Python step holds at a time; a longer document is a step of its own. A step's arrays take some
#: forty times as much, so this bounds a worker's memory.
STEP_BYTES = 1 << 20
#: The same for operators that return a row for each step and bucket, of which there should be few.
GROUP_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; the session names it in spark.checkpoint.dir.

    Where the setting is missing, a folder in the warehouse, which they share too.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex}"


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends here and survives lost executors.

    The write's own shuffle files go when it ends, as nothing runs that plan again.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(*frames: DataFrame) -> None:
    """Deletes tables that written() made and that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for f in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(f)
            if f"{shared_dir(spark).removeprefix('file://')}/quillspark/" in f:
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: What this worker keeps from task to task of one operator.
KEPT: dict = {}


def give_back() -> None:
    """Returns freed memory to the system, which a worker that goes on to other tasks would hold."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = STEP_BYTES, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds about `most` bytes of the column text, one row at least.

    Unless keep is set, the task is of an operator that keeps nothing, and what other tasks have kept goes.
    """
    if KEPT and not keep:
        KEPT.clear()
        give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        sizes = np.nan_to_num(np.asarray(pc.binary_length(col).to_numpy(zero_copy_only=False), dtype=np.float64))
        group = (np.cumsum(sizes) // most).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
    give_back()


def size_of(df: DataFrame) -> int:
    """Bytes of df by the plan's statistics: of a written table, those of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, per_task: int = 32 << 20, text: str = "text") -> int:
    """A number of partitions by the size that the plan's statistics give: about per_task bytes of files each, at any size."""
    low = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(low, size_of(df) // per_task + 1)


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Names for columns of our own that no column of the input has, whatever their case."""
    lead = "__"
    while any(c.lower().startswith(lead) for c in taken):
        lead += "_"
    return [lead + w for w in wanted]


def row_key(doc_id: str = "doc_id", text: str = "text"):
    """Tells rows apart that have the same id but other texts; null texts count as empty."""
    return F.xxhash64(F.col(doc_id), F.coalesce(F.col(text), F.lit("")))


def broadcast_if_small(df: DataFrame, rows: int, most_rows: int) -> DataFrame:
    """Marks df for broadcast only when its counted rows are within the bound; else the planner joins by shuffle."""
    return F.broadcast(df) if rows <= most_rows else df


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of some texts, as hashes and byte offsets, found with array operations.

    texts: Arrow string or binary array (null: no words). starts, ends: byte offsets in `data`. hashes: 64 bits for
    each word, from its bytes. first: index of each document's first word, with the total at the end.
    """

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        buf = texts.buffers()[2] if len(texts) else None
        base = int(offsets[0])
        data = np.frombuffer(buf, np.uint8)[base : int(offsets[-1])] if buf is not None and offsets[-1] > base else np.zeros(0, np.uint8)
        bounds = offsets - base
        if texts.null_count:  # a null has no bytes in a well-formed array, but offsets may still cover some
            gone = np.asarray(texts.is_null())
            data = data.copy()
            for k in np.flatnonzero(gone & (np.diff(bounds) > 0)):
                data[bounds[k] : bounds[k + 1]] = 32
        self.data, self.bounds = data, bounds
        inside = (data != 32) & ((data < 9) | (data > 13))
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edge = bounds[(bounds > 0) & (bounds < len(data))]
        begin[edge] = inside[edge]
        end[edge - 1] = inside[edge - 1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, bounds)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, seed)


_ROOT = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, root: int = _ROOT) -> np.ndarray:
    """root**0, root**1, ... modulo 2**64, n of them at least."""
    if len(_POWERS.get(root, ())) < n:
        p = np.full(1 << max(12, (n - 1).bit_length()), root, np.uint64)
        p[0] = 1
        _POWERS[root] = np.multiply.accumulate(p)
    return _POWERS[root]


_INVERSE = pow(_ROOT, -1, 1 << 64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes: a polynomial over random byte values, mixed with the length.

    Sums of value * root**position stand in for Horner's rule; a power of the inverse root takes the position out.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    values = np.random.default_rng(97 + seed).integers(0, 1 << 64, 256, dtype=np.uint64)
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * powers(n)[:n], out=total[1:])
    out = (total[ends] - total[starts]) * powers(n, _INVERSE)[starts]
    return mixed(out ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of `width` neighbours; windows that cross documents are the caller's to leave out."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(n)[:n], out=total[1:])
    return mixed((total[width:] - total[: n - width + 1]) * powers(n, _INVERSE)[: n - width + 1])


def window_starts(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of documents whose words begin at `first`: starts of the windows within one document, and their documents."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    base = np.repeat(np.cumsum(counts) - counts, counts)
    return np.arange(len(doc)) - base + first[:-1][doc], doc
