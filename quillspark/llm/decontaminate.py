"""Benchmark decontamination with one Aho-Corasick automaton over normalised windows (operator 6).

Normal form: A-Z lower-cased, words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ (digits, a-z and all non-ASCII characters), one
space between words and around all of them. A window's normal form then occurs in a text's exactly where its words do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

WIDTH = 10
#: Characters of items in one automaton, and in one broadcast; a larger benchmark is scanned for in blocks of this size.
BLOCK_CHARS = 1_000_000
#: Bytes of text that are scanned for all blocks, one after the other, if there are several: each automaton is built once for them.
BLOCKS_STEP = 32 << 20

_TABLE = bytes(b + 32 if 65 <= b < 91 else b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else 32 for b in range(256))
_NORMAL = np.frombuffer(_TABLE, np.uint8) != 32


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def automaton(items: list[tuple[str, str | None]], width: int = WIDTH):
    """Windows of `width` words of all items (id as string, text), each with its number of words and the items that have it."""
    found: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        words = normal_words(text)
        for k in range(max(len(words) - width + 1, min(len(words), 1))):
            w = words[k : k + width]
            found.setdefault(b" ".join([b"", *w, b""]).decode("latin-1"), (len(w), set()))[1].add(item)
    a = ahocorasick.Automaton()
    for k, v in found.items():
        a.add_word(k, (v[0], tuple(sorted(v[1]))))
    if found:
        a.make_automaton()
    return a if found else None


def scan(a, text: str | None) -> tuple[int, np.ndarray, set[str]]:
    """Words of a text, which of them are hit, and the items whose windows occur."""
    words = normal_words(text)
    hit, items = np.zeros(len(words), bool), set()
    if a is None or not words:
        return len(words), hit, items
    line = b" ".join([b"", *words, b""])
    ends, last, n = [], 0, 0
    for end, (size, who) in a.iter(line.decode("latin-1")):
        n += line.count(b" ", last, end)  # words that end before this place
        last = end
        ends.append((n, size))
        items.update(who)
    for n, size in ends:
        hit[n - size : n] = True
    return len(words), hit, items


def hit_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """The hit words' stretches in the original text: code points, end exclusive."""
    raw = np.frombuffer(text.encode(), np.uint8)
    inside = np.concatenate([[False], _NORMAL[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    starts, ends = edges[::2][hit], edges[1::2][hit]
    at = np.flatnonzero(hit)
    new = np.concatenate([[True], np.diff(at) > 1]) if len(at) else np.zeros(0, bool)
    s, e = starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)] if len(at) else starts
    return list(zip(chars[s].tolist(), chars[e].tolist(), strict=True))


def item_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[list[tuple[str, str]]]:
    """The stated query set, in blocks of BLOCK_CHARS or one item, one at a time. Items of a null id or text are left out."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    block, size = [], 0
    for r in rows.orderBy("i", "t").toLocalIterator():
        if block and size + len(r.t) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += len(r.t)
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, keep: list[str] | None = None) -> DataFrame:
    """Scans every whole text with one automaton; a benchmark of over BLOCK_CHARS makes one for each block of its items.

    Returns the columns `keep` (doc_id by default), n_words, n_hit, n_items, items_sha256, contaminated and spans
    (start, end in code points of the original text). Null and empty texts have no words: zeros and no spans. An item
    with fewer words than `width`, but not none, is one window; repeated items and rows change nothing; an empty
    benchmark hits nothing. Clashing names do no harm: only the named columns are read.
    """
    keep = keep or ["doc_id"]
    blocks = [docs.sparkSession.sparkContext.broadcast(b) for b in item_blocks(benchmark)]  # each of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = automaton(blocks[0].value if blocks else [], width) if len(blocks) < 2 else None
        for b in C.steps(batches, "__text", C.STEP_BYTES if len(blocks) < 2 else BLOCKS_STEP):
            texts = b.column(len(keep)).to_pylist()
            sums = [None] * len(texts)
            for block in blocks or [None]:
                a = only if len(blocks) < 2 else automaton(block.value, width)
                for k, t in enumerate(texts):
                    n, hit, items = scan(a, t)
                    if sums[k] is None:
                        sums[k] = [n, hit, items]
                    else:
                        sums[k][1] |= hit
                        sums[k][2] |= items
            n = pa.array([len(s[1]) for s in sums], pa.int64())
            hits = [int(s[1].sum()) for s in sums]
            sha = [hashlib.sha256(",".join(sorted(s[2])).encode()).hexdigest() for s in sums]
            spans = [[{"start": x, "end": y} for x, y in hit_spans(t, s[1])] if h else [] for t, s, h in zip(texts, sums, hits, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), n, pa.array(hits, pa.int64()), pa.array([len(s[2]) for s in sums], pa.int64()), pa.array(sha, pa.string()), pa.array([h > 0 for h in hits]), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], [*keep, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>"])
    return docs.select(*(F.col(f"`{k}`") for k in keep), F.col("text").alias("__text")).mapInArrow(run, schema)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs' rows, all columns, in which no window occurs; any column names do."""
    names = docs.columns
    own = [f"__c{k}" for k in range(len(names))]
    marked = docs.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(names, own, strict=True)), F.col("text"))
    judged = contamination(marked, benchmark, width, own)
    return judged.where("NOT contaminated").select(*(F.col(o).alias(c) for c, o in zip(names, own, strict=True)))


ORACLE_SQL = r"""
WITH b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) AS i FROM b)),
d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w,
    row_number() OVER () AS r
  FROM documents),
dw AS (
  SELECT r, s.n AS n, i, array_to_string(w[i:i + s.n - 1], ' ') AS k
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) x) s),
h AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.r = c.r LEFT JOIN m ON d.r = m.r
"""
