"""Substring dedup by fixed-block anchors (operator 4).

Every document is cut into non-overlapping reference blocks of BLOCK words; every rolling window of BLOCK words of every
document probes them. A repeat of WIDTH = 2 * BLOCK words always holds one whole reference block, so it is never missed.
A hit's neighbourhood is then extended: all windows of WIDTH words around hits are looked up by a hash of 96 bits in its bucket, and a run
of equal neighbours is a maximal exact repeat. What is found in a smaller doc_id goes.

Nothing is paired: blocks, probes and windows meet in buckets of their hashes, each bucket holds the least document of a
hash, and only hits come back. Probes travel packed, some 7 bytes each. What the documents read together (GROUP_BYTES)
already settle among themselves is combined before the shuffle: of a passage that many of them share a bucket gets two
entries, and the other places go straight to their documents. So a passage in a third of all documents does not gather in
one bucket with all its occurrences, but with two for each such group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

BLOCK = 25
WIDTH = 2 * BLOCK
#: Bytes of a probe's hash that travel; its bucket stands for further bits. False hits are sorted out later.
HASH_BYTES = 5
#: Bytes of two hashes of a window of WIDTH words; with the bucket they tell windows apart at any size.
LONG_HASH_BYTES = 12
#: Bytes of text whose windows are hashed at a time; arrays of 64-bit values take some forty times as much.
STEP_BYTES = 4 << 20

_SCHEMA = "bucket int, docs binary, counts binary, places binary, blocks binary, hashes binary"


def _rows(bucket: np.ndarray, doc: np.ndarray, row: np.ndarray, place: np.ndarray, payload: np.ndarray, block: np.ndarray | None, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packs entries (document, row key, place, payload bytes) by bucket, in the order in which they come."""
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    cols: list[list] = [[] for _ in range(6)]
    for rows in np.split(order, cuts):
        if not len(rows):
            continue
        d, r = doc[rows], row[rows]
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (place[rows][1:] <= place[rows][:-1])])
        at = np.flatnonzero(new)
        p = place[rows]
        step = np.diff(p, prepend=0)
        step[at] = p[at]
        small = step.max() < 1 << 16
        cols[0].append(int(bucket[rows[0]]))
        cols[1].append(d[at].astype("<i8").tobytes() + r[at].astype("<i8").tobytes())
        cols[2].append(np.diff(np.append(at, len(rows))).astype("<u4").tobytes())
        # Two byte planes compress better than pairs do.
        cols[3].append(b"s" + step.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes() if small else b"l" + step.astype("<i8").tobytes())
        cols[4].append(np.packbits(block[rows]).tobytes() if block is not None else b"")
        cols[5].append(payload[rows].tobytes())
    kinds = [pa.int32(), *[pa.binary()] * 5]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["bucket", "docs", "counts", "places", "blocks", "hashes"])


def _unpacked(b: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    """The bucket, document, row key, place, block flag and payload of all entries of some rows."""
    parts = []
    for bucket, docs, counts, places, blocks, hashes in zip(*(c.to_pylist() for c in b.columns), strict=True):
        n = np.frombuffer(counts, "<u4").astype(np.int64)
        total = int(n.sum())
        step = np.frombuffer(places, np.uint8, offset=1).reshape(2, -1).T.copy().view("<u2").reshape(-1).astype(np.int64) if places[:1] == b"s" else np.frombuffer(places, "<i8", offset=1)
        run = np.cumsum(step)
        first = np.cumsum(n) - n
        place = run - np.repeat(run[first] - step[first], n)
        flag = np.unpackbits(np.frombuffer(blocks, np.uint8), count=total).astype(bool) if blocks else np.zeros(total, bool)
        ids = np.frombuffer(docs, "<i8").reshape(2, -1)
        parts.append((np.full(total, bucket), np.repeat(ids[0], n), np.repeat(ids[1], n), place, flag, np.frombuffer(hashes, np.uint8).reshape(total, width)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _as_number(payload: np.ndarray) -> np.ndarray:
    """Up to 8 bytes of each row as a number."""
    full = np.zeros((len(payload), 8), np.uint8)
    full[:, : payload.shape[1]] = payload
    return full.view("<u8").reshape(-1)


def _by_document(doc: np.ndarray, row: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Each document and row key with its places, ascending, each once."""
    if not len(doc):
        return
    order = np.lexsort((place, row, doc))
    doc, row, place = doc[order], row[order], place[order]
    same = (doc[1:] == doc[:-1]) & (row[1:] == row[:-1])
    once = np.concatenate([[True], ~(same & (place[1:] == place[:-1]))])
    begin = np.concatenate([[True], ~same])[once]
    doc, row, place = doc[once], row[once], place[once]
    at = np.flatnonzero(begin)
    for x, y in zip(at.tolist(), [*at[1:].tolist(), len(doc)], strict=True):
        yield int(doc[x]), int(row[x]), place[x:y]


_MENTIONS = "home int, docs binary, counts binary, places binary"


def _mentions(doc: np.ndarray, row: np.ndarray, place: np.ndarray, groups: int) -> Iterator[pa.RecordBatch]:
    """A bucket's places, one row for each of the groups that documents are gathered in."""
    found: dict[int, list] = {}
    for d, r, p in _by_document(doc, row, place):
        found.setdefault(d % groups, []).append((d, r, p))
    if found:
        heads = [np.asarray([(d, r) for d, r, _ in x], "<i8").tobytes() for x in found.values()]
        counts = [np.asarray([len(p) for _, _, p in x], "<u4").tobytes() for x in found.values()]
        places = [np.concatenate([p for _, _, p in x]).astype("<u4").tobytes() for x in found.values()]
        yield pa.RecordBatch.from_arrays([pa.array([*found], pa.int32()), *(pa.array(x, pa.binary()) for x in (heads, counts, places))], ["home", "docs", "counts", "places"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's places from all buckets: doc, row, places."""
    parts = []
    for b in batches:
        for heads, counts, places in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            h, n = np.frombuffer(heads, "<i8").reshape(-1, 2), np.frombuffer(counts, "<u4")
            parts.append((np.repeat(h[:, 0], n), np.repeat(h[:, 1], n), np.frombuffer(places, "<u4")))
    if parts:
        out = list(_by_document(*(np.concatenate(x) for x in zip(*parts, strict=True))))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2].astype("<u4").tobytes() for x in out], pa.binary())], ["doc", "row", "places"])


def _settled(doc: np.ndarray, row: np.ndarray, place: np.ndarray, groups: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Places that are known to be hits, as rows of _SCHEMA: they pass a bucket, dealt by their documents, unread."""
    for b in _mentions(doc, row, place, groups):
        home = np.asarray(b.column(0))
        marked = [b"m" + p for p in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(home % buckets, pa.int32()), b.column(1), b.column(2), pa.array(marked, pa.binary()), pa.array([b""] * len(home), pa.binary()), pa.array([int(h).to_bytes(4, "little") for h in home], pa.binary())], ["bucket", "docs", "counts", "places", "blocks", "hashes"])


def _apart(batches: Iterator[pa.RecordBatch]) -> tuple[list[pa.RecordBatch], list[pa.RecordBatch]]:
    """A bucket's rows: mentions that were settled before, as rows of _MENTIONS, and entries."""
    settled, entries = [], []
    for b in batches:
        known = np.asarray([p[:1] == b"m" for p in b.column(3).to_pylist()], bool)
        if known.any():
            k = b.filter(pa.array(known))
            settled.append(pa.RecordBatch.from_arrays([pa.array([int.from_bytes(h, "little") for h in k.column(5).to_pylist()], pa.int32()), k.column(1), k.column(2), pa.array([p[1:] for p in k.column(3).to_pylist()], pa.binary())], ["home", "docs", "counts", "places"]))
        if not known.all():
            entries.append(b.filter(pa.array(~known)))
    return settled, entries


def _least_by(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries by key, then document; where each key begins; and the number of each entry's key, in that order."""
    order = np.lexsort((doc, key))
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _entries(bucket_rows: Iterator[pa.RecordBatch], width: int):
    got = [_unpacked(b, width) for b in bucket_rows if b.num_rows]
    return tuple(np.concatenate(x) for x in zip(*got, strict=True)) if got else None


def _marked(df: DataFrame, groups: int) -> DataFrame:
    return df.repartitionById(groups, F.col("home")).mapInArrow(_gathered, "doc long, row long, places binary")


def _runs(first: int, last: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of the words first..last-1 lie in a window that starts at one of `starts`."""
    d = np.zeros(last - first + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + width, last - first), -1)
    return np.cumsum(d[:-1]) > 0


def repeats(docs: DataFrame, groups: int | None = None, texts: bool = True) -> DataFrame:
    """docs(doc_id, text) with the words to remove: doc_id, text, n_words, n_removed, kept_sha256, and kept text.

    A word goes if a window of WIDTH words over it also starts in a document with a smaller doc_id; windows are judged on
    the input. Null texts have no words. A row with a null doc_id neither gives nor loses words. Rows that share a
    doc_id are no copies of each other, as neither id is smaller, and each is compared with other documents. Repeated
    rows are returned as often as they come; an empty table gives no rows. Without `texts`, kept_text is null where
    nothing goes, and such texts are not stored on the way.
    """
    id_type = dict(docs.dtypes)["doc_id"]
    groups = groups or C.spread(docs, 8 << 20)
    buckets = groups
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", C.row_key().alias("row_key"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.steps(batches, "text", STEP_BYTES):
            w = C.Words(b.column(1))
            h = C.windows(w.hashes(), BLOCK)
            at, doc = C.window_starts(w.first, BLOCK)
            if not len(at):
                continue
            ids = np.asarray(b.column(0), np.int64)
            h, place = h[at], at - w.first[doc]
            payload = np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES])
            bucket, ids, block, none = ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64), ids[doc], place % BLOCK == 0, np.zeros(len(doc), np.int64)
            # A key with a reference block and two documents here is a hit wherever it occurs: its first and last entry speak for all.
            order, at, nth = _least_by((h & np.uint64((1 << 40) - 1)) | (bucket.astype(np.uint64) << np.uint64(40)), ids)
            end = np.append(at[1:], len(order))
            sure = np.logical_or.reduceat(block[order], at) & (ids[order[at]] < ids[order[end - 1]])
            spoken, speaker = sure[nth], np.zeros(len(order), bool)
            speaker[at], speaker[end - 1] = True, True
            block = block.copy()
            block[order[spoken & speaker]] = True
            known, sent = order[spoken & ~speaker], np.sort(order[~spoken | speaker])
            yield from _settled(ids[known], none[known], place[known], groups, buckets)
            yield from _rows(bucket[sent], ids[sent], none[sent], place[sent], payload[sent], block[sent], buckets)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settled, entries = _apart(batches)
        yield from settled
        got = _entries(iter(entries), HASH_BYTES)
        if got is None:
            return
        bucket, doc, row, place, block, payload = got
        key = _as_number(payload) | (bucket.astype(np.uint64) % np.uint64(1 << 24)) << np.uint64(40)
        index = np.unique(key[block])  # the reference blocks
        if not len(index):
            return
        k = np.searchsorted(index, key)
        k[k == len(index)] = 0
        k = np.where(index[k] == key, k, -1)
        some = np.flatnonzero(k >= 0)
        low, high = np.full(len(index), np.iinfo(np.int64).max), np.full(len(index), np.iinfo(np.int64).min)
        np.minimum.at(low, k[some], doc[some])
        np.maximum.at(high, k[some], doc[some])
        some = some[low[k[some]] < high[k[some]]]
        yield from _mentions(doc[some], row[some], place[some], groups)

    known = rows.where("doc_id IS NOT NULL AND text IS NOT NULL")
    hit = known.mapInArrow(probe, _SCHEMA).repartitionById(buckets, F.col("bucket")).mapInArrow(hits, _MENTIONS)
    near = rows.join(_marked(hit, groups), F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "places", "row_key")
    near = C.written(near.mapInArrow(_settle if texts else _settle_without_texts, "doc_id long, n_words long, n_removed long, kept_sha256 string, text string, places binary, row_key long"), "near")
    open_rows = near.where("places IS NOT NULL").select("doc_id", "text", "places", "row_key")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.steps(batches, "text", STEP_BYTES):
            w = C.Words(b.column(1))
            at, doc = C.window_starts(w.first, WIDTH)
            if not len(at):
                continue
            flags = np.zeros(int(w.first[-1]) + 1, np.int64)  # at k + 1: hits before and at word k
            for k, p in enumerate(b.column(2).to_pylist()):
                p = np.frombuffer(p, "<u4").astype(np.int64)
                flags[w.first[k] + p[p < w.first[k + 1] - w.first[k]] + 1] = 1  # of rows that share an id, the longer may have more
            flags = np.cumsum(flags)
            near_hit = flags[at + WIDTH - BLOCK + 1] > flags[at]  # a hit window lies within
            at, doc = at[near_hit], doc[near_hit]
            if not len(at):
                continue
            one, two = (C.windows(w.hashes(s), WIDTH)[at] for s in (0, 1))
            ids, keys = np.asarray(b.column(0), np.int64), np.asarray(b.column(3), np.int64)
            payload = np.ascontiguousarray(np.stack([one, two], 1).astype("<u8").view(np.uint8).reshape(-1, 16)[:, :LONG_HASH_BYTES])
            bucket, ids, keys, place = ((one >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64), ids[doc], keys[doc], at - w.first[doc]
            # What begins here in a smaller document goes; the least document of each window here speaks for it.
            order, first, nth = _least_by(one ^ C.mixed(two), ids)
            later_here = ids[order] > ids[order[first]][nth]
            known, sent = order[later_here], np.sort(order[~later_here])
            yield from _settled(ids[known], keys[known], place[known], groups, buckets)
            yield from _rows(bucket[sent], ids[sent], keys[sent], place[sent], payload[sent], None, buckets)

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settled, entries = _apart(batches)
        yield from settled
        got = _entries(iter(entries), LONG_HASH_BYTES)
        if got is None:
            return
        _, doc, row, place, _, payload = got
        one, two = _as_number(payload[:, :8]), _as_number(payload[:, 8:])
        order = np.lexsort((doc, two, one))
        o, t, d = one[order], two[order], doc[order]
        at = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (t[1:] != t[:-1])]))
        least = np.repeat(d[at], np.diff(np.append(at, len(d))))
        gone = order[d > least]
        yield from _mentions(doc[gone], row[gone], place[gone], groups)

    over = open_rows.mapInArrow(extend, _SCHEMA).repartitionById(buckets, F.col("bucket")).mapInArrow(later, _MENTIONS)
    judged = open_rows.drop("places").join(_marked(over, groups), (F.col("doc_id") == F.col("doc")) & (F.col("row_key") == F.col("row")), "left").select("doc_id", "text", "places")
    removed = judged.mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    same = near.where("places IS NULL").select("doc_id", "n_words", "n_removed", "kept_sha256", F.col("text").alias("kept_text"))
    return same.unionByName(removed).withColumn("doc_id", F.col("doc_id").cast(id_type))


def _settle_without_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _settle(batches, False)


def _settle(batches: Iterator[pa.RecordBatch], texts: bool = True) -> Iterator[pa.RecordBatch]:
    """Rows without hits get their result, the others keep text and places."""
    for b in C.steps(batches, "text"):
        n, sha, text, places = [], [], [], []
        for t, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            words = (t or "").encode().split()
            n.append(len(words))
            sha.append(None if p else hashlib.sha256(b" ".join(words)).hexdigest())
            text.append(t if texts or p else None)
            places.append(p)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(np.zeros(len(n), np.int64)), pa.array(sha, pa.string()), pa.array(text, pa.string()), pa.array(places, pa.binary()), b.column(3)], ["doc_id", "n_words", "n_removed", "kept_sha256", "text", "places", "row_key"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in C.steps(batches, "text"):
        n, gone, sha, kept = [], [], [], []
        for t, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            words = (t or "").encode().split()
            n.append(len(words))
            if p:
                starts = np.frombuffer(p, "<u4").astype(np.int64)
                out = _runs(0, len(words), starts, WIDTH)
                left = [words[k] for k in np.flatnonzero(~out).tolist()]
            else:
                left = words
            gone.append(len(words) - len(left))
            line = b" ".join(left)
            sha.append(hashlib.sha256(line).hexdigest())
            kept.append(line.decode() if len(left) < len(words) else t)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, r, i, md5(array_to_string(w[i:i + 49], ' ')) AS s FROM (SELECT doc_id, r, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s),
p AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM g JOIN m ON g.s = m.s WHERE m.least < g.doc_id),
q AS (SELECT r, list(p) AS gone FROM p GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN q ON d.r = q.r
"""
