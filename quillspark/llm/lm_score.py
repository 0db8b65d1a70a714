"""Language-model scoring: word counts for a base score, a subword lattice for the model's score (operator 10).

Pieces are an existing byte-level vocabulary's tokens. Each has a probability; a word (with the space before it) has the
sum over all ways to cut it into pieces of the product of their probabilities, by a forward recursion in log space. The
starting probabilities fall with the vocabulary's rank; one round of expected counts over the training words gives
the ones in use. A text's probability is the product of its words' and that of the end symbol.

The vocabulary of words grows with the corpus, so it is never on one machine. Documents are dealt into groups; a group
sends its distinct words, with training counts, to buckets by hash; each bucket adds up what all groups sent, scores
every distinct word once, and answers each group. Within a task all is done by array operations on bounded steps.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from .bpe import _alphabet

#: Added to each piece's expected count, so that every piece keeps some probability.
PRIOR_COUNT = 0.1
#: Words of one length that are scored at a time.
STEP_WORDS = 20_000


def pieces_of(path: str) -> list[bytes]:
    """The vocabulary's tokens that can be part of a word with the space before it, by rank."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = _alphabet()
    tokens = [bytes(alphabet[c] for c in t) for t, _ in sorted(spec["model"]["vocab"].items(), key=lambda x: x[1]) if all(c in alphabet for c in t)]
    return [t for t in tokens if not set(t[1:]) & {9, 10, 11, 12, 13, 32} and t[0] not in (9, 10, 11, 12, 13)]


class Lattice:
    """Piece probabilities (log10) in a hash table of byte strings, and sums over segmentations."""

    BITS = 18

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.logp = logp
        sizes = np.asarray([len(p) for p in pieces])
        #: Lengths of pieces, so that spans of others are not hashed; the longest first, as edges come by their starts.
        self.lengths = sorted(set(sizes.tolist()), reverse=True)
        ends = np.cumsum(sizes)
        keys = C.span_hashes(np.frombuffer(b"".join(pieces), np.uint8), ends - sizes, ends) | np.uint64(1)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a hash")
        self.keys, self.ids = np.zeros(1 << self.BITS, np.uint64), np.zeros(1 << self.BITS, np.int32)
        for k, h in enumerate(keys.tolist()):
            s = h >> (64 - self.BITS)
            while self.keys[s]:
                s = (s + 1) & ((1 << self.BITS) - 1)
            self.keys[s], self.ids[s] = h, k

    def find(self, h: np.ndarray) -> np.ndarray:
        """Each hash's piece, or -1."""
        h = h | np.uint64(1)
        slot = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        out = np.full(len(h), -1, np.int32)
        left = np.arange(len(h))
        while len(left):
            there = self.keys[slot[left]]
            same = there == h[left]
            out[left[same]] = self.ids[slot[left[same]]]
            left = left[~same & (there != 0)]
            slot[left] = (slot[left] + 1) & ((1 << self.BITS) - 1)
        return out

    def _edges(self, words: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray, np.ndarray]]]:
        """words: rows of bytes of one length. Log-probabilities of all their beginnings, and the edges (from, to, rows, piece)."""
        m, n = words.shape
        values = np.random.default_rng(97).integers(0, 1 << 64, 256, dtype=np.uint64)
        p, q = C.powers(n + 1), C.powers(n + 1, C._INVERSE)
        total = np.zeros((n + 1, m), np.uint64)
        np.cumsum(values[words.T] * p[:n, None], axis=0, out=total[1:])
        alpha = np.full((n + 1, m), -np.inf)
        alpha[0] = 0
        edges = []
        ten = math.log(10)
        for j in range(1, n + 1):
            parts = []
            for i in (j - k for k in self.lengths if k <= j):
                h = C.mixed(((total[j] - total[i]) * q[i]) ^ (np.uint64((j - i) * 0xD6E8FEB86659FD93 % (1 << 64))))
                piece = self.find(h)
                rows = np.flatnonzero(piece >= 0)
                if len(rows):
                    piece = piece[rows]
                    edges.append((i, j, rows, piece))
                    parts.append((rows, alpha[i, rows] + self.logp[piece]))
            top = np.full(m, -np.inf)
            for rows, x in parts:
                top[rows] = np.maximum(top[rows], x)
            sums = np.zeros(m)
            safe = np.where(np.isfinite(top), top, 0)
            for rows, x in parts:
                sums[rows] += np.exp((x - safe[rows]) * ten)
            with np.errstate(divide="ignore"):
                alpha[j] = np.where(sums > 0, safe + np.log10(np.maximum(sums, 1e-300)), -np.inf)
        return alpha, edges

    def scores(self, words: list[bytes]) -> np.ndarray:
        """Log10 of each word's probability, the space before it included."""
        out = np.zeros(len(words))
        for rows, block in by_length(words):
            out[rows] = self._edges(block)[0][-1]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Each piece's expected count over all segmentations of words that occur `counts` times."""
        out = np.zeros(len(self.logp))
        ten = math.log(10)
        for rows, block in by_length(words):
            alpha, edges = self._edges(block)
            n = block.shape[1]
            beta = np.zeros((n + 1, len(rows)))  # as ratios to the whole: what reaches a place, backwards
            beta[n] = counts[rows]
            for i, j, r, piece in reversed(edges):  # edges come by their ends, so a place is complete when it is used
                w = beta[j, r] * np.exp((alpha[i, r] + self.logp[piece] - alpha[j, r]) * ten)
                beta[i, r] += w
                out += np.bincount(piece, weights=w, minlength=len(out))
        return out


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of words of one length, with a space before each: rows, and their bytes."""
    sizes = np.asarray([len(w) for w in words], np.int64)
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for rows in np.split(order, cuts):
        if not len(rows):
            continue
        most = max(1, STEP_WORDS * 8 // (int(sizes[rows[0]]) + 1))
        for k in range(0, len(rows), most):
            some = rows[k : k + most]
            yield some, np.frombuffer(b"".join([b" " + words[i] for i in some.tolist()]), np.uint8).reshape(len(some), -1)


def tokens(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased (bytes split at just these)."""
    return (text or "").encode().lower().split()


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def _grouped(docs: DataFrame, groups: int) -> DataFrame:
    return docs.select(F.pmod(C.row_key(), F.lit(groups)).cast("int").alias("g"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def word_table(docs: DataFrame, groups: int) -> DataFrame:
    """A row per bucket of words, written: distinct words, training counts, and which words each group asked for."""
    buckets = groups

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained, other, home = Counter(), set(), None
        for b in C.steps(batches, "text", C.GROUP_BYTES):
            home = b.column(0)[0].as_py() if home is None else home
            for i, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if held_out(i):
                    other.update(tokens(t))
                else:
                    trained.update(tokens(t))
        words = [*trained, *(other - trained.keys())]
        if not words:
            return
        counts = np.zeros(len(words), np.int64)
        counts[: len(trained)] = list(trained.values())
        sizes = np.asarray([len(w) for w in words])
        ends = np.cumsum(sizes)
        bucket = (C.span_hashes(np.frombuffer(b"".join(words), np.uint8), ends - sizes, ends, 5) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[rows[0]])], pa.int32()), pa.array([home], pa.int32()), pa.array([b"\n".join([words[k] for k in rows.tolist()])], pa.binary()), pa.array([counts[rows].astype("<i8").tobytes()], pa.binary())], ["bucket", "g", "words", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[bytes, int] = {}
        total, asked, homes = [], [], []
        for b in batches:
            for g, blob, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                at = np.empty(n.__len__() // 8, np.uint32)
                for k, (w, c) in enumerate(zip(blob.split(b"\n"), np.frombuffer(n, "<i8").tolist(), strict=True)):
                    p = place.get(w)
                    if p is None:
                        p = place[w] = len(total)
                        total.append(0)
                    total[p] += c
                    at[k] = p
                homes.append(g)
                asked.append(at.tobytes())
        if total:
            c = np.asarray(total, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(place)], pa.binary()), pa.array([c.astype("<i8").tobytes()], pa.binary()), pa.array([homes], pa.list_(pa.int32())), pa.array([asked], pa.list_(pa.binary())), pa.array([int(c.sum())], pa.int64()), pa.array([int((c > 0).sum())], pa.int64())], ["words", "counts", "homes", "asked", "n", "v"])

    sent = _grouped(docs, groups).repartitionById(groups, F.col("g")).mapInArrow(ask, "bucket int, g int, words binary, counts binary")
    summed = sent.repartitionById(buckets, F.col("bucket")).mapInArrow(add, "words binary, counts binary, homes array<int>, asked array<binary>, n long, v long")
    return C.written(summed, "words")


def train(table: DataFrame, pieces: list[bytes], n_end: int) -> np.ndarray:
    """Log10 probabilities of the pieces, then that of the end symbol: one round of expected counts.

    The start falls with the rank in the vocabulary. What comes to the driver is one number for each piece.
    """
    start = 1 / (np.arange(len(pieces)) + 10.0)
    bc = table.sparkSession.sparkContext.broadcast((pieces, np.log10(start / start.sum())))

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, out = Lattice(*bc.value), np.zeros(len(pieces))
        for b in batches:
            for blob, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = np.frombuffer(n, "<i8")
                words = blob.split(b"\n")
                known = np.flatnonzero(c > 0)
                out += lattice.expected([words[k] for k in known.tolist()], c[known].astype(np.float64))
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["piece", "n"])

    counts = np.full(len(pieces) + 1, PRIOR_COUNT)
    for r in table.select("words", "counts").mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.piece] += r.n
    counts[-1] += n_end
    return np.log10(counts / counts.sum())


def score(docs: DataFrame, vocabulary: str, groups: int | None = None) -> DataFrame:
    """Scores every whole text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training texts are those whose crc32 of doc_id as text, modulo 7, is not 2 (a null id counts as empty text). Null
    and empty texts have one token, the end. Without training texts all counts are 0. Repeated rows are counted and
    returned as often as they come; an empty table gives no rows.
    """
    spark = docs.sparkSession
    groups = groups or C.spread(docs, 12 << 20)
    id_type = dict(docs.dtypes)["doc_id"]
    table = word_table(docs, groups)
    sums = table.agg(F.sum("n"), F.sum("v")).first()
    n_end = docs.where(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) != 2).count()
    n, v = (sums[0] or 0) + n_end, (sums[1] or 0) + (n_end > 0)
    pieces = pieces_of(vocabulary)
    logp = train(table, pieces, n_end)
    bc = spark.sparkContext.broadcast((pieces, logp))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(bc.value[0], bc.value[1][:-1])
        for b in batches:
            for blob, counts, homes, asked in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                words, c = blob.split(b"\n"), np.frombuffer(counts, "<i8")
                sizes = np.asarray([len(w) for w in words])
                ends = np.cumsum(sizes)
                h = C.span_hashes(np.frombuffer(b"".join(words), np.uint8), ends - sizes, ends)
                s = lattice.scores(words)
                for g, at in zip(homes, asked, strict=True):
                    at = np.frombuffer(at, np.uint32)
                    yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([h[at].tobytes() + c[at].tobytes() + s[at].tobytes()], pa.binary())], ["g", "told"])

    told = table.select("words", "counts", "homes", "asked").mapInArrow(answer, "g int, told binary")
    end_count, end_logp, per_token = n_end, float(logp[-1]), math.log10(n + v + 1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heard, keys = [], None
        for b in C.steps(batches, "text", C.GROUP_BYTES):
            if keys is None:
                heard += [x.as_buffer().to_pybytes() for x in b.column(3).drop_null()]
                b = b.filter(b.column(3).is_null())
                if not b.num_rows:
                    continue
                keys = np.concatenate([np.frombuffer(x, np.uint64, len(x) // 24) for x in heard] or [np.zeros(0, np.uint64)])
                known = np.concatenate([np.frombuffer(x, np.int64, len(x) // 24, len(x) // 3) for x in heard] or [np.zeros(0, np.int64)])
                lattice = np.concatenate([np.frombuffer(x, np.float64, len(x) // 24, 2 * (len(x) // 3)) for x in heard] or [np.zeros(0)])
                heard = []
                order = np.argsort(keys)
                keys, known, lattice = keys[order], known[order], lattice[order]
                base = np.log10(known + 1.0)
            texts = b.column(2).cast(pa.large_binary())
            lower = pa.array([t.lower() if t else t for t in texts.to_pylist()], pa.large_binary())
            w = C.Words(lower)
            at = np.searchsorted(keys, w.hashes())
            doc = np.repeat(np.arange(b.num_rows), np.diff(w.first))
            m = b.num_rows
            size = np.diff(w.first) + 1
            n_known = np.bincount(doc, weights=known[at] > 0, minlength=m).astype(np.int64) + (end_count > 0)
            base_score = np.bincount(doc, weights=base[at], minlength=m) + math.log10(end_count + 1) - size * per_token
            model = np.bincount(doc, weights=lattice[at], minlength=m) + end_logp
            ids = b.column(1)
            yield pa.RecordBatch.from_arrays([ids, pa.array([held_out(i) for i in ids.to_pylist()]), pa.array(size.astype(np.int64)), pa.array(n_known), pa.array(np.full(m, n, np.int64)), pa.array(base_score), pa.array(model)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = _grouped(docs, groups).withColumn("told", F.lit(None).cast("binary"))
    both = told.select("g", F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"), "told").unionByName(rows)
    met = both.repartitionById(groups, F.col("g")).sortWithinPartitions(F.col("told").isNull())
    out = met.select("g", "doc_id", "text", "told").mapInArrow(add, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast(id_type))
