"""Near-duplicates by ProbMinHash, banding and verification (operator 8).

A document is the set of its five-word shingles; a shingle's weight grows with the number of its distinct words (1 to 2).
Every shingle sends out a Poisson process of its weight's rate; an arrival falls on a random register, which keeps the
first. A process ends when its next arrival is later than all registers of its document. The share of equal registers
estimates the probability Jaccard similarity, here the weighted one. Bands of registers give candidates; these are
verified by the exact Jaccard similarity of the shingle sets.

Equal texts are one node. A band's group of up to SMALL nodes is compared in full. In a larger one every node is compared
with leaders, the nodes that come first in LEADERS random orders, and with a few mates dealt by hash, anew in each band.
If that does not join the group, what lies outside its largest component is compared with all the rest in blocks: nodes
are dealt into blocks of a bounded number and size, a task gets two blocks and counts common shingles as a product of
matrices, and only such links leave it as join components, fewer than the two blocks have nodes. So every pair of a group
is either joined already or compared exactly, no link is lost, and rows grow with the group's nodes times its outside's
blocks. Groups are never in one task: leaders come from grouped minima and reach members by a join. Components of links
come from repeated minima over neighbours, as tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

WIDTH = 5
#: Weighted similarity is at least 0.667 where the plain one is 0.8; 24 bands of 4 find 0.667 with 99.5 % and 0.8 with 99.9997 %.
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
#: Links need a Jaccard similarity of NUMERATOR / DENOMINATOR at least.
NUMERATOR, DENOMINATOR = 4, 5
SMALL = 16
LEADERS = 2
#: Mates that a node of a larger group has on average in a band.
MATES = 3
#: Nodes of a block, and bytes of their shingles, on average; columns of a block's matrix at a time.
BLOCK, BLOCK_BYTES, COLUMNS = 256, 2 << 20, 4096
#: Nodes that a task remembers as joined, and bytes of links that it reads together.
JOINED, EDGES_BYTES = 1 << 17, 4 << 20


def shingles(w: C.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All documents' shingles: hash, weight, document. Fewer words than WIDTH, but not none, are one shingle."""
    h = w.hashes()
    at, doc = C.window_starts(w.first, WIDTH)
    runs = C.windows(h, WIDTH)[at]
    weight = np.ones(len(at))
    for j in range(1, WIDTH):
        new = np.ones(len(at), bool)
        for i in range(j):
            new &= h[at + j] != h[at + i]
        weight += new / (WIDTH - 1)
    sizes = np.diff(w.first)
    short = np.flatnonzero((sizes > 0) & (sizes < WIDTH))
    if len(short):
        own = np.asarray([int(C.windows(h[w.first[k] : w.first[k + 1]], int(sizes[k]))[0]) for k in short.tolist()], np.uint64) ^ sizes[short].astype(np.uint64)
        runs, weight, doc = np.concatenate([runs, own]), np.concatenate([weight, np.ones(len(short))]), np.concatenate([doc, short])
    return runs, weight, doc


def signatures(runs: np.ndarray, weight: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Registers (n x REGISTERS) of the shingles that came first."""
    first = np.full(n * REGISTERS, np.inf)
    who = np.zeros(n * REGISTERS, np.uint64)
    time, turn = np.zeros(len(runs)), 0
    gone = np.zeros(n)
    while len(runs):
        turn += 1
        seed = C.mixed(runs + np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64)))
        time = time - np.log(((seed >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / weight
        cell = doc * REGISTERS + ((seed & np.uint64(2047)) % np.uint64(REGISTERS)).astype(np.int64)
        sooner = time < first[cell]
        c, t = cell[sooner], time[sooner]
        np.minimum.at(first, c, t)
        won = t == first[c]
        who[c[won]] = runs[sooner][won]
        gone = first.reshape(n, REGISTERS).max(1)
        going = time < gone[doc]
        runs, weight, doc, time = runs[going], weight[going], doc[going], time[going]
    return who.reshape(n, REGISTERS)


def band_keys(who: np.ndarray) -> np.ndarray:
    out = np.zeros((len(who), BANDS), np.uint64)
    for r in range(ROWS):
        out = C.mixed(out + who[:, r::ROWS] + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in C.steps(batches, "text"):
        w = C.Words(b.column(2))
        n = b.num_rows
        who = signatures(*shingles(w), n)
        keys = band_keys(who)
        some = np.diff(w.first) > 0
        bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1)))
        node = pa.array([k if s else None for k, s in zip(b.column(1).to_pylist(), some.tolist(), strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), node, bands], ["doc_id", "node", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in C.steps(batches, "text"):
        runs, _, doc = shingles(C.Words(b.column(1)))
        order = np.lexsort((runs, doc))
        runs, doc = runs[order], doc[order]
        once = np.concatenate([[True], (runs[1:] != runs[:-1]) | (doc[1:] != doc[:-1])]) if len(runs) else np.zeros(0, bool)
        raw = runs[once].tobytes()
        ends = (8 * np.searchsorted(doc[once], np.arange(b.num_rows + 1))).tolist()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([raw[x:y] for x, y in zip(ends, ends[1:], strict=False)], pa.binary())], ["node", "shingles"])


class Joined:
    """Which nodes a task's links have joined so far. It starts anew beyond JOINED nodes, which only costs work."""

    def __init__(self):
        self.up: dict[bytes, bytes] = {}

    def top(self, k: bytes) -> bytes:
        up = self.up
        while (above := up.get(k, k)) != k:
            up[k] = k = up.get(above, above)
        return k

    def stars(self) -> Iterator[pa.RecordBatch]:
        yield from _links([(self.top(k), k) for k in list(self.up)])

    def join(self, a: bytes, b: bytes) -> None:
        if len(self.up) > JOINED:
            self.up.clear()
        least, other = sorted((self.top(a), self.top(b)))
        self.up[other] = least


def _links(pairs: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    if pairs:
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.binary()), pa.array([y for _, y in pairs], pa.binary())], ["a", "b"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links of pairs (a, b, their shingles). Nodes that a task's earlier links join are not compared: no class depends on it."""
    joined = Joined()
    for b in batches:
        out = []
        for p, q, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
            if joined.top(p) != joined.top(q):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both * DENOMINATOR >= (len(x) + len(y) - both) * NUMERATOR:
                    joined.join(p, q)
                    out.append((p, q))
        yield from _links(out)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For links (a, b) pairs that join the same nodes: the least node that a task's links join others to, and each of the others."""
    joined = Joined()
    for b in batches:
        for p, q in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if joined.top(p) != joined.top(q):
                joined.join(p, q)
            if len(joined.up) >= JOINED:
                yield from joined.stars()
                joined = Joined()
    yield from joined.stars()


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _joined(roots: list[bytes], links: np.ndarray, sides: tuple[np.ndarray, np.ndarray]) -> list[tuple[bytes, bytes]]:
    """Of links between nodes (rows of the matrix) pairs of roots that join components not yet joined."""
    at = np.argwhere(links)
    pairs = np.unique(np.stack([sides[0][at[:, 0]], sides[1][at[:, 1]]], 1), axis=0)
    up = list(range(len(roots)))

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    out = []
    for x, y in pairs.tolist():
        x, y = top(x), top(y)
        if x != y:
            up[x] = y
            out.append((min(roots[x], roots[y]), max(roots[x], roots[y])))
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of roots that verified links join, from pairs of blocks: rows of two lists of (node, root, shingles)."""
    for b in batches:
        for k in range(b.num_rows):
            sides = [b.column(c)[k].values for c in range(2)]
            sizes = [np.asarray(pc.binary_length(v.field("shingles")).to_numpy(zero_copy_only=False), np.int64) // 8 for v in sides]
            flat = [np.frombuffer(b"".join(v.field("shingles").to_pylist()), np.uint64) for v in sides]
            kinds, column = np.unique(np.concatenate(flat), return_inverse=True)
            column = [column[: len(flat[0])], column[len(flat[0]) :]]
            shared = np.bincount(column[0], minlength=len(kinds)).astype(bool) & np.bincount(column[1], minlength=len(kinds)).astype(bool)
            place = np.cumsum(shared) - 1
            row = [np.repeat(np.arange(len(n)), n) for n in sizes]
            keep = [shared[c] for c in column]
            row, column = [r[m] for r, m in zip(row, keep, strict=True)], [place[c[m]] for c, m in zip(column, keep, strict=True)]
            both = np.zeros((len(sizes[0]), len(sizes[1])), np.int64)
            for start in range(0, int(shared.sum()), COLUMNS):
                slab = []
                for r, c, n in zip(row, column, sizes, strict=True):
                    inside = (c >= start) & (c < start + COLUMNS)
                    m = np.zeros((len(n), COLUMNS), np.float32)
                    m[r[inside], c[inside] - start] = 1
                    slab.append(m)
                both += (slab[0] @ slab[1].T).astype(np.int64)
            either = sizes[0][:, None] + sizes[1][None, :] - both
            names, code = np.unique(np.concatenate([np.asarray(v.field("root").to_pylist(), object) for v in sides]), return_inverse=True)
            code = code[: len(sizes[0])], code[len(sizes[0]) :]
            linked = (both * DENOMINATOR >= either * NUMERATOR) & (code[0][:, None] != code[1][None, :])
            if linked.any():
                yield from _links(_joined(names.tolist(), linked, code))


def _between(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of roots (a, b) that links join; members(band, node, root, main): groups that are not joined yet."""
    own = members.join(sets, "node").withColumn("out", F.col("root") != F.col("main"))
    bulk = F.greatest(F.count("*") / BLOCK, F.sum(F.length("shingles")) / BLOCK_BYTES)
    dealt = own.groupBy("band", "out").agg(F.ceil(bulk).alias("blocks"))
    outside = dealt.where("out").select("band", F.col("blocks").alias("others"))
    dealt = C.written(dealt.join(outside, "band"), "dealt")
    placed = own.join(dealt, ["band", "out"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")))
    blocks = C.written(placed.groupBy("band", "out", "block").agg(F.first("others").alias("others"), F.collect_list(F.struct("node", "root", "shingles")).alias("y")), "blocks")
    from_block = F.when(F.col("out"), F.col("block")).otherwise(F.lit(0))
    met = blocks.select("band", F.explode(F.sequence(from_block, F.col("others") - 1)).alias("block"), "y")
    pairs = blocks.where("out").select("band", "block", F.col("y").alias("x")).join(met, ["band", "block"]).select("x", "y")
    return C.written(pairs.mapInArrow(_blocks, "a binary, b binary"), "between")


def roots(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """node, root for the nodes that verified links join to others; root is the least node of its component."""
    nodes = C.written(signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")), "nodes")
    exploded = nodes.select("node", F.explode("bands").alias("band"))
    first = [F.min_by("node", F.xxhash64("node", F.lit(k))).alias(f"l{k}") for k in range(LEADERS)]
    # Written, as are other sums by band: a join with a sum of the same rows would keep a band in one task, one with a table is split.
    groups = C.written(exploded.groupBy("band").agg(F.count("*").alias("n"), *first).where("n > 1"), "groups")
    rows = C.written(exploded.join(groups, "band"), "bands")
    used = rows.select("node").distinct().join(nodes.select("node", "rep"), "node")
    texts = docs.select("doc_id", "text").join(used, F.col("doc_id").eqNullSafe(F.col("rep"))).where(F.unhex(F.md5(F.col("text").cast("binary"))) == F.col("node")).select("node", "text")
    sets = C.written(texts.mapInArrow(_sets, "node binary, shingles binary").dropDuplicates(["node"]), "shingles")

    deal = F.when(F.col("n") > SMALL, F.pmod(F.xxhash64("node", "band"), F.floor(F.col("n") / MATES))).otherwise(F.lit(0))
    few = rows.groupBy("band", deal.alias("deal")).agg(F.sort_array(F.collect_set("node")).alias("nodes"))  # SMALL at most, or MATES on average
    small = few.select(F.posexplode("nodes").alias("k", "a"), "nodes").select("a", F.explode(F.expr("slice(nodes, k + 2, size(nodes))")).alias("b"))
    large = rows.where(f"n > {SMALL}")
    star = large.select("node", F.explode(F.array_distinct(F.array(*(f"l{k}" for k in range(LEADERS))))).alias("leader")).where("node != leader").select(*_pair("node", "leader"))
    pairs = small.unionByName(star).distinct()
    full = pairs.join(sets.withColumnsRenamed({"node": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"node": "b", "shingles": "y"}), "b")
    seen = C.written(full.select("a", "b", "x", "y").mapInArrow(_linked, "a binary, b binary"), "links")
    found = components(seen)
    C.drop_written(seen)
    rooted = large.join(found, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    sizes = rooted.groupBy("band", "root").agg(F.count("*").alias("of"))
    parted = sizes.groupBy("band").agg(F.max_by("root", F.struct("of", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("band", "main")
    parted = C.written(parted, "parted")
    members = C.written(rooted.join(parted, "band"), "members")
    if not members.isEmpty():
        joined = components(_between(members, sets)).select(F.col("node").alias("root"), F.col("root").alias("top"))
        alone = joined.join(found.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
        found = C.written(found.join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(alone), "roots")
    C.drop_written(nodes, groups, rows, sets, parted, members)
    return found


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each component of edges(a, b); minima over neighbours, with shortcuts, until still.

    The rounds join the edges again and again; so a task first makes stars of those it reads.
    """
    few = C.written(edges.select("a", "b").coalesce(C.size_of(edges) // EDGES_BYTES + 1).mapInArrow(_stars, "a binary, b binary"), "stars")
    both = C.written(few.unionByName(few.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    C.drop_written(few)
    labels = C.written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        seen = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy("a").agg(F.min("root").alias("near"))
        further = labels.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
        new = labels.join(seen, F.col("node") == F.col("a")).join(further, "root", "left")
        new = C.written(new.select("node", F.col("root").alias("was"), F.least("root", "near", "beyond").alias("root")), "labels")
        if new.where("was != root").isEmpty():
            C.drop_written(both, labels)
            return new.select("node", "root")
        C.drop_written(labels)
        labels = new.select("node", "root")


def classes(docs: DataFrame) -> DataFrame:
    """A row per row of docs(doc_id, text): doc_id, class_id (least doc_id of its class, null if all are null), node (binary, the text's key), root (the
    class's least node).

    Documents are in one class when links, or equal texts, join them. Null and empty texts and those of white space
    have no shingles: each is a class of its own (node null). Rows of one doc_id with other texts are documents of their
    own. An empty table gives no rows.
    """
    key = F.unhex(F.md5(F.col("text").cast("binary")))
    id_type = dict(docs.dtypes)["doc_id"]
    signed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("node"), "text").mapInArrow(_signed, "doc_id long, node binary, bands array<long>")
    signed = C.written(signed, "signed")
    found = roots(docs, signed)
    reps = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"))
    rooted = reps.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "rep")
    least = rooted.groupBy("root").agg(F.min("rep").alias("class_id"))
    of = rooted.join(least, "root").select("node", "root", "class_id")
    out = signed.select("doc_id", "node").join(of, "node", "left")
    return out.select(F.col("doc_id").cast(id_type).alias("doc_id"), F.coalesce("class_id", "doc_id").cast(id_type).alias("class_id"), "node", "root")


def first_of_classes(docs: DataFrame) -> DataFrame:
    """docs' rows, all columns, with one row for each class: the one of the least doc_id, then of the least text key.

    Rows without words (null, empty, white space) all stay. Null doc_ids come last; a class that has no other keeps one of
    those rows. Of rows with equal id and text the one stays whose columns come first as JSON. An empty table gives none.
    """
    own = classes(docs.select("doc_id", "text"))
    least = F.min(F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("place"), F.col("doc_id").alias("won_id"), F.col("node").alias("won_node"))).alias("w")
    winners = own.where("node IS NOT NULL").groupBy("root").agg(least).select("w.won_id", "w.won_node")
    rest = F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("worded"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("node"), rest.alias("rest"))
    kept = packed.where("worded").join(winners, (F.col("node") == F.col("won_node")) & F.col("row.doc_id").eqNullSafe(F.col("won_id")), "left_semi")
    return kept.groupBy("node").agg(F.min_by("row", "rest").alias("row")).select("row.*").unionByName(packed.where(~F.col("worded")).select("row.*"))
