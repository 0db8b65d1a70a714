"""Byte-level BPE: exact splitting into pieces, forced cuts inside pieces, and decoding (operator 7)."""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import _common as C

#: Slots for pieces that a worker remembers, at first and at most: they double when 70 % are taken, and at most start
#: anew. Bounds its memory: 24 bytes a slot.
FIRST_SLOTS, SLOTS = 1 << 16, 1 << 20
#: Pieces that go to the encoder at a time.
MISSES = 50_000

_CLASSES: np.ndarray | None = None
SPACE, LETTER, NUMBER, OTHER, UNSURE = 0, 1, 2, 3, 9


def classes() -> np.ndarray:
    """Each code point's class in the splitting pattern; UNSURE where Unicode versions may differ."""
    global _CLASSES
    if _CLASSES is None:
        kind = {"L": LETTER, "N": NUMBER}
        table = np.full(0x110000, OTHER, np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))
            table[c] = UNSURE if k == "Cn" else kind.get(k[0], OTHER)
        for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
            table[c] = SPACE
        _CLASSES = table
    return _CLASSES


def piece_starts(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of texts begin, and which code points are unsure.

    codes: the texts' code points, one after the other; first: where each text begins. The pattern

        's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

    amounts to runs of one class, each with a U+0020 right before it if there is one; of several white-space characters
    before another class the last stands apart; and an apostrophe that begins a piece takes the listed endings along.
    """
    n = len(codes)
    kind = classes()[codes]
    head = np.zeros(n + 1, bool)
    head[first] = True
    head = head[:n]
    start = head.copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    start[:-1] |= space[:-1] & ~space[1:] & ~head[1:]
    start[1:] &= space[1:] | head[1:] | (codes[:-1] != 32)
    at = np.flatnonzero(codes == 39)
    at = at[start[at]]
    for ending in ("s", "t", "re", "ve", "m", "ll", "d"):
        k = len(ending)
        fits = at[at + k < n]
        for j, c in enumerate(ending, 1):
            fits = fits[(codes[fits + j] == ord(c)) & ~head[fits + j]]
        start[fits + 1] = False
        after = fits + k + 1
        start[after[after < n]] = True
    return np.flatnonzero(start), np.flatnonzero(kind == UNSURE)


class Coder:
    """Reads a tokenizer file; encodes many texts at once. New pieces go to encode_pieces; a table remembers them."""

    def __init__(self, path: str, encode_pieces: Callable[[Coder, list[str]], list[np.ndarray]]):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.encode_pieces = encode_pieces
        alphabet = _alphabet()
        self.shown = {b: c for c, b in alphabet.items()}
        vocab = spec["model"]["vocab"]
        self.tokens: dict[int, bytes] = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items() if all(c in alphabet for c in t)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x.get(k) for x in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("only added tokens that stand for their very strings are understood")
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or spec["post_processor"] or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"]:
            raise ValueError("only byte-level tokenizers with the usual splitting pattern are understood")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.in_order = all(vocab[a + b] < vocab[c + d] for (a, b), (c, d) in zip(merges, merges[1:], strict=False))
        texts = [b""] * (max([*self.tokens, *self.special.values()]) + 1)
        for i, t in [*self.tokens.items(), *((i, t.encode()) for t, i in self.special.items())]:
            texts[i] = t
        self.token_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.token_sizes = np.asarray([len(t) for t in texts], np.int64)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self._forget()

    def _forget(self) -> None:
        self._empty(FIRST_SLOTS)
        self.store, self.stored = np.zeros(1 << 16, np.uint32), 0

    def _empty(self, slots: int) -> None:
        self.keys, self.checks = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.at, self.size = np.zeros(slots, np.uint32), np.zeros(slots, np.uint32)
        self.taken = 0

    def _room(self, new: int) -> bool:
        """Doubles the slots until `new` more pieces fit; false if that is beyond the bound and all is forgotten."""
        slots = len(self.keys)
        while self.taken + new > 0.7 * slots and slots < SLOTS:
            slots *= 2
        if self.taken + new > 0.7 * slots:
            self._forget()
            return False
        if slots > len(self.keys):
            old = np.flatnonzero(self.keys)
            key, check, at, size = self.keys[old], self.checks[old], self.at[old], self.size[old]
            self._empty(slots)
            self._place(key, check, at, size)
        return True

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    def _find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Each piece's slot, or -1."""
        slot, last = self._slot(key), len(self.keys) - 1
        out = np.full(len(key), -1, np.int64)
        left = np.arange(len(key))
        while len(left):
            s = slot[left]
            there = self.keys[s]
            same = (there == key[left]) & (self.checks[s] == check[left])
            out[left[same]] = s[same]
            left = left[~same & (there != 0)]
            slot[left] = (slot[left] + 1) & last
        return out

    def _add(self, key: np.ndarray, check: np.ndarray, ids: list[np.ndarray]) -> None:
        sizes = np.asarray([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids)
        while self.stored + len(flat) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros(len(self.store), np.uint32)])
        self.store[self.stored : self.stored + len(flat)] = flat
        at = self.stored + np.cumsum(sizes) - sizes
        self.stored += len(flat)
        self._place(key, check, at, sizes)

    def _place(self, key: np.ndarray, check: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> None:
        self.taken += len(key)
        slot, last = self._slot(key), len(self.keys) - 1
        left = np.arange(len(key))
        while len(left):
            s = slot[left]
            free = self.keys[s] == 0
            self.keys[s[free]], self.checks[s[free]] = key[left[free]], check[left[free]]
            won = free & (self.keys[s] == key[left]) & (self.checks[s] == check[left])
            self.at[s[won]], self.size[s[won]] = at[left[won]], sizes[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & last

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and each text's number of ids. Null counts as empty."""
        listed = texts.to_pylist()
        alone: dict[int, np.ndarray] = {}
        for k, t in enumerate(listed):
            if t and any(x in t for x in self.special):
                alone[k] = self._alone(t)
        counts = np.zeros(len(listed), np.int64)
        for _ in range(2):
            joined = [k for k, t in enumerate(listed) if t and k not in alone]
            whole = "".join([listed[k] for k in joined])
            codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
            sizes = np.asarray([len(listed[k]) for k in joined], np.int64)
            first = np.cumsum(sizes) - sizes
            start, unsure = piece_starts(codes, first)
            if not len(unsure):
                break
            for k in np.unique(np.searchsorted(first, unsure, "right") - 1).tolist():
                alone[joined[k]] = np.asarray(self.library.encode(listed[joined[k]], add_special_tokens=False).ids, np.uint32)
        parts, bounds = (np.zeros(0, np.uint32), np.zeros(1, np.int64)) if not joined else self._pieces(whole, codes, start)
        ends = bounds[np.searchsorted(start, first[1:])] if len(first) > 1 else np.zeros(0, np.int64)
        edges = np.concatenate([[0], ends, [len(parts)]]) if joined else np.zeros(1, np.int64)
        counts[joined] = np.diff(edges)
        if not alone:
            return parts, counts
        place = {k: j for j, k in enumerate(joined)}
        out = [alone[k] if k in alone else parts[edges[place[k]] : edges[place[k] + 1]] for k in range(len(listed)) if k in alone or k in place]
        for k, ids in alone.items():
            counts[k] = len(ids)
        return np.concatenate(out), counts

    def _pieces(self, whole: str, codes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces that begin at `start`, and where each piece's ids begin, with the total at the end."""
        data = np.frombuffer(whole.encode(), np.uint8)
        if len(data) == len(codes):
            begin = start
        else:
            begin = np.zeros(len(codes) + 1, np.int64)
            np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800).astype(np.int64) + (codes >= 0x10000), out=begin[1:])
            begin = begin[start]
        end = np.append(begin[1:], len(data))
        key, check = (C.span_hashes(data, begin, end, seed) | np.uint64(1) for seed in (0, 1))
        slot = self._find(key, check)
        lost = np.flatnonzero(slot < 0)
        if len(lost):
            _, one = np.unique(key[lost], return_index=True)
            new = lost[one]
            if not self._room(len(new)):
                _, new = np.unique(key, return_index=True)
                self._room(len(new))
            for k in range(0, len(new), MISSES):
                some = new[k : k + MISSES]
                ids = self.encode_pieces(self, [data[a:b].tobytes().decode() for a, b in zip(begin[some].tolist(), end[some].tolist(), strict=True)])
                self._add(key[some], check[some], ids)
            slot = self._find(key, check)
            for k in np.flatnonzero(slot < 0).tolist():  # two pieces with one key: all but the first are added here
                if self._find(key[k : k + 1], check[k : k + 1])[0] < 0:
                    self._add(key[k : k + 1], check[k : k + 1], self.encode_pieces(self, [data[begin[k] : end[k]].tobytes().decode()]))
                slot[k] = self._find(key[k : k + 1], check[k : k + 1])[0]
        size = self.size[slot].astype(np.int64)
        bounds = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=bounds[1:])
        return self.store[np.repeat(self.at[slot].astype(np.int64) - bounds[:-1], size) + np.arange(bounds[-1])], bounds

    def _alone(self, text: str) -> np.ndarray:
        """A text with special tokens' strings in it: they stand for themselves and part what is around them."""
        out, at = [], 0
        for m in regex.finditer("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)), text):
            out += self.encode(pa.array([text[at : m.start()]]))[0], np.asarray([self.special[m[0]]], np.uint32)
            at = m.end()
        return np.concatenate([*out, self.encode(pa.array([text[at:]]))[0]])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Each document's ids as text: their bytes as UTF-8; what is no UTF-8 becomes U+FFFD. Special tokens stay."""
        sizes = self.token_sizes[ids]
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        data = self.token_bytes[np.repeat(self.token_starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        edges = ends[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(edges, edges[1:], strict=False)]


def _alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, others from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def by_library(coder: Coder, parts: list[str]) -> list[np.ndarray]:
    """Encodes pieces with the tokenizers library's own model; splitting is done, so its splitter is passed by."""
    shown = coder.shown
    tokenize = coder.library.model.tokenize
    return [np.array([t.id for t in tokenize(p.encode().decode("latin-1").translate(shown))], np.uint32) for p in parts]


class ForcedCuts:
    """Cuts pieces between bytes that no vocabulary token has next to each other, and encodes each fragment alone.

    A merge only ever makes vocabulary tokens, so no merge crosses such a border: the fragments' ids, one after the
    other, are the piece's ids.
    """

    def __init__(self):
        self.ready = False

    def _prepare(self, coder: Coder) -> None:
        import tiktoken

        if not coder.in_order:
            raise ValueError("merges are not in the order of ids")
        self.joined = [bytearray(256) for _ in range(256)]
        for t in coder.tokens.values():
            for a, b in zip(t, t[1:], strict=False):
                self.joined[a][b] = 1
        self.core = tiktoken.Encoding("fragments", pat_str=r"[\s\S]+", mergeable_ranks={t: i for i, t in coder.tokens.items()}, special_tokens={})
        self.ready = True

    def split(self, piece: bytes) -> list[bytes]:
        joined, at, out = self.joined, 0, []
        a = piece[0]
        for k, b in enumerate(piece):
            if k and not joined[a][b]:
                out.append(piece[at:k])
                at = k
            a = b
        out.append(piece[at:])
        return out

    def __call__(self, coder: Coder, parts: list[str]) -> list[np.ndarray]:
        if not self.ready:
            self._prepare(coder)
        one, out = self.core._encode_single_piece, []
        for p in parts:
            ids = []
            for f in self.split(p.encode()):
                ids += one(f)
            out.append(np.asarray(ids, np.uint32))
        return out


def shared_coder(path: str, make: Callable[[], Callable], name: str) -> Coder:
    """This worker's coder for a tokenizer file and a way to encode pieces: tasks of a worker follow one another."""
    if (path, name) not in C.KEPT:
        C.KEPT.clear()
        C.KEPT[path, name] = Coder(path, make())
    return C.KEPT[path, name]


def encode_decode(df: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Ids of every whole text, and the text decoded from them: columns doc_id, ids (binary), decoded.

    A null text counts as empty: no ids, decoded as "". An empty table gives no rows; repeated rows give a row each;
    the input's other columns are not looked at, so clashing names do no harm. Ids are as the tokenizers library gives
    them: text inside special tokens' strings counts as those tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared_coder(tokenizer, ForcedCuts, "forced cuts")
        for b in C.steps(batches, "text", keep=True):
            ids, counts = coder.encode(b.column(1))
            raw = ids.astype("<u4").tobytes()
            ends = (4 * np.concatenate([[0], np.cumsum(counts)])).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([raw[x:y] for x, y in zip(ends, ends[1:], strict=False)], pa.binary()), pa.array(coder.decode(ids, counts), pa.string())], ["doc_id", "ids", "decoded"])

    return df.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text").mapInArrow(run, f"doc_id {dict(df.dtypes)[doc_id]}, ids binary, decoded string")


def digests(df: DataFrame, tokenizer: str) -> DataFrame:
    """For each document of encode_decode's kind: doc_id, n_tokens, and SHA-256 of ids and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared_coder(tokenizer, ForcedCuts, "forced cuts")
        for b in C.steps(batches, "text", keep=True):
            ids, counts = coder.encode(b.column(1))
            raw = ids.astype("<u4").tobytes()
            ends = (4 * np.concatenate([[0], np.cumsum(counts)])).tolist()
            left = [hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(ends, ends[1:], strict=False)]
            right = [hashlib.sha256(t.encode()).hexdigest() for t in coder.decode(ids, counts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts), pa.array(left, pa.string()), pa.array(right, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")

