"""URL filter: rules, and a character language-model ratio for the rest (operator 1).

The models are variable-order Markov chains over a small alphabet: one from URLs that rules accept, one from URLs that
rules reject. A symbol's probability interpolates the orders 0 to ORDER (Witten-Bell weights), so a context counts as
far as it has been seen. Their counts are two arrays of A ** (ORDER + 1) cells, whatever the input's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: Letters, one symbol for all digits, the marks of URLs, one for other ASCII, one for non-ASCII, and the border.
MARKS = "/.-_?=&%#:"
ALPHABET = 1 + 26 + 1 + len(MARKS) + 2
ORDER = 3
#: Share of the labelled URLs, by hash, that only calibrate the threshold.
HELD_OUT = 5
#: Score bins for calibration: score differences of -RANGE to RANGE in steps of 1 / STEPS.
RANGE, STEPS = 12, 200

_SYMBOLS = np.full(256, ALPHABET - 2, np.int64)
_SYMBOLS[128:] = ALPHABET - 1
for _i in range(26):
    _SYMBOLS[65 + _i] = _SYMBOLS[97 + _i] = 1 + _i
_SYMBOLS[48:58] = 27
for _i, _c in enumerate(MARKS):
    _SYMBOLS[ord(_c)] = 28 + _i


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; null or no :// gives ''."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_verdict(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict), the last listed of equally long ones; null if none does. Rules: (verdict, host, path prefix)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & (path.startswith(p) if p else F.lit(True))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _encoded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each after ORDER borders and before one; and where each text's scored symbols end."""
    parts = [_SYMBOLS[np.frombuffer((t or "").encode(), np.uint8)] for t in texts]
    zero, one = np.zeros(ORDER, np.int64), np.zeros(1, np.int64)
    flat = np.concatenate([x for p in parts for x in (zero, p, one)]) if parts else zero
    return flat, np.cumsum([len(p) + ORDER + 1 for p in parts])


def _cells(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each scored symbol its cell, context and symbol as one number, and its text."""
    cell = np.zeros(len(flat), np.int64)
    for k in range(ORDER + 1):
        cell[k:] += flat[: len(flat) - k] * ALPHABET**k
    text = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    begin = np.concatenate([[0], ends[:-1]])[text]
    scored = np.arange(len(flat)) - begin >= ORDER
    return cell[scored], text[scored]


def counts(labelled: DataFrame) -> DataFrame:
    """Columns cell, accepted, rejected: sums over all rows of labelled (text, accept), combined within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, ALPHABET ** (ORDER + 1)), np.int64)
        for b in C.steps(batches, "text"):
            flat, ends = _encoded(b.column(0).to_pylist())
            cell, text = _cells(flat, ends)
            accept = np.asarray(b.column(1), bool)[text]
            for k in (0, 1):
                u, n = np.unique(cell[accept == (k == 0)], return_counts=True)
                total[k, u] += n
        at = np.flatnonzero(total.any(0))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], ["cell", "accepted", "rejected"])

    part = labelled.mapInArrow(run, "cell long, accepted long, rejected long")
    return part.groupBy("cell").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))


def log_probabilities(total: np.ndarray) -> np.ndarray:
    """Log2 of each symbol's probability after each context of ORDER symbols, from one class's counts."""
    shape = (ALPHABET,) * (ORDER + 1)
    full = total.reshape(shape).astype(np.float64)
    p = np.full(ALPHABET, 1 / ALPHABET)
    for order in range(ORDER + 1):
        c = full.sum(axis=tuple(range(ORDER - order)))
        n, kinds = c.sum(-1, keepdims=True), (c > 0).sum(-1, keepdims=True)
        p = np.where(n > 0, (c + kinds * p) / np.maximum(n + kinds, 1), p)
    return np.log2(p).astype(np.float32).reshape(-1)


def score_column(df: DataFrame, table: np.ndarray, out: str) -> DataFrame:
    """Adds the score of df's column text: mean log2 ratio (accepted over rejected) per symbol, with the closing border."""
    bc = df.sparkSession.sparkContext.broadcast(table)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.steps(batches, "text"):
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            cell, text = _cells(*_encoded(texts))
            n = np.bincount(text, minlength=len(texts))
            score = np.bincount(text, weights=bc.value[cell], minlength=len(texts)) / n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.round(score, 9))], [*names, out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"{out} double"])
    return df.mapInArrow(run, schema)


def calibrated(bins: list[tuple[int, bool, int]]) -> float:
    """The threshold at which the held-out URLs' two error rates sum to least; of equals the middle one. 0 without both classes."""
    n = 2 * RANGE * STEPS + 1
    c = np.zeros((2, n))
    for b, accept, k in bins:
        c[0 if accept else 1, b + RANGE * STEPS] += k
    if not c.sum(1).all():
        return 0.0
    share = c / c.sum(1, keepdims=True)
    lost = np.concatenate([[0], np.cumsum(share[0])])  # accepted URLs under each bin's lower edge
    kept = 1 - np.concatenate([[0], np.cumsum(share[1])])
    best = np.flatnonzero(lost + kept <= (lost + kept).min() + 1e-12)
    return float(best[len(best) // 2] - RANGE * STEPS) / STEPS


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """Judges every URL: key, host, path, rule (host and path prefix, else null), verdict (allow or block), score, threshold.

    Both models count all URLs that rules decide, but for every HELD_OUT-th by hash, on which the threshold is set.
    The models read whole URLs, with scheme, query and fragment; rules read host and path, and win over the models. Null
    URLs and those without :// have an empty host and path and fit no rule; null is scored as empty text. With no URL of one class there is no model: what fits no rule is allowed (score 0). Repeated rows give a row
    each, an empty table none; only the two named columns are read.
    """
    spark = pages.sparkSession
    u = F.col(f"`{url}`")
    judged = pages.select(F.col(f"`{key}`").alias(key), host_of(u).alias("host"), path_of(u).alias("path"), F.coalesce(u, F.lit("")).alias("text"))
    judged = judged.select(key, "host", "path", rule_verdict(F.col("host"), F.col("path"), rules).alias("r"), "text")
    labelled = judged.where("r IS NOT NULL").select("text", (F.col("r.verdict") == "allow").alias("accept"))
    held = F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0
    total = np.zeros((2, ALPHABET ** (ORDER + 1)), np.int64)
    for r in counts(labelled.where(~held)).toLocalIterator():  # at most ALPHABET ** (ORDER + 1) rows
        total[:, r.cell] = r.accepted, r.rejected
    threshold = 0.0
    if total.any(1).all():
        ratio = log_probabilities(total[0]) - log_probabilities(total[1])
        bin_of = F.least(F.greatest(F.floor(F.col("score") * STEPS), F.lit(-RANGE * STEPS)), F.lit(RANGE * STEPS))
        bins = score_column(labelled.where(held), ratio, "score").groupBy(bin_of.cast("int").alias("b"), "accept").count()
        threshold = calibrated([tuple(r) for r in bins.collect()])
    else:
        ratio = np.zeros(ALPHABET ** (ORDER + 1), np.float32)
    out = score_column(judged.select(key, "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("said"), "text"), ratio, "score")
    own = F.when(F.col("score") >= F.lit(threshold), "allow").otherwise("block")
    return out.select(key, "host", "path", "rule", F.coalesce("said", own).alias("verdict"), "score", F.lit(threshold).alias("threshold"))
