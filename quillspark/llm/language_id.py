"""Language ID by Bayesian evidence fusion (operator 9).

Evidence: the text's byte n-grams, the language that the markup declares, the address's suffix, and the host's prior.
Host priors come from grouped aggregation over all rows and are smoothed along host, registered domain, suffix, all.
Each piece of evidence adds to a log posterior; missing evidence adds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

LANGUAGES = ("de", "en", "es", "fr")
#: Rows per language that the text model is fitted on, chosen by hash: on average this many, or all if there are fewer.
FIT_ROWS = 2000
#: Buckets of byte trigrams.
BUCKETS = 1 << 15
#: Pseudo-count of the parent level's distribution in a host's prior.
HOST_WEIGHT = 20.0
#: Probability that a declared language is right, and that a country suffix is.
DECLARED_RIGHT = 0.9
SUFFIX_RIGHT = 0.6
#: Neighbouring trigrams are not independent: their log-likelihoods count this much.
TEXT_WEIGHT = 0.3
#: Share of texts in no language of the list, whose trigrams are taken as even over all buckets.
UNKNOWN_PRIOR = 0.02
#: Least posterior of the best language for a document to stay.
MIN_POSTERIOR = 0.5
#: Country suffixes and the language that most hosts under them use; a fixed table.
SUFFIXES = {"at": "de", "ch": "de", "de": "de", "li": "de", "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en", "ar": "es", "cl": "es", "co": "es", "es": "es", "mx": "es", "pe": "es", "fr": "fr", "mc": "fr", "sn": "fr"}
#: Hosts whose priors may be broadcast; beyond it they are joined by shuffle.
BROADCAST_HOSTS = 50_000


def declared_of(html: Column) -> Column:
    """The primary language tag of <html lang="...">, lower-case; null if there is none."""
    tag = F.lower(F.regexp_extract(html, r"(?i)<html[^>]{0,500}?\slang\s*=\s*[\x22\x27]?([A-Za-z]{2,3})", 1))
    return F.when(tag != "", tag)


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"(?s)^.*?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def text_of(html: Column) -> Column:
    """What is left of a page without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def primary(declared: str | None) -> str | None:
    """The language code that a declared tag begins with; null if it names none."""
    code = (declared or "").lower().replace("_", "-").partition("-")[0]
    return code if 2 <= len(code) <= 3 and code.isalpha() and code != "und" else None


def _letters() -> np.ndarray:
    """Byte classes for trigrams: a-z folded, bytes of non-ASCII characters as they are, all else a border."""
    t = np.full(256, 32, np.int64)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


_FOLD = _letters()


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the byte trigrams of a whole text, borders squeezed; those of borders alone are left out."""
    raw = _FOLD[np.frombuffer((text or "").encode(), np.uint8)]
    if not len(raw):
        return np.zeros(0, np.int64)
    raw = np.concatenate([[32], raw, [32]])
    keep = np.concatenate([[True], (raw[1:] != 32) | (raw[:-1] != 32)])
    raw = raw[keep]
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    return (raw[:-2] * 40503 + raw[1:-1] * 2654435 + raw[2:] * 97) * 2654435761 % (1 << 32) >> 17


def fit(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> np.ndarray:
    """Log-probabilities (languages x BUCKETS) from a bounded sample of rows with a declared language.

    docs: text, declared. About FIT_ROWS rows per language, by the texts' hash; a language without rows gets the mean of the others.
    """
    spark = docs.sparkSession
    have = {r[0]: r[1] for r in docs.where(F.col("declared").isin(*languages)).groupBy("declared").count().collect()}
    share = F.lit(0.0)
    for lang, n in have.items():
        share = F.when(F.col("declared") == lang, F.lit(min(1.0, FIT_ROWS / n))).otherwise(share)
    some = docs.where(F.col("declared").isin(*languages) & (F.pmod(F.xxhash64("text", F.lit(9)), F.lit(1 << 20)) < share * (1 << 20)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for b in C.steps(batches, "text"):
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[languages.index(lang)] += np.bincount(trigrams(t), minlength=BUCKETS)
        row, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(at), pa.array(total[row, at])], ["lang", "bucket", "n"])

    c = np.zeros((len(languages), BUCKETS))
    for r in some.select("declared", "text").mapInArrow(count, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        c[r.lang, r.bucket] = r.n  # at most len(languages) * BUCKETS rows
    seen = c.sum(1) > 0
    if seen.any():
        c[~seen] = c[seen].mean(0)
    all_of = c.sum(0) + 0.5
    mean = all_of / all_of.sum()
    return np.log((c + 200 * mean) / (c.sum(1, keepdims=True) + 200)).astype(np.float32)


#: The levels of a host's prior, from the host up.
LEVELS = ("host", "domain", "suffix", "whole")


def host_counts(rows: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """Declared languages of each host, of its domain (the last two labels), of its suffix and of all rows: host and, for each level, an array of counts.

    rows: host, declared. A host without a dot is its own domain and suffix. Counts are sums over all rows; hosts are
    summed again for the levels above, so a hot host is one row there.
    """
    names = [f"c{k}" for k in range(len(languages))]
    hosts = rows.where(F.col("host").isNotNull()).groupBy("host").agg(*(F.count_if(F.col("declared") == lang).alias(n) for lang, n in zip(languages, names, strict=True)))
    parts = F.split("host", r"\.")
    hosts = hosts.select("*", F.element_at(parts, -1).alias("suffix"), F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), ".").alias("domain"))
    listed = F.array(*names)
    summed = lambda key: hosts.groupBy(key).agg(F.array(*(F.sum(n) for n in names)).alias(f"of_{key}"))
    whole = hosts.agg(F.array(*(F.coalesce(F.sum(n), F.lit(0)) for n in names)).alias("of_whole"))
    return hosts.select("host", "domain", "suffix", listed.alias("of_host")).join(summed("domain"), "domain").join(summed("suffix"), "suffix").crossJoin(F.broadcast(whole)).select("host", *(f"of_{k}" for k in LEVELS))  # whole is one row


def prior_of(counts: list[list[int]], own: int | None = None) -> np.ndarray:
    """A host's prior over the languages: counts of its levels, from the host up, each smoothed with the level above, the last with even shares.

    own: the place of the language that the row itself declares, which is left out of all counts: a row's declaration is
    evidence of its own and does not count twice.
    """
    p = np.full(len(counts[0]), 1 / len(counts[0]))
    for level in reversed(counts):
        c = np.asarray(level, np.float64)
        if own is not None:
            c = c.copy()
            c[own] = max(c[own] - 1, 0)
        p = (c + HOST_WEIGHT * p) / (c.sum() + HOST_WEIGHT)
    return p


def identify(docs: DataFrame, text: str, declared: Column | None = None, host: Column | None = None, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """Adds detected_lang, posterior, and kept to docs' columns.

    kept: a language was found with posterior MIN_POSTERIOR or more, and the text has letters. The posterior is over the
    languages and 'none of them', a class of even trigrams that a declared language outside the list speaks for. A text without letters
    (null, empty, marks only) has detected_lang null, posterior 0 and is not kept. Evidence that is missing adds
    nothing; equal posteriors go to the language first in the list. Repeated rows are judged
    alike, an empty table gives no rows. Columns of docs named as the new ones are replaced; any other names do.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ("detected_lang", "posterior", "kept")]
    none = F.lit(None).cast("string")
    # The text travels once, in its row.
    inside = own if text.lower() in (c.lower() for c in own) else [*own, text]
    at = [c.lower() for c in inside].index(text.lower())
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in inside)).alias("row"), F.col(f"`{text}`").alias("text"), (none if declared is None else declared).alias("declared"), (none if host is None else host).alias("host"))
    marked = packed.select("text", "declared", "host")
    table = spark.sparkContext.broadcast(fit(marked, languages))
    if host is None:
        joined = packed.select("row", "declared", "host", *(F.lit(None).cast("array<long>").alias(f"of_{k}") for k in LEVELS))
    else:
        counts = C.written(host_counts(marked.select("host", "declared"), languages), "host-counts")
        joined = packed.join(C.broadcast_if_small(counts, counts.count(), BROADCAST_HOSTS), "host", "left").select("row", "declared", "host", *(f"of_{k}" for k in LEVELS))
    n = len(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp = table.value
        with_text = (pa.RecordBatch.from_arrays([b.column(0).field(at), *b.columns], ["text", *b.schema.names]) for b in batches)
        for b in C.steps(with_text, "text"):
            texts, _, said_by, hosts, *levels = (b.column(k).to_pylist() if k != 1 else None for k in range(4 + len(LEVELS)))
            best, post = [], []
            for k, (t, d, h) in enumerate(zip(texts, said_by, hosts, strict=True)):
                grams = trigrams(t)
                if not len(grams):
                    best.append(None)
                    post.append(0.0)
                    continue
                s = np.append(TEXT_WEIGHT * logp[:, grams].astype(np.float64).sum(1), -TEXT_WEIGHT * len(grams) * np.log(BUCKETS))
                said, suffix = primary(d), SUFFIXES.get(h.rpartition(".")[2]) if h and "." in h else None
                counts = [x[k] for x in levels]
                prior = np.full(n, 1 / n) if counts[0] is None else prior_of(counts, languages.index(d) if d in languages else None)
                s += np.log([*((1 - UNKNOWN_PRIOR) * prior), UNKNOWN_PRIOR])
                for code, right in ((said, DECLARED_RIGHT), (suffix, SUFFIX_RIGHT)):
                    if code in languages:
                        s += np.log([right if x == code else (1 - right) / n for x in [*languages, None]])
                    elif code:
                        s += np.log([(1 - right) / n] * n + [right])
                p = np.exp(s - s.max())
                i = int(p[:n].argmax())
                best.append(languages[i])
                post.append(round(float(p[i] / p.sum()), 6))
            kept = [x is not None and p >= MIN_POSTERIOR for x, p in zip(best, post, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(best, pa.string()), pa.array(post, pa.float64()), pa.array(kept, pa.bool_())], ["row", "detected_lang", "posterior", "kept"])

    shape = packed.schema["row"].dataType.simpleString()
    return joined.mapInArrow(run, f"row {shape}, detected_lang string, posterior double, kept boolean").select(*(F.col(f"row.`{c}`") for c in own), "detected_lang", "posterior", "kept")


def of_documents(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """identify() for documents(text, lang, source): lang is what was declared, source stands for the host."""
    low, host = F.lower(F.trim(F.col(f"`{lang}`"))), F.trim(F.col(f"`{source}`"))
    return identify(docs, text, F.when(low != "", low), F.when(host != "", host))


def of_pages(pages: DataFrame) -> DataFrame:
    """identify() for pages(url, html): adds text, the page without its markup."""
    return identify(pages.withColumn("text", text_of(F.col("html"))), "text", declared_of(F.col("html")), host_of(F.col("url")))
