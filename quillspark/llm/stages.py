"""The corpus pipeline's stages: each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the columns of documents. Rows without an accepted language, later copies, contaminated
rows go; texts lose personal data; the last stage returns token ids and what they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from . import bpe, decontaminate, language_id, minhash, pii
from .queries import TOKENIZER, table


def detect_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is found among the accepted ones; their other columns stay as they were, whatever their names.

    Null and empty texts, those without letters, and those of other languages go. Repeated rows are judged alike; an empty
    table gives no rows.
    """
    names = docs.columns
    own = [f"__c{k}" for k in range(len(names))]
    marked = docs.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(names, own, strict=True)))
    low = [c.lower() for c in names]
    found = language_id.of_documents(marked, *(own[low.index(c)] for c in ("text", "lang", "source"))).where("kept")
    return found.select(*(F.col(o).alias(c) for c, o in zip(names, own, strict=True)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, as minhash.first_of_classes says: texts without words, null ones too, all stay.

    Of equal ids and texts one row stays; an empty table gives no rows.
    """
    return minhash.first_of_classes(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark window occurs. Null and empty texts stay, repeated rows too; an empty table gives no rows."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows the text where there is such a column.

    Null texts stay null, empty ones empty; every row stays.
    """
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of ids and of the decoded text; a null text counts as empty; a row for every row."""
    return bpe.digests(docs, TOKENIZER)


STAGES = [
    ("language ID", detect_language),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("PII", redacted),
    ("BPE encoding and decoding", encoded),
]


def run(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """All stages, each one's rows written to the shared folder and read again."""
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = C.written(docs, f"stage-{k}")
    return docs
