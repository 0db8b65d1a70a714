"""The training-data operators' queries over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, language_id, lm_score, minhash, pii, quality, substring_dedup, token_store, url_filter

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "example.net", "/de/8"), ("allow", "net", "/de/"), ("block", "org", "/es/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_store.stored(docs, TOKENIZER, END_ID).drop("shard")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(table(spark, sf_dir, "documents"), texts=False).drop("kept_text")


def op5_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), TOKENIZER)


def op8_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.of_documents(table(spark, sf_dir, "documents")).select("doc_id", "lang", "detected_lang", "posterior", "kept")


def op9_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.of_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "detected_lang", "posterior", "kept")


def op10_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"), TOKENIZER)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_token_store": op2_token_store,
        "op3_pii": op3_pii,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_line_cleaning": op5_line_cleaning,
        "op6_decontaminate": op6_decontaminate,
        "op7_bpe": op7_bpe,
        "op8_probminhash": op8_probminhash,
        "op9_language_id": op9_language_id,
        "op9_language_id_pages": op9_language_id_pages,
        "op10_lattice_score": op10_lattice_score,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_substring_dedup": substring_dedup.ORACLE_SQL, "op5_line_cleaning": quality.ORACLE_SQL, "op6_decontaminate": decontaminate.ORACLE_SQL}
