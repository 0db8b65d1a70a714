"""What a service in front of the engine calls: uploads, processing, results, reviews, the log and purging, as tables in one folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

UPLOADS = "doc_id string, path string, at timestamp"
FIELDS = "doc_id string, page_num int, field_name string, value string, confidence double, category string"
REVIEWS = "doc_id string, field_name string, new_value string, reviewer string, at timestamp"
LOG = "at timestamp, doc_id string, event string"


class Desk:
    """Tables uploads, results, reviews and log under a shared folder; all but results are only ever added to.

    A document that is processed again replaces its own results. A folder without tables is an empty desk.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        return self.spark.read.schema(schema).parquet(path) if files.exists(self.spark, f"{path}/*") else self.spark.createDataFrame([], schema)

    def _log(self, rows: DataFrame, event: str) -> None:
        rows.select(F.current_timestamp().alias("at"), F.col("doc_id").cast("string").alias("doc_id"), F.lit(event).alias("event")).write.mode("append").parquet(f"{self.root}/log")

    def upload(self, documents: DataFrame) -> None:
        """documents(doc_id, path)."""
        documents.select(F.col("doc_id").cast("string").alias("doc_id"), "path", F.current_timestamp().alias("at")).write.mode("append").parquet(f"{self.root}/uploads")
        self._log(documents, "uploaded")

    def process(self, extract: Callable[[DataFrame], DataFrame], doc_ids: DataFrame | None = None) -> None:
        """Runs extract, a function from uploads to fields (FIELDS), on the latest upload of each document, or of those in doc_ids(doc_id)."""
        latest = self._table("uploads", UPLOADS).groupBy("doc_id").agg(F.max_by("path", "at").alias("path"))
        todo = latest if doc_ids is None else latest.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
        fields = extract(todo).select("page_num", "field_name", "value", "confidence", "category", "doc_id")
        fields.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(f"{self.root}/results")
        self._log(todo, "processed")

    def results(self, doc_id: str | None = None) -> DataFrame:
        """Fields with the latest reviewed value, if any, in place of the read one; of all documents or of one."""
        fields = self._table("results", FIELDS)
        fields = fields if doc_id is None else fields.where(F.col("doc_id") == doc_id)
        last = self._table("reviews", REVIEWS).groupBy("doc_id", "field_name").agg(F.max_by(F.struct("new_value", "reviewer"), "at").alias("r"))
        out = fields.join(last, ["doc_id", "field_name"], "left")
        return out.select("doc_id", "page_num", "field_name", F.coalesce("r.new_value", "value").alias("value"), F.when(F.col("r.new_value").isNotNull(), 1.0).otherwise(F.col("confidence")).alias("confidence"), "category", F.col("r.reviewer").alias("reviewer"))

    def to_review(self, least: float = 0.85) -> DataFrame:
        """Fields that nobody has reviewed and that are not sure."""
        return self.results().where(F.col("reviewer").isNull() & (F.col("confidence") < least))

    def review(self, corrections: DataFrame) -> None:
        """corrections(doc_id, field_name, new_value, reviewer)."""
        corrections.select("doc_id", "field_name", "new_value", "reviewer", F.current_timestamp().alias("at")).write.mode("append").parquet(f"{self.root}/reviews")
        self._log(corrections.select("doc_id").distinct(), "reviewed")

    def log(self, n: int = 100) -> DataFrame:
        """The last n events; a report for people."""
        return self._table("log", LOG).orderBy(F.desc("at"), "doc_id", "event").limit(n)

    def purge(self, really: bool = False) -> list[str]:
        """Uploads' list, results, reviews and log, gone for good when told so."""
        return files.purge(self.spark, *(f"{self.root}/{t}" for t in ("uploads", "results", "reviews", "log")), really=really)
