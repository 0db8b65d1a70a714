"""Reviewers' corrections as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ("doc_id", "field_name")


def latest(events: DataFrame) -> DataFrame:
    """events(event_id, doc_id, field_name, ts, new_value): each field's last correction by ts, then event_id, and their number."""
    return events.groupBy(*KEY).agg(F.max(F.struct("ts", "event_id", "new_value")).alias("b"), F.count("*").alias("edits")).select(*KEY, "b.new_value", "b.ts", "b.event_id", "edits")


def trail(events: DataFrame) -> DataFrame:
    """Each correction with the value that it replaced."""
    w = Window.partitionBy(*KEY).orderBy("ts", "event_id")
    return events.withColumn("old_value", F.lag("new_value").over(w)).withColumn("turn", F.row_number().over(w))


def start_latest(events: DataFrame, table_path: str, checkpoint: str):
    """Folds a stream of corrections into a table of the latest values: each batch's best is merged with what is stored.

    A batch writes a new version folder named by its id, so a repeated batch writes the same one; readers take the newest.
    """

    def fold(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = latest(batch)
        older = newest(spark, table_path, epoch)
        if older is not None:
            both = new.unionByName(older)
            new = both.groupBy(*KEY).agg(F.max(F.struct("ts", "event_id", "new_value")).alias("b"), F.sum("edits").alias("edits")).select(*KEY, "b.new_value", "b.ts", "b.event_id", "edits")
        new.write.mode("overwrite").parquet(f"{table_path}/version={epoch:012d}")

    return events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).start()


def newest(spark: SparkSession, table_path: str, before: int | None = None) -> DataFrame | None:
    """The newest version of a folded table, older than epoch `before` if given; None if there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(table_path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    found = sorted(s.getPath().getName() for s in fs.listStatus(root) if fs.exists(hadoop.Path(s.getPath(), "_SUCCESS")))
    found = [v for v in found if before is None or int(v.partition("=")[2]) < before]
    return spark.read.parquet(f"{table_path}/{found[-1]}") if found else None


def counts_by_window(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """An extension: corrections per event-time window, closed by a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "field_name").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "field_name", "n")
