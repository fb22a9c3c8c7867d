"""Notes and logs as streams: idempotent batches, throttled triggers, daily partitions, late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import querylog
from ..workspace import new_folder


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files as they appear, those that are there already first."""
    return spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(path).select(F.col("_metadata.file_path").alias("raw_path"), F.col("value").alias("content"))


def pace(seconds: int | None) -> dict:
    """A trigger: every so many seconds (changes in between are one batch), or once for all that is there."""
    return {"processingTime": f"{seconds} seconds"} if seconds else {"availableNow": True}


def log_queries(stream: DataFrame, target: str, checkpoint: str, seconds: int | None = None):
    """Query records (querylog.FIELDS and ts) checked, redacted and appended by day; faulty ones go beside them, without
    their texts. The checkpoint makes each record count once, also when a batch is run again."""

    def write(batch: DataFrame, number: int) -> None:
        rows = querylog.checked(batch).select(F.to_date("ts").alias("day"), "line", "fault").persist()
        rows.where("line is not null").select("day", "line").write.mode("overwrite").partitionBy("day").parquet(f"{target}/records/batch={number}")
        rows.where("fault is not null").groupBy("day", "fault").count().write.mode("overwrite").parquet(f"{target}/faults/batch={number}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**pace(seconds)).start()


def upsert_batches(stream: DataFrame, target: str, key: list[str], checkpoint: str, seconds: int | None = None):
    """Write each batch as its own version folder; replaying a batch overwrites its folder, so nothing is counted twice. Of
    a key's rows in a batch the one that is largest by its other columns, in their order, is taken: the same in a replay."""

    def write(batch: DataFrame, version: int) -> None:
        rest = [c for c in batch.columns if c not in key]
        batch.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_r")).select(*key, "_r.*").write.mode("overwrite").parquet(f"{target}/version={version}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**pace(seconds)).start()


def current(spark: SparkSession, target: str, key: list[str]) -> DataFrame:
    """The latest version of each key."""
    rows = spark.read.option("basePath", target).parquet(target)
    return rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), "version").alias("r")).select(*key, "r.*")


def append_log(stream: DataFrame, target: str, checkpoint: str):
    """Events appended below one folder a day; the file sink's checkpoint makes that exactly once."""
    by_day = stream.withColumn("day", F.to_date("ts"))
    return by_day.writeStream.format("parquet").partitionBy("day").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Beyond the reference: events by type in windows of event time, with a bound for late ones."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))


def ingest_available(spark: SparkSession, path: str) -> DataFrame:
    """All events that are there, through the log sink; events by day and type."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    target = new_folder(spark, "log")
    query = append_log(stream, target, new_folder(spark, "checkpoint"))
    query.awaitTermination()
    return spark.read.parquet(target).groupBy("day", "event_type").agg(F.count("*").alias("n"))
