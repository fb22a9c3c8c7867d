"""Where the engine writes what it needs again: a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where that is unset and Spark runs on one machine (tests) a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/quillon-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str = "table", by: list[str] | None = None) -> DataFrame:
    """The same rows, read back from a written table: cut lineage that outlives lost executors."""
    path = new_folder(df.sparkSession, name)
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quillon_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._quillon_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
