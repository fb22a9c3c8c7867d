"""What the operators of this package share: inputs, scratch tables, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextlib.contextmanager
def settings(spark: SparkSession, **values):
    """Session settings (dots as two underscores) for the eager work inside; the old ones come back."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def parts_of(batch: pa.RecordBatch, column: int, most: int = 4 << 20):
    """The batch in slices of about ``most`` bytes of a string or binary column; a longer value is a slice of its own."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist() if batch.column(column).nbytes > most else []
    lo, total = 0, 0
    for k, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(lo, k - lo)
            lo, total = k, 0
        total += n
    yield batch.slice(lo)


def _trim() -> None:
    """Free memory goes back to the system: workers are kept for later tasks, and allocators keep what they had."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def by_bytes(column: int, most: int = 4 << 20):
    """For functions of Arrow batches: they get slices of bounded bytes of a column, and leave no free memory behind."""

    def wrap(run):
        @wraps(run)
        def sliced(batches):
            try:
                yield from run(part for batch in batches for part in parts_of(batch, column, most))
            finally:
                _trim()

        return sliced

    return wrap


class Scratch:
    """Written intermediate tables in the folder that the cluster shares.

    A written table cuts the lineage as checkpoint() does and outlives lost executors. The folder is
    ``spark.checkpoint.dir``; only where that is unset and Spark runs on one machine (tests) a temporary one is made.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="quillon-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.root = f"{base.rstrip('/')}/quillon/{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def table(self, df: DataFrame, schema=None) -> DataFrame:
        """The same rows, read back from a written table."""
        path = f"{self.root}/{uuid.uuid4().hex[:12]}"
        df.write.parquet(path)
        out = self.spark.read.schema(schema or df.schema).parquet(path)
        self.paths[id(out)] = path
        out._quillon_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more, and let Spark free their shuffle files."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t._quillon_path)
            p.getFileSystem(conf).delete(p, True)
        self.release()

    def release(self) -> None:
        """Shuffle files go when the driver's JVM drops their handles; large jobs can't wait for that."""
        gc.collect()
        self.spark._jvm.System.gc()


def joined(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids that join what a matrix of links joins; ``left`` and ``right``: ids of its rows and columns.

    Every id but the smallest of a component makes one pair with the smallest. Labels fall to the smallest linked one,
    and to its label, until they are still: a few passes over the matrix, whatever the number of links.
    """
    ids, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    row, column, n = at[: len(left)], at[len(left) :], len(ids)
    label, moved = np.arange(n), linked.any()
    while moved:
        new = label.copy()
        np.minimum.at(new, row, np.where(linked, label[column], n).min(1))
        np.minimum.at(new, column, np.where(linked, new[row][:, None], n).min(0))
        new = new[new]
        moved, label = (new != label).any(), new
    below = np.flatnonzero(label != np.arange(n))
    return ids[below], ids[label[below]]


def connected_components(scratch: Scratch, edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star steps.

    ``edges``: columns a, b of one orderable type, any order, repeats allowed, no nulls. Returns ``node`` and ``root``
    (the smallest node of its component) for every node of an edge that joins two different nodes. Every round is one
    partial-aggregated minimum and one join by node, so a hub with a third of all edges is split by Spark's skew
    handling; nothing is gathered in one task or on the driver but one count a round.
    """
    cur = scratch.table(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour hangs below the smallest of the neighbourhood
        large = scratch.table(
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        # small star: a node and its smaller neighbours hang below the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        nxt = scratch.table(
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).distinct()
        )
        # done when every node hangs below exactly one that hangs below none
        ends = nxt.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above"))
        ends = ends.union(nxt.select(F.col("v").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        ends = ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        done = not ends.where("below > 1 or below + above > 1").head(1)
        scratch.drop(large, cur)
        cur = nxt
        if done:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
