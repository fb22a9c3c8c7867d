"""Hilbert-curve sharding: rows close in several metadata dimensions share a shard."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions

BITS = 5


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Curve positions of integer cells (rows of one coordinate per dimension, each of ``bits`` bits)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):  # undo the rotations and reflections from the coarsest square inwards
        half, low = 1 << level, (1 << level) - 1
        for d in range(dims):
            upper = (x[d] & half) != 0
            swap = np.where(upper, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(upper, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[dims - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << 1) | ((x[d] >> level) & 1)
    return out


def quantised(kind: str, col: Column) -> Column:
    """A coordinate of BITS bits: ``log`` for sizes (powers of two), ``name`` for categories (hashed)."""
    top = (1 << BITS) - 1
    if kind == "log":
        return F.least(F.lit(top), F.floor(F.log2(F.greatest(col, F.lit(1)))).cast("int"))
    return (F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % (top + 1)).cast("int")


def hilbert_shards(docs: DataFrame, shards: int, dims: dict[str, str], order: list[str]) -> DataFrame:
    """Deal all rows of ``docs`` into ``shards`` runs of the Hilbert curve, row counts at most one apart.

    ``dims``: column -> ``log`` or ``name``; null counts as 0 or ''. Rows of one cell follow by the columns ``order``,
    so equal rows stay together and the order does not depend on partitions; a cell with a third of all rows is cut by
    these columns as well. Adds shard (int) and slot (long, gapless from 0 in each shard); columns of the caller's of these
    names are replaced, all others pass. With fewer rows than shards some shards are empty, and an empty table gives an
    empty table. Repeated rows have places of their own. Columns travel as given, so leave texts out.

    One range exchange; ranks come from the partitions' row counts (one number each), not from one sorted task.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    n_dims, side = len(dims), 1 << BITS
    if BITS * n_dims > 16:
        raise ValueError("the table of curve positions is broadcast; take at most three dimensions")
    cells = np.stack(np.meshgrid(*[np.arange(side)] * n_dims, indexing="ij"), -1).reshape(-1, n_dims)
    code = cells @ (side ** np.arange(n_dims - 1, -1, -1))
    curve = spark.createDataFrame([(int(a), int(b)) for a, b in zip(code, hilbert_index(cells))], "_cell int, _curve int")
    taken = ("shard", "slot")
    given = [c for c in docs.columns if c.lower() not in taken]
    inner = {c: f"c{k}" for k, c in enumerate(docs.columns)}  # the caller's names can't meet those of this plan
    docs = docs.toDF(*inner.values())
    dims, order = {inner[c]: kind for c, kind in dims.items()}, [inner[c] for c in order]
    cell = F.lit(0)
    for name, kind in dims.items():
        cell = cell * side + quantised(kind, F.col(name))
    keyed = docs.withColumn("_cell", cell.cast("int")).join(F.broadcast(curve), "_cell").drop("_cell")  # 32,768 rows at most
    placed = scratch.table(
        keyed.repartitionByRange(partitions(spark), "_curve", *order)
        .sortWithinPartitions("_curve", *order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    counts = placed.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()
    total, before, starts = sum(r.n for r in counts), 0, []
    for r in counts:
        starts.append((r._part, before))
        before += r.n
    first = F.broadcast(spark.createDataFrame(starts, "_part long, _before long"))  # a row for each partition
    rank = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    ranked = placed.withColumn("_part", F.shiftright("_at", 33)).join(first, "_part").withColumn("_rank", rank)
    shard = F.expr(f"(_rank * {shards}) div {max(total, 1)}")
    slot = F.col("_rank") - F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard.cast("int")).select(*(F.col(inner[c]).alias(c) for c in given), "shard", slot.alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, key: str, path: str, tasks: int | None = None) -> None:
    """Write ``docs`` as one folder per shard, its files in slot order; ``placed``: key, shard and slot. Keys must be unique.

    Tasks get runs of (shard, slot) by range, so a large shard is written by several tasks. Columns of ``docs`` named
    shard or slot are left out.
    """
    rows = docs.select(*(c for c in docs.columns if c.lower() not in ("shard", "slot"))).join(placed.select(key, "shard", "slot"), key)
    by = ["shard", "slot"]
    ranged = rows.repartitionByRange(tasks, *by) if tasks else rows.repartitionByRange(*by)
    ranged.sortWithinPartitions(*by).drop("slot").write.partitionBy("shard").parquet(path)
