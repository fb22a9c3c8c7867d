"""Candidate lists from several searches made one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import EngineConfig

KEY = ["qid", "corpus"]


def union_candidates(primary: DataFrame, alternate: DataFrame) -> DataFrame:
    """Both lists by id: the smaller distance, whether it was in the first list, its rank in the second; pos orders.

    Ties of distance go by the id as a string, as references are strings.
    """
    p = primary.select(*KEY, "id", F.col("distance").alias("dp"))
    a = alternate.select(*KEY, "id", F.col("distance").alias("da"), F.col("rank").alias("alternate_rank"))
    both = p.join(a, [*KEY, "id"], "full_outer")
    out = both.select(*KEY, "id", F.least("dp", "da").alias("distance"), F.col("dp").isNotNull().alias("from_primary"), "alternate_rank")
    return out.withColumn("pos", F.row_number().over(W.partitionBy(*KEY).orderBy("distance", F.col("id").cast("string"))))


def prune_alternates(candidates: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Rows of the first list, and of the second alone only its best."""
    return candidates.where(F.col("from_primary") | (F.col("alternate_rank") <= cfg.alternate_rank))


def hybrid_merge(semantic: DataFrame, lexical: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The first semantic rows, then some lexical ones that are not among these, then semantic rows until the list is full.

    A lexical row gets the largest allowed distance, even if it was further down in the semantic list. Lists: qid, corpus,
    id, rank (and distance).
    """
    head = semantic.where(F.col("rank") <= cfg.semantic_k).select(*KEY, "id", "distance", F.lit(False).alias("from_lexical"), F.lit(0).alias("part"), F.col("rank").alias("at"))
    new = lexical.join(head.select(*KEY, "id"), [*KEY, "id"], "left_anti")
    new = new.withColumn("at", F.row_number().over(W.partitionBy(*KEY).orderBy("rank"))).where(F.col("at") <= cfg.lexical_k)
    new = new.select(*KEY, "id", F.lit(cfg.max_distance).alias("distance"), F.lit(True).alias("from_lexical"), F.lit(1).alias("part"), "at")
    rest = semantic.where(F.col("rank") > cfg.semantic_k).join(new.select(*KEY, "id"), [*KEY, "id"], "left_anti")
    rest = rest.select(*KEY, "id", "distance", F.lit(False).alias("from_lexical"), F.lit(2).alias("part"), F.col("rank").alias("at"))
    merged = head.union(new).union(rest).withColumn("pos", F.row_number().over(W.partitionBy(*KEY).orderBy("part", "at")))
    return merged.where((F.col("pos") <= cfg.candidate_k) | (F.col("part") < 2)).drop("part", "at")


def admit_alternates(scored: DataFrame, cfg: EngineConfig) -> DataFrame:
    """After scoring: of the homelab rows that only the second list has, the best ranks; and if no row of the first list
    is above the cut, only those that are clearly relevant."""
    strong = F.max(F.when(F.col("from_primary") & (F.col("corpus") == "homelab"), F.col("relevance"))).over(W.partitionBy("qid"))
    alone = (F.col("corpus") == "homelab") & ~F.col("from_primary")
    enough = F.when(F.coalesce(F.col("_strong") >= cfg.reject, F.lit(False)), F.lit(True)).otherwise(F.col("relevance") >= cfg.alternate_alone)
    fine = ~alone | ((F.col("alternate_rank") <= cfg.alternate_rank) & enough)
    return scored.withColumn("_strong", strong).where(fine).drop("_strong")
