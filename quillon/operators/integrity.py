"""Is what is stored consistent?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parity(entries: DataFrame, vectors: DataFrame) -> DataFrame:
    """corpus, id, kind: embedded entries without a vector (missing), vectors without an entry (orphan)."""
    key = ["corpus", "id"]
    due = entries.where("embedded_at is not null").select(*key)
    missing = due.join(vectors.select(*key), key, "left_anti").withColumn("kind", F.lit("missing"))
    return missing.union(vectors.select(*key).join(entries.select(*key), key, "left_anti").withColumn("kind", F.lit("orphan")))


def vector_faults(vectors: DataFrame, dimension: int) -> DataFrame:
    """id and fault of vectors that search can't use."""
    odd = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fault = F.when(F.col("x").isNull(), "null").when(F.size("x") != dimension, "dimension").when(odd, "not finite")
    return vectors.select("id", fault.alias("fault")).where("fault is not null")


def health(entries: DataFrame, vectors: DataFrame, stored: dict, wanted: dict) -> dict:
    """Counts by kind and the settings that differ; healthy if there is nothing to report."""
    counts = {r["kind"]: r["count"] for r in parity(entries, vectors).groupBy("kind").count().collect()}
    differs = sorted(k for k in wanted if stored.get(k) != wanted[k])
    return {"healthy": not counts and not differs, "missing": counts.get("missing", 0), "orphan": counts.get("orphan", 0), "settings": differs}


def valid_ids(rows: DataFrame, column: str = "id") -> DataFrame:
    """Rows whose id, as text, is a number from 1 on; as a number."""
    number = F.when(F.col(column).rlike("^[0-9]+$"), F.col(column).try_cast("long"))
    return rows.withColumn(column, number).where(F.col(column) >= 1)


#: What a collection of vectors must say about itself.
METADATA = {"space": "cosine", "schema_version": 1}


def metadata_faults(metadata: dict | None, corpus: str, model: str, dimension: int) -> dict:
    """Settings of a collection that differ from what they must be, and when it was made if it doesn't say."""
    want = METADATA | {"corpus": corpus, "embedding_model": model, "embedding_dimension": dimension}
    have = metadata or {}
    faults = {k: {"expected": v, "actual": have.get(k)} for k, v in want.items() if have.get(k) != v}
    if not have.get("created_at"):
        faults["created_at"] = {"expected": "a time", "actual": have.get("created_at")}
    return faults


def corpus_health(corpus: str, entries: DataFrame, vectors: DataFrame, metadata: dict | None, model: str, dimension: int, scorer_ready: bool = True) -> dict:
    """Whether a corpus can be searched, why not, and its counts in either case; reasons name no paths."""
    reason, counts = None, {"entries": None, "pending": None, "last": None}
    try:
        mine = entries.where(F.col("corpus") == corpus)
        row = mine.agg(F.count("*").alias("entries"), F.count_if(F.col("embedded_at").isNull()).alias("pending"), F.max("created_at").cast("string").alias("last")).first()
        counts = row.asDict()
        own = vectors.where(F.col("corpus") == corpus)
        found = {r.kind: r["count"] for r in parity(mine, own).groupBy("kind").count().collect()}
        if metadata_faults(metadata, corpus, model, dimension):
            reason = "collection_metadata_mismatch"
        elif found:
            reason = f"id_mismatch missing={found.get('missing', 0)} orphan={found.get('orphan', 0)}"
        elif vector_faults(own, dimension).head(1):
            reason = "vector_faults"
        elif not scorer_ready:
            reason = "reranker_unavailable"
    except Exception:
        reason = "dependency_unavailable"
    return {"corpus": corpus, "ready": reason is None, "reason": reason} | counts
