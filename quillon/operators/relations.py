"""Later notes that change earlier ones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.scoring import is_superseded
from ..sources.followed import FollowedTable
from ..functions.text import HEAD_CHARS, RELATION, change_relations, preview_udf

_KINDS = {"dst_corpus": T.StringType(), "dst_id": T.LongType(), "relation": T.StringType(), "where": T.StringType(), "form": T.StringType()}
_FOUND = T.ArrayType(T.StructType([T.StructField(name, kind) for name, kind in _KINDS.items()]))


@F.pandas_udf(_FOUND)
def _relations(corpus: pd.Series, id_: pd.Series, title: pd.Series, head: pd.Series, known: pd.Series) -> pd.Series:
    rows = zip(corpus, id_, title, head, known)
    return pd.Series([change_relations(c, int(i), t or "", h or "", set() if k is None else {int(n) for n in k}) for c, i, t, h, k in rows])


def relations(entries: DataFrame) -> DataFrame:
    """src_corpus, src_id, dst_corpus, dst_id, relation, where, form: what entries say they change, read from their heads only.

    Only entries with a verb of change and a number are looked at. The numbers that they name are joined with the ids of
    their own corpus first, as it matters to what follows in a list whether a number is an entry.
    """
    both = F.concat_ws("\n", "title", "head")
    e = entries.select("corpus", "id", "title", F.substring("content", 1, HEAD_CHARS).alias("head"))
    e = e.where(F.lower(both).rlike("(?U)\\b(" + "|".join(sorted(RELATION)) + ")\\b") & both.rlike("[0-9]"))
    numbers = e.select("corpus", "id", F.explode(F.regexp_extract_all(both, F.lit("([0-9]+)"), F.lit(1))).alias("n"))
    numbers = numbers.select("corpus", "id", F.expr("try_cast(n as bigint)").alias("n")).distinct()
    ids = entries.select("corpus", F.col("id").alias("n")).distinct()
    known = numbers.join(ids, ["corpus", "n"], "left_semi").groupBy("corpus", "id").agg(F.collect_set("n").alias("known"))
    e = e.join(known, ["corpus", "id"], "left")
    found = e.select(F.col("corpus").alias("src_corpus"), F.col("id").alias("src_id"), F.explode(_relations("corpus", "id", "title", "head", "known")).alias("r"))
    return found.select("src_corpus", "src_id", "r.*")


def newest_edges(relations: DataFrame, entries: DataFrame, most: int = 3) -> DataFrame:
    """Relations to existing, older entries from ones that aren't replaced; the newest few of each target.

    created_at is compared as text, then the id.
    """
    src = entries.where(~is_superseded(F.col("title"))).select(F.col("corpus").alias("src_corpus"), F.col("id").alias("src_id"), F.col("created_at").alias("src_at"))
    dst = entries.select(F.col("corpus").alias("dst_corpus"), F.col("id").alias("dst_id"), F.col("created_at").alias("dst_at"))
    e = relations.join(src, ["src_corpus", "src_id"]).join(dst, ["dst_corpus", "dst_id"])
    e = e.where("src_at > dst_at or (src_at = dst_at and src_id > dst_id)")
    rank = F.row_number().over(W.partitionBy("dst_corpus", "dst_id").orderBy(F.desc("src_at"), F.desc("src_id")))
    return e.withColumn("rank", rank).where(F.col("rank") <= most)


def detect(entries: DataFrame) -> DataFrame:
    """The edges with previews of the newer notes, made from their openings; shown only for updates and corrections."""
    e = newest_edges(relations(entries), entries)
    texts = entries.select(F.col("corpus").alias("src_corpus"), F.col("id").alias("src_id"), "title", F.substring("content", 1, HEAD_CHARS).alias("head"))
    shown = F.when(F.col("relation").isin("updates", "corrects"), preview_udf("head", "title"))
    return e.join(texts, ["src_corpus", "src_id"]).select("dst_corpus", "dst_id", "src_corpus", "src_id", "relation", "where", "form", "rank", shown.alias("preview"))


def with_warnings(results: DataFrame, edges: DataFrame) -> DataFrame:
    """Results (qid, corpus, id) with the newer notes about them that are not results of the same query."""
    e = edges.select(F.col("dst_corpus").alias("corpus"), F.col("dst_id").alias("id"), "src_corpus", "src_id", "relation", "rank")
    hits = results.select("qid", "corpus", "id").join(e, ["corpus", "id"])
    shown = results.select("qid", F.col("corpus").alias("src_corpus"), F.col("id").alias("src_id"))
    left = hits.join(shown, ["qid", "src_corpus", "src_id"], "left_anti")
    lists = left.groupBy("qid", "corpus", "id").agg(F.sort_array(F.collect_list(F.struct("rank", "src_corpus", "src_id", "relation"))).alias("newer"))
    return results.join(lists, ["qid", "corpus", "id"], "left")


class NewerNotes(FollowedTable):
    """The stored edges of newer notes, which follow the entries."""

    name = "newer notes"

    def __init__(self, spark, path: str, source, **options):
        super().__init__(spark, path, lambda: source().select("corpus", "id", "title", "content", "created_at"), detect, **options)

    def warn(self, results: DataFrame) -> tuple[DataFrame, str | None]:
        """Results with their warnings; without edges none, and the reason."""
        edges, reason = self.table()
        if edges is None:
            edges = self.spark.createDataFrame([], "dst_corpus string, dst_id long, src_corpus string, src_id long, relation string, rank int")
        return with_warnings(results, edges), reason
