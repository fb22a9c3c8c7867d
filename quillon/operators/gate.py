"""Is there an entry about the same topic already?"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .vector import PLACES, block_distances, kind_of, tiled

#: Words that say nothing about a topic.
GENERAL = (
    "gotcha fix bug homelab ai archive changelog telegram url note repo policy documentation dijagnoza superseded howto "
    "decision evergreen config security monitoring docker nexus rpi4 rpi nexus2 forrix nas kerrigan update patch root-cause "
    "diagnosis review github web configuration setup integration"
).split()


def topic_tokens(tags: Column, title: Column, general: Sequence[str] = GENERAL) -> Column:
    """Distinct tags and words of the title that tell something: three letters or more, no numbers, no general words."""
    parts = F.transform(F.split(F.lower(F.coalesce(tags, F.lit(""))), "[,/;]"), lambda t: F.trim(t))
    words = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit("([a-z0-9][a-z0-9._-]{2,})"), F.lit(1))
    fine = lambda t: (F.length(t) >= 3) & ~t.rlike("^[0-9]+$") & ~t.isin(*general)
    return F.array_distinct(F.filter(F.concat(parts, words), fine))


_PLACED = "qid long, id long, similarity double, place int"


def _placed(key: tuple[pa.Scalar, ...], lists: pa.Table) -> pa.Table:
    """What a query found, in order, from one row for each tile."""
    joined = lambda name, kind: np.concatenate([np.frombuffer(b, kind) for b in lists[name].to_pylist()])
    ids, units = joined("ids", np.int64), joined("units", np.int32)
    order = np.lexsort((ids, -units))
    made = {"qid": np.full(len(ids), key[0].as_py()), "id": ids[order], "similarity": units[order] / 10**PLACES, "place": np.arange(1, len(ids) + 1)}
    return pa.table(made).cast(kind_of(_PLACED))


def related(queries: DataFrame, vectors: DataFrame, entries: DataFrame, threshold: float, exclude: DataFrame | Callable | None = None, general: Sequence[str] = GENERAL) -> DataFrame:
    """qid, id, similarity, place: entries near a new one (qid, qx, qtags, qtitle) that share a topic with it, by
    similarity; the limit holds for the exact similarity. ``exclude``: qid, id that aren't looked at, as rows, or as a
    function of arrays of qids (a column) and ids, for which no rows are made; the entry itself never is. ``general``: words
    that are no topic. ``with_topics`` tells the shared topics.

    Tiles find near pairs and whether they share a topic; what a query found in a tile is one row, so no text is joined to
    a pair. The lists of a query meet in one task, 12 bytes for each entry found, which puts them in order.
    """
    v = vectors.join(entries.select("id", topic_tokens(F.col("tags"), F.col("title"), general).alias("topics")), "id")
    q = queries.select("qid", "qx", topic_tokens(F.col("qtags"), F.col("qtitle"), general).alias("topics"))

    without = exclude if callable(exclude) else None

    def run(qids, qx, ids, x, shared):
        similar = 1 - block_distances(qx, x)
        fine = (similar >= threshold) & shared & (qids[:, None] != ids)
        if without is not None:
            fine &= ~without(qids[:, None], ids)
        i, j = np.nonzero(fine)
        found = similar[i, j]
        units = (np.sign(found) * np.floor(np.abs(found) * 10**PLACES + 0.5)).astype(np.int32)
        ends = np.searchsorted(i, np.arange(len(qids) + 1))
        some = np.flatnonzero(np.diff(ends))
        lists = lambda a: pa.array([a[ends[r] : ends[r + 1]].tobytes() for r in some], pa.binary())
        return {"qid": qids[some], "ids": lists(ids[j]), "units": lists(units)}

    found = tiled(q, v, run, "qid long, corpus string, ids binary, units binary", words="topics")
    placed = found.select("qid", "ids", "units").groupBy("qid").applyInArrow(_placed, _PLACED)
    if exclude is None or without is not None:
        return placed
    left = placed.drop("place").join(exclude.select("qid", "id"), ["qid", "id"], "left_anti")
    return left.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("similarity"), "id")))


def with_topics(found: DataFrame, queries: DataFrame, entries: DataFrame, general: Sequence[str] = GENERAL) -> DataFrame:
    """What ``related`` found, with the entries' tags and titles and the topics that they share (``shared``)."""
    both = found.join(queries.select("qid", "qtags", "qtitle"), "qid").join(entries.select("id", "tags", "title"), "id")
    shared = F.array_intersect(topic_tokens(F.col("qtags"), F.col("qtitle"), general), topic_tokens(F.col("tags"), F.col("title"), general))
    return both.withColumn("shared", F.array_sort(shared)).drop("qtags", "qtitle")
