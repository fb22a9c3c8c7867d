"""A map of the corpus: clusters, names, a projection to the plane."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..workspace import written

#: Tags that name no cluster.
DULL_TAGS = ["url", "web", "note", "test", "youtube", "ai", "kb"]
#: Where k-means and the scaling's iteration begin.
SEED = 7


def cluster_names(members: DataFrame) -> DataFrame:
    """label, name: the three most frequent tags of each cluster; of equal ones that of the smallest id first."""
    tags = members.select("label", "id", F.explode(F.split("tags", ",")).alias("tag")).withColumn("tag", F.trim("tag"))
    n = tags.where((F.length("tag") >= 2) & ~F.lower("tag").isin(DULL_TAGS)).groupBy("label", "tag").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    top = n.withColumn("k", F.row_number().over(W.partitionBy("label").orderBy(F.desc("n"), "first"))).where("k <= 3")
    return top.groupBy("label").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "tag"))), lambda s: s["tag"]), " · ").alias("name"))


def cluster_count(n: int) -> int:
    return int(np.clip(round((n / 2) ** 0.5), 4, 16))


def clusters(vectors: DataFrame) -> DataFrame:
    """id, cluster by k-means (k-means|| start, 80 rounds at most)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = vectors.where("x is not null").select("id", array_to_vector("x").alias("features"))
    model = KMeans(k=cluster_count(v.count()), maxIter=80, seed=SEED, featuresCol="features", predictionCol="cluster").fit(v)
    return model.transform(v).select("id", "cluster")


def _features(x: np.ndarray, w: np.ndarray, dim: int) -> np.ndarray:
    """phi(x) w for the features phi(x) = 1, x, x x', without making them: rows of x, columns of w."""
    out = w[0] + x @ w[1 : dim + 1]
    for k in range(w.shape[1]):
        out[:, k] += ((x @ w[dim + 1 :, k].reshape(dim, dim)) * x).sum(1)
    return out


#: Numbers of a piece of an array that is added up by itself.
PIECE = 1 << 16


def _summed(vectors: DataFrame, make, size: int) -> np.ndarray:
    """The sum of the arrays (of ``size`` numbers) that ``make`` gives for batches of vectors.

    A task's array goes out in pieces; each piece is added up as a stream, whatever the number of tasks, and the driver
    gets one array: 8 ``size`` bytes.
    """

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += make(np.stack(batch.column(0).to_numpy(zero_copy_only=False)).astype(float))
        for k in range(0, size, PIECE):
            yield pa.RecordBatch.from_arrays([pa.array([k // PIECE], pa.int32()), pa.array([total[k : k + PIECE].tobytes()])], names=["piece", "s"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(np.frombuffer(s, float) for batch in batches for s in batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()])], names=["piece", "s"])

    parts = vectors.select("x").mapInArrow(run, "piece int, s binary").groupBy("piece").applyInArrow(add, "piece int, s binary")
    out = np.zeros(size)
    for r in parts.collect():
        out[r.piece * PIECE : (r.piece + 1) * PIECE] = np.frombuffer(r.s, float)
    return out


def scaling_weights(vectors: DataFrame, block: int = 16, rounds: int = 100, settled: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Weights w and offset so that phi(x) w - offset are the classical scaling's coordinates of x in the plane.

    The squared cosine distances of vectors of length one are 1 - 2 x.y + (x.y)^2, a product of features of x and of y. So
    the matrix that scaling decomposes is never made: a block of its eigenvectors is found by orthogonal iteration, each
    step of which is one pass over the vectors that adds up arrays of features, and exact for any number of them. The
    driver holds a few arrays of (1 + dim + dim^2) block numbers, 75 MB each at 768 dimensions.
    """
    dim = len(vectors.first().x)
    size = 1 + dim + dim * dim

    def moments(x):
        return np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])

    total = _summed(vectors, moments, size)
    mean = total / total[0]
    sign = np.concatenate([[1.0], np.full(dim, -2.0), np.ones(dim * dim)])
    w, last = np.random.default_rng(SEED).standard_normal((size, block)), None
    for _ in range(rounds):
        w = w / np.linalg.norm(w, axis=0)
        shared = vectors.sparkSession.sparkContext.broadcast((w, mean @ w))  # 8 size (block + 1) bytes: 75 MB at 768 dimensions

        def step(x):
            weights, offset = shared.value
            v = _features(x, weights, dim) - offset
            s = np.concatenate([v.sum(0)[None], x.T @ v, np.stack([(x.T @ (x * v[:, k : k + 1])).ravel() for k in range(v.shape[1])], 1)])
            return np.concatenate([s.ravel(), (v.T @ v).ravel()])

        out = _summed(vectors, step, (size + w.shape[1]) * w.shape[1])
        shared.unpersist()
        s, gram = out[: size * w.shape[1]].reshape(size, -1), out[size * w.shape[1] :].reshape(w.shape[1], -1)
        value, basis = np.linalg.eigh(gram)
        basis = basis[:, value > 1e-12 * value[-1]] / np.sqrt(value[value > 1e-12 * value[-1]])
        found, turn = np.linalg.eigh(basis.T @ (-0.5 * s.T @ (sign[:, None] * s)) @ basis)
        turn = basis @ turn[:, ::-1]
        top = found[::-1][:2]
        here = w @ turn[:, :2]
        if last is not None and len(last) == len(top) and np.abs(top - last).max() <= settled * np.abs(top).max():
            break
        last = top
        w = -0.5 * sign[:, None] * (s @ turn)
    here = here * np.sqrt(np.maximum(top, 1e-12))
    here = here * np.sign(here[np.abs(here).argmax(0), np.arange(here.shape[1])])  # either sign is right; this one is taken
    return here, mean @ here


def project(vectors: DataFrame) -> DataFrame:
    """id, px, py within -1 and 1: classical scaling of the cosine distances of all vectors, divided by the largest
    coordinate of all. Fewer than three vectors are in the middle."""
    v = written(vectors.where("x is not null").select("id", "x"), "atlas")
    if len(v.limit(3).collect()) < 3:
        return v.select("id", F.lit(0.0).alias("px"), F.lit(0.0).alias("py"))
    w, offset = scaling_weights(v)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(float)
                at = np.zeros((len(x), 2))
                at[:, : w.shape[1]] = _features(x, w, x.shape[1]) - offset
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at[:, 0].copy()), pa.array(at[:, 1].copy())], names=["id", "px", "py"])

    placed = written(v.mapInArrow(run, "id long, px double, py double"), "atlas")
    most = placed.agg(F.max(F.greatest(F.abs("px"), F.abs("py")))).first()[0] or 1.0
    return placed.select("id", (F.col("px") / most).alias("px"), (F.col("py") / most).alias("py"))


def cluster_members(members: DataFrame) -> DataFrame:
    """label, id, mean distance to all of the cluster (itself included, rounded to 6), place: the nearest to all come first.

    For vectors of length one it is one less the product with the cluster's mean vector, so no pairs are made.
    """
    parts = members.select("label", F.posexplode("x").alias("k", "v")).groupBy("label", "k").agg(F.avg("v").alias("v"))
    centre = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("c"))
    dot = F.aggregate(F.zip_with("x", "c", lambda x, c: x * c), F.lit(0.0), lambda s, v: s + v)
    far = members.join(centre, "label").select("label", "id", F.round(1 - dot, 6).alias("distance"))
    return far.withColumn("place", F.row_number().over(W.partitionBy("label").orderBy("distance", "id")))


def listed_pairs(pairs: DataFrame, most: int = 60) -> DataFrame:
    """The nearest pairs (a, b, d) with their place."""
    return pairs.select("a", "b", F.round("d", 3).alias("d")).orderBy("d", "a", "b").limit(most).withColumn("place", F.row_number().over(W.orderBy("d", "a", "b")))


def view(points: DataFrame, pairs: DataFrame, corpus: str) -> tuple[DataFrame, DataFrame]:
    """What a reader sees of one corpus: clusters by their visible entries (place: largest first), pairs that are wholly in it."""
    shown = points.where(F.col("corpus") == corpus)
    n = shown.groupBy("label").agg(F.count("*").alias("visible"))
    order = W.orderBy(F.desc("visible"), "label")  # a row for each cluster
    ids = shown.select("id")
    inside = pairs.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    return n.withColumn("place", F.row_number().over(order)), inside


def page(model: dict, template: str) -> str:
    """The atlas as a page: the model as JSON that can't end its script element, in place of the template's mark."""
    mark = "__ATLAS_DATA__"
    if mark not in template:
        raise ValueError("the template has no place for the data")
    return template.replace(mark, json.dumps(model, ensure_ascii=False, separators=(",", ":")).replace("<", "\\u003c"))


def write_page(text: str, path: str) -> None:
    """The whole page or the old one: written beside it, then moved."""
    handle, made = tempfile.mkstemp(dir=os.path.dirname(path) or ".", prefix=".atlas-")
    with open(handle, "w", encoding="utf-8") as out:
        out.write(text)
    os.chmod(made, 0o644)
    os.replace(made, path)
