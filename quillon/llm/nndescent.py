"""Neighbour graphs of vectors by NN-descent, greedy search on them, and near-duplicate links."""

from __future__ import annotations

import logging
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, connected_components, joined, partitions

log = logging.getLogger(__name__)

#: First neighbours: rows of one sorted order that are compared with each other, and hyperplanes that make an order.
CHUNK, SIGN_BITS = 1024, 14
BLOCK = 512


def storage(rows: DataFrame, vector: str) -> str:
    """How vectors travel: single precision if that is what they have; all arithmetic is in double precision."""
    return "<f4" if rows.schema[vector].dataType.elementType.simpleString() == "float" else "<f8"


def valid_vectors(rows: DataFrame, key: str, vector: str, group: str | None, unit: bool, kind: str = "<f8") -> DataFrame:
    """id, grp and x (bytes; ``unit``: scaled to length 1) of the rows whose vectors take part.

    Not so: null or empty vectors, those of length zero, with null or non-finite components, null keys, and with ``group``
    null groups. Vectors of other dimensions are in other groups.
    """

    def run(batches):
        for batch in batches:
            ids, grp, xs = [], [], []
            for i, g, v in zip(*(c.to_pylist() for c in batch.columns)):
                if i is None or not v or (group and g is None) or any(c is None for c in v):
                    continue
                x = np.array(v, np.float64)
                top = np.abs(x).max() if np.isfinite(x).all() else 0.0
                if top == 0:
                    continue
                if unit:
                    x = x / top
                    x = x / np.sqrt(x @ x)
                ids.append(i), grp.append(f"{len(v)}:{g}"), xs.append(x.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(grp, pa.string()), pa.array(xs, pa.binary())], names=["id", "grp", "x"])

    g = F.col(group).cast("string") if group else F.lit("all")
    return rows.select(F.col(key).cast("long"), g, vector).mapInArrow(run, "id long, grp string, x binary")


def classes_of(scratch: Scratch, vectors: DataFrame) -> DataFrame:
    """One row for each different vector of a group: v (its smallest id), grp, x, m (ids)."""
    distinct = vectors.groupBy("grp", "x").agg(F.min("id").alias("v"), F.countDistinct("id").alias("m"))
    return scratch.table(distinct)


def _rows(column, kind: str = "<f8") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)


def square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T)


def first_neighbours(scratch: Scratch, nodes: DataFrame, k: int, kind: str, orders: int) -> DataFrame:
    """v, u, d: near pairs from rows that are close in one of ``orders`` by random hyperplanes.

    An order's rows are cut by rank into chunks of equal size, so groups of like vectors are split as well.
    """

    def place(batches):
        for batch in batches:
            v, grp = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            x = batch.column(2).to_pylist()
            out: list[list] = [[] for _ in range(6)]
            for t in range(orders):
                for i, (a, g, b) in enumerate(zip(v, grp, x)):
                    value = np.frombuffer(b, kind).astype(np.float64)
                    p = _planes(t, len(value)) @ value
                    code = int(((p[:-1] > 0) << np.arange(SIGN_BITS)).sum())
                    for col, value in zip(out, (t, code, float(p[-1]), a, g, b)):
                        col.append(value)
            kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds)], names=["t", "code", "p", "v", "grp", "x"])

    placed = nodes.select("v", "grp", "x").mapInArrow(place, "t int, code int, p double, v long, grp string, x binary")
    key = ["t", "grp", "code", "p", "v"]
    ranked = scratch.table(
        placed.repartitionByRange(partitions(scratch.spark), *key).sortWithinPartitions(*key).withColumn("at", F.monotonically_increasing_id()).select("at", "v", "grp", "x")
    )
    counts = ranked.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    before, starts = 0, []
    for r in counts:
        starts.append((r.part, before))
        before += r.n
    first = F.broadcast(scratch.spark.createDataFrame(starts, "part long, before long"))  # a row for each partition
    chunk = F.expr(f"(before + (at & {(1 << 33) - 1}L)) div {CHUNK}")
    chunked = ranked.withColumn("part", F.shiftright("at", 33)).join(first, "part").select(chunk.alias("chunk"), "v", "grp", "x")

    def near(table: pa.Table) -> pa.Table:
        v, grp = table.column("v").to_numpy(), np.array(table.column("grp").to_pylist())
        out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for g in np.unique(grp):
            at = np.flatnonzero(grp == g)
            x = _rows(table.column("x").take(pa.array(at)), kind)
            d = square_distances(x, x)
            ids = v[at]
            d[ids[:, None] == ids] = np.inf
            n = min(k, len(at) - 1)
            if n < 1:
                continue
            best = np.argpartition(d, n - 1, axis=1)[:, :n]
            dist = np.take_along_axis(d, best, 1)
            fine = np.isfinite(dist)
            out[0].append(np.repeat(ids, n).reshape(-1, n)[fine]), out[1].append(ids[best][fine]), out[2].append(dist[fine])
        return pa.table({"v": np.concatenate(out[0]), "u": np.concatenate(out[1]), "d": np.concatenate(out[2])})

    pairs = chunked.groupBy("chunk").applyInArrow(near, "v long, u long, d double")
    return pairs


_plane_cache: dict = {}


def _planes(t: int, dim: int) -> np.ndarray:
    if (t, dim) not in _plane_cache:
        _plane_cache[t, dim] = np.random.default_rng([t, dim]).standard_normal((SIGN_BITS + 1, dim))
    return _plane_cache[t, dim]


def _best(pairs: DataFrame, limit) -> DataFrame:
    """The ``limit`` nearest of each v (ties: smaller u); new: whether a pair wasn't known."""
    once = pairs.groupBy("v", "u").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    return once.withColumn("rank", F.row_number().over(W.partitionBy("v").orderBy("d", "u"))).where(F.col("rank") <= limit)


def neighbour_graph(scratch: Scratch, nodes: DataFrame, k: int, rounds: int = 6, settled: float = 0.02, near: float | None = None, most: int = 64, kind: str = "<f8", sample: int = 8, report: int = 4, orders: int = 6, first: int | None = None) -> DataFrame:
    """v, u, d (square distance), rank: about the ``k`` nearest neighbours of each node in its group, by NN-descent.

    Every round joins ``sample`` neighbours of each node, and as many of those that it is a neighbour of, with each other,
    and keeps the best of each; new ones go first, and a join reports the ``report`` best partners of each member. It ends
    when less than ``settled`` of the lists change. With ``near``, lists that hold
    nothing but distances up to it are saturated and grow to twice the size, up to ``most``.
    """
    near_rows = first_neighbours(scratch, nodes, first or k, kind, orders).withColumn("new", F.lit(1))
    graph = scratch.table(_best(near_rows, k))
    sizes = graph.select("v").distinct().withColumn("k", F.lit(k)) if near is not None else None
    n = nodes.count()
    for turn in range(rounds):
        turns = F.row_number().over(W.partitionBy("v").orderBy(F.desc("new"), F.xxhash64("u", F.lit(turn))))
        graph_at = graph.withColumn("turn", turns)
        ahead = graph_at.where(F.col("turn") <= sample).select("v", "u", "new")
        spread = F.pmod(F.xxhash64("v", F.lit(turn)), F.lit(sample)).alias("s")
        back = graph.groupBy(F.col("u").alias("v"), spread).agg(F.max(F.struct("new", F.xxhash64("v", F.lit(turn)), F.col("v").alias("u"))).alias("b")).select("v", "b.u", "b.new")
        around = ahead.union(back).union(nodes.select("v", F.col("v").alias("u"), F.lit(0).alias("new")))
        around = around.groupBy("v", "u").agg(F.max("new").alias("new"))
        # a full list takes nothing beyond its last distance, so joins don't report it; saturated lists still grow
        most_here = F.lit(k) if near is None else F.col("k")
        lists_now = graph if near is None else graph.join(sizes, "v")
        last_of = lists_now.groupBy("v").agg(F.count("*").alias("n"), F.max("d").alias("far"), F.max(most_here).alias("k"))
        full = F.col("n") >= F.col("k") if near is None else (F.col("n") >= F.col("k")) & (F.col("far") > near)
        bound = last_of.select("v", F.when(full, F.col("far")).otherwise(float("inf")).alias("far"))
        members = nodes.select("v", "x").join(bound, "v", "left").select(F.col("v").alias("u"), "x", F.coalesce("far", F.lit(float("inf"))).alias("far"))
        with_x = around.join(members, "u")
        lists = with_x.groupBy("v").agg(F.collect_list(F.struct("u", "new", "x", "far")).alias("m")).select("m")
        found = lists.mapInArrow(_local_join(kind, report), "v long, u long, d double").withColumn("new", F.lit(1))
        old = graph_at.select("v", "u", "d", F.when(F.col("turn") <= sample, 0).otherwise(F.col("new")).alias("new"))
        pairs = old.union(found)
        if near is None:
            nxt = scratch.table(_best(pairs, k))
        else:
            full = graph.groupBy("v").agg(F.count("*").alias("n"), F.max("d").alias("far"))
            grown = sizes.join(full, "v").select("v", F.when((F.col("far") <= near) & (F.col("n") >= F.col("k")), F.least(F.lit(most), F.col("k") * 2)).otherwise(F.col("k")).alias("k"))
            last, sizes = sizes, scratch.table(grown)
            best = _best(pairs, most).join(sizes, "v").where("rank <= k").select("v", "u", "d", "new", "rank")
            nxt = scratch.table(best)
            if turn:
                scratch.drop(last)
        scratch.drop(graph)
        graph = nxt
        if graph.where("new = 1").count() <= settled * n * k:
            break
    return graph


def _local_join(kind: str, report: int):
    """Distances between all members of each list, of which one at least is new; of each member the best few that are
    below its own bound."""

    def run(batches):
        for batch in batches:
            offsets, m = batch.column(0).offsets.to_numpy(), batch.column(0).values
            u, new, x, far = m.field("u").to_numpy(), m.field("new").to_numpy(), m.field("x").to_pylist(), m.field("far").to_numpy()
            out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            for lo, hi in zip(offsets, offsets[1:]):
                if hi - lo < 2:
                    continue
                a = np.frombuffer(b"".join(x[lo:hi]), kind).reshape(hi - lo, -1).astype(np.float64)
                d = square_distances(a, a)
                d[(new[lo:hi, None] | new[lo:hi]) == 0] = np.inf
                d[d >= far[lo:hi, None]] = np.inf
                np.fill_diagonal(d, np.inf)
                n = min(report, hi - lo - 1)
                best = np.argpartition(d, n - 1, axis=1)[:, :n]
                dist = np.take_along_axis(d, best, 1)
                fine = np.isfinite(dist)
                ids = u[lo:hi]
                out[0].append(np.repeat(ids, n).reshape(-1, n)[fine]), out[1].append(ids[best][fine]), out[2].append(dist[fine])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["v", "u", "d"])

    return run


def _distance(kind: str):
    """Euclidean distances in double precision, straight from the differences."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            d = np.zeros(len(a))
            for lo in range(0, len(a), 4096):
                x, y = (np.frombuffer(b"".join(c[lo : lo + 4096]), kind).astype(np.float64) for c in (a, b))
                n = len(a[lo : lo + 4096])
                if all(len(v) == len(a[lo]) for v in a[lo : lo + 4096]):
                    d[lo : lo + n] = np.sqrt(((x - y).reshape(n, -1) ** 2).sum(1))
                else:  # several dimensions in one batch
                    at = np.cumsum([0] + [len(v) // np.dtype(kind).itemsize for v in a[lo : lo + 4096]])
                    d[lo : lo + n] = [np.sqrt(((x[p:q] - y[p:q]) ** 2).sum()) for p, q in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d)], names=["q", "u", "d"])

    return run


def greedy_search(scratch: Scratch, nodes: DataFrame, graph: DataFrame, starts: DataFrame, beam: int, kind: str) -> DataFrame:
    """q, u, d: the ``beam`` nearest nodes found for each query by walking the graph.

    ``starts``: q, qx (the query's vector), u (a node to begin at). Each step goes on from all nodes of the beam that it
    hasn't been at, along neighbours in both directions; it ends when no beam has one. A node that left a beam is further
    than all in it and can't come back, so it does end.
    """
    both = graph.select("v", "u").union(graph.groupBy(F.col("u").alias("v"), F.pmod(F.xxhash64("v"), F.lit(24)).alias("s")).agg(F.min_by("v", "d").alias("u")).select("v", "u"))
    roads = scratch.table(both.distinct().withColumnRenamed("u", "next"))
    queries = scratch.table(starts.select("q", "qx").distinct())
    x = nodes.select(F.col("v").alias("u"), "x")

    def measured(pairs: DataFrame) -> DataFrame:
        return pairs.join(queries, "q").join(x, "u").select("q", "u", "qx", "x").mapInArrow(_distance(kind), "q long, u long, d double")

    nearest = W.partitionBy("q").orderBy("d", "u")
    state = scratch.table(measured(starts.select("q", "u").distinct()).withColumn("been", F.lit(False)))
    while state.where(~F.col("been")).head(1):
        front = state.where(~F.col("been")).select("q", F.col("u").alias("v"))
        reached = front.join(roads, "v").select("q", F.col("next").alias("u")).distinct()
        fresh = reached.join(state.select("q", "u"), ["q", "u"], "left_anti")
        grown = state.withColumn("been", F.lit(True)).union(measured(fresh).withColumn("been", F.lit(False)))
        nxt = scratch.table(grown.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= beam).drop("rank"))
        scratch.drop(state)
        state = nxt
    return state.select("q", "u", "d")


def exact_search(nodes: DataFrame, asked: DataFrame, k: int, kind: str, few: bool = False) -> DataFrame:
    """q, u, d: the ``k`` nearest nodes of each of ``asked`` (q, grp, qx), itself included, by comparing it with all nodes.

    A block of queries is compared with a block of nodes and keeps the best of each query. ``few``: a bounded number is
    asked, which goes to all tasks; else each block of queries meets each block of nodes by a join.
    """

    def run(batches):
        for batch in batches:
            (oq, q), (ou, u) = ((c.offsets.to_numpy(), c.values) for c in (batch.column(0), batch.column(1)))
            for r in range(batch.num_rows):
                a, b = q.slice(oq[r], oq[r + 1] - oq[r]), u.slice(ou[r], ou[r + 1] - ou[r])
                x, y = _rows(a.field("qx"), kind), _rows(b.field("x"), kind)
                quick, ids, out = square_distances(x, y), b.field("v").to_numpy(), []
                # the quick distances are rounded: all that may be among the k nearest, or as near, are measured exactly
                edge = np.partition(quick, min(k, len(y)) - 1, axis=1)[:, min(k, len(y)) - 1]
                edge += 1e-9 * ((x**2).sum(1) + (y**2).sum(1).max())
                for i, near in enumerate(quick <= edge[:, None]):
                    at = np.flatnonzero(near)
                    d = np.sqrt(((x[i] - y[at]) ** 2).sum(1))
                    best = np.lexsort((ids[at], d))[:k]
                    out.append((ids[at[best]], d[best]))
                n = [len(u) for u, _ in out]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(a.field("q").to_numpy(), n)), pa.array(np.concatenate([u for u, _ in out])), pa.array(np.concatenate([d for _, d in out]))], names=["q", "u", "d"])

    many = asked.groupBy("grp").agg(F.count("*").alias("n"))
    ask = asked.join(many, "grp").withColumn("b", F.expr(f"pmod(xxhash64(q), n div {BLOCK} + 1)")).groupBy("grp", "b").agg(F.collect_list(F.struct("q", "qx")).alias("qs"))
    sizes = nodes.groupBy("grp").agg(F.count("*").alias("n"))
    deal = nodes.join(sizes, "grp").withColumn("c", F.expr(f"pmod(xxhash64(v), n div {4 * BLOCK} + 1)")).repartition("grp", "c").groupBy("grp", "c").agg(F.collect_list(F.struct("v", "x")).alias("us"))
    if few:
        met = deal.join(F.broadcast(ask), "grp")
    else:
        met = ask.join(sizes, "grp").withColumn("c", F.explode(F.expr(f"sequence(0, n div {4 * BLOCK})"))).join(deal, ["grp", "c"])
    found = met.select("qs", "us").mapInArrow(run, "q long, u long, d double")
    return found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("d", "u"))).where(F.col("rank") <= k).drop("rank")


def search_recall(scratch: Scratch, nodes: DataFrame, starts: DataFrame, found: DataFrame, k: int, kind: str, sample: int = 400) -> tuple[float, float]:
    """Recall at ``k`` of ``found`` (q, u, d) against comparison with all nodes, over about ``sample`` queries chosen by
    hash, and a bound that the recall of all queries exceeds with 95 % confidence (two standard errors; all: the same)."""
    n = starts.count()
    share = min(1.0, 1.1 * sample / max(n, 1))
    chosen = starts.where(F.pmod(F.xxhash64("q", F.lit(7)), F.lit(1 << 32)) < int(share * (1 << 32)))
    asked = scratch.table(chosen.join(nodes.select(F.col("v").alias("q"), "grp"), "q").select("q", "grp", "qx"))
    want = scratch.table(exact_search(nodes, asked, k + 1, kind, few=True).where("q <> u")).groupBy("q").agg(F.max("d").alias("far"), F.count("*").alias("n"))
    have = found.where("q <> u").join(want, "q").where(F.col("d") <= F.col("far") * (1 + 1e-12)).groupBy("q").agg(F.count("*").alias("hits"))
    per = want.join(have, "q", "left").select(F.least(F.lit(1.0), F.coalesce("hits", F.lit(0)) / F.least(F.lit(k), "n")).alias("r"))
    r = per.agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.coalesce(F.stddev_samp("r"), F.lit(0.0)).alias("sd")).first()
    if not r["n"]:
        return 1.0, 1.0
    return r["mean"], r["mean"] - (2 * r["sd"] / r["n"] ** 0.5 if share < 1 else 0)


def nearest_neighbours(rows: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", degree: int = 24, beam: int = 128, wanted: float = 0.9) -> DataFrame:
    """query_id, rank (from 1), the key, score (Euclidean distance, double): the ``k`` nearest of each query row.

    ``queries`` are rows of ``rows`` (only the key is read); a query's own row is no candidate. All valid rows are in the
    graph; the search starts at the query's own node. Ties go to the smaller key. Equal vectors are one node; of its keys
    the k + 1 smallest are kept, more can't be in a result. Repeated keys: a row for each different vector is a candidate,
    once. Null, empty, zero vectors and those with null or non-finite components take no part; with fewer candidates
    than ``k`` all are returned; an empty table, or no valid query, gives an empty table. Of other columns, whatever their
    names, nothing is read.

    A sample of the queries is compared with all nodes. Unless its recall is at least ``wanted`` with 95 % confidence, the
    graph is made anew from twice the orders with longer lists, and searched with twice the beam; after two graphs all
    queries are compared with all nodes.
    """
    scratch = Scratch(rows.sparkSession)
    kind = storage(rows, vector)
    vectors = scratch.table(valid_vectors(rows, key, vector, None, unit=False, kind=kind))
    nodes = classes_of(scratch, vectors)
    members = vectors.select("grp", "x", "id").distinct().withColumn("r", F.row_number().over(W.partitionBy("grp", "x").orderBy("id"))).where(F.col("r") <= k + 1)
    members = scratch.table(members.join(nodes.select("grp", "x", "v"), ["grp", "x"]).select("v", "id"))
    asked = vectors.join(queries.select(F.col(key).cast("long").alias("id")).distinct(), "id", "left_semi")
    own = scratch.table(asked.join(nodes.select("grp", "x", "v"), ["grp", "x"]).select("id", "v").distinct())
    starts = own.select("v").distinct().join(nodes.select("v", F.col("x").alias("qx")), "v").select(F.col("v").alias("q"), "qx", F.col("v").alias("u"))
    starts = scratch.table(starts)
    for attempt in range(2):
        graph = neighbour_graph(scratch, nodes, degree << attempt, rounds=5 + 3 * attempt, kind=kind, sample=16, report=6, orders=20 << attempt, first=10)
        found = greedy_search(scratch, nodes, graph, starts, max(beam, 2 * k) << attempt, kind)
        recall, sure = search_recall(scratch, nodes, starts, found, k, kind)
        log.info("graph %d: recall %.4f, at least %.4f", attempt, recall, sure)
        if sure >= wanted:
            break
    else:
        all_asked = starts.join(nodes.select(F.col("v").alias("q"), "grp"), "q").select("q", "grp", "qx")
        found = scratch.table(exact_search(nodes, all_asked, k + 1, kind))
    named = own.select(F.col("id").alias("query_id"), F.col("v").alias("q")).join(found, "q").join(members.withColumnRenamed("v", "u"), "u")
    ranked = named.where("id <> query_id").groupBy("query_id", "id").agg(F.min("d").alias("score")).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")


def _meeting_parts(scratch: Scratch, nodes: DataFrame, parts: DataFrame, saturated: DataFrame, least: float) -> DataFrame:
    """grp, r1, r2: the pairs of parts (v, root) that links of ``saturated`` nodes (v) may join.

    A list that holds only links may lack some, also those to other parts; both ends of a link that no list holds are
    saturated. Angles are a metric, so the pivots of two such parts are no further apart than the parts' radii (over their
    saturated members) and the angle of a link together. The pivots of a group are compared in blocks, each with each.
    """
    members = scratch.table(parts.join(saturated, "v", "left_semi").join(nodes.select("v", "grp", "x"), "v"))
    pivots = members.groupBy("grp", "root").agg(F.min("v").alias("v")).join(members.select("grp", "v", "x"), ["grp", "v"]).groupBy("grp", "root").agg(F.min("x").alias("p"))

    def angles(batches):
        for batch in batches:
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            cos = np.array([np.frombuffer(p, np.float64) @ np.frombuffer(x, np.float64) for p, x in pairs], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.arccos(np.clip(cos, -1, 1)))], names=["grp", "root", "p", "a"])

    measured = members.join(pivots, ["grp", "root"]).select("grp", "root", "p", "x").mapInArrow(angles, "grp string, root long, p binary, a double")
    balls = scratch.table(measured.groupBy("grp", "root").agg(F.max("a").alias("a"), F.min("p").alias("p")))
    sizes = balls.groupBy("grp").agg(F.count("*").alias("n"))
    deal = balls.join(sizes, "grp").withColumn("b", F.expr(f"pmod(xxhash64(root), n div {BLOCK} + 1)"))
    blocks = scratch.table(deal.groupBy("grp", "b").agg(F.collect_list(F.struct("root", "a", "p")).alias("s")))
    side = lambda c: blocks.select("grp", F.col("b").alias(f"b{c}"), F.col("s").alias(f"s{c}"))

    def near(batches):
        for batch in batches:
            grp, same = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            (oa, va), (ob, vb) = ((c.offsets.to_numpy(), c.values) for c in (batch.column(1), batch.column(2)))
            for k in range(batch.num_rows):
                p, q = va.slice(oa[k], oa[k + 1] - oa[k]), vb.slice(ob[k], ob[k + 1] - ob[k])
                apart = np.arccos(np.clip(_rows(p.field("p")) @ _rows(q.field("p")).T, -1, 1))
                meet = apart <= p.field("a").to_numpy()[:, None] + q.field("a").to_numpy() + np.arccos(least) + 1e-6
                i, j = np.nonzero(np.triu(meet, 1) if same[k] else meet)
                yield pa.RecordBatch.from_arrays([pa.array([grp[k]] * len(i), pa.string()), p.field("root").take(pa.array(i)), q.field("root").take(pa.array(j))], names=["grp", "r1", "r2"])

    own = sizes.select("grp", F.explode(F.expr(f"sequence(0, n div {BLOCK})")).alias("b1"), F.expr(f"n div {BLOCK}").alias("last"))
    pairs = own.select("grp", "b1", F.explode(F.expr("sequence(b1, last)")).alias("b2"))
    met = pairs.join(side("1"), ["grp", "b1"]).join(side("2"), ["grp", "b2"]).select("grp", "s1", "s2", (F.col("b1") == F.col("b2")).alias("same"))
    return scratch.table(met.mapInArrow(near, "grp string, r1 long, r2 long"))


def _pairs_in_blocks(scratch: Scratch, nodes: DataFrame, parts: DataFrame, least: float, meeting: DataFrame | None = None):
    """Exact links inside parts (v, root): (v, links) sums, and edges (a, b) that connect what links connect.

    A part's members are dealt to blocks; a task compares two blocks, and reports counts and a spanning forest. Links
    between the two parts of each row of ``meeting`` (grp, r1, r2) are found as well.
    """
    placed = parts.join(nodes, "v")
    sizes = scratch.table(placed.groupBy("grp", "root").agg(F.count("*").alias("n")))
    deal = placed.join(sizes, ["grp", "root"]).withColumn("b", F.expr(f"pmod(xxhash64(v), n div {BLOCK} + 1)"))
    blocks = scratch.table(deal.groupBy("grp", "root", "b").agg(F.collect_list(F.struct("v", "m", "x")).alias("s")))
    side = lambda c: blocks.select("grp", F.col("root").alias(f"r{c}"), F.col("b").alias(f"b{c}"), F.col("s").alias(f"s{c}"))

    def run(batches):
        for batch in batches:
            same = batch.column(2).to_pylist()
            (oa, va), (ob, vb) = ((c.offsets.to_numpy(), c.values) for c in (batch.column(0), batch.column(1)))
            for k in range(batch.num_rows):
                p, q = va.slice(oa[k], oa[k + 1] - oa[k]), vb.slice(ob[k], ob[k + 1] - ob[k])
                i, j = p.field("v").to_numpy(), q.field("v").to_numpy()
                linked = _rows(p.field("x")) @ _rows(q.field("x")).T >= least
                if same[k]:
                    np.fill_diagonal(linked, False)
                counts = [(i, linked @ q.field("m").to_numpy())]
                if not same[k]:
                    counts.append((j, linked.T @ p.field("m").to_numpy()))
                a, b = joined(linked, i, j)
                v = np.concatenate([c[0] for c in counts] + [a])
                n = np.concatenate([c[1] for c in counts] + [np.zeros(len(a), np.int64)])
                to = np.concatenate([np.full(len(v) - len(a), -1), b])
                has = np.arange(len(v)) >= len(v) - len(a)
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(n.astype(np.int64)), pa.array(to.astype(np.int64), mask=~has)], names=["v", "n", "u"])

    # which blocks meet is dealt out first, so that the blocks of a large part go to many tasks
    counts = sizes.select("grp", "root", F.expr(f"n div {BLOCK}").alias("last"))
    own = counts.select("grp", F.col("root").alias("r1"), F.col("root").alias("r2"), F.explode(F.expr("sequence(0, last)")).alias("b1"), "last")
    pairs = own.select("grp", "r1", "b1", "r2", F.explode(F.expr("sequence(b1, last)")).alias("b2"))
    if meeting is not None:
        of = lambda c: counts.select("grp", F.col("root").alias(f"r{c}"), F.col("last").alias(f"l{c}"))
        across = meeting.join(of(1), ["grp", "r1"]).join(of(2), ["grp", "r2"])
        across = across.select("grp", "r1", F.explode(F.expr("sequence(0, l1)")).alias("b1"), "r2", "l2").select("grp", "r1", "b1", "r2", F.explode(F.expr("sequence(0, l2)")).alias("b2"))
        pairs = pairs.union(across)
    met = pairs.join(side("1"), ["grp", "r1", "b1"]).join(side("2"), ["grp", "r2", "b2"]).select("s1", "s2", F.expr("r1 = r2 and b1 = b2").alias("same"))
    out = scratch.table(met.mapInArrow(run, "v long, n long, u long"))
    return out.where("u is null").groupBy("v").agg(F.sum("n").alias("links")), out.where("u is not null").select(F.col("v").alias("a"), F.col("u").alias("b"))


#: The audit's sample of each stratum of linked nodes, and the smallest share of all nodes whose loss it tells for sure.
AUDITED, RARE = 1000, 1e-4


def _most_lost(lost: int) -> float:
    """The largest Poisson mean of which so few as ``lost`` are seen with a chance of 5 % (Poisson bounds the binomial)."""
    lo, hi = 0.0, 2.0 * lost + 20
    for _ in range(60):
        mid = (lo + hi) / 2
        chance = sum(math.exp(i * math.log(mid) - mid - math.lgamma(i + 1)) for i in range(lost + 1))
        lo, hi = (lo, mid) if chance <= 0.05 else (mid, hi)
    return hi


def audit_recall(nodes: DataFrame, links: DataFrame, least: float) -> float:
    """The share of linked nodes whose links ``links`` (v, links: number of rows) counts in full, by comparing a sample of
    nodes with all nodes: a bound that holds with 95 % confidence, of the worst stratum.

    Strata are by the number of links found, so small groups count as much as large ones: 1,000 nodes of each, or all.
    Nodes without any are sampled in proportion to their number over that of the linked ones, so that 1 % of the linked
    nodes lost entirely would be seen; where fewer than 1 % of all nodes are linked, one in 10,000 of all nodes.
    """
    spark = nodes.sparkSession
    stratum = F.when(F.col("links") > 0, F.least(F.lit(5), F.floor(F.log(4.0, F.col("links") + 1)))).otherwise(-1)
    known = nodes.join(links, "v", "left").withColumn("links", F.coalesce("links", F.lit(0))).withColumn("stratum", stratum.cast("int"))
    sizes = {r.stratum: r.n for r in known.groupBy("stratum").agg(F.count("*").alias("n")).collect()}
    total, alone = sum(sizes.values()), sizes.get(-1, 0)
    linked = total - alone
    wanted = {k: AUDITED for k in sizes} | {-1: max(AUDITED, 475 * alone / max(linked, 100 * RARE * total, 1))}
    shares = {k: min(1.0, 1.1 * wanted[k] / n) for k, n in sizes.items()}
    place = F.pmod(F.xxhash64("v", F.lit(7)), F.lit(1 << 32)) / F.lit(float(1 << 32))
    chosen = F.lit(False)
    for k, share in shares.items():
        chosen = chosen | ((F.col("stratum") == k) & (place < share))
    picked = known.where(chosen).select("v", "grp", "x", "links", "stratum").collect()
    groups: dict = {}
    for i, r in enumerate(picked):
        groups.setdefault(r.grp, []).append(i)
    data = {g: (at, np.array([picked[i].v for i in at]), np.frombuffer(b"".join(bytes(picked[i].x) for i in at), np.float64).reshape(len(at), -1)) for g, at in groups.items()}
    shared = spark.sparkContext.broadcast(data)  # at most about 52,000 nodes

    def run(batches):
        for batch in batches:
            grp, v, m = np.array(batch.column(0).to_pylist()), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            x = batch.column(1).to_pylist()
            sums: dict = {}
            for g in set(grp.tolist()) & shared.value.keys():
                at = np.flatnonzero(grp == g)
                rows = np.frombuffer(b"".join([x[i] for i in at]), np.float64).reshape(len(at), -1)
                own, ids, vectors = shared.value[g]
                for lo in range(0, len(own), 1024):
                    near = (vectors[lo : lo + 1024] @ rows.T >= least) & (ids[lo : lo + 1024, None] != v[at])
                    i, j = np.nonzero(near)
                    n = np.bincount(i, m[at][j], minlength=len(near)).astype(np.int64)
                    sums |= {own[lo + k]: int(n[k]) for k in np.flatnonzero(n)}
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], names=["i", "n"])

    exact = {r.i: r.n for r in nodes.select("grp", "x", "v", "m").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    shared.unpersist()
    seen, lost = {k: 0 for k in sizes}, {k: 0 for k in sizes}
    for i, r in enumerate(picked):
        seen[r.stratum] += 1
        lost[r.stratum] += exact.get(i, 0) > r.links
    worst = 1.0
    for k, n in sizes.items():
        most = lost[k] if seen[k] == n else min(n, _most_lost(lost[k]) / max(seen[k], 1) * n)
        worst = min(worst, 1 - most / (max(linked, 100 * RARE * total if seen[k] < n else 0, most) if k < 0 else n) if most else 1.0)
    return worst


def near_duplicate_vectors(rows: DataFrame, least: float = 0.98, key: str = "vec_id", vector: str = "embedding", group: str = "label", degree: int = 8, slack: float = 0.03, wanted: float = 0.99) -> DataFrame:
    """The key, n_links, component_id, kept of each row: links are pairs of one group with cosine >= ``least``.

    1. NN-descent on unit vectors; lists that hold only near ones are saturated and grow.
    2. Edges down to ``least`` - ``slack`` give parts; inside a part all pairs are compared in blocks, so the links of a
       saturated list are whole, however many there are, and n_links counts them without making them. Parts with saturated
       lists are compared with all such parts of the group that are near enough for a link.
    3. An audit compares samples of nodes, drawn by their number of links, with all nodes. Unless ``wanted`` of the linked
       nodes have all their links with 95 % confidence, the graph is made anew with longer lists, and after three graphs all pairs of each group are compared in blocks.
    Equal vectors of a group are one node with a number of copies, which link with each other. Vectors that are null, empty,
    zero, or hold null or non-finite components, and rows of a null group link with nothing: n_links 0, their own
    component_id, kept. Repeated rows count once and give equal rows; a key with several vectors gives several rows.
    A row of a null key has component_id null and is kept; an empty table gives an empty table. Of other columns, whatever
    their names, nothing is read.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    vectors = scratch.table(valid_vectors(rows, key, vector, group, unit=True))
    nodes = classes_of(scratch, vectors)
    near = 2 - 2 * (least - slack)
    for attempt in range(3):
        graph = neighbour_graph(scratch, nodes, degree << attempt, near=2 - 2 * least)
        edges = graph.where(F.col("d") <= near).select(F.col("v").alias("a"), F.col("u").alias("b"))
        if not edges.head(1):
            links, exact = None, None
        else:
            parts = scratch.table(connected_components(scratch, edges)).withColumnRenamed("node", "v")
            lists = graph.groupBy("v").agg(F.count("*").alias("n"), F.max("d").alias("far"))
            saturated = lists.where((F.col("far") <= 2 - 2 * least) & (F.col("n") >= degree << attempt)).select("v")
            meeting = _meeting_parts(scratch, nodes, parts, saturated, least)
            links, exact = _pairs_in_blocks(scratch, nodes, parts, least, meeting)
        recall = audit_recall(nodes, links if links is not None else spark.createDataFrame([], "v long, links long"), least)
        if recall >= wanted:
            break
    else:
        links, exact = _pairs_in_blocks(scratch, nodes, nodes.select("v", F.lit(0).alias("root")).distinct(), least)
    known = nodes.select("v", "grp", "x", "m")
    if links is not None and exact.head(1):
        roots = scratch.table(connected_components(scratch, exact)).withColumnRenamed("node", "v")
        known = known.join(roots, "v", "left").join(links, "v", "left")
    else:
        known = known.withColumn("root", F.lit(None).cast("long")).withColumn("links", F.lit(0))
    known = known.select("grp", "x", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "v").alias("component_id"))
    linked = scratch.table(vectors.join(known, ["grp", "x"]).select("id", "n_links", "component_id").distinct())
    rest = rows.select(F.col(key).cast("long").alias("id")).distinct().join(linked.select("id").distinct(), "id", "left_anti")
    alone = rest.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    all_rows = linked.select("id", F.col("n_links").cast("long"), "component_id").union(alone)
    return all_rows.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
