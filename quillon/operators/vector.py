"""Exact vector search as plain expressions: the query side is small, the vectors are scanned once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..workspace import written


def _dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(col) -> Column:
    """A vector scaled to length one, in double precision; null for zero vectors and such with null or non-finite parts."""
    x = F.transform(col, lambda v: v.cast("double"))

    def scaled(squares: Column) -> Column:  # the sum is bound here; beside the transform it would be made for each part anew
        return F.when((squares > 0) & ~F.isnan(squares) & (squares < float("inf")), F.transform(x, lambda v: v / F.sqrt(squares)))

    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v, scaled)


def cosine_distance(a, b) -> Column:
    """Of vectors of length one, kept within 0 and 2."""
    return F.lit(1.0) - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(a, b)))


def distances(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Every query (qid, qx) against every vector row; d is not rounded.

    The plan is a nested loop over the query rows; Spark broadcasts them if they are below its threshold. For many queries
    ``tiled`` is the faster way.
    """
    return vectors.join(queries).withColumn("d", cosine_distance("qx", "x")).drop("qx", "x").where("d is not null")


#: Queries and vectors of a tile, at most; the fewest tiles over the vectors, which lets all cores take part; the queries
#: of one matrix product; decimals that distances are ordered by.
TILE_QUERIES, TILE_VECTORS, TILES, CHUNK, PLACES = 4096, 32768, 24, 128, 4


def rounded(d: np.ndarray) -> np.ndarray:
    """Distances in units of the last decimal, half up."""
    return np.floor(d * 10**PLACES + 0.5)


def tiled(queries: DataFrame, vectors: DataFrame, run, schema: str, most: int | None = None, ready=lambda x: x, words: str | None = None) -> DataFrame:
    """What ``run(qids, qx, ids, x)`` gives, as a record batch, for tiles of queries (qid, qx) and vectors (corpus, id, x)
    of one corpus, in order of the ids; together they are all pairs. ``ready`` is what is made of a tile's x, once.
    ``words``: a column of lists of words on both sides; ``run`` then gets also which pairs share one.

    Both sides are dealt by hash, so a tile is bounded (4,096 by about 32,768 vectors) and so is the task that gets it;
    what is sent is each vector once for every 4,096 queries (``most``), and each query once for every tile of vectors.
    """
    more = [words] if words else []
    q, v = queries.where("qx is not null").select("qid", "qx", *more), vectors.where("x is not null").select("corpus", "id", "x", *more)
    across, down = q.count() // (most or TILE_QUERIES) + 1, max(TILES, v.count() // TILE_VECTORS + 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("a", F.expr(f"cast(pmod(xxhash64(qid), {across}) as int)")).withColumn("b", every(down))
    v = v.withColumn("b", F.expr(f"cast(pmod(xxhash64(corpus, id), {down}) as int)")).withColumn("a", every(across))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            qids, qx = left["qid"].to_numpy(), _matrix(left["qx"].combine_chunks())
            for corpus in right["corpus"].unique():
                rows = right.filter(pc.equal(right["corpus"], corpus))
                ids, x = rows["id"].to_numpy(), _matrix(rows["x"].combine_chunks())
                order = np.argsort(ids, kind="stable")
                ids, x = ids[order], ready(x[order])
                sharing = Sharing(left[words], rows[words].take(pa.array(order))) if words else None
                for at in range(0, len(qids), CHUNK):
                    shared = [sharing.rows(at, at + CHUNK)] if words else []
                    made = run(qids[at : at + CHUNK], qx[at : at + CHUNK], ids, x, *shared)
                    out.append(pa.table({"corpus": pa.repeat(corpus, len(next(iter(made.values())))), **made}))
        kinds = kind_of(schema)
        return pa.concat_tables(t.select(kinds.names).cast(kinds) for t in out) if out else kinds.empty_table()

    return q.groupBy("a", "b").cogroup(v.groupBy("a", "b")).applyInArrow(meet, schema)


class Sharing:
    """Which lists of words of two columns have a word in common; exact, as words are numbered, not hashed."""

    def __init__(self, left: pa.ChunkedArray, right: pa.ChunkedArray):
        left, right = left.combine_chunks(), right.combine_chunks()
        self.starts, self.n = np.r_[0, np.cumsum(self._lengths(left))], len(right)
        said = left.flatten().dictionary_encode()
        self.codes, self.total = said.indices.to_numpy(), len(said.dictionary)
        found = pc.index_in(right.flatten(), value_set=said.dictionary)
        known = found.is_valid().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(self.n), self._lengths(right))[known]
        self.at = found.drop_null().to_numpy()
        self.owners, self.first = np.unique(owner, return_index=True)

    @staticmethod
    def _lengths(column) -> np.ndarray:
        return pc.fill_null(pc.list_value_length(column), 0).to_numpy()

    def rows(self, lo: int, hi: int) -> np.ndarray:
        """For rows ``lo`` to ``hi`` of the left column, true where a row of the right one shares a word.

        Each word has a bit for each of these rows; the bits of a list's words are put together.
        """
        starts = self.starts[lo : hi + 1]
        m = len(starts) - 1
        bits = np.zeros((self.total, -(-m // 64)), np.uint64)
        row = np.repeat(np.arange(m), np.diff(starts))
        np.bitwise_or.at(bits, (self.codes[starts[0] : starts[-1]], row // 64), np.uint64(1) << (row % 64).astype(np.uint64))
        out = np.zeros((self.n, bits.shape[1]), np.uint64)
        if len(self.owners):
            out[self.owners] = np.bitwise_or.reduceat(bits[self.at], self.first, axis=0)
        return np.unpackbits(out.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, :m].astype(bool).T


def kind_of(schema: str) -> pa.Schema:
    """The Arrow schema of a schema of plain columns."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (column.split() for column in schema.split(", "))])


def block_distances(qx: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 - np.clip(qx @ x.T, -1, 1)


#: Columns of which one in so many is looked at for a bound, if so many times ``k`` are left.
SAMPLED, ENOUGH = 8, 8


def first_places(d: np.ndarray, k: int, unit=lambda v: v, slack: float = 0.0, most: float = np.finfo(float).max) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's ``k`` smallest finite entries, up to ``most``, in units (which ``slack`` is larger
    than); of equal ones those of the first columns.

    The k-th smallest of some columns is not below that of all. So it is a bound for what is to be sorted, and finding it
    in an eighth of the columns is cheaper than in all.
    """
    n = d.shape[1]
    some = d[:, np.random.default_rng(n).choice(n, n // SAMPLED, replace=False)] if n // SAMPLED >= ENOUGH * k else d
    bound = np.partition(some, k - 1, axis=1)[:, k - 1 : k] if n > k else np.inf
    i, j = np.nonzero(d <= np.minimum(bound + slack, most))
    order = np.lexsort((j, unit(d[i, j]), i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k]


def top_candidates(queries: DataFrame, vectors: DataFrame, max_distance: float, k: int) -> DataFrame:
    """qid, corpus, id, distance, rank: the k nearest per query and corpus within ``max_distance``.

    The limit holds for the exact distance, the order is by the rounded one and then by id. Distances are matrix products
    of tiles; of each tile the k nearest of a query and corpus are left, and one window ranks these.
    """

    def run(qids, qx, ids, x):
        d = block_distances(qx, x)
        i, j = first_places(d, k, rounded, 1.5 / 10**PLACES, max_distance)
        return {"qid": qids[i], "id": ids[j], "distance": rounded(d[i, j]) / 10**PLACES}

    d = tiled(queries, vectors, run, "qid long, corpus string, id long, distance double")
    ranked = d.withColumn("rank", F.row_number().over(W.partitionBy("qid", "corpus").orderBy("distance", "id")))
    return ranked.where(F.col("rank") <= k)


def scan(queries: DataFrame, vectors: DataFrame, max_distance: float, k: int) -> DataFrame:
    """What a trace needs of all distances: rows qid, corpus, id, distance, near (within ``max_distance``) that hold the k
    nearest and the k nearest within the limit, and rows with a total: so many vectors were compared, so many of them
    (within) are within the limit. Both come from tiles and are to be ranked and added up."""

    def run(qids, qx, ids, x):
        d = block_distances(qx, x)
        units, near, chosen = rounded(d), d <= max_distance, np.zeros(d.shape, bool)
        for order in (units, np.where(near, units, np.inf)):
            chosen[first_places(order, k)] = True
        i, j = np.nonzero(chosen)
        none, zero = np.zeros(len(i), np.int64), np.zeros(len(qids), np.int64)
        return {
            "qid": np.r_[qids[i], qids], "id": np.r_[ids[j], zero], "distance": np.r_[units[i, j] / 10**PLACES, zero], "near": np.r_[near[i, j], zero > 0],
            "total": np.r_[none, zero + len(ids)], "within": np.r_[none, near.sum(1)],
        }

    return tiled(queries, vectors, run, "qid long, corpus string, id long, distance double, near boolean, total long, within long")


def totals(queries: DataFrame, vectors: DataFrame, max_distance: float) -> DataFrame:
    """qid, corpus, total, within, d: how many vectors of a corpus a query was compared with, how many of them are within
    ``max_distance``, and the smallest distance. A tile gives one row for each query and corpus; these are added up."""

    def run(qids, qx, ids, x):
        d = block_distances(qx, x)
        return {"qid": qids, "total": np.full(len(qids), len(ids)), "within": (d <= max_distance).sum(1), "d": d.min(1)}

    parts = tiled(queries, vectors, run, "qid long, corpus string, total long, within long, d double")
    return parts.groupBy("qid", "corpus").agg(F.sum("total").alias("total"), F.sum("within").alias("within"), F.min("d").alias("d"))


#: Vectors of a block in which watched ones are ranked; rows that it gives, about; queries that are compared at once.
RANKED_VECTORS, RANKED_ROWS, RANKED_AT_ONCE = 262144, 4_000_000, 16


def places_of(queries: DataFrame, vectors: DataFrame, watch: DataFrame, max_distance: float) -> DataFrame:
    """qid, corpus, id, distance, within, raw, near: for every query and vector of ``watch`` (corpus, id), how many vectors
    of its corpus come before it by rounded distance and id, and how many of these are within ``max_distance``.

    A task gets some queries, up to RANKED_VECTORS vectors and the watched ones; it sorts a query's distances once and looks
    the watched ones up. The result has a row for each query and watched vector, so it grows as their product.
    """
    q, v = queries.where("qx is not null").select("qid", "qx"), vectors.where("x is not null").select("corpus", "id", "x")
    w = v.join(watch.select("corpus", "id").distinct(), ["corpus", "id"], "left_semi")
    n = q.count()
    across = max(min(n, TILES), n // max(RANKED_AT_ONCE, RANKED_ROWS // (w.count() + 1)) + 1, n // 1024 + 1)
    down = v.count() // RANKED_VECTORS + 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("a", F.expr(f"cast(pmod(xxhash64(qid), {across}) as int)")).withColumn("b", every(down))
    own = v.withColumn("b", F.expr(f"cast(pmod(xxhash64(corpus, id), {down}) as int)")).withColumn("watched", F.lit(False))
    both = own.unionByName(w.withColumn("b", every(down)).withColumn("watched", F.lit(True))).withColumn("a", every(across))
    schema = "qid long, corpus string, id long, distance double, within boolean, raw long, near long"
    kinds = kind_of(schema)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for corpus in right["corpus"].unique() if left.num_rows and right.num_rows else []:
            rows = right.filter(pc.equal(right["corpus"], corpus))
            mine, others = rows.filter(rows["watched"]), rows.filter(pc.invert(rows["watched"]))
            if not mine.num_rows:
                continue
            qids, qx = left["qid"].to_numpy(), _matrix(left["qx"].combine_chunks())
            wids, wx = mine["id"].to_numpy(), _matrix(mine["x"].combine_chunks())
            ids = others["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, n = ids[order], len(ids) + 1
            x = _matrix(others["x"].combine_chunks())[order] if len(ids) else np.zeros((0, wx.shape[1]))
            place = np.searchsorted(ids, wids)
            for at in range(0, len(qids), RANKED_AT_ONCE):
                some = qx[at : at + RANKED_AT_ONCE]
                d, dw = block_distances(some, x), block_distances(some, wx)
                keys = rounded(d).astype(np.int64) * n + np.arange(len(ids))
                units = rounded(dw)
                wanted = units.astype(np.int64) * n + place
                raw = np.stack([np.searchsorted(np.sort(k), t) for k, t in zip(keys, wanted)])
                near = np.stack([np.searchsorted(np.sort(k[e <= max_distance]), t) for k, e, t in zip(keys, d, wanted)])
                made = {"qid": np.repeat(qids[at : at + RANKED_AT_ONCE], len(wids)), "corpus": pa.repeat(corpus, units.size), "id": np.tile(wids, len(some))}
                made |= {"distance": units.ravel() / 10**PLACES, "within": (dw <= max_distance).ravel(), "raw": raw.ravel(), "near": near.ravel()}
                out.append(pa.table(made).cast(kinds))
        return pa.concat_tables(out) if out else kinds.empty_table()

    found = q.groupBy("a", "b").cogroup(both.groupBy("a", "b")).applyInArrow(meet, schema)
    if down == 1:
        return found
    return found.groupBy("qid", "corpus", "id").agg(F.first("distance").alias("distance"), F.first("within").alias("within"), F.sum("raw").alias("raw"), F.sum("near").alias("near"))


# --- Neighbours of all vectors --------------------------------------------------------------------------------------

#: Vectors of one block, which is one side of a matrix product; the most pivots, and the vectors that they are chosen from;
#: the width of a slice of angles about a pivot; what angles may be off by rounding.
BLOCK, PIVOTS, SAMPLE, STEP, SLACK = 1024, 256, 2048, 0.1, 1e-6
#: Visits of a vector up to which they are sent; beyond it the cells leave little out, and tiles of all with all send less.
VISITS = 2
#: Vectors whose visits are made at once.
VISITORS = 128


def _matrix(column) -> np.ndarray:
    """The vectors of an Arrow column of lists, as rows."""
    n = len(column)
    return column.flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, 1))


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


class Cells:
    """Vectors of length one, each in the cell of its nearest pivot. Angles obey the triangle inequality, so what two
    vectors' angles to a pivot tell of their own is exact.

    ``homes``: id, x, cell and alpha, the angle to the pivot. Pivots are a spread of a bounded sample; as many as there
    are blocks to fill, PIVOTS at most, so that they can go to every task.
    """

    def __init__(self, vectors: DataFrame, pivots: int | None = None):
        v = vectors.where("x is not null").select("id", "x")
        n = v.count()
        some = np.array([r.x for r in v.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()])
        wanted = min(pivots or max(1, min(PIVOTS, n // (2 * BLOCK))), len(some))
        chosen = [0] if n else []
        far = _angles(some, some[:1])[:, 0] if n else None
        while len(chosen) < wanted:  # the one that is farthest from all others
            chosen.append(int(far.argmax()))
            far = np.minimum(far, _angles(some, some[chosen[-1:]])[:, 0])
        self.pivots = some[chosen] if n else np.zeros((0, 1))
        pivots_ = self.pivots

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    to = _angles(_matrix(batch.column(1)), pivots_)
                    cell = to.argmin(1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(to.min(1))], names=["id", "x", "cell", "alpha"])

        self.homes = written(v.mapInArrow(run, "id long, x array<double>, cell int, alpha double"), "cells")
        sizes = self.homes.groupBy("cell").agg(F.count("*").alias("n"), F.max("alpha").alias("r")).collect()  # PIVOTS rows at most
        self.size, self.radius = np.zeros(len(self.pivots), np.int64), np.full(len(self.pivots), -np.inf)
        for r in sizes:
            self.size[r.cell], self.radius[r.cell] = r.n, r.r
        large = F.col("cell").isin([int(c) for c in np.flatnonzero(self.size > BLOCK)])
        placed = self.homes.withColumn("slice", F.when(large, F.floor(F.col("alpha") / STEP)).otherwise(-1))
        self.residents = self._blocked(placed, F.struct("id", "x"))

    @staticmethod
    def _blocked(rows: DataFrame, member: Column, **more: Column) -> DataFrame:
        """Blocks (cell, slice, sub, m) of rows: a slice of angles, dealt by hash if it holds more than one block."""
        sizes = rows.groupBy("cell", "slice").agg(F.count("*").alias("_n"))
        dealt = rows.join(sizes, ["cell", "slice"]).withColumn("sub", F.expr(f"pmod(xxhash64(id), _n div {BLOCK} + 1)"))
        return written(dealt.groupBy("cell", "slice", "sub").agg(F.collect_list(member).alias("m"), F.count("*").alias("n"), *(c.alias(k) for k, c in more.items())), "blocks")

    def apart(self, reach: DataFrame, upwards: bool) -> bool:
        """Whether cells leave so much out that visits are worth what is sent for them: a few for each vector. Visits are
        counted where they would be made, so none is made for it."""
        meets = self._meets(upwards)

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array([int(sum(m.sum() for _, m, _ in meets(batch)))])], names=["n"])

        n = reach.select("id", "x", "cell", "reach").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
        return n <= VISITS * max(1, int(self.size.sum()))

    def _meets(self, upwards: bool):
        """A function that goes through a batch by slices: the slice, which of its vectors visit which cells, and the angles."""
        pivots, radius = self.pivots, self.radius

        def slices(batch):
            for at in range(0, batch.num_rows, VISITORS):
                rows = batch.slice(at, VISITORS)
                beta, most = _angles(_matrix(rows.column(1)), pivots), rows.column(3).to_numpy()
                meets = beta <= radius + most[:, None] + SLACK
                if upwards:
                    meets &= np.arange(len(pivots)) >= rows.column(2).to_numpy()[:, None]
                yield rows, meets, beta

        return slices

    def visits(self, reach: DataFrame, upwards: bool) -> DataFrame:
        """Vectors (id, x, cell, reach: an angle) at every cell in which something can be within their reach: cell, beta (the
        angle to its pivot), id, x and reach. ``upwards``: at their own cell and those of higher numbers only. A slice of
        VISITORS vectors goes out at once, PIVOTS times that at most."""
        slices = self._meets(upwards)

        def run(batches):
            for batch in batches:
                for part, meets, beta in slices(batch):
                    i, cell = np.nonzero(meets)
                    rows = part.take(pa.array(i))
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(beta[i, cell]), rows.column(0), rows.column(1), rows.column(3)], names=["cell", "beta", "id", "x", "reach"])

        return reach.select("id", "x", "cell", "reach").mapInArrow(run, "cell int, beta double, id long, x array<double>, reach double")

    def meetings(self, visits: DataFrame) -> DataFrame:
        """ma, mb, na, nb: blocks of visitors and of residents with angles to the pivot that leave something in reach.

        Which blocks meet is joined by their numbers; then each block is sent once for each other one, to any task.
        """
        placed = visits.withColumn("slice", F.floor(F.col("beta") / STEP))
        blocks = self._blocked(placed, F.struct("id", "x", "reach"), reach=F.max("reach"))
        guest = blocks.select("cell", F.col("slice").alias("sa"), F.col("sub").alias("a"), "reach")
        host = self.residents.select("cell", F.col("slice").alias("sb"), F.col("sub").alias("b"))
        lo, hi = F.col("sa") * STEP - F.col("reach") - SLACK, (F.col("sa") + 1) * STEP + F.col("reach") + SLACK
        near = (F.col("sb") < 0) | ((F.col("sb") * STEP <= hi) & ((F.col("sb") + 1) * STEP >= lo))
        numbers = guest.join(host, "cell").where(near).select("cell", "sa", "a", "sb", "b")
        a = blocks.select("cell", F.col("slice").alias("sa"), F.col("sub").alias("a"), F.col("m").alias("ma"), F.col("n").alias("na"))
        b = self.residents.select("cell", F.col("slice").alias("sb"), F.col("sub").alias("b"), F.col("m").alias("mb"), F.col("n").alias("nb"))
        return numbers.join(a, ["cell", "sa", "a"]).join(b, ["cell", "sb", "b"]).select("ma", "mb", "na", "nb")


def _blocks(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of each block in an Arrow column."""
    ids, x = column.values.field("id").to_numpy(), column.values.field("x")
    lists, flat = x.offsets.to_numpy(), x.values.to_numpy()
    out = []
    for lo, hi in zip(column.offsets.to_numpy(), column.offsets.to_numpy()[1:]):
        out.append((ids[lo:hi], flat[lists[lo] : lists[hi]].reshape(hi - lo, -1)))
    return out


def near_meetings(cells: Cells, most: float) -> DataFrame:
    """Blocks between which pairs up to the distance ``most`` may be: of two cells the vectors of the lower one near the
    border visit the higher one."""
    return cells.meetings(cells.visits(cells.homes.withColumn("reach", F.lit(_reach(most))), upwards=True))


def _reach(most: float) -> float:
    return float(np.arccos(np.clip(1 - most, -1, 1)))


#: Columns of a product that are made at once; columns of which the largest entry is kept; pairs of which one in so many
#: is measured anew at most.
COLUMNS, GROUP, ANEW = 4096, 128, 64


def halved(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, and in single precision as columns."""
    return x, np.ascontiguousarray(x.T, np.float32)


def nearest_places(qids: np.ndarray, qx: np.ndarray, ids: np.ndarray, x: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and distances of each row's ``k`` nearest others, exact: by distance to nine decimals, of equal ones
    the first columns. ``ids`` are in order.

    Products are made in single precision, which for vectors of length one is off by less than (dim + 8) / 2^24. The k-th
    largest of what is the largest in a group of columns isn't above that of all. What is not below it by more than twice
    the error is measured in double precision.
    """
    x, single = x
    n, m = len(x), len(qx)
    wide = -(-n // GROUP) * GROUP
    s, top = np.full((m, wide), -2, np.float32), np.empty((m, wide // GROUP), np.float32)
    lo = np.searchsorted(ids, qids)
    own = np.searchsorted(ids, qids, "right") - lo
    oi = np.repeat(np.arange(m), own)
    oj = lo[oi] + np.arange(len(oi)) - (np.cumsum(own) - own)[oi]
    q = qx.astype(np.float32)
    for at in range(0, wide, COLUMNS):
        part, mine = slice(at, min(at + COLUMNS, n)), (oj >= at) & (oj < at + COLUMNS)
        s[:, part] = q @ single[:, part]
        s[oi[mine], oj[mine]] = -2  # not a vector itself
        top[:, at // GROUP : (at + COLUMNS) // GROUP] = s[:, at : at + COLUMNS].reshape(m, -1, GROUP).max(2)
    bound = np.partition(top, -k, axis=1)[:, -k].astype(float) if top.shape[1] >= k else np.full(m, -2.0)
    bound = np.maximum(bound - (2 * (x.shape[1] + 8) / 2**24 + 2e-9), -1.5)
    i, g = np.nonzero(top >= bound[:, None])
    if len(i) * GROUP <= s.size // 4:
        a, b = np.nonzero(s.reshape(m, -1, GROUP)[i, g] >= bound[i][:, None])
        i, j = i[a], g[a] * GROUP + b
        if len(i) <= s.size // ANEW:
            d = 1 - np.clip(np.einsum("ij,ij->i", qx[i], x[j]), -1, 1)
            order = np.lexsort((j, np.round(d, 9), i))
            i, j, d = i[order], j[order], d[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            return i[first], j[first], d[first]
    d = block_distances(qx, x)  # few columns, or many equal ones
    d[oi, oj] = np.inf
    i, j = first_places(d, k, lambda v: np.round(v, 9), 2e-9)
    return i, j, d[i, j]


def all_with_all(cells: Cells, run, schema: str, ready=lambda x: x) -> DataFrame:
    """``tiled`` over all pairs of the vectors; what is sent is about each vector once for every 32,768 and TILES times."""
    v = cells.homes.select(F.lit("").alias("corpus"), "id", "x")
    return tiled(v.select(F.col("id").alias("qid"), F.col("x").alias("qx")), v, run, schema, TILE_VECTORS, ready)


def near_duplicates(vectors: DataFrame, most: float, pivots: int | None = None) -> DataFrame:
    """a, b, d of all pairs a < b of vectors of length one up to the distance ``most``; exact, whatever the pivots."""
    cells = Cells(vectors, pivots)
    if not cells.apart(cells.homes.withColumn("reach", F.lit(_reach(most))), upwards=True):

        def pairs(qids, qx, ids, x):
            d = block_distances(qx, x)
            i, j = np.nonzero((d <= most) & (qids[:, None] < ids))
            return {"a": qids[i], "b": ids[j], "d": d[i, j]}

        return all_with_all(cells, pairs, "corpus string, a long, b long, d double").drop("corpus")
    own = cells.homes.select("id", "cell")

    def run(batches):
        for batch in batches:
            for (ia, xa), (ib, xb) in zip(_blocks(batch.column(0)), _blocks(batch.column(1))):
                d = 1 - np.clip(xa @ xb.T, -1, 1)
                i, j = np.nonzero((d <= most) & (ia[:, None] != ib))
                yield pa.RecordBatch.from_arrays([pa.array(ia[i]), pa.array(ib[j]), pa.array(d[i, j])], names=["p", "q", "d"])

    found = near_meetings(cells, most).select("ma", "mb").mapInArrow(run, "p long, q long, d double")
    # in a cell of its own a pair is found from both sides
    side = lambda c: own.select(F.col("id").alias(c), F.col("cell").alias(f"c{c}"))
    once = found.join(side("p"), "p").join(side("q"), "q").where("cp <> cq or p < q")
    return once.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "d")


def _with_reach(cells: Cells, k: int) -> DataFrame:
    """The vectors with an angle within which their ``k`` nearest others are: of their own block, or of a whole cell."""
    pivots, radius, size = cells.pivots, cells.radius, cells.size

    def run(batches):
        for batch in batches:
            for ids, x in _blocks(batch.column(0)):
                bound = np.full(len(ids), np.pi)
                if (size > k).any():
                    bound = np.minimum(bound, (_angles(x, pivots) + radius)[:, size > k].min(1))
                if len(ids) > k:
                    bound = np.minimum(bound, np.partition(_angles(x, x), k, axis=1)[:, k])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(bound)], names=["id", "reach"])

    return cells.homes.join(cells.residents.select("m").mapInArrow(run, "id long, reach double"), "id")


def nearest_meetings(cells: Cells, k: int) -> DataFrame:
    """Blocks between which the ``k`` nearest others of a vector may be."""
    return cells.meetings(cells.visits(_with_reach(cells, k), upwards=False))


def nearest(vectors: DataFrame, k: int, pivots: int | None = None) -> DataFrame:
    """id, other, d, rank: each vector's k nearest others; exact, whatever the pivots. Blocks keep k per row, then one
    window over these."""

    def run(batches):
        for batch in batches:
            for (ia, xa), (ib, xb) in zip(_blocks(batch.column(0)), _blocks(batch.column(1))):
                d = 1 - np.clip(xa @ xb.T, -1, 1)
                d[ia[:, None] == ib] = np.inf
                n = min(k, len(ib))
                order = np.lexsort((np.broadcast_to(ib, d.shape), np.round(d, 9)), axis=1)[:, :n]
                dist = np.take_along_axis(d, order, 1)
                fine = np.isfinite(dist)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ia, n).reshape(-1, n)[fine]), pa.array(ib[order][fine]), pa.array(dist[fine])], names=["id", "other", "d"])

    def ranked(qids, qx, ids, x):
        i, j, d = nearest_places(qids, qx, ids, x, k)
        return {"id": qids[i], "other": ids[j], "d": d}

    cells = Cells(vectors, pivots)
    reach = _with_reach(cells, k)
    if cells.apart(reach, upwards=False):
        found = nearest_meetings(cells, k).select("ma", "mb").mapInArrow(run, "id long, other long, d double")
    else:
        found = all_with_all(cells, ranked, "corpus string, id long, other long, d double", halved).drop("corpus")
    near = found.withColumn("d", F.round("d", 9))
    return near.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy("d", "other"))).where(F.col("rank") <= k)
