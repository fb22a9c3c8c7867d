"""Near-duplicates by bottom-k sketches of word shingles, with exact Jaccard similarity at the end."""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_bytes, connected_components, joined, partitions

#: Retained values of a sketch, and how many of the smallest make keys of the inverted lists.
SKETCH, KEYED = 64, 48
#: Keys of the smallest values that round r of the passes with pivots uses; members of a list in one block.
ROUND_KEYS, BLOCK = (10,), 256
SMALL_SET = 12
#: The chance that the estimate drops a pair of the threshold's similarity.
RARE = 1e-7
P1, P2, P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all shingles of ``width`` words; fewer words count as one shingle.

    A-Z are lower-cased; words are what ASCII white space separates.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    n = min(width, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = (h ^ (h >> np.uint64(31))) * P1 + w[k : len(w) - n + 1 + k] * P2
    return np.unique((h ^ (h >> np.uint64(29))) * P3)


def list_keys(sketch: np.ndarray) -> np.ndarray:
    """Keys of the inverted lists: every three neighbours among the smallest retained values.

    Sets of a high similarity agree in long runs of their smallest values; texts that merely share a passage have other
    values between. Small sets are keyed by two neighbours as well, so that one difference never hides a pair.
    """
    s = sketch[:KEYED]
    keys = (s[:-2] * P1 + s[1:-1]) * P2 + s[2:] if len(s) > 2 else s[:0]
    if len(sketch) <= SMALL_SET and len(s) > 1:
        keys = np.concatenate([keys, (s[:-1] * P3 + s[1:]) * P1])
    return keys.view(np.int64)


def union_estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity from the smallest values of the union of two sketches; exact if both are whole sets."""
    u = np.union1d(a, b)
    if len(a) >= SKETCH or len(b) >= SKETCH:
        u = u[:SKETCH]
    both = np.intersect1d(a, b, assume_unique=True)
    return np.isin(u, both, assume_unique=True).mean()


class Jaccard:
    """A threshold num/den; a pair is linked if den * intersection >= num * union."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.floor = self.lowest(SKETCH)

    def lowest(self, k: int) -> float:
        """The lowest estimate from k values that sets of the threshold's similarity have but for a chance of RARE.

        Of the k smallest values of a union, the number that both sets hold is hypergeometric, with no longer a tail than
        the binomial one that is added up here.
        """
        t, below = self.num / self.den, 0.0
        for n in range(k + 1):
            below += comb(k, n) * t**n * (1 - t) ** (k - n)
            if below > RARE:
                return n / k
        return 1.0

    def sizes_allow(self, a: str, b: str):
        return F.expr(f"{self.den} * least({a}, {b}) >= {self.num} * greatest({a}, {b})")

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return self.den * both >= self.num * (len(a) + len(b) - both)


def _sketches(docs: DataFrame, width: int, key: str, text: str) -> DataFrame:
    @by_bytes(1)
    def run(batches):
        for batch in batches:
            n, sig, sketch = [], [], []
            for t in batch.column(1).to_pylist():
                h = shingle_hashes(t, width)
                n.append(len(h))
                sig.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                sketch.append(h[:SKETCH].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(sketch, pa.binary())],
                names=["id", "n", "sig", "sketch"],
            )

    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    return rows.mapInArrow(run, f"id {docs.schema[key].dataType.simpleString()}, n long, sig binary, sketch binary")


def _keys(classes: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            keys = [list_keys(np.frombuffer(s, np.uint64)) for s in batch.column(1).to_pylist()]
            count = [len(k) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.zeros(0, np.int64), *keys])),
                    batch.column(0).take(pa.array(np.repeat(np.arange(len(keys)), count))),
                    pa.array(np.concatenate([np.zeros(0, np.int32), *(np.arange(c, dtype=np.int32) for c in count)])),
                ],
                names=["key", "cid", "no"],
            )

    return classes.select("cid", "sketch").mapInArrow(run, "key long, cid long, no int")


def _estimated(pairs: DataFrame, classes: DataFrame, rule: Jaccard) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow the threshold."""
    side = lambda c: classes.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))

    def run(batches):
        for batch in batches:
            sa, sb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = [union_estimate(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= rule.floor for x, y in zip(sa, sb)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    with_a = pairs.join(side("a"), "a")
    both = with_a.join(side("b"), "b").where(rule.sizes_allow("na", "nb"))
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _whole_sets(scratch: Scratch, wanted: DataFrame, docs: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """cid and the whole shingle set, made again from the text of one document, of the classes ``wanted`` (cid, id, sig)."""

    @by_bytes(2)
    def run(batches):
        for batch in batches:
            sets = [shingle_hashes(t, width) for t in batch.column(2).to_pylist()]
            same = [xxhash.xxh3_128_digest(h.tobytes()) == s for h, s in zip(sets, batch.column(1).to_pylist())]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.tobytes() for h in sets], pa.binary())], names=["cid", "hashes"])
            yield out.filter(pa.array(same, pa.bool_()))

    texts = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    return scratch.table(texts.join(wanted, "id").select("cid", "sig", "t").mapInArrow(run, "cid long, hashes binary"))


def _verified(scratch: Scratch, pairs: DataFrame, sets: DataFrame, rule: Jaccard) -> DataFrame:
    """The pairs whose whole sets reach the threshold."""

    def check(batches):
        for batch in batches:
            ha, hb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = [rule.linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(ha, hb)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda c: sets.select(F.col("cid").alias(c), F.col("hashes").alias(f"h{c}"))
    return scratch.table(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ha", "hb").mapInArrow(check, "a long, b long"))


def _mixed(scratch: Scratch, shared: DataFrame, parts: DataFrame | None) -> DataFrame:
    """(key, no, cid, root) of the lists that hold several components."""
    placed = shared.select("key", "no", "cid")
    if parts is None:
        return placed.withColumn("root", F.col("cid"))
    placed = scratch.table(placed.join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid")))
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return scratch.table(placed.join(mixed, "key"))


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of documents linked by shingle sets of similarity num/den or more.

    1. Every document's shingle set gives its size, a 128-bit signature and a bottom-k sketch (one hash function).
       Documents of one signature are a class; what follows is about classes, so copies never make pairs.
    2. Inverted lists by keys of the smallest retained values. In rounds, each list's members are compared with one
       pivot, and what is linked becomes one component; lists of one component are done. In lists that still hold
       several, members of different components are compared with each other, in blocks: nothing is capped.
    3. Union-sketch estimates drop pairs that the threshold's similarity would give with a chance below 1e-7, the others
       are verified on whole sets, so no link is wrong. A link between different sets escapes with a chance below 2e-7: its
       48 smallest values would have to hold no three neighbours that both sets have (3e-8 at a similarity of 0.8).

    Returns key, n_shingles long, component_id (smallest key reachable, itself included), kept boolean (it is its own
    component_id), one row for each input row. Without words: no shingles, linked with nothing, kept. A null key can't be
    a component_id; such a row takes its class's one, and links to its own class only. Equal rows give equal rows; a key
    with several texts is in several classes. An empty table gives an empty table; of other columns, whatever their names,
    nothing is read; texts are whole, however long.
    """
    spark, scratch, rule = docs.sparkSession, Scratch(docs.sparkSession), Jaccard(num, den)
    rows = scratch.table(_sketches(docs, width, key, text))
    classes = scratch.table(
        rows.where("n > 0").groupBy("sig").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.max("sketch").alias("sketch"))
        .withColumn("cid", F.monotonically_increasing_id())
    )
    # smaller sets can't be similar enough to any other set
    keys = scratch.table(_keys(classes.where(F.expr(f"{den} * n >= {num} * (n + 1)"))))
    lists = keys.groupBy("key").agg(F.count("*").alias("m"), F.min("cid").alias("low"), F.max("cid").alias("high"))
    shared = scratch.table(keys.join(lists.where("low < high").select("key", "low"), "key"))
    scratch.drop(keys)
    wanted = shared.select("cid").distinct().join(classes.select("cid", F.col("rep").alias("id"), "sig"), "cid")
    sets = _whole_sets(scratch, wanted, docs, width, key, text)
    links, parts = None, None
    for turn, most in enumerate(ROUND_KEYS):
        at = _mixed(scratch, shared, parts).where(F.col("no") < most).withColumn("turn", F.xxhash64("cid", F.lit(turn)))
        pivot = at.groupBy("key").agg(F.min(F.struct("turn", "cid", "root")).alias("p"))
        stars = at.join(pivot, "key").where("root <> p.root").select(F.greatest("cid", "p.cid").alias("a"), F.least("cid", "p.cid").alias("b")).distinct()
        found = _verified(scratch, scratch.table(_estimated(stars, classes, rule)), sets, rule)
        if not found.head(1):
            break
        links = found if links is None else links.union(found)
        parts = scratch.table(connected_components(scratch, links))
    more = _across(scratch, _mixed(scratch, shared, parts), classes, sets, rule)
    if more.head(1):
        parts = scratch.table(connected_components(scratch, more if links is None else links.union(more)))
    scratch.drop(shared, sets)
    label = classes.select("sig", "cid", "rep")
    if parts is not None:
        label = scratch.table(label.join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid")))
        least = label.groupBy("root").agg(F.min("rep").alias("component_id"))
        label = label.join(least, "root").select("sig", "component_id")
    else:
        label = label.select("sig", F.col("rep").alias("component_id"))
    out = rows.select("id", "n", "sig").join(scratch.table(label), "sig", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, component.isNull()).alias("kept"),
    )


def _across(scratch: Scratch, rows: DataFrame, classes: DataFrame, sets: DataFrame, rule: Jaccard) -> DataFrame:
    """Links between classes that share a list but are in different components, as many as their components need.

    Every class is in one block: of its largest list, and of about ``BLOCK`` members. Two blocks meet once, however many
    lists they share; so a pair is looked at once. First by sketches; blocks in which some pair may be similar meet
    again with whole sets.
    """
    sizes = rows.groupBy("key").agg(F.count("*").alias("m"))
    home = scratch.table(
        rows.join(sizes, "key").groupBy("cid").agg(F.max(F.struct("m", "key")).alias("h"), F.max("root").alias("root"))
        .select("cid", "root", F.xxhash64("h.key", F.expr(f"pmod(xxhash64(cid), h.m div {BLOCK} + 1)")).alias("block"))
    )
    touch = scratch.table(rows.select("key", "cid").join(home.select("cid", "block"), "cid").select("key", "block").distinct())
    met = touch.withColumnRenamed("block", "a").join(touch.withColumnRenamed("block", "b"), "key").where("a <= b").select("a", "b").distinct()

    def gathered(values: DataFrame) -> DataFrame:
        members = home.join(values, "cid").groupBy("block").agg(F.collect_list(F.struct("cid", "root", "hashes", "n")).alias("m"))
        return scratch.table(members)

    def meet(pairs: DataFrame, blocks: DataFrame, look, schema: str) -> DataFrame:
        side = lambda c: blocks.select(F.col("block").alias(c), F.col("m").alias(f"m{c}"))

        def run(batches):
            for batch in batches:
                (oa, va), (ob, vb) = ((c.offsets.to_numpy(), c.values) for c in (batch.column(2), batch.column(3)))
                for k in range(batch.num_rows):
                    x, y = va.slice(oa[k], oa[k + 1] - oa[k]), vb.slice(ob[k], ob[k + 1] - ob[k])
                    got = look(batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), x, y)
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array([g[c] for g in got], pa.int64()) for c in (0, 1)], names=["a", "b"])

        return scratch.table(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ma", "mb").mapInArrow(run, schema))

    def hopeful(a, b, x, y):
        return [(a, b)] if _allowed(x, y, a == b, rule)[0].any() else []

    def linked(a, b, x, y):
        ok, sa, sb = _allowed(x, y, a == b, rule)
        i, j = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
        if not len(i):
            return []
        sa, sb = [sa[k] for k in i], [sb[k] for k in j]
        both = _in_common(sa, sb)
        na, nb = np.array([len(s) for s in sa]), np.array([len(s) for s in sb])
        same = ok[np.ix_(i, j)] & (rule.den * both >= rule.num * (na[:, None] + nb - both))
        ra, rb = x.field("root").to_numpy()[i], y.field("root").to_numpy()[j]
        return [(int(p), int(q)) for p, q in zip(*joined(same, ra, rb))]  # roots stand for their components

    blocks = gathered(classes.select("cid", F.col("sketch").alias("hashes"), "n"))
    close = meet(met, blocks, hopeful, "a long, b long")
    whole = gathered(sets.withColumn("n", F.expr("length(hashes) div 8")).join(close.select(F.explode(F.array("a", "b")).alias("block")).distinct().join(home.select("cid", "block"), "block").select("cid"), "cid", "left_semi"))
    found = meet(close, whole, linked, "a long, b long")
    out = scratch.table(found.distinct())
    scratch.drop(blocks, whole, touch, close, found, home)
    return out


def _in_common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b``: products of 0/1 matrices, a slice of the values at a time."""
    values, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    row = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in (*a, *b)])
    often = np.bincount(at, minlength=len(values)) > 1
    column = np.cumsum(often) - 1
    keep = often[at]
    at, row = column[at[keep]], row[keep]
    out = np.zeros((len(a), len(b)), np.float32)
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    for lo in range(0, int(often.sum()), 4096):
        part = slice(*np.searchsorted(at, [lo, lo + 4096]))
        has = np.zeros((len(a) + len(b), 4096), np.float32)
        has[row[part], at[part] - lo] = 1
        out += has[: len(a)] @ has[len(a) :].T
    return out.astype(np.int64)


def _allowed(x: pa.StructArray, y: pa.StructArray, same: bool, rule: Jaccard):
    """Which pairs of members (cid, root, hashes, n) of two blocks sizes and sketches allow, and the members' hashes.

    Retained values in common bound the union's estimate from above.
    """
    (ca, ra, na), (cb, rb, nb) = (tuple(v.field(k).to_numpy(zero_copy_only=False) for k in ("cid", "root", "n")) for v in (x, y))
    ok = (ra[:, None] != rb) & (rule.den * np.minimum(na[:, None], nb) >= rule.num * np.maximum(na[:, None], nb))
    if same:
        ok &= ca[:, None] < cb
    if not ok.any():
        return ok, [], []
    sa, sb = ([np.frombuffer(s, np.uint64) for s in v.field("hashes").to_pylist()] for v in (x, y))
    ha, hb = ([s[:SKETCH] for s in v] for v in (sa, sb))
    la, lb = np.array([len(s) for s in ha]), np.array([len(s) for s in hb])
    common = _in_common(ha, hb)
    return ok & (common >= rule.floor * np.minimum(SKETCH, la[:, None] + lb - common)), sa, sb


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates: of each group the document of the smallest key.

    Of rows that repeat a kept key one stays. Rows of a null key stay unless their words are another document's. Texts
    without words stay; an empty table gives an empty table; columns of any names pass.
    """
    scratch = Scratch(docs.sparkSession)
    ids = scratch.table(near_duplicates(docs, width, num, den, key, text).where("kept").select(key))
    out = docs.where(F.col(key).isNotNull()).join(ids.where(F.col(key).isNotNull()).distinct(), key, "left_semi")
    if ids.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").head(1):
        out = out.dropDuplicates([key])
    if ids.where(F.col(key).isNull()).head(1):
        out = out.union(docs.where(F.col(key).isNull()))
    return out.select(docs.columns)
