"""Removal of long byte strings that occur more than once, by a sparse suffix array."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_bytes, partitions, settings

#: Bytes of an anchor; windows of a text that are looked at together.
GRAM, SEGMENT = 64, 1 << 19
POSITION_BITS = 20
#: Suffixes in one task of the sort; splitters that are sampled from a task's rows; rows of one Arrow batch that is sent.
TASK_SUFFIXES, SPLITTERS, CHUNK = 20_000, 20, 4_000
_rng = np.random.default_rng(20240229)
#: A random odd 64-bit number for each byte, and powers of an odd base and of its inverse.
BYTE_CODES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
BASE = int(_rng.integers(0, 1 << 62)) << 1 | 1


def _powers(base: int) -> np.ndarray:
    out = np.full(SEGMENT + (1 << 10), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


UP, DOWN = _powers(BASE), _powers(pow(BASE, -1, 1 << 64))
MIX = np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """64-bit hashes of all GRAM-byte strings of at most SEGMENT + 1024 bytes, by start."""
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(BYTE_CODES[text] * UP[: len(text)], out=total[1:])
    n = len(text) - GRAM + 1
    h = (total[GRAM:] - total[:n]) * DOWN[:n]
    return (h ^ (h >> np.uint64(29))) * MIX


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(text: bytes, length: int):
    """(pos, lo, hi, gram) of a text's anchors: windows of ``length`` bytes that start from lo to hi have theirs at pos.

    A window's anchor is the string of GRAM bytes in it with the smallest hash, the leftmost of equal ones; so equal
    windows have it at the same place, wherever they are.
    """
    codes = np.frombuffer(text, np.uint8)
    width = length - GRAM + 1
    out: list[np.ndarray] = []
    for at in range(0, len(codes) - length + 1, SEGMENT):
        h = gram_hashes(codes[at : at + SEGMENT + length - 1])
        packed = (h >> np.uint64(POSITION_BITS) << np.uint64(POSITION_BITS)) | np.arange(len(h), dtype=np.uint64)
        low = sliding_minimum(packed, width)
        cut = np.flatnonzero(low[1:] != low[:-1]) + 1
        start = np.concatenate([[0], cut])
        end = np.concatenate([cut, [len(low)]]) - 1
        place = (low[start] & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
        out.append(np.stack([place + at, start + at, end + at, h[place].view(np.int64)], 1))
    if not out:
        return np.zeros((0, 4), np.int64)
    rows = np.concatenate(out)
    new = np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])  # an anchor at a segment's end goes on in the next
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(rows)]]) - 1
    rows[first, 2] = rows[last, 2]
    return rows[first]


def multikey_sort(words: np.ndarray) -> np.ndarray:
    """Order of rows of 64-bit words: three-way quicksort on one word at a time, equal ones by the next word."""
    n, depth = words.shape
    order = np.arange(n)
    todo = [(0, n, 0)]
    while todo:
        lo, hi, d = todo.pop()
        if hi - lo < 2 or d == depth:
            continue
        part = order[lo:hi]
        key = words[part, d]
        if hi - lo <= 64:
            part = part[np.lexsort(words[part, d:].T[::-1])]
            order[lo:hi] = part
            continue
        pivot = np.partition(key, len(key) // 2)[len(key) // 2]
        less, equal = key < pivot, key == pivot
        a, b = int(less.sum()), int(equal.sum())
        order[lo:hi] = np.concatenate([part[less], part[equal], part[~(less | equal)]])
        todo += [(lo, lo + a, d), (lo + a, lo + a + b, d + 1), (lo + a + b, hi, d)]
    return order


def common_prefixes(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bytes that each row of a padded byte matrix has in common with the next one."""
    same = rows[1:] == rows[:-1]
    n = np.where(same.all(1), rows.shape[1], same.argmin(1)) if len(same) else np.zeros(0, np.int64)
    return np.minimum(n, np.minimum(sizes[1:], sizes[:-1]))


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """k (the key column), r1 and r2 (128 bits of key and text) and t (bytes of the text, '' for null)."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("k"), F.xxhash64(F.lit(1), F.col(key), t).alias("r1"), F.xxhash64(F.lit(2), F.col(key), t).alias("r2"), t.cast("binary").alias("t"))


def _anchor_rows(keyed: DataFrame, length: int) -> DataFrame:
    @by_bytes(2)
    def run(batches):
        for batch in batches:
            found, which, hashes = [np.zeros((0, 4), np.int64)], [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                rows = anchors(t, length)
                if len(rows):
                    found.append(rows)
                    which.append(np.full(len(rows), i))
                    left = np.maximum(0, rows[:, 0] + GRAM - length).tolist()
                    for p, lo in zip(rows[:, 0].tolist(), left):
                        # what all windows about the anchor can see, and where in it the anchor is
                        h = xxhash.xxh3_128(t[lo : p + length], seed=p - lo)
                        hashes.append(h.digest())
            rows = np.concatenate(found)
            at = pa.array(np.concatenate(which) if which else np.zeros(0, np.int64))
            both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(np.ascontiguousarray(rows[:, c])) for c in range(4)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())],
                names=["r1", "r2", "pos", "lo", "hi", "gram", "c1", "c2"],
            )

    return keyed.select("r1", "r2", "t").mapInArrow(run, "r1 long, r2 long, pos long, lo long, hi long, gram long, c1 long, c2 long")


def _surroundings(keyed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """uid, gram, r1, r2, pos, lo, hi, suffix (from the anchor on) and left (from lo to the anchor) of the wanted anchors."""

    names, kinds = ["uid", "gram", "r1", "r2", "pos", "lo", "hi", "suffix", "left"], [pa.int64()] * 7 + [pa.binary()] * 2

    @by_bytes(2)
    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for r1, r2, t, places in zip(*(c.to_pylist() for c in batch.columns)):
                for p in places:
                    pos, lo = p["pos"], p["lo"]
                    for col, x in zip(out, (p["uid"], p["gram"], r1, r2, pos, lo, p["hi"], t[pos : pos + length], t[lo:pos])):
                        col.append(x)
                    if len(out[0]) >= CHUNK:  # a long text has many anchors
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
                        out = [[] for _ in range(9)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    places = wanted.groupBy("r1", "r2").agg(F.collect_list(F.struct("uid", "gram", "pos", "lo", "hi")).alias("places"))
    joined = keyed.select("r1", "r2", "t").join(places, ["r1", "r2"]).select("r1", "r2", "t", "places")
    return joined.mapInArrow(run, "uid long, gram long, r1 long, r2 long, pos long, lo long, hi long, suffix binary, left binary")


def longest_matches(scratch: Scratch, suffixes: DataFrame, length: int) -> DataFrame:
    """uid and reach: bytes, ``length`` at most, that a suffix has in common with any other one.

    Sampled splitters range-partition the suffixes by their leading bytes (equal ones by uid, so that no group is too
    large for a task); every bucket sorts its own. The ends of neighbouring buckets meet in a join; the driver only gets
    the numbers of the buckets that have rows.
    """
    spark = scratch.spark
    words = -(-length // 8)
    count = suffixes.count()
    tasks = max(partitions(spark), -(-count // TASK_SUFFIXES))

    @by_bytes(1, 1 << 62)
    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        uid = np.concatenate([b.column(0).to_numpy() for b in batches])
        text = [s for b in batches for s in b.column(1).to_pylist()]
        batches.clear()
        sizes = np.array([len(s) for s in text])
        rows = np.frombuffer(b"".join([s.ljust(words * 8, b"\0") for s in text]), np.uint8).reshape(len(text), words * 8)
        order = multikey_sort(rows.view(">u8").astype(np.uint64))
        first, last = text[order[0]], text[order[-1]]
        del text
        # among equal rows (zero bytes pad shorter ones) shorter ones first, then by uid
        sizes, uid = sizes[order], uid[order]
        reach = np.zeros(len(uid), np.int64)
        for at in range(0, len(uid), CHUNK):
            near = common_prefixes(rows[order[at : at + CHUNK + 1]], sizes[at : at + CHUNK + 1])
            reach[at + 1 : at + 1 + len(near)] = near
            reach[at : at + len(near)] = np.maximum(reach[at : at + len(near)], near)
        for at in range(0, len(uid), CHUNK):
            n = len(uid[at : at + CHUNK])
            head, tail = ([value if here else None] + [None] * (n - 1) for value, here in ((first, at == 0), (last, at + n == len(uid))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid[at : at + n]), pa.array(reach[at : at + n]), pa.array(head, pa.binary()), pa.array(tail[::-1], pa.binary()), pa.array(np.full(n, part))],
                names=["uid", "reach", "head", "tail", "part"],
            )

    @by_bytes(1)
    def meet(batches):
        for batch in batches:
            pairs = zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())
            n = [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in pairs]
            for side in (0, 2):
                yield pa.RecordBatch.from_arrays([batch.column(side), pa.array(n, pa.int64())], names=["uid", "reach"])

    with settings(spark, spark__sql__execution__rangeExchange__sampleSizePerPartition=SPLITTERS):
        ranged = suffixes.select("uid", "suffix").repartitionByRange(tasks, "suffix", "uid")
        out = scratch.table(ranged.mapInArrow(run, "uid long, reach long, head binary, tail binary, part long"))
    full = [r.part for r in out.where("head is not null").select("part").orderBy("part").collect()]
    steps = spark.createDataFrame(list(zip(full, full[1:])), "part long, next long")
    ends = out.where("tail is not null").select("part", F.col("uid").alias("u1"), "tail").join(steps, "part")
    heads = out.where("head is not null").select(F.col("part").alias("next"), F.col("uid").alias("u2"), "head")
    across = ends.join(heads, "next").select("u1", "tail", "u2", "head").mapInArrow(meet, "uid long, reach long")
    return out.select("uid", "reach").union(across).groupBy("uid").agg(F.max("reach").alias("reach"))


def _spans(rows: DataFrame, length: int, single: bool) -> DataFrame:
    """uid, a, b and a 128-bit hash of the bytes of all windows of a run a..b of starts, or of each of them."""

    @by_bytes(5, 1 << 62)
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                uid, lows, highs, hashes = [], [], [], []
                for u, pos, lo, a, b, suffix, left in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns)):
                    text = left + suffix
                    step = 1 if single else b - a + 1
                    for p in range(a, b + 1, step):
                        q = min(p + step - 1, b)
                        # where the anchor is in it counts as well
                        hashes.append(xxhash.xxh3_128(text[p - lo : q - lo + length], seed=pos - p).digest())
                        uid.append(u), lows.append(p), highs.append(q)
                both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (uid, lows, highs)] + [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["uid", "a", "b", "w1", "w2"])

    return rows.select("uid", "pos", "lo", "a", "b", "suffix", "left").mapInArrow(run, "uid long, a long, b long, w1 long, w2 long")


def repeated_windows(scratch: Scratch, keyed: DataFrame, length: int) -> DataFrame:
    """r1, r2, lo, hi: runs of starts of windows of ``length`` bytes that also start anywhere else.

    1. Anchors of all texts. Those whose surroundings (all that their windows can see) occur twice are settled: all their
       windows do. Those whose own bytes occur once are settled as well: none does.
    2. The others, and one of each settled kind that shares their bytes, go into two sparse suffix arrays, one of what
       follows the anchor and one of what precedes it, read backwards: the longest matches bound the windows that can
       occur elsewhere.
    3. These runs of windows are compared by 128-bit hashes: as a whole, those without an equal window by window
       (with one run of each kind that has equals).
    Counts are partial-aggregated and written before they are joined, so that Spark's skew handling can split the joins:
    a passage in a third of all texts is no hot spot; no pairs are made.
    """
    found = scratch.table(_anchor_rows(keyed, length))
    grams = found.groupBy("gram").agg(F.count("*").alias("n"), F.min("c1").alias("a"), F.max("c1").alias("b")).where("n > 1")
    grams = scratch.table(grams.select("gram", (F.col("a") < F.col("b")).alias("mixed")))
    shared = scratch.table(found.join(grams, "gram"))
    scratch.drop(found, grams)
    seen = shared.groupBy("c1", "c2").agg(F.count("*").alias("m"), F.min(F.struct("r1", "r2", "pos")).alias("rep"))
    seen = scratch.table(seen.where("m > 1"))
    counted = scratch.table(shared.join(seen, ["c1", "c2"], "left"))
    scratch.drop(shared, seen)
    settled = counted.where("m > 1").select("r1", "r2", "lo", "hi")
    wanted = scratch.table(
        counted.where("mixed").where(F.col("m").isNull() | (F.col("rep") == F.struct("r1", "r2", "pos")))
        .select("r1", "r2", "pos", "lo", "hi", "gram").distinct().withColumn("uid", F.monotonically_increasing_id())
    )
    around = scratch.table(_surroundings(keyed, wanted, length))
    scratch.release()
    ahead = longest_matches(scratch, around.select("uid", "suffix"), length)
    # one more row for each text that repeats does no harm: all its windows occur twice anyway
    before = F.concat(F.unhex(F.lpad(F.hex("gram"), 16, "0")), F.reverse(F.hex("left")))
    back = longest_matches(scratch, around.select("uid", before.cast("binary").alias("suffix")), 8 + 2 * length)
    back = back.select("uid", F.expr("greatest(0, reach - 8) div 2").alias("behind"))
    first, last = F.greatest("lo", F.col("pos") - F.col("behind")), F.least("hi", F.col("pos") + F.col("reach") - length)
    rows = around.join(ahead.where(f"reach >= {GRAM}"), "uid").join(back, "uid").withColumn("a", first).withColumn("b", last).where("a <= b")
    rows = scratch.table(rows.select("uid", "gram", "r1", "r2", "pos", "lo", "a", "b", "suffix", "left"))
    scratch.drop(around, wanted)
    out, ids = settled, rows.select("uid", "r1", "r2").distinct()
    for single in (False, True):
        spans = scratch.table(_spans(rows, length, single))
        twice = scratch.table(spans.groupBy("w1", "w2").agg(F.count("*").alias("m"), F.min("uid").alias("one")).where("m > 1"))
        known = scratch.table(spans.join(twice, ["w1", "w2"], "left").select("uid", "a", "b", F.col("m").isNotNull().alias("again")))
        out = out.union(scratch.table(known.where("again").join(ids, "uid").select("r1", "r2", F.col("a").alias("lo"), F.col("b").alias("hi"))))
        if not single:
            # a window of a run without an equal may be in one that has some, so one of each kind goes along
            alone = rows.join(known.where("not again").select("uid").distinct(), "uid", "left_semi")
            kinds = rows.join(twice.select(F.col("one").alias("uid")).distinct(), "uid", "left_semi")
            open_grams = scratch.table(alone.select("gram").distinct())
            rows = scratch.table(alone.union(kinds.join(open_grams, "gram", "left_semi").select(alone.columns)))
        scratch.drop(spans, known)
    return out


def covered(starts: list[tuple[int, int]], length: int) -> list[list[int]]:
    """Maximal runs of bytes in windows whose starts are given as runs."""
    runs: list[list[int]] = []
    for lo, hi in sorted(starts):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi + length)
        else:
            runs.append([lo, hi + length])
    return runs


def _cut(docs: DataFrame, length: int, key: str, text: str):
    scratch = Scratch(docs.sparkSession)
    keyed = _keyed(docs, key, text)
    runs = repeated_windows(scratch, keyed, length).groupBy("r1", "r2").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("runs"))
    return scratch.table(runs)


def _kept(text: bytes, starts, length: int, least_words: int = 0) -> tuple[bytes, list[list[int]]]:
    runs = covered([(s["lo"], s["hi"]) for s in starts or ()], length)
    if least_words:
        runs = [r for r in runs if len(text[r[0] : r[1]].split()) >= least_words]
    at, parts = 0, []
    for lo, hi in runs:
        parts.append(text[at:lo])
        at = hi
    return b"".join([*parts, text[at:]]), runs


def removed_spans(docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What is left of each text without the bytes covered by a ``length``-byte string that also starts anywhere else.

    Texts are UTF-8 bytes, null counts as empty; a match may be in the same text and may overlap. All is judged on the
    input. Returns key, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and kept_text (the bytes left,
    without those of a character that lost some) of each row; a text below ``length`` bytes loses nothing; rows that
    repeat are other places, so both lose all windows. An empty table gives an empty table; of other columns, whatever
    their names, nothing is read.
    """

    @by_bytes(1)
    def run(batches):
        for batch in batches:
            size, gone, spans, sha, left = [], [], [], [], []
            for t, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                kept, runs = _kept(t, starts, length)
                size.append(len(t)), gone.append(len(t) - len(kept)), spans.append(len(runs)), sha.append(hashlib.sha256(kept).hexdigest())
                left.append(kept.decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (size, gone, spans)), pa.array(sha, pa.string()), pa.array(left, pa.string())], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    joined = _keyed(docs, key, text).join(_cut(docs, length, key, text), ["r1", "r2"], "left").select("k", "t", "runs")
    kind = docs.schema[key].dataType.simpleString()
    return joined.mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")


def cut_repeats(docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text", count: str | None = "n_chars", least_words: int = 0) -> DataFrame:
    """The rows of ``docs``, all columns, with texts cut (a character that loses a byte goes as a whole) and ``count`` set anew.

    With ``least_words``, removed runs of fewer words stay. A null text stays null, texts below ``length`` bytes stay as
    they are, repeated rows both lose what repeats, and an empty table gives an empty table. Columns of any names pass.
    """
    names = docs.columns
    at = names.index(text)

    @by_bytes(at)
    def run(batches):
        for batch in batches:
            starts = batch.column(len(names)).to_pylist()
            texts = []
            for t, s in zip(batch.column(at).to_pylist(), starts):
                texts.append(t if not s else _kept(t.encode(), s, length, least_words)[0].decode("utf-8", "ignore"))
            cols = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
            if count in names:
                n = names.index(count)
                cols[n] = pa.array([old if not s else len(t) for t, s, old in zip(texts, starts, cols[n].to_pylist())], cols[n].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))  # the caller's names can't meet those of the join
    t = F.coalesce(F.col(f"c{at}"), F.lit(""))
    r = [F.xxhash64(F.lit(k), F.col(f"c{names.index(key)}"), t).alias(f"r{k}") for k in (1, 2)]
    joined = plain.select("*", *r).join(_cut(docs, length, key, text), ["r1", "r2"], "left").select(*plain.columns, "runs")
    return joined.mapInArrow(run, docs.schema)
