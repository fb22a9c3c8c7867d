"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_bytes

ORDERS = (3, 4, 5, 6, 8, 10)
BUCKET_BITS = 20
#: Bounds of the model, whatever the input's size: labelled rows that it learns from, and n-grams that it keeps.
MAX_LABELLED, MAX_FEATURES = 16_000, 4_096
BLOCK = 1 << 18
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: A-Z lower-cased; other ASCII that is neither letter nor digit becomes a space.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
GAP = b" " * max(ORDERS)


def blocks(texts: list[bytes]):
    """Whole texts as (codes, starts, numbers): blocks of bounded size.

    Every text is between spaces, so n-grams know word starts and ends; no n-gram holds letters of two texts.
    """
    parts, starts, numbers, size = [], [], [], 0
    for number, text in enumerate(texts):
        text = text.translate(TABLE)
        for piece in pieces_of(text):
            parts += [GAP, piece]
            starts.append(size)
            numbers.append(number)
            size += len(GAP) + len(piece)
            if size >= BLOCK:
                yield np.frombuffer(b"".join([*parts, GAP]), np.uint8), np.array(starts), np.array(numbers)
                parts, starts, numbers, size = [], [], [], 0
    if parts:
        yield np.frombuffer(b"".join([*parts, GAP]), np.uint8), np.array(starts), np.array(numbers)


def pieces_of(text: bytes):
    """The text in pieces of about BLOCK bytes that begin and end at spaces where there are any, and overlap by an n-gram."""
    at = 0
    while True:
        end = at + BLOCK
        if end >= len(text):
            yield text[at:]
            return
        space = text.rfind(b" ", at + 2 * max(ORDERS), end)
        end = space + 1 if space >= 0 else end
        yield text[at:end]
        back = text.rfind(b" ", at + 1, end - max(ORDERS))
        at = back if back > at and end - back < BLOCK // 2 else end - max(ORDERS)


def gram_codes(codes: np.ndarray):
    """64-bit codes of the n-grams of each order, by start."""
    wide = codes.astype(np.uint64) + np.uint64(1)
    code = np.zeros(len(wide), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        code = (code[: len(wide) - n + 1] + wide[n - 1 :]) * FACTOR
        if n in ORDERS:
            mixed = (code ^ (code >> np.uint64(29))) * MIX
            yield mixed


def bucket_of(mixed: np.ndarray) -> np.ndarray:
    return (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.uint32)


def select(mixed: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Positions of the n-grams whose bucket is in the bitmap."""
    return np.flatnonzero(bitmap[bucket_of(mixed)])


def damped(times: np.ndarray) -> np.ndarray:
    return 1 + np.log(np.minimum(times, 32))


@dataclass
class Model:
    """Kept n-grams (sorted codes), their weights, which of them counts more than once, and the bias.

    Only n-grams of the label's side count by how often they occur: however long, clean text doesn't outweigh the rest.
    """

    codes: np.ndarray
    weights: np.ndarray
    bias: float
    repeats: np.ndarray | None = None

    def __post_init__(self):
        self.bitmap = np.zeros(1 << BUCKET_BITS, bool)
        self.bitmap[bucket_of(self.codes)] = True

    def features(self, texts: list[bytes]):
        """(text number, feature number, damped count) of the kept n-grams that a text has, each once."""
        found = [np.zeros(0, np.int64)]
        for block, starts, numbers in blocks(texts):
            for mixed in gram_codes(block):
                at = select(mixed, self.bitmap)
                code = mixed[at]
                k = np.minimum(np.searchsorted(self.codes, code), max(0, len(self.codes) - 1))
                hit = self.codes[k] == code if len(self.codes) else np.zeros(len(at), bool)
                if hit.any():
                    text = numbers[np.searchsorted(starts, at[hit], side="right") - 1]
                    found.append(text * len(self.codes) + k[hit])
        pairs, times = np.unique(np.concatenate(found), return_counts=True)
        size = max(1, len(self.codes))
        k = pairs % size
        counted = damped(times) if self.repeats is None else np.where(self.repeats[k], damped(times), 1.0)
        return pairs // size, k, counted

    def score(self, texts: list[bytes]) -> np.ndarray:
        text, k, value = self.features(texts)
        total = np.bincount(text, self.weights[k] * value, minlength=len(texts)) if len(texts) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -500, 500)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, most: int) -> DataFrame:
    """(text, y) of at most ``most`` labelled rows, chosen by a hash of their key; of a repeated key one text, and 1 if
    any of its labels is. Other labels than 0 and 1 don't count."""
    chosen = (
        labels.select(key, F.col(label).cast("int").alias("y")).where("y in (0, 1)").where(F.col(key).isNotNull())
        .groupBy(key).agg(F.max("y").alias("y")).orderBy(F.xxhash64(key), key).limit(most)
    )
    texts = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    both = texts.join(F.broadcast(chosen), key)  # 16,000 keys at most
    return both.groupBy(key).agg(F.min(F.struct(F.xxhash64("t"), "t", "y")).alias("s")).select("s.t", "s.y")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", most: int = MAX_LABELLED, features: int = MAX_FEATURES) -> Model:
    """Learn from at most ``most`` labelled rows; the given ``labels`` are all that may be learnt from.

    1. Documents of each class that have a bucket of n-grams, by bucket; buckets that tell the classes apart stay.
    2. The same for the n-grams in these buckets, by their exact 64-bit codes; the strongest ``features`` stay.
    3. Logistic regression over damped counts times log-count ratio, with a penalty on the weights.
    Counting and extraction run on executors; the driver gets bounded arrays. Without both classes the model is the
    (smoothed) share of the label.
    """
    scratch = Scratch(docs.sparkSession)
    sample = scratch.table(labelled_sample(docs, labels, label, key, text, most).repartition(8))
    n_by = dict(sample.groupBy("y").count().collect())
    n1, n0 = n_by.get(1, 0), n_by.get(0, 0)
    prior = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), prior)
    if not n1 or not n0:
        return nothing
    segments = 64
    width = (1 << BUCKET_BITS) // segments

    def count_buckets(batches):
        counts = np.zeros((2, 1 << BUCKET_BITS), np.uint16)  # at most 16,000 rows
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = [np.unique(bucket_of(m)) for block, _, _ in blocks([t]) for m in gram_codes(block)]
                counts[y][np.unique(np.concatenate(own))] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(segments), pa.int32()), pa.array([counts[:, k * width : (k + 1) * width].tobytes() for k in range(segments)], pa.binary())],
            names=["segment", "counts"],
        )

    def strongest(key, frame: pd.DataFrame) -> pd.DataFrame:
        c = sum(np.frombuffer(x, np.uint16).reshape(2, width).astype(np.int64) for x in frame.counts)
        z = _strength(c[1], c[0], n1, n0)
        at = np.argsort(-z, kind="stable")[: 2 * features // segments]
        at = at[z[at] > 2]
        return pd.DataFrame({"bucket": (key[0] * width + at).astype(np.int64)})

    buckets = sample.mapInArrow(count_buckets, "segment int, counts binary").groupBy("segment").applyInPandas(strongest, "bucket long")
    bitmap = np.zeros(1 << BUCKET_BITS, bool)
    bitmap[[r.bucket for r in buckets.collect()]] = True  # 2 x MAX_FEATURES at most
    packed = np.packbits(bitmap).tobytes()

    def count_grams(batches):
        chosen = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        for batch in batches:
            codes, ys = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.unique(np.concatenate([m[select(m, chosen)] for block, _, _ in blocks([t]) for m in gram_codes(block)]))
                codes.append(own)
                ys.append(np.full(len(own), y, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(codes).view(np.int64)), pa.array(np.concatenate(ys))], names=["code", "y"])

    grams = sample.mapInArrow(count_grams, "code long, y int").groupBy("code").agg(F.sum("y").alias("c1"), F.sum(1 - F.col("y")).alias("c0"))
    z = (F.abs(F.col("c1") / n1 - F.col("c0") / n0)) / F.sqrt((F.col("c1") + F.col("c0") + 1) / (n1 * n0 / (n1 + n0)) / (n1 + n0))
    kept = grams.withColumn("z", z).where("z > 3").orderBy(F.desc("z"), "code").limit(features).collect()
    if not kept:
        return nothing
    codes = np.array([r.code for r in kept], np.int64).view(np.uint64)
    c1, c0 = np.array([r.c1 for r in kept], float), np.array([r.c0 for r in kept], float)
    ratio = np.log(((c1 + 0.5) / (n1 + 1)) / ((c0 + 0.5) / (n0 + 1)))
    order = np.argsort(codes)
    model = Model(codes[order], ratio[order], 0.0, ratio[order] > 0)

    def present(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            row, k, value = model.features(texts)
            both = np.stack([k, value], 1).astype(np.float32)
            lists = [x.tobytes() for x in np.split(both, np.searchsorted(row, np.arange(1, len(texts))))] if texts else []
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.binary()), batch.column(1)], names=["k", "y"])

    rows = sample.mapInArrow(present, "k binary, y int").collect()  # MAX_LABELLED lists
    lists = [np.frombuffer(r.k, np.float32).reshape(-1, 2) for r in rows]
    y = np.array([r.y for r in rows], float)
    model.weights, model.bias = _logistic(lists, y, model.weights, prior)
    scratch.drop(sample)
    return model


def _strength(c1, c0, n1, n0):
    """Difference of the classes' shares in standard errors."""
    shared = (c1 + c0 + 1) / (n1 + n0)
    return np.abs(c1 / n1 - c0 / n0) / np.sqrt(shared * (1 / n1 + 1 / n0))


def _logistic(lists: list[np.ndarray], y: np.ndarray, scale: np.ndarray, prior: float, penalty: float = 0.02, steps: int = 300):
    """Weights and bias over scaled counts, by accelerated gradient steps."""
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    both = np.concatenate(lists)
    col = both[:, 0].astype(np.int64)
    value = scale[col] * both[:, 1]
    n = len(y)
    w, b = np.zeros(len(scale)), prior
    norm = np.bincount(row, value * value, minlength=n)
    rate = 1 / (0.25 * (np.sort(norm)[-max(1, n // 50)] + 1) * 0.5 + penalty)
    vw, vb = w.copy(), b
    for step in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * vw[col], minlength=n) + vb, -500, 500)))
        gw = np.bincount(col, value * (p - y)[row], minlength=len(w)) / n + penalty * vw / max(1, n) ** 0.5
        gb = (p - y).mean()
        nw, nb = vw - rate * gw, vb - min(1.0, rate * 4) * gb
        keep = step / (step + 3)
        vw, vb = nw + keep * (nw - w), nb + keep * (nb - b)
        w, b = nw, nb
    return w * scale, float(b)


def score_texts(docs: DataFrame, model: Model, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text are left behind: key, score double (0 to 1), predicted int.

    Every whole text is scored, a null or empty one by the bias alone. One row for each input row, repeated ones included;
    an empty table gives an empty table; other columns may have any names. One scan.
    """

    @by_bytes(1)
    def run(batches):
        for batch in batches:
            s = model.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=[key, "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.coalesce(text, F.lit("")).cast("binary")).mapInArrow(run, f"`{key}` {kind}, score double, predicted int")
