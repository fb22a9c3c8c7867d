"""Quality: heuristic labellers, weighed by expectation-maximisation, teach a hashed linear scorer."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes


#: Bounds of the scorer: documents that it learns from, and its hashed dimensions.
MAX_SAMPLE, DIMS = 8_192, 1_024
#: Frequent short words of some languages.
FREQUENT = {w.encode() for w in (
    "a an and are as at be by der das de del des die du ein eine el en es et for from has in is ist it la las le les los "
    "mit nicht of on or para por pour que qui se sur that the this to un una und une von was with y zu"
).split()}
UPPER, LOWER, DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
SPACE = [9, 10, 11, 12, 13, 32]
#: Each labeller: the measure it reads, then bounds: votes bad below / good from / good to / bad above. NaN: it abstains.
LABELLERS = {
    "punctuation": (-1.0, 0.0, 0.06, 0.10),
    "capitals": (-1.0, 0.0, 0.20, 0.40),
    "word_length": (2.5, 3.5, 9.0, 11.0),
    "variety": (0.60, 0.80, 2.0, 2.0),
    "same_lines": (-1.0, 0.0, 0.10, 0.50),
    "top_word": (-1.0, 0.0, 0.15, 0.30),
    "frequent_words": (0.01, 0.05, 0.60, 0.80),
    "wordlike": (0.70, 0.90, 1.0, 1.1),
    "repeats": (-1.0, 0.0, 0.05, 0.20),
}


def measures(text: bytes) -> list[float]:
    """The measures that the labellers read, in their order; NaN where a text is too short for one."""
    nan = float("nan")
    n = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    if not words:
        return [nan] * len(LABELLERS)
    high = int(n[128:].sum())
    upper, lower = int(n[UPPER].sum()), int(n[LOWER].sum())
    letters = upper + lower + high
    marks = len(text) - letters - int(n[DIGIT].sum()) - int(n[SPACE].sum())
    count = Counter(words)
    lines = [x for x in text.split(b"\n") if x]
    many = len(words) >= 10
    letterless = sum(k for w, k in count.items() if not (w.isalpha() or any(c >= 65 and c not in b"[\\]^_`{|}~" for c in w)))
    return [
        marks / len(text),
        upper / letters if letters >= 20 else nan,
        (len(text) - int(n[SPACE].sum())) / len(words) if many else nan,
        float(np.log(len(count)) / np.log(len(words))) if len(words) >= 20 else nan,
        1 - len(set(lines)) / len(lines) if len(lines) >= 3 else nan,
        max(count.values()) / len(words) if many else nan,
        sum(k for w, k in count.items() if w.lower().strip(b".,;:!?") in FREQUENT) / len(words) if len(words) >= 20 else nan,
        1 - letterless / len(words) if many else nan,
        sum(map(bytes.__eq__, words, words[1:])) / (len(words) - 1) if many else nan,
    ]


def votes(m: np.ndarray) -> np.ndarray:
    """Of each text and labeller: 0 abstains, 1 bad, 2 good."""
    low_bad, low_good, high_good, high_bad = np.array(list(LABELLERS.values())).T
    with np.errstate(invalid="ignore"):
        good = (m >= low_good) & (m <= high_good)
        bad = (m < low_bad) | (m > high_bad)
    return np.where(bad, 1, np.where(good, 2, 0))


def pattern(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def label_model(patterns: np.ndarray, counts: np.ndarray, steps: int = 60):
    """P(good | pattern) for patterns of votes with their numbers of documents, by expectation-maximisation.

    Every labeller has its own chances to vote good on good and on bad documents; given the class, labellers are
    independent, and a labeller that abstains says nothing. It starts from the votes: two bad ones, or a quarter.
    """
    n = len(LABELLERS)
    v = patterns[:, None] // 3 ** np.arange(n) % 3
    bad, cast = (v == 1).sum(1), (v > 0).sum(1)
    post = np.where((bad >= 2) | (bad * 4 >= np.maximum(cast, 1)), 0.1, 0.9)
    total = counts.sum()
    for _ in range(steps):
        share = np.clip((post * counts).sum() / max(1, total), 0.02, 0.98)
        logs = np.zeros((len(v), 2))
        for c, weight in ((0, (1 - post) * counts), (1, post * counts)):
            chance = np.stack([((v == k) * weight[:, None]).sum(0) + 1 for k in (1, 2)])
            says = np.concatenate([np.zeros((1, n)), np.log(chance / chance.sum(0))])
            logs[:, c] = says[v, np.arange(n)].sum(1) + np.log(share if c else 1 - share)
        post = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
    return post


def hashed(text: bytes, m: list[float]) -> np.ndarray:
    """Hashed features: shares of byte trigrams, and the measures cut into steps."""
    out = np.zeros(DIMS, np.float32)
    codes = np.frombuffer(text, np.uint8).astype(np.uint32)
    for at in range(0, max(0, len(codes) - 2), 1 << 20):  # whole texts, in blocks of bounded memory
        c = codes[at : at + (1 << 20) + 2]
        tri = ((c[:-2] << 16 | c[1:-1] << 8 | c[2:]) * np.uint32(2654435761)) >> np.uint32(23)
        out[:512] += np.bincount(tri, minlength=512)
    if len(codes) > 2:
        out[:512] = np.sqrt(out[:512] / (len(codes) - 2))
    for k, x in enumerate(m):
        if x == x:
            out[512 + xxhash.xxh3_64_intdigest(f"{k}:{min(40, int(x * 20)) if k != 2 else min(20, int(x))}") % 512] += 1
    return out


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = np.array([hashed(t, measures(t)) @ self.weights for t in texts], float) + self.bias
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MAX_SAMPLE) -> Scorer:
    """Label model over the votes on all documents, then a scorer from at most ``most`` of them (chosen by a hash of the key).

    The driver gets the numbers of documents by pattern of votes (3^9 at most) and the sample's hashed features. Of a
    repeated key one text is learnt from; rows of a null key only vote; without rows the score is 0.5 everywhere.
    """
    texts = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))

    @by_bytes(1)
    def vote(batches):
        for batch in batches:
            ts = batch.column(1).to_pylist()
            p = pattern(votes(np.array([measures(t) for t in ts]).reshape(-1, len(LABELLERS))))
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64())], names=["pattern"])

    seen = texts.mapInArrow(vote, "pattern long").groupBy("pattern").count().orderBy("pattern").collect()
    if not seen:
        return Scorer(np.zeros(DIMS), 0.0)
    codes, counts = np.array([r["pattern"] for r in seen]), np.array([r["count"] for r in seen], float)
    good = dict(zip(codes.tolist(), label_model(codes, counts).tolist()))

    @by_bytes(1)
    def features(batches):
        for batch in batches:
            ts = batch.column(1).to_pylist()
            ms = [measures(t) for t in ts]
            p = pattern(votes(np.array(ms).reshape(-1, len(LABELLERS))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([hashed(t, m).astype(np.float16).tobytes() for t, m in zip(ts, ms)], pa.binary()), pa.array([good[int(x)] for x in p], pa.float64())],
                names=["x", "good"],
            )

    chosen = docs.select(key).distinct().orderBy(F.xxhash64(key), key).limit(most)
    one = texts.join(F.broadcast(chosen), key).groupBy(key).agg(F.min(F.struct(F.xxhash64("t"), "t")).alias("s"))  # of a repeated key one text
    sample = one.select(key, "s.t").mapInArrow(features, "x binary, good double").collect()
    if not sample:
        return Scorer(np.zeros(DIMS), 0.0)
    x = np.stack([np.frombuffer(r.x, np.float16) for r in sample]).astype(np.float32)
    y = np.array([r.good for r in sample], np.float32)
    w, b = np.zeros(DIMS, np.float32), 0.0
    vw, vb = w, b
    rate, penalty = 0.15, 1e-4
    for step in range(400):
        p = 1 / (1 + np.exp(-np.clip(x @ vw + vb, -60, 60)))
        nw, nb = vw - rate * ((p - y) @ x / len(y) + penalty * vw), vb - rate * float((p - y).mean())
        keep = step / (step + 3)
        vw, vb = nw + keep * (nw - w), nb + keep * (nb - b)
        w, b = nw, nb
    return Scorer(w.astype(float), float(b))


def score_quality(docs: DataFrame, scorer: Scorer, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score double (0 to 1, higher: better), kept boolean (score >= ``threshold``) of each row.

    Null text counts as empty; such texts get no vote and the score of the bias and the empty measures. One row for each
    input row, repeated ones included; an empty table gives an empty table; of other columns, whatever their names,
    nothing is read. One scan.
    """

    @by_bytes(1)
    def run(batches):
        for batch in batches:
            s = scorer.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array(s >= threshold)], names=[key, "score", "kept"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.coalesce(text, F.lit("")).cast("binary")).mapInArrow(run, f"`{key}` {kind}, score double, kept boolean")


def keep_rows(docs: DataFrame, score, threshold: float, text: str = "text", below: bool = False) -> DataFrame:
    """The rows of ``docs``, all columns of any names, whose whole text scores at least ``threshold`` (``below``: less than it).

    Null text counts as empty and stays null; repeated rows are judged alike; an empty table gives an empty table.
    """
    at = docs.columns.index(text)

    @by_bytes(at)
    def run(batches):
        for batch in batches:
            s = score([(t or "").encode() for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array((s < threshold) if below else (s >= threshold), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
