"""Phrase collocations: frequent phrases of a few words and how well they hold together at their weakest cut."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, by_bytes, partitions

#: A-Z lower-cased; marks and line ends that end a piece become line feeds, tabs become spaces.
ENDS = b".,;:!?" + bytes(range(0x0A, 0x0E))
TABLE = bytes(0x0A if c in ENDS else 0x20 if c == 0x09 else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: Odd numbers, by which hashes are mixed.
ODD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes of text that are hashed at a time.
BLOCK = 4 << 20
#: Bytes from which a word's hash is that of the whole word at once.
LONG = 64
#: Words in an automaton, and distinct words counted, before a task sends what it has.
SHARD_WORDS, COUNTED = 200_000, 200_000


# --- A suffix automaton over words ----------------------------------------------------------------------------------


class SuffixAutomaton:
    """Of runs of words, each with a number of times: states are sets of places (endpos), ``count`` is their size.

    A state stands for the suffixes of its longest phrase down to one word more than its suffix link has.
    """

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.count, self.end = [-1], [0], [0], [0]
        self.words: list[bytes] = []

    def _state(self, moves: dict, link: int, length: int, end: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        self.end.append(end)
        return len(self.link) - 1

    def add(self, run: list[bytes], times: int) -> None:
        """A run of words that occurs ``times`` times."""
        moves, link, length, last = self.next, self.link, self.length, 0
        for word in run:
            self.words.append(word)
            end, p = len(self.words), last
            q = moves[p].get(word, -1)
            if q >= 0:  # another run has been here
                last = q if length[q] == length[p] + 1 else self._split(p, q, word)
            else:
                last = self._state({}, 0, length[p] + 1, end)
                while p >= 0 and word not in moves[p]:
                    moves[p][word] = last
                    p = link[p]
                if p >= 0:
                    q = moves[p][word]
                    link[last] = q if length[q] == length[p] + 1 else self._split(p, q, word)
            self.count[last] += times

    def _split(self, p: int, q: int, word: bytes) -> int:
        """A state of its own for the shorter phrases of ``q``, which also occur elsewhere."""
        new = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1, self.end[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = new
            p = self.link[p]
        return new

    def phrases(self, most: int):
        """(phrase, count) of all phrases of 2 to ``most`` words: places are added up along the suffix links."""
        count, link, length = self.count, self.link, self.length
        for s in np.argsort(-np.asarray(length), kind="stable").tolist()[:-1]:
            count[link[s]] += count[s]
        for s in range(1, len(link)):
            end = self.end[s]
            for n in range(max(2, length[link[s]] + 1), min(most, length[s]) + 1):
                yield b" ".join(self.words[end - n : end]), count[s]


# --- Texts as hashed words ------------------------------------------------------------------------------------------


def blocks(texts: list[bytes]):
    """The texts' pieces, lower-cased and ended by line feeds, in blocks of about BLOCK bytes; a longer piece is whole."""
    joined = b"\n".join(texts).translate(TABLE)
    at = 0
    while at < len(joined):
        cut = len(joined) if at + BLOCK >= len(joined) else joined.rfind(b"\n", at, at + BLOCK) + 1
        if cut <= at:
            cut = joined.find(b"\n", at + BLOCK) + 1 or len(joined)
        yield joined[at:cut]
        at = cut


class Pairs:
    """Words of a block and buckets of the pairs of neighbours in one piece.

    ``start`` and ``end``: bytes of each word; ``joined``: whether the next word is of the same piece; ``bucket``: of a
    word with its next one, by their hashes.
    """

    def __init__(self, block: bytes, lang: str, bits: int):
        codes = np.frombuffer(block, np.uint8)
        inside = (codes != 0x20) & (codes != 0x0A)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        self.start, self.end = edges[::2], edges[1::2]
        pieces = np.cumsum(codes == 0x0A)
        piece = pieces[self.start] if len(self.start) else pieces[:0]
        self.joined = piece[1:] == piece[:-1]
        hashes = self._hashes(codes)
        seed = np.uint64(int.from_bytes(lang.encode()[:8].ljust(8), "little"))
        mixed = (hashes[:-1] * ODD + seed) ^ (hashes[1:] * MIX)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * ODD
        self.bucket = (mixed >> np.uint64(64 - bits)).astype(np.int64)

    def _hashes(self, codes: np.ndarray) -> np.ndarray:
        """Polynomials of the words' bytes, a byte of each word at a time."""
        out, length = np.zeros(len(self.start), np.uint64), self.end - self.start
        order = np.argsort(-length, kind="stable")
        start, length = self.start[order], length[order]
        some = np.zeros(len(order), np.uint64)
        for k in range(min(int(length[0]), LONG) if len(length) else 0):
            n = int(np.searchsorted(-length, -k, side="left"))  # words longer than k
            some[:n] = (some[:n] + codes[start[:n] + k] + np.uint64(1)) * MIX
        for k in range(int(np.searchsorted(-length, -LONG, side="left"))):
            some[k] = zlib.crc32(codes[start[k] : start[k] + length[k]])
        out[order] = some ^ (some >> np.uint64(32))
        return out

    def runs(self, block: bytes, frequent: np.ndarray) -> list[bytes]:
        """Stretches of words of which all neighbours are pairs that may be frequent."""
        kept = self.joined & ((frequent[self.bucket >> 3] >> (self.bucket & 7).astype(np.uint8)) & 1).astype(bool)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], kept, [False]]).view(np.int8)))
        return [block[a:b] for a, b in zip(self.start[edges[::2]].tolist(), self.end[edges[1::2]].tolist())]


def _by_language(batch: pa.RecordBatch) -> dict[str, list[bytes]]:
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        texts.setdefault(lang, []).append(text)
    return texts


# --- Jobs -----------------------------------------------------------------------------------------------------------


def frequent_pairs(texts: DataFrame, least: int, bits: int) -> Broadcast:
    """A bit for each bucket of word pairs that has ``least`` pairs or more in all texts (lang, text): 2**(bits - 3) bytes,
    whatever the input. A pair with a bit of 0 is rare; a pair with a bit of 1 may be.

    Tasks count their pairs by bucket and send the counts in ranges of buckets; a range is added up as a stream, so its
    memory is its buckets'.
    """
    spark = texts.sparkSession
    wide, enough = 16, min(least, 0xFFFF)  # buckets of a range: 2**wide; a count needs to go no further

    @by_bytes(1)
    def run(batches):
        bucket, count, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def merged():
            both = np.concatenate([bucket, *(b for b, _ in waiting)])
            order = np.argsort(both, kind="stable")
            both, counts = both[order], np.concatenate([count, *(c for _, c in waiting)])[order]
            first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
            return both[first], np.minimum(np.add.reduceat(counts, first), enough) if len(first) else counts

        def sent():
            for part in np.split(np.arange(len(bucket)), np.flatnonzero(np.diff(bucket >> wide)) + 1):
                if len(part):
                    at = int(bucket[part[0]] >> wide)
                    yield at, (bucket[part] & ((1 << wide) - 1)).astype("<u2").tobytes(), count[part].astype("<u2").tobytes()

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["at", "buckets", "counts"])

        for batch in batches:
            for lang, some in _by_language(batch).items():
                for block in blocks(some):
                    p = Pairs(block, lang, bits)
                    waiting.append(np.unique(p.bucket[p.joined], return_counts=True))
            if sum(len(b) for b, _ in waiting) > 2_000_000:
                bucket, count = merged()
                waiting = []
                if len(bucket) > 4_000_000:
                    yield batch_of(sent())
                    bucket, count = bucket[:0], count[:0]
        bucket, count = merged()
        if len(bucket):
            yield batch_of(sent())

    def total(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << wide, np.int64)
        for batch in batches:
            for b, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                counts[np.frombuffer(b, "<u2")] += np.frombuffer(c, "<u2")
        frequent = np.packbits(counts >= enough, bitorder="little").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([frequent])], names=["at", "bits"])

    found = texts.mapInArrow(run, "at int, buckets binary, counts binary").groupBy("at").applyInArrow(total, "at int, bits binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in found.collect():  # of all ranges 2**(bits - 3) bytes
        at = row.at << (wide - 3)
        out[at : at + (1 << (wide - 3))] = np.frombuffer(row.bits, np.uint8)
    return spark.sparkContext.broadcast(out)


def phrase_counts(texts: DataFrame, most: int, frequent: Broadcast, bits: int) -> DataFrame:
    """lang, phrase, f of all words, and of the phrases of 2 to ``most`` words without a rare pair, of all texts (lang, text)."""

    @by_bytes(1)
    def run(batches):
        words: dict[str, Counter] = {}
        runs: dict[str, Counter] = {}

        def rows(lang, found):
            if found:
                phrases, counts = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=["lang", "phrase", "f"])

        def shards(lang):
            automaton = SuffixAutomaton()
            for run_, times in runs.pop(lang).items():
                automaton.add(run_.split(), times)
                if len(automaton.words) >= SHARD_WORDS:
                    yield from rows(lang, list(automaton.phrases(most)))
                    automaton = SuffixAutomaton()
            yield from rows(lang, list(automaton.phrases(most)))

        for batch in batches:
            for lang, some in _by_language(batch).items():
                counted, kept = words.setdefault(lang, Counter()), runs.setdefault(lang, Counter())
                for block in blocks(some):
                    counted.update(block.split())
                    kept.update(Pairs(block, lang, bits).runs(block, frequent.value))
                if len(counted) > COUNTED:
                    yield from rows(lang, list(words.pop(lang).items()))
                if sum(map(len, kept)) > 8 * SHARD_WORDS:
                    yield from shards(lang)
        for lang in list(words):
            yield from rows(lang, list(words.pop(lang).items()))
        for lang in list(runs):
            yield from shards(lang)

    parts = texts.mapInArrow(run, "lang string, phrase string, f long")
    return parts.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def collocations(docs: DataFrame, most: int = 4, least: int = 30, top: int = 2000, share: int = 80, scale: int = 2_000_000, bits: int = 26, text: str = "text", lang: str = "lang") -> DataFrame:
    """The ``top`` phrases of each language, of 2 to ``most`` words and ``least`` occurrences, by their weakest cut.

    Texts, A-Z lower-cased, are split at marks and line ends into pieces and those at spaces and tabs into words; a phrase
    lies within a piece. Cutting a phrase with a occurrences in two parts with l and r gives the score
    floor(scale * a / (l + r)); the cut with the lowest counts, of equal ones the first. A phrase is dropped if one that
    contains it and is longer, dropped or not, has ``share`` percent of its occurrences or more. Returns lang, rank (from
    1, by score, occurrences, both descending, then the phrase by its bytes), phrase, a, l, r, n (words of the language)
    and score. Counts are exact over whole texts, products in 38 digits.

    Null text counts as empty, a null language is ``und``; repeated rows count each time; an empty table, or one without
    frequent phrases, gives an empty table; of other columns, whatever their names, nothing is read.

    A first scan finds pairs of neighbours that are rare, by counts of 2**``bits`` buckets; a frequent phrase has no rare
    pair, so a second scan leaves them out. What is left goes through a suffix automaton in each task (bounded words each),
    whose phrases are counted and added up. An extension by one word is enough to look at for dropping: it contains the
    shorter phrase, lies in the longer one, and is at least as frequent as that. These are the phrases' suffix links, and
    the same from the other end. Memory of a task grows with the longest piece only.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).cast("binary").alias("text"))
    frequent = frequent_pairs(texts, least, bits)
    counts = phrase_counts(texts, most, frequent, bits)
    counts = scratch.table(counts.where((F.col("f") >= least) | ~F.contains("phrase", F.lit(" "))))
    frequent.unpersist()
    total = counts.where(~F.contains("phrase", F.lit(" "))).groupBy("lang").agg(F.sum("f").alias("n"))
    known = counts.where(F.col("f") >= least)
    found = known.where(F.contains("phrase", F.lit(" "))).withColumn("w", F.split("phrase", " "))
    # phrases that are longer by one word, at either end
    longer = found.where("size(w) > 2").select("lang", F.col("f").alias("longer"), F.explode(F.expr("array(array_join(slice(w, 2, size(w) - 1), ' '), array_join(slice(w, 1, size(w) - 1), ' '))")).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    kept = found.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide("longer") * 100 < wide("f") * share))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("first"), F.expr("array_join(slice(w, k + 1, size(w) - k), ' ')").alias("rest"))
    side = lambda name, f: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    score = F.expr(f"cast((cast(a as decimal(20,0)) * {scale}) div (cast(l as decimal(20,0)) + r) as long)")
    weakest = cuts.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    rows = weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = rows.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
