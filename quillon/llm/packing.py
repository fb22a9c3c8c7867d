"""Best-fit-decreasing packing with certificates from dual feasible functions."""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bpe import Memo
from .common import Scratch, by_bytes

#: Pieces in one task of a packing round; the lengths of that many are all a task holds.
TASK_PIECES = 20_000


#: ASCII punctuation but the apostrophe, with which contractions begin.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)


def _byte_letters() -> list[str]:
    """How byte-level vocabularies write bytes: visible ones as themselves, the others as letters from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [c for c in range(256) if c not in visible]
    return [chr(c if c in visible else 256 + others.index(c)) for c in range(256)]


class WordIds(Memo):
    """Ids of a word between ASCII white space, as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and never looks across it, so words are encoded once and short ones remembered. Its
    normaliser and splitter leave a lower-case word of letters whole: such a word goes to the merges directly. Capitals
    of ASCII words, and marks after a letter or digit, are taken off first. All others, and those that hold the string of
    a special token, take the tokenizer's own way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__(None, most=300_000, longest=20)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merges = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.make = self._ids

    def _ids(self, word: bytes) -> bytes:
        if any(s in word for s in self.special):
            return self._packed(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)
        core = word.rstrip(MARKS)
        if len(core) < len(word) and core[-1:].isalnum():
            return self[core] + self[word[len(core) :]]
        if word.isascii():
            lower = word.lower()
            if lower != word and not any(s in lower for s in self.special):
                return self[lower]
            if word.isalpha():
                return self._packed([t.id for t in self.merges(word.decode())])
        s = word.decode()
        if s.isalpha() and s.lower() == s and unicodedata.is_normalized("NFC", s):
            return self._packed([t.id for t in self.merges("".join([self.letters[c] for c in word]))])
        return self._packed(self.tokenizer.encode(s, add_special_tokens=False).ids)

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_ids(path: str, text: bytes) -> bytes:
    return b"".join(map(word_ids(path).__getitem__, text.split()))


def token_pieces(docs: DataFrame, path: str, room: int, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenize whole texts by a vocabulary with word ends, end each with ``end_id``, and cut those longer than ``room``.

    Ids are those of the tokenizer's plain ``encode`` without added ones; strings of special tokens get their ids. Null
    text counts as empty (one piece of one token). Returns key, piece int, start long, length long and ids_crc32 long;
    one scan, no exchange. Repeated rows give repeated pieces, an empty table an empty table; of other columns, whatever
    their names, nothing is read.
    """
    end = np.array([end_id], "<u4").tobytes()

    @by_bytes(1)
    def run(batches):
        for batch in batches:
            keys = batch.column(0)
            texts = batch.column(1).to_pylist()
            row, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(texts):
                ids = token_ids(path, text) + end
                for p, at in enumerate(range(0, len(ids), 4 * room)):
                    cut = ids[at : at + 4 * room]
                    row.append(k), piece.append(p), start.append(at // 4), length.append(len(cut) // 4), crc.append(zlib.crc32(cut))
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=[key, "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.coalesce(text, F.lit("")).cast("binary")).mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def lower_bound(sizes: np.ndarray, room: int) -> int:
    """No packing of these sizes has fewer bins: the best of the sum and two families of dual feasible functions."""
    if not len(sizes):
        return 0
    size, n = np.unique(sizes, return_counts=True)
    best = -(-int((size * n).sum()) // room)
    for small in np.unique(np.minimum(size, room - size)):  # sizes above room - small fill a bin, those below small count nothing
        if 0 < small <= room // 2:
            value = np.where(size > room - small, room, np.where(size >= small, size, 0))
            best = max(best, -(-int((value * n).sum()) // room))
    for k in range(1, 21):  # sizes rounded to multiples of 1/k, whole multiples of 1/(k+1) kept
        exact = size * (k + 1) % room == 0
        value = np.where(exact, size * k, size * (k + 1) // room * room)
        best = max(best, -(-int((value * n).sum()) // (room * k)))
    return best


def best_fit_decreasing(sizes: np.ndarray, room: int) -> np.ndarray:
    """The bin of each size; largest first, each into the fullest bin that still takes it."""
    out = np.empty(len(sizes), np.int64)
    by_rest: list[list[int]] = [[] for _ in range(room + 1)]
    have, bins = 0, 0  # have: bit r is set if a bin with r left exists
    for k in np.argsort(-sizes, kind="stable"):
        s = int(sizes[k])
        fits = have >> s
        if fits:
            rest = s + (fits & -fits).bit_length() - 1
            b = by_rest[rest].pop()
            if not by_rest[rest]:
                have &= ~(1 << rest)
        else:
            rest, b, bins = room, bins, bins + 1
        out[k] = b
        if rest > s:
            by_rest[rest - s].append(b)
            have |= 1 << (rest - s)
    return out


def pack(pieces: DataFrame, room: int, key: str = "doc_id", rounds: int = 4, task_pieces: int = TASK_PIECES) -> DataFrame:
    """Put pieces (key, piece, length from 1 to ``room``, and any further columns) into sequences of at most ``room``.

    Each round deals the open pieces to tasks of about ``task_pieces`` by a hash of key and piece, packs every task's
    share by best-fit decreasing, and bounds its bin count from below. A share that meets its bound is closed: no packing
    of it is smaller. Of the others, bins that are all but full are closed and the rest is exchanged for the next
    round, until nothing is open or the last round, which closes all. Adds sequence_id and offset (long), gapless from
    0 in each sequence; columns of the caller's of these names are replaced, all others pass. Null, zero or larger
    lengths are not allowed; an empty table gives an empty table. Equal lengths and repeated rows are dealt like any
    others; a hot key is spread by its piece numbers.
    """
    scratch = Scratch(pieces.sparkSession)
    pieces = pieces.select(*(c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")))
    given, schema = pieces.columns, StructType()
    names = [f"c{k}" for k in range(len(given))]  # the caller's names can't meet those added here
    for name, field in zip(names, pieces.schema):
        schema.add(name, field.dataType)
    schema.add("sequence_id", "long").add("offset", "long").add("open", "boolean")
    pieces = pieces.toDF(*names)
    key, piece, length = (names[given.index(c)] for c in (key, "piece", "length"))
    whole = (
        pieces.where(F.col(length) == room)
        .withColumn("sequence_id", F.monotonically_increasing_id())
        .withColumn("offset", F.lit(0).cast("long"))
    )
    todo, done = pieces.where(F.col(length) < room), []
    for turn in range(rounds):
        n = todo.count()
        if not n:
            break
        tasks = max(1, -(-n // task_pieces))
        last = turn == rounds - 1

        def run(batches, turn=turn, last=last):
            from pyspark import TaskContext

            batches = [b for b in batches if b.num_rows]
            if not batches:
                return
            t = pa.Table.from_batches(batches)
            t = t.sort_by([(c, "ascending") for c in (length, key, piece)])
            sizes = t.column(length).to_numpy()
            bins = best_fit_decreasing(sizes, room)
            fill = np.bincount(bins, sizes)
            count = len(fill)
            if last or count == lower_bound(sizes, room):
                open_bin = np.zeros(count, bool)
            else:
                open_bin = fill < room - room // 256
            order = np.argsort(bins, kind="stable")
            before = np.cumsum(sizes[order]) - sizes[order]
            offset = np.empty(len(sizes), np.int64)
            offset[order] = before - np.repeat(before[np.searchsorted(bins[order], np.arange(count))], np.bincount(bins))
            seq = ((turn + 1) << 58) | (TaskContext.get().partitionId() << 32) | bins
            for name, col in (("sequence_id", pa.array(seq)), ("offset", pa.array(offset)), ("open", pa.array(open_bin[bins]))):
                t = t.append_column(name, col)
            yield from t.to_batches(10_000)

        dealt = todo.repartition(tasks, F.xxhash64(F.lit(turn), key, piece))
        out = scratch.table(dealt.mapInArrow(run, schema), schema)
        done.append(out.where("not open").drop("open"))
        todo = out.where("open").select(*names)
    for d in done:
        whole = whole.unionByName(d)
    return whole.toDF(*given, "sequence_id", "offset")


def pack_texts(docs: DataFrame, path: str, room: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``token_pieces`` then ``pack``: one row for each piece with its place."""
    scratch = Scratch(docs.sparkSession)
    return pack(scratch.table(token_pieces(docs, path, room, key=key, text=text)), room, key)
