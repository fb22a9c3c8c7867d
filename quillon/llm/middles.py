"""Fill-in-the-middle transformation: texts cut at two units and put in another order, with markers."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

#: White space; its bytes are no part of a longer UTF-8 sequence, so units are cut in bytes.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
#: The markers before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
BLOCK = 1 << 20


class Checkpoints:
    """A sparse index of a text's units: bytes and code points before every ``every``-th unit, and ``n``, their number.

    It is filled while the units are counted, block by block, so memory is a block and a checkpoint for every ``every``
    units. A cut is a binary search among the checkpoints and a scan of fewer than ``every`` units after one.
    """

    def __init__(self, text: bytes, every: int = 256):
        self.text, self.n = text, 0
        self.units, self.places, self.points = [0], [0], [0]
        codes, before = np.frombuffer(text, np.uint8), 0
        for at in range(0, len(codes), BLOCK):
            space = SPACE[codes[at : at + BLOCK + 1]]  # the byte after the block tells whether a word ends with it
            block = codes[at : at + BLOCK]
            ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
            if at + BLOCK >= len(codes):  # a word ends with the text, or the white space at its end is a unit
                ends = np.append(ends, len(block))
            begun = np.cumsum((block & 0xC0) != 0x80)  # code points
            chosen = np.flatnonzero((np.arange(len(ends)) + self.n + 1) % every == 0)
            self.units += (chosen + self.n + 1).tolist()
            self.places += (ends[chosen] + at).tolist()
            self.points += (begun[ends[chosen] - 1] + before).tolist()
            self.n += len(ends)
            before += int(begun[-1])

    def cut(self, unit: int) -> tuple[int, int]:
        """Bytes and code points before a unit, from 0; before unit ``n`` lies the whole text."""
        k = bisect_right(self.units, unit) - 1
        start = at = self.places[k]
        for _ in range(unit - self.units[k]):
            at = UNIT.match(self.text, at).end()
        passed = np.frombuffer(self.text, np.uint8, at - start, start) if at > start else np.zeros(0, np.uint8)
        return at, self.points[k] + int(((passed & 0xC0) != 0x80).sum())


def transformed(text: bytes, key, seed: int, rate: int, spm: int, every: int, markers: tuple[bytes, ...]) -> tuple:
    """n, form, prefix_chars, middle_chars and output of a text."""
    index = Checkpoints(text, every)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or h3 % 100 >= rate or any(m in text for m in markers):
        return index.n, "plain", None, None, text
    low, high = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
    (a, chars_a), (b, chars_b) = index.cut(low), index.cut(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = markers
    form = "spm" if h4 % 100 < spm else "psm"
    order = (s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle)
    return index.n, form, chars_a, chars_b - chars_a, b"".join(order)


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, every: int = 256, markers: tuple[str, ...] = MARKERS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut ``rate`` percent of the texts at two units into prefix, middle and suffix, and move the middle to the end.

    Units are words with the white space before them, and white space at the end. The cuts, and whether a text is changed
    and how, come from the SHA-256 of seed and key alone, so a task that runs again gives the same. Returns key, n
    (units), form (plain, psm or spm: ``spm`` percent of the changed ones), prefix_chars and middle_chars (code points;
    null if plain) and output, from which ``restored`` rebuilds the text.

    Null text counts as empty, and empty texts are plain, as are texts that hold a marker. A null key draws like an empty
    one. One row for each input row: repeated rows are transformed alike; an empty table gives an empty table; of other
    columns, whatever their names, nothing is read. One scan, no exchange; memory is the text, its output and the sparse
    index.
    """
    marks = tuple(m.encode() for m in markers)

    @by_bytes(1)
    def run(batches):
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [transformed(t, k, seed, rate, spm, every, marks) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            *cols, outputs = zip(*rows)
            arrays = [pa.array(c, kind) for c, kind in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, pa.array(outputs, pa.binary()).cast(pa.string())], names=[key, "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.coalesce(text, F.lit("")).cast("binary")).mapInArrow(run, f"`{key}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, markers: tuple[str, ...] = MARKERS) -> Column:
    """The text again. No marker can arise where parts meet, so the markers in an output are those that were put in."""
    part = F.split(output, "|".join(re.escape(m) for m in markers), -1)
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
