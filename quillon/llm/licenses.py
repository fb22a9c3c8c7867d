"""License scans: exact phrases by words, and short notices with a bounded number of edits."""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Memo
from .common import by_bytes

#: Phrases that count by exact words, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short notices that are searched with edits, and their labels.
NOTICES = {
    "all rights reserved": "reserved",
    "creative commons attribution": "cc-by",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "licensed under the apache license": "apache",
    "apache license version 2 0": "apache",
    "mozilla public license": "mpl",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "released under the mit license": "mit",
    "licensed under cc by": "cc-by",
    "this work is in the public domain": "public-domain",
}
WORD = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: A-Z lower-cased; whatever is no part of a word becomes a space.
TABLE = bytes(c if c in WORD else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z."""
    return text.translate(TABLE).split()


class NoticeSearch:
    """Finds every notice with at most ``len(notice) // per_edit`` edits.

    A notice with k edits allowed is split into k + 1 seeds; by the pigeonhole principle any match holds one of them
    unchanged. All seeds are located in one pass of an automaton; only the text about a seed is searched with edits.
    """

    def __init__(self, notices: dict[str, str], per_edit: int = 9):
        self.notices = []
        self.automaton = ahocorasick.Automaton()
        seeds: dict[str, list[tuple[int, int]]] = {}
        for number, (notice, label) in enumerate(notices.items()):
            k = len(notice) // per_edit
            cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
            for lo, hi in zip(cuts, cuts[1:]):
                seeds.setdefault(notice[lo:hi], []).append((number, lo))
            pattern = regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={k}}}")
            self.notices.append((notice, label, k, Memo(lambda part, p=pattern: _matches(p, part), most=20_000, longest=1_000)))
        for seed, uses in seeds.items():
            self.automaton.add_word(seed, (len(seed), uses))
        self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[str, int, int, int]]:
        """(label, start, end, edits) of the matches; those of one notice don't overlap, fewer edits go first.

        Every seed has a window of its own, of bounded size, so the work grows with the number of seeds; windows of the
        same letters are searched once.
        """
        windows: dict[int, set[tuple[int, int]]] = {}
        for last, (size, uses) in self.automaton.iter(text):
            for number, offset in uses:
                notice, _, k, _ = self.notices[number]
                at = last + 1 - size - offset
                windows.setdefault(number, set()).add((max(0, at - k), min(len(text), at + len(notice) + k)))
        found = []
        for number, places in windows.items():
            _, label, _, matches = self.notices[number]
            found += [(label, a, b, e) for a, b, e in _best_apart(text, sorted(places), matches)]
        return found


def _matches(pattern, part: str) -> list[tuple[int, int, int]]:
    """Best match first, then what lies left and right of it."""
    todo, out = [(0, len(part))], []
    while todo:
        lo, hi = todo.pop()
        m = pattern.search(part, lo, hi)
        if m and m.end() > m.start():
            out.append((m.start(), m.end(), sum(m.fuzzy_counts)))
            todo += [(lo, m.start()), (m.end(), hi)]
    return out


def _best_apart(text: str, windows: list[tuple[int, int]], matches) -> list[tuple[int, int, int]]:
    """Matches of the windows that don't overlap: by number of edits, then by place. What better ones leave of a window
    is searched once more."""
    taken = np.zeros(len(text), bool)
    out = []

    def take(found) -> None:
        for e, a, b in sorted(found):
            if not taken[a:b].any():
                taken[a:b] = True
                out.append((a, b, e))

    first = {(e, lo + a, lo + b) for lo, hi in windows for a, b, e in matches[text[lo:hi]]}
    take(first)
    chosen = {(e, a, b) for a, b, e in out}
    rest = set()
    for lo, hi in windows:
        if any((e, lo + a, lo + b) not in chosen for a, b, e in matches[text[lo:hi]]):
            edges = np.flatnonzero(np.diff(np.concatenate([[True], taken[lo:hi], [True]]).astype(np.int8)))
            for a, b in zip(edges[::2], edges[1::2]):
                rest |= {(e, int(lo + a + x), int(lo + a + y)) for x, y, e in matches[text[lo + a : lo + b]]}
    take(rest)
    return out


@lru_cache(maxsize=4)
def _search(notices: tuple, per_edit: int) -> NoticeSearch:
    return NoticeSearch(dict(notices), per_edit)


def scan_licenses(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, per_edit: int = 9, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Search whole texts for ``base`` phrases (exact consecutive words) and ``notices`` (bounded edits).

    Returns key, n_words, n_base (all places, overlapping ones too), first_word and last_word (smallest and largest
    start, words from 0; null without a place), base_labels and labels (distinct, sorted, comma-joined; '' if none),
    score (1 for an exact phrase or notice, less by the share of edited letters, 0 without any) and spans (label, start
    and end word, edits). Null text counts as empty: no words, no labels, score 0. One row for each input row, repeated
    ones included; an empty table gives an empty table; of other columns, whatever their names, nothing is read. Work
    grows with the text's length and its number of places. One scan, no exchange.
    """
    phrases = [(f" {p} ".encode(), label) for p, label in base.items()]
    listed = tuple(notices.items())

    @by_bytes(1)
    def run(batches):
        search = _search(listed, per_edit)
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for t in batch.column(1).to_pylist():
                words = words_of(t)
                line = b" ".join([b"", *words, b""])
                places, labels = [], set()
                for phrase, label in phrases:
                    at = line.find(phrase)
                    while at >= 0:
                        places.append(at)
                        labels.add(label)
                        at = line.find(phrase, at + 1)
                starts = np.searchsorted(np.flatnonzero(np.frombuffer(line, np.uint8) == 32), places).tolist()
                line = line.decode()
                spans = sorted(search.search(line), key=lambda s: s[1:])
                gaps = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), "<u4") == 32) if spans else np.zeros(0)
                ends = np.maximum(0, np.searchsorted(gaps, [[a + 1, b] for _, a, b, _ in spans]).reshape(-1, 2) - 1).tolist()
                best = max([1 - e / max(1, b - a) for _, a, b, e in spans], default=0.0)
                for col, value in zip(cols, (
                    len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)),
                    ",".join(sorted(labels | {s[0] for s in spans})), 1.0 if labels else best,
                    [{"label": s[0], "first": a, "last": b, "edits": s[3]} for s, (a, b) in zip(spans, ends)],
                )):
                    col.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("edits", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[key, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,edits:long>>"
    return docs.select(key, F.coalesce(text, F.lit("")).cast("binary")).mapInArrow(run, schema)
