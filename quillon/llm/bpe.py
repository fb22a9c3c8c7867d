"""Byte-level BPE by compatibility of neighbouring tokens instead of by merging.

A token sequence is the result of the merges exactly if every two neighbours are what the merges give for those two
alone. So the encoder takes the longest match at each place, steps back to shorter ones where neighbours don't agree,
and never looks at a dead end twice: linear in the text's length. Agreement of two tokens is memoised.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

NEVER = 1 << 60


class BytePairs:
    """Encoder and decoder for a table of ranks (token bytes -> rank, ranks are merge order and ids)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: t for t, i in ranks.items()}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no token for the bytes {missing[:5]}")
        self.text = {i: t.decode("latin-1") for i, t in self.bytes.items()}
        self.ids = {s: i for i, s in self.text.items()}
        self.size = {i: len(t) for i, t in self.bytes.items()}
        self.automaton = ahocorasick.Automaton()
        for i, s in self.text.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.joins: dict[tuple[int, int], int] = {}
        for i in sorted(self.bytes):
            self.parts[i] = self._last_merge(self.bytes[i], i)
            if self.parts[i]:
                self.joins[self.parts[i]] = i
        self.shorter = {i: self._prefix(s) for i, s in self.text.items()}
        self.agreed: dict[int, bool] = {}

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for single bytes."""
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda k: self.ranks.get(parts[k] + parts[k + 1], NEVER))
            if self.ranks.get(parts[best] + parts[best + 1], NEVER) >= rank:
                return None
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None

    def _prefix(self, s: str) -> int | None:
        return next((self.ids[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in self.ids), None)

    def agree(self, left: int, right: int) -> bool:
        """Whether the merges keep these two neighbours apart.

        Go back in time along the right edge of ``left`` and the left edge of ``right``, undoing the later merge each
        time. Two edge tokens would have merged across if that came before either was used up; of equal ranks the
        leftmost merge comes first.
        """
        key = left << 32 | right
        known = self.agreed.get(key)
        if known is not None:
            return known
        x, y, x_used, y_used, apart = left, right, NEVER, NEVER, True
        while True:
            across = self.joins.get((x, y))
            if across is not None and across < x_used and across <= y_used:
                apart = False
                break
            px, py = self.parts[x], self.parts[y]
            if px and (not py or x > y):
                x_used, x = x, px[1]
            elif py:
                y_used, y = y, py[0]
            else:
                break
        if len(self.agreed) >= 700_000:  # bounded memory
            self.agreed.clear()
        self.agreed[key] = apart
        return apart

    def encode(self, piece: str) -> list[int]:
        """Ids of one piece, given as Latin-1 text of its bytes."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        agree, iter_long = self.agree, self.automaton.iter_long
        greedy = [i for _, i in iter_long(piece)]
        if all(map(agree, greedy, greedy[1:])):
            return greedy
        size, shorter, n = self.size, self.shorter, len(piece)
        out: list[int] = []
        dead: set[int] = set()
        at, token = 0, greedy[0]
        while True:
            while token is not None:
                end = at + size[token]
                if end not in dead and (not out or agree(out[-1], token)):
                    break
                token = shorter[token]
            if token is None:
                dead.add(at)
                token = out.pop()
                at -= size[token]
                token = shorter[token]
                continue
            out.append(token)
            at = end
            if at == n:
                return out
            token = next(iter_long(piece, at))[1]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes[i] for i in ids])


class Memo(dict):
    """Results by key, forgotten when there are too many or the key is long."""

    def __init__(self, make, most: int = 400_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


_loaded: dict[tuple[str, str], tuple] = {}


def codec(path: str, pattern: str):
    """(split, piece -> ids as text, ids as text -> bytes), once for each Python worker."""
    if (path, pattern) not in _loaded:
        with open(path, "rb") as lines:
            bpe = BytePairs({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})
        encode = Memo(lambda piece: " ".join(map(str, bpe.encode(piece.encode().decode("latin-1")))))
        decode = Memo(lambda ids: bpe.decode([int(i) for i in ids.split()]))
        _loaded[path, pattern] = regex.compile(pattern).findall, encode, decode
    return _loaded[path, pattern]


def encode_texts(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Encode whole texts by the ranks in ``path`` and decode them again.

    Every match of ``pattern`` is encoded separately; there are no special tokens. Null text counts as empty: no ids.
    Returns key, n_tokens long, ids_sha256 and decoded_sha256 (of the ids as decimal numbers joined by one space, and
    of the decoded bytes), and with ``ids`` the ids themselves (array<int>). One row for each input row, repeated keys
    included; one scan, no exchange.
    """

    @by_bytes(1)
    def run(batches):
        findall, encode, decode = codec(path, pattern)
        for batch in batches:
            n, shas, back, all_ids = [], [], [], []
            for t in batch.column(1).to_pylist():
                parts = [encode[p] for p in findall(t)]
                joined = " ".join(parts)
                n.append(joined.count(" ") + 1 if parts else 0)
                shas.append(hashlib.sha256(joined.encode()).hexdigest())
                back.append(hashlib.sha256(b"".join([decode[p] for p in parts])).hexdigest())
                if ids:
                    all_ids.append([int(i) for i in joined.split()])
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(back, pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                cols.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(key, F.coalesce(text, F.lit(""))).mapInArrow(run, schema + (", ids array<int>" if ids else ""))
