"""What of a long text a scorer gets to see: the window, by the scorer's own tokens, that says most about the query."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import fold, query_terms

WINDOW = T.StructType([T.StructField("text", T.StringType()), T.StructField("hits", T.ArrayType(T.StringType())), T.StructField("centrality", T.DoubleType())])


class WordTokenizer:
    """Words as tokens: what a scorer has that names no tokenizer of its own. ``limit``: tokens of a pair, ``special`` of
    them markers."""

    limit, special = 128, 3

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """Beginning and end of each token, in characters."""
        return [m.span() for m in re.finditer(r"\S+", text)]


def tokenizer_of(model) -> WordTokenizer:
    return model if hasattr(model, "offsets") else WordTokenizer()


def room_for(tokens: WordTokenizer, query: str) -> int:
    """Tokens that are left for a text beside its query, which takes half of the pair at most."""
    both = tokens.limit - tokens.special
    room = both - min(len(tokens.offsets(query)), -(-both // 2))
    if room < 1:
        raise ValueError("the scorer has no room for a text")
    return room


def spans(tokens: WordTokenizer, content: str, room: int) -> list[str]:
    """Windows of ``room`` tokens, each half a window on; a window whose tokens are more when it stands alone is cut
    shorter. One window, the text itself, if that fits."""
    places = tokens.offsets(content)
    if len(places) <= room:
        return [content]
    out = []
    for first in range(0, len(places), max(1, room // 2)):
        last = min(first + room, len(places)) - 1
        cut = lambda: content[places[first][0] : places[last][1]]
        while last > first and len(tokens.offsets(cut())) > room:
            last -= 1
        out.append(cut())
    return out


def centrality(window: str, terms: list[str]) -> float:
    """How near to the middle the terms stand, each at its best place: 1 in the middle, 0 at the ends."""
    text = fold(window)
    middle = max(1, len(text)) / 2
    best = 0.0
    for term in terms:
        places = (m.start() + len(term) / 2 for m in re.finditer(r"\b" + re.escape(term), text))
        best += max((1 - abs(place - middle) / middle for place in places), default=0.0)
    return best


def _described(tokens: WordTokenizer, query: str, content: str) -> list[dict]:
    windows = spans(tokens, content, room_for(tokens, query))
    if len(windows) == 1:
        return [{"text": windows[0], "hits": [], "centrality": 0.0}]
    terms, out = sorted(query_terms(query)), []
    for window in windows:
        words = query_terms(window)
        hits = [t for t in terms if any(w.startswith(t) for w in words)]
        out.append({"text": window, "hits": hits, "centrality": centrality(window, hits)})
    return out


def passage_windows(make: Callable, query: Column, content: Column) -> Column:
    """The windows of a text with the query's terms that they have. ``make`` makes the scorer, once in a Python worker."""

    @F.pandas_udf(T.ArrayType(WINDOW))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        tokens = tokenizer_of(make())
        for queries, contents in batches:
            yield pd.Series([_described(tokens, q, c) for q, c in zip(queries.fillna(""), contents.fillna(""))], dtype=object)

    return run(query, content)


def best_passage(windows: Column) -> Column:
    """The text of the window that covers the query best: a term counts ln(1 + windows / (1 + windows that have it)); of
    equal windows the one with more central terms (to nine decimals: their sum depends on the order of the terms), then the first. Without any term that is the beginning."""
    n = F.size(windows)
    having = lambda term: F.size(F.filter(windows, lambda w: F.array_contains(w["hits"], term)))
    worth = lambda w: F.array_sort(F.transform(w["hits"], lambda t: F.log(1 + n / (1 + having(t)))))
    cover = lambda w: F.aggregate(worth(w), F.lit(0.0), lambda s, x: s + x)
    ranked = F.transform(windows, lambda w, k: F.struct(cover(w).alias("cover"), F.round(w["centrality"], 9).alias("centrality"), (-k).alias("at")))
    return F.get(windows, (-F.array_max(ranked)["at"]).cast("int"))["text"]


def with_passage(rows: DataFrame, make: Callable, query: str, content: str, name: str = "passage") -> DataFrame:
    """Adds the part of a text that a scorer should see with a query; all of it if it fits. The windows are a column of
    their own, because a function over arrays can't have a Python function in it."""
    described = rows.withColumn("_windows", passage_windows(make, F.col(query), F.col(content)))
    return described.withColumn(name, best_passage(F.col("_windows"))).drop("_windows")
