"""Models that the engine is given: embedders and scorers, with defaults that need no files."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import written
from .synthesis import without_thoughts
from .text import query_terms, stemmed_tokens

#: Numbers of a vector, texts that a model gets at a time, and the two ways to embed.
DIMENSION, TOGETHER, MODES = 768, 50, ("query", "passage")


class Embedder(Protocol):
    def query_embed(self, texts: list[str]) -> Iterator[np.ndarray]: ...

    def passage_embed(self, texts: list[str]) -> Iterator[np.ndarray]: ...


class Scorer(Protocol):
    """Judges pairs of a query and a text. One with a tokenizer also has ``offsets`` (a text's tokens as characters),
    ``limit`` and ``special`` (``passages.WordTokenizer``), by which long texts are cut for it."""

    def predict(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class HashEmbedder:
    """Stems dealt to dimensions by a hash: equal texts, equal vectors; no model, no files."""

    def __init__(self, dimension: int = DIMENSION):
        self.dimension = dimension

    def _vector(self, text: str) -> np.ndarray:
        out = np.zeros(self.dimension)
        for word in stemmed_tokens(text):
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            out[h % self.dimension] += 1 if h >> 63 else -1
        return out / (np.linalg.norm(out) or 1.0)

    def query_embed(self, texts):
        return map(self._vector, texts)

    passage_embed = query_embed


class OverlapScorer:
    """Scores a pair by the share of the query's stems that the passage has, as a logit."""

    def predict(self, pairs):
        out = []
        for query, passage in pairs:
            words = set(stemmed_tokens(query))
            share = len(words & set(stemmed_tokens(passage))) / max(len(words), 1)
            out.append(8 * share - 3)
        return out


def vectors_of(model: Embedder, texts: list[str], mode: str, dimension: int = DIMENSION) -> list[list[float] | None]:
    """Vectors of texts, None where the model gives none of the right size and with finite numbers.

    The texts go to the model together; only where that fails is each asked for alone.
    """
    ask = model.passage_embed if mode == "passage" else model.query_embed
    try:
        made = np.array([np.asarray(v, float) for v in ask(texts)])
    except Exception:  # whatever a model raises: the texts are tried one by one
        made = np.zeros(0)
    if made.shape == (len(texts), dimension) and np.isfinite(made).all():
        return made.tolist()
    return [None] if len(texts) == 1 else [vector for t in texts for vector in vectors_of(model, [t], mode, dimension)]


def embedded(make: Callable[[], Embedder], text: Column, mode: str = "passage", dimension: int = DIMENSION, together: int = TOGETHER) -> Column:
    """Vectors of texts; null for blank texts and where the model fails. ``make`` runs once in each Python worker, and the
    model gets ``together`` texts at a time."""
    if mode not in MODES:
        raise ValueError(f"no mode {mode!r}")

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            out = pd.Series([None] * len(texts), dtype=object)
            asked = np.flatnonzero(texts.fillna("").str.strip() != "")
            for at in range(0, len(asked), together):
                some = asked[at : at + together]
                for k, vector in zip(some, vectors_of(model, texts.iloc[some].str.strip().tolist() if mode == "query" else texts.iloc[some].tolist(), mode, dimension)):
                    out.iat[k] = vector
            yield out

    return run(text)


def embed_text(title: Column, summary: Column, content: Column, tags: Column) -> Column:
    """What of an entry is embedded: its title, summary, opening and tags, each on a line, empty ones left out."""
    line = lambda name, c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(name), c))
    return F.concat_ws("\n", line("Title: ", title), line("Summary: ", summary), line("", F.substring(content, 1, 8000)), line("Tags: ", tags))


def embed_entries(entries: DataFrame, make: Callable[[], Embedder], dimension: int = DIMENSION) -> tuple[DataFrame, DataFrame]:
    """Vectors (corpus, id, x) of entries that have a text, and the entries (corpus, id) whose embedding failed.

    The model runs once: both are read from a written table.
    """
    text = embed_text(F.col("title"), F.col("summary"), F.col("content"), F.col("tags"))
    asked = entries.select("corpus", "id", text.alias("text")).where(F.trim("text") != "")
    made = written(asked.select("corpus", "id", embedded(make, F.col("text"), "passage", dimension).alias("x")), "vectors")
    return made.where("x is not null"), made.where("x is null").select("corpus", "id")


def with_model_relevance(rows: DataFrame, make: Callable[[], Scorer], query: str, passage: str) -> DataFrame:
    """Adds relevance: a scorer's logits of queries and passages through the logistic curve, rounded to four digits; a
    number missing or not finite is an error."""

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for q, p in batches:
            logits = np.asarray(model.predict(list(zip(q.fillna(""), p.fillna("")))) if len(q) else [], float)
            if logits.shape != (len(q),) or not np.isfinite(logits).all():
                raise ValueError("the scorer gave no number for each pair")
            yield pd.Series(np.round(np.exp(-np.logaddexp(0, -logits)), 4))

    return rows.withColumn("relevance", run(query, passage))


class KeywordRewriter:
    """Another wording of a query: its terms, without words that say nothing."""

    def rewrite(self, query: str) -> str:
        return " ".join(query_terms(query))


def rewritten(make: Callable, query: Column) -> Column:
    """Queries as a rewriter words them, without what a model thought aloud; null where it gives nothing."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for q in batches:
            yield q.map(lambda t: without_thoughts(model.rewrite(t) or "").strip() or None if t else None)

    return run(query)
