"""Collocations against brute force; the automaton against counts of windows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillon.llm import phrases
from quillon.llm.phrases import Pairs, SuffixAutomaton, blocks, collocations


def pieces(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def brute(rows, least=30, top=2000, most=4):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            cuts = [(2000000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def run(docs, **options):
    return sorted(tuple(r) for r in collocations(docs, bits=20, **options).collect())


@pytest.fixture
def texts(words):
    rng = random.Random(8)
    out = []
    for k in range(150):
        t = words(60, vocabulary=12, seed=k).replace("w1 ", "New\tYork ").replace("w2 ", "A, ").replace("w3 ", "Ünï. \r\n")
        out.append(t + rng.choice(["", " rot-weiss  essen!", "  of THE  of the of the", "\x1cx \x85y\x0bz"]))
    return out


@pytest.mark.parametrize("least, top", [(30, 2000), (30, 7), (2, 50), (500, 10)])
def test_collocations(spark, texts, least, top):
    rows = [(k, t) for k, t in enumerate(texts)]
    langs = [("de" if k % 3 == 0 else None if k % 3 == 1 else "und") for k, _ in rows]
    docs = spark.createDataFrame([(k, t, lang, "f", "phrase") for (k, t), lang in zip(rows, langs)], "doc_id long, text string, lang string, f string, phrase string").repartition(3)
    got = run(docs, least=least, top=top)
    assert got == brute(zip(langs, texts), least, top) and (got or least == 500)


def test_small_shards_and_blocks_give_the_same(spark, texts, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_WORDS", 50)
    for size in (1, 100):
        monkeypatch.setattr(phrases, "BLOCK", size)
        joined = b"\n".join(t.encode() for t in texts).translate(phrases.TABLE)
        assert b"".join(blocks([t.encode() for t in texts])) == joined


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", None), (3, " ,.; \n", ""), (4, "one two", "en"), (4, "one two", "en"), (None, "one two three" * 3, "en"), (5, "x" * 70_000 + " y", "en"), (6, "x" * 70_000 + " y", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert run(docs, least=2) == brute([(lang, t) for _, t, lang in rows], 2)
    assert run(docs.limit(0)) == [] and run(docs) == []


def test_products_beyond_64_bits(spark, monkeypatch):
    """Counts near 2**61: products with 2000000 and 100 need more than 64 bits."""
    big = 1 << 61
    rows = [("en", "a", big), ("en", "b", big), ("en", "a b", big - 1), ("en", "c", big), ("en", "b c", big - 5), ("en", "a b c", big - big // 4)]
    monkeypatch.setattr(phrases, "phrase_counts", lambda texts, *_: spark.createDataFrame(rows, "lang string, phrase string, f long"))
    docs = spark.createDataFrame([("x", "en")], "text string, lang string")
    got = [(r.phrase, r.a, r.l, r.r, r.score) for r in collocations(docs.limit(1), bits=20).orderBy("rank").collect()]
    left = [("a b", big - 1, big, big), ("b c", big - 5, big, big)]
    whole = big - big // 4
    assert [g[:4] for g in got if g[0] != "a b c"] == left
    scores = {g[0]: g[4] for g in got}
    assert scores["a b"] == 2000000 * (big - 1) // (2 * big) and scores["a b c"] == min(2000000 * whole // (big + big - 5), 2000000 * whole // (big - 1 + big))


@pytest.mark.parametrize("seed", range(5))
def test_automaton(seed):
    rng = random.Random(seed)
    runs = [([rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 12))], rng.randrange(1, 4)) for _ in range(30)]
    automaton, want = SuffixAutomaton(), Counter()
    for run_, times in runs:
        automaton.add(run_, times)
        for k in range(2, 5):
            for i in range(len(run_) - k + 1):
                want[b" ".join(run_[i : i + k])] += times
    got = list(automaton.phrases(4))
    assert dict(got) == want and len(got) == len(want)


def test_pairs_of_words():
    block = b"one two\nthree  four five\n" + b"l" * 100 + b" one two\n"
    p = Pairs(block, "en", 20)
    assert [block[a:b] for a, b in zip(p.start, p.end)] == block.split()
    assert p.joined.tolist() == [True, False, True, True, False, True, True]
    assert p.bucket[0] == p.bucket[-1] != p.bucket[2]
    frequent = np.zeros(1 << 17, np.uint8)
    for b in (p.bucket[0], p.bucket[2], p.bucket[3]):
        frequent[b >> 3] |= 1 << (b & 7)
    assert p.runs(block, frequent) == [b"one two", b"three  four five", b"one two"]
    empty = Pairs(b"\n\n", "en", 20)
    assert empty.runs(b"\n\n", frequent) == []
