import hashlib
import random
from collections import Counter

import numpy as np

from quillon.llm import suffixes
from quillon.llm.common import Scratch


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[p : p + length] for t in data for p in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng, n=120):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(rng.randint(80, 160)) for _ in range(4)]
    texts = [None, "", "a" * 399, "a" * 400, "a" * 401, "b" * 2000, "line of words. " * 90, text(200)]
    for _ in range(n):
        parts = [text(rng.randint(0, 150))]
        if rng.random() < 0.5:
            p = rng.choice(passages)
            lo = rng.choice([0, 0, rng.randint(0, 60)])
            parts += [p[lo : lo + rng.randint(380, 800)], text(rng.randint(0, 100))]
        if rng.random() < 0.1:
            parts.append(rng.choice(passages))
        texts.append(" ".join(parts))
    return texts + texts[-5:]


def test_against_brute_force(make_docs):
    for seed in (1, 2):
        texts = corpus(random.Random(seed))
        got = {r.doc_id: r for r in suffixes.removed_spans(make_docs(texts, "runs")).collect()}
        assert [tuple(got[i])[1:5] for i in range(len(texts))] == brute(texts, 400)
        for r in got.values():  # the text left has whole characters only
            assert len(r.kept_text.encode()) <= r.n_bytes - r.n_removed <= len(r.kept_text.encode()) + 2 * r.n_spans


def test_buckets_of_the_sort(spark):
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.choice([70, 80, 80]))) for _ in range(300)] + [b"same" * 20] * 50
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "uid long, suffix binary")
    spark.conf.set("spark.sql.shuffle.partitions", "23")  # several buckets, some of one row
    got = {r.uid: r.reach for r in suffixes.longest_matches(Scratch(spark), rows, 80).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert got == {k: max(common(t, u) for j, u in enumerate(texts) if j != k) for k, t in enumerate(texts)}


def test_short_runs_and_clashing_names(make_docs):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    long_run = " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(60))
    few_words = " ".join("".join(rng.choice("abcdef") for _ in range(20)) for _ in range(15))
    texts = [f"one {long_run}", f"{long_run} two", f"three {few_words}", f"{few_words} four", None, "", "x" * 300]
    docs = make_docs(texts)
    for name in ("_r1", "_runs", "runs", "r1", "c0"):
        docs = docs.withColumn(name, F.lit(name))
    got = suffixes.cut_repeats(docs, length=200, least_words=51)
    assert got.columns == docs.columns and got.schema == docs.schema
    rows = {r.doc_id: r for r in got.collect()}
    # "x" * 300 repeats itself, as one word
    assert [rows[k].text for k in range(7)] == ["one ", " two", texts[2], texts[3], None, "", texts[6]]
    assert all(r["_r1"] == "_r1" and r["runs"] == "runs" for r in rows.values())
    assert suffixes.cut_repeats(docs.limit(0), length=200).collect() == []


def test_repeated_rows_and_empty_table(make_docs):
    t = "x y z w " * 10 + "".join(chr(97 + i * i % 26) for i in range(700))
    rows = suffixes.removed_spans(make_docs([(1, t), (1, t), (None, "short"), (2, "other")])).collect()
    assert sorted(r.n_removed for r in rows) == [0, 0, len(t), len(t)]
    assert not suffixes.removed_spans(make_docs([])).collect()


def test_texts_are_cut(make_docs):
    rng = random.Random(4)
    shared = "".join(rng.choice("abc d") for _ in range(450))
    docs = make_docs(["one " + shared, shared + " two", None, "three"])
    rows = {r.doc_id: r for r in suffixes.cut_repeats(docs).collect()}
    assert [rows[i].text for i in range(4)] == ["one ", " two", None, "three"]
    assert rows[0].n_chars == 4 and rows[3].n_chars == 5


def test_long_text_in_segments():
    rng = random.Random(6)
    text = bytes(rng.randrange(97, 123) for _ in range(suffixes.SEGMENT + 5000))
    rows = suffixes.anchors(text, 400)
    assert rows[0, 1] == 0 and rows[-1, 2] == len(text) - 400
    assert (rows[1:, 1] == rows[:-1, 2] + 1).all() and (rows[1:, 0] != rows[:-1, 0]).all()


def test_multikey_sort():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 3, (3000, 6)).astype(np.uint64)
    got = words[suffixes.multikey_sort(words)]
    assert [tuple(r) for r in got] == sorted(tuple(r) for r in words)
