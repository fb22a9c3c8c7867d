"""Fill-in-the-middle transformation against a plain version."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.llm.middles import BLOCK, Checkpoints, fill_in_middle, restored

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(key, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if text == "" or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = [None, "", " ", " \t\n", "a", " a ", "a b c", "é ü\r\n\x0b ü", "<P>", "x <M> y", "< P> <S", "\x1c a \x85 b", "😀 " * 40, "一 二\n三  ", "x" * 5000, "a" + " " * 3000]


def test_checkpoints_of_any_step(words):
    rng = random.Random(3)
    texts = [t for t in ODD if t] + [words(700), "".join(rng.choice(" \té\nab😀") for _ in range(5000))]
    for text in texts:
        units = UNIT.findall(text)
        for every in (1, 2, 7, 256):
            index = Checkpoints(text.encode(), every)
            assert index.n == len(units) and len(index.units) == 1 + len(units) // every
            for k in {0, len(units), *(rng.randrange(len(units) + 1) for _ in range(20))}:
                head = "".join(units[:k])
                assert index.cut(k) == (len(head.encode()), len(head))


@pytest.mark.parametrize("shift", [-2, -1, 0, 1, 2])
def test_checkpoints_at_the_ends_of_blocks(shift):
    for tail in ("", " ", "é b ", "b  "):
        text = "é" * ((BLOCK + shift) // 2 - 3) + " a" + tail + "z " * 5
        units = UNIT.findall(text)
        index = Checkpoints(text.encode(), 2)
        assert index.n == len(units)
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert index.cut(k) == (len(head.encode()), len(head))


def test_fill_in_middle(spark, make_docs, words):
    texts = ODD + [words(n) for n in range(1, 60)] + [words(40, seed=1)] * 3 + [words(60_000)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, words(30, seed=2)), (7, words(30, seed=2)), (7, words(30, seed=2))]
    made = fill_in_middle(make_docs(rows, extra="output"))
    got = made.withColumn("again", restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: repr(r)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted(((k, *plain(k, t)) for k, t in rows), key=key)
    assert sorted(((r.doc_id, r.again) for r in got), key=key) == sorted(((k, t or "") for k, t in rows), key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_empty_table_and_parameters(spark, make_docs, words):
    assert fill_in_middle(make_docs([])).collect() == []
    text = words(50)
    all_psm = fill_in_middle(make_docs([text] * 5), rate=100, spm=0, markers=("[a", "b|", "c.")).withColumn("again", restored(F.col("output"), F.col("form"), ("[a", "b|", "c."))).collect()
    assert {r.form for r in all_psm} == {"psm"} and {r.again for r in all_psm} == {text}
