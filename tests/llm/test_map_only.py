import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from quillon.llm import bpe, licenses, packing, sharding

ODD = [None, "", " ", "a", "é" * 300, "x" * 60_000, "the cat's 12\t\r\n  ok\x1cz\x0b \x0cq", "same text", "same text", "Ünï ÀÉ ’s 日本語", "<|endoftext|> a"]


@pytest.fixture(scope="module")
def reference_bpe():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_merging(reference_bpe):
    findall, encode, decode = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = random.Random(1)
    for _ in range(4000):
        s = "".join(rng.choice("ab \n éthe'sin1!aaa") for _ in range(rng.randint(0, 60)))
        ids = [int(i) for p in findall(s) for i in encode[p].split()]
        assert ids == reference_bpe.encode_ordinary(s)


def test_bpe_query_over_odd_texts(make_docs, reference_bpe):
    got = {r.doc_id: r for r in bpe.encode_texts(make_docs(ODD, "ids"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    for i, t in enumerate(ODD):
        ids = reference_bpe.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert not bpe.encode_texts(make_docs([]), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()


def test_licenses_against_brute_force(make_docs):
    rng = random.Random(2)
    bits = ["cc", "by", "All", "rights", "reserved", "General", "Public", "License", "é", "7", "GNU"]
    texts = [*ODD, *(" ".join(rng.choice(bits) + rng.choice(["", ".", "-", "\n"]) for _ in range(rng.randint(1, 60))) for _ in range(300))]
    got = {r.doc_id: r for r in licenses.scan_licenses(make_docs(texts, "labels")).collect()}
    for i, t in enumerate(texts):
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        places = [(k, label) for p, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1


def test_notices_with_edits(make_docs):
    texts = ["xx relased under teh MIT license yy", "Released under the MIT License.", "released many things under a license", "all rihgts reserved"]
    rows = licenses.scan_licenses(make_docs(texts)).orderBy("doc_id").collect()
    assert [r.labels for r in rows] == ["mit", "mit", "", "reserved"]
    assert rows[1].spans[0].edits == 0 and 0 < rows[0].score < 1
    assert (rows[0].spans[0]["first"], rows[0].spans[0]["last"]) == (1, 5)


def test_hilbert_curve_is_a_path():
    side = 1 << sharding.BITS
    cells = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), -1).reshape(-1, 3)
    index = sharding.hilbert_index(cells)
    path = cells[np.argsort(index)]
    assert sorted(index) == list(range(side**3))
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("n", [0, 1, 39, 1234])
def test_shards_are_even_and_gapless(make_docs, n):
    docs = make_docs([(i % 700, f"t{i % 50}" * (i % 9)) for i in range(n)], "shards").fillna("x", ["lang"])
    got = sharding.hilbert_shards(docs.withColumn("size", docs.n_chars), 40, {"lang": "name", "size": "log", "source": "name"}, ["text", "doc_id"]).collect()
    assert len(got) == n
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(k, [])) for k in range(40)]
    assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(40))


def test_word_tokens_equal_whole_text():
    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rng = random.Random(3)
    texts = [x or "" for x in ODD] + ["".join(rng.choice("aBzé́ \n\t\x0b\x0c\x1c'sre1 Σσ!.  ́") for _ in range(60)) for _ in range(3000)]
    texts += ["W\u030a w\u030a It's, it'S,'s don't!'s a,'re \u212a ǅ ﬁ ß ẞ İ", "<|startoftext|>,x ab\u0301, A\u0301"]
    for text in texts:
        assert np.frombuffer(packing.token_ids(path, text.encode()), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_places_every_token_once(spark, make_docs, words):
    path = P.path("word_bpe_49k.json")
    texts = [*ODD, *(words(n) for n in range(0, 900, 3)), words(9000)]
    got = packing.pack_texts(make_docs(texts, "length"), path).collect()
    t = Tokenizer.from_file(path)
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.start for p in pieces] == list(range(0, len(ids), 2048)) and sum(p.length for p in pieces) == len(ids)
        assert [p.ids_crc32 for p in pieces] == [zlib.crc32(ids[p.start : p.start + 2048].tobytes()) for p in pieces]
    for rows in by_seq.values():
        rows.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in rows])
        assert ends[-1] <= 2048 and [r.offset for r in rows] == [0, *ends[:-1]]
    sizes = np.array([r.length for r in got])
    assert len(by_seq) <= packing.lower_bound(sizes, 2048) * 1.02 + 1
    assert not packing.pack_texts(make_docs([]), path).collect()


def test_packing_rounds_exchange_open_bins(spark):
    rng = np.random.default_rng(0)
    sizes = rng.integers(300, 1300, 5000)
    df = spark.createDataFrame([(int(i), 0, int(s)) for i, s in enumerate(sizes)], "doc_id long, piece int, length long")
    got = packing.pack(df, 2048, task_pieces=500).collect()
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert len(got) == 5000 and max(fill.values()) <= 2048
    alone = packing.best_fit_decreasing(sizes, 2048).max() + 1
    assert len(fill) <= alone * 1.02


def test_lower_bound_holds():
    rng = np.random.default_rng(1)
    for _ in range(300):
        sizes = rng.integers(1, 21, rng.integers(0, 40))
        bins = packing.best_fit_decreasing(sizes, 20)
        assert packing.lower_bound(sizes, 20) <= (bins.max() + 1 if len(bins) else 0)
        assert (np.bincount(bins, sizes) <= 20).all() if len(bins) else True
    assert packing.lower_bound(np.array([11] * 7), 20) == 7


def test_special_strings_get_their_ids(make_docs):
    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = ["hi <|endoftext|> a <|startoftext|>b", "<|endoftext|>", "x<|ENDOFTEXT|>, <|EndOfText|>", "a<|endoftext|>!!B.<|startoftext|>|>", "<|endoftext|"]
    assert t.encode(texts[0], add_special_tokens=False).ids == [1883, 49407, 320, 49406, 321]
    for text in texts:
        assert np.frombuffer(packing.token_ids(path, text.encode()), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_packing_with_clashing_names(spark):
    rows = [(f"d{k}", 0, 700, 9, "x", "y") for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id string, piece int, length long, offset int, open string, c1 string")
    got = packing.pack(df, 2048)
    assert got.columns == ["doc_id", "piece", "length", "open", "c1", "sequence_id", "offset"]
    got = got.collect()
    assert sorted(r.offset for r in got) == [0] * 5 + [700] * 5 and {(r.open, r.c1) for r in got} == {("x", "y")}


def test_long_texts_full_of_notices(make_docs):
    rng = random.Random(8)

    def typo(s):
        k = rng.randrange(1, len(s) - 1)
        return s[:k] + "q" + s[k + 1 :]

    lines = [typo("all rights reserved") for _ in range(10_000)]
    search = licenses.NoticeSearch(licenses.NOTICES)
    began = time.process_time()
    found = search.search(" " + " ".join(lines) + " ")
    assert time.process_time() - began < 5  # 200 KB; quadratic work took minutes
    assert len(found) == 10_000 and all(e == 1 for _, _, _, e in found)
    spans = sorted((a, b) for _, a, b, _ in found)
    assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
    row = licenses.scan_licenses(make_docs(["cc by " * 30_000, "x " * 5 + "all rights reserved " * 20_000])).orderBy("doc_id").collect()
    assert (row[0].n_base, row[0].first_word, row[0].last_word) == (30_000, 0, 59_998)
    assert (row[1].n_base, row[1].first_word, row[1].last_word, len(row[1].spans)) == (20_000, 5, 60_002, 20_000)
    assert [(s["first"], s["last"]) for s in row[1].spans[:2]] == [(5, 7), (8, 10)]


def test_shards_of_odd_tables(spark, make_docs, tmp_path):
    docs = make_docs([(i % 90, None if i % 7 == 0 else "t" * (i % 40)) for i in range(200)] + [(500, "x" * 2_000_000)] * 3)
    odd = docs.selectExpr("doc_id", "lang", "source", "octet_length(text) size", "'mine' shard", "1 _cell", "2 _part", "3 c0", "4 _rank")
    got = sharding.hilbert_shards(odd, 40, {"lang": "name", "size": "log", "source": "name"}, ["size", "doc_id"])
    assert got.columns == ["doc_id", "lang", "source", "size", "_cell", "_part", "c0", "_rank", "shard", "slot"]
    rows = got.collect()
    assert len(rows) == 203 and {(r._cell, r._part, r.c0, r._rank) for r in rows} == {(1, 2, 3, 4)}
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1

    one_each = spark.createDataFrame([(i, f"text {i}", i % 3) for i in range(60)], "doc_id long, text string, shard int")
    placed = sharding.hilbert_shards(one_each.selectExpr("doc_id", "length(text) size"), 4, {"size": "log"}, ["doc_id"])
    sharding.write_shards(one_each, placed, "doc_id", str(tmp_path / "out"), tasks=9)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.doc_id, r.shard, r.text) for r in back.collect()} == {(r.doc_id, r.shard, f"text {r.doc_id}") for r in placed.collect()}
    files = [sorted(d.glob("*.parquet")) for d in (tmp_path / "out").iterdir() if d.is_dir()]
    assert len(files) == 4 and any(len(f) > 1 for f in files)
    slot = {r.doc_id: r.slot for r in placed.collect()}
    for names in files:
        order = [slot[r.doc_id] for f in names for r in spark.read.parquet(str(f)).collect()]
        assert order == list(range(len(order)))
