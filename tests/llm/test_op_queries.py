"""Every registered query of this subpackage over whole tables, against brute force."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from test_graphs import brute_groups, brute_links
from test_suffixes import brute
from tokenizers import Tokenizer

from quillon.llm import licenses
from quillon.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")


def run(spark, name):
    return QUERIES[name](spark, SF).toPandas()


def crc(x) -> int:
    return zlib.crc32(str(x).encode())


def test_op1(spark, vectors):
    got = run(spark, "op1_nn_descent_search")
    x = np.stack(vectors.embedding).astype(float)
    ids = vectors.vec_id.to_numpy()
    want = hits = 0
    for q, rows in got.groupby("query_id"):
        rows = rows.sort_values("rank")
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        fine = np.abs(x).sum(1) > 0
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q and fine[i]][:10]
        assert rows["rank"].tolist() == list(range(1, len(order) + 1))
        assert np.allclose(rows.score, [d[ids == i][0] for i in rows.vec_id], rtol=1e-12, atol=0)
        assert sorted(zip(rows.score, rows.vec_id)) == list(zip(rows.score, rows.vec_id))
        want, hits = want + len(order), hits + len(set(ids[order]) & set(rows.vec_id))
    assert set(got.query_id) == set(ids[ids % 100 == 0]) and hits >= 0.9 * want


def test_op2(spark, docs):
    got = run(spark, "op2_toxicity")
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    assert (got.held_out == [crc(i) % 4 == 2 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()


def test_op2_learns_nothing_from_held_out_rows(spark, tmp_path):
    import shutil

    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    shutil.copy(f"{SF}/documents.parquet", tmp_path / "documents.parquet")
    labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))).write.parquet(str(tmp_path / "labels.parquet"))
    turned = QUERIES["op2_toxicity"](spark, str(tmp_path)).toPandas().sort_values("doc_id")
    plain = run(spark, "op2_toxicity").sort_values("doc_id")
    assert np.allclose(plain.score, turned.score)


def test_op3(spark, vectors):
    got = run(spark, "op3_nn_descent_dedup").sort_values("vec_id")
    ids = vectors.vec_id.tolist()
    n, comp = brute_links([None if v is None else list(v) for v in vectors.embedding], [None if x is None or x != x else int(x) for x in vectors.label], 0.98)
    assert got.vec_id.tolist() == ids and got.n_links.tolist() == n
    assert got.component_id.tolist() == [ids[comp[k]] for k in range(len(ids))]
    assert got.kept.tolist() == [i == c for i, c in zip(got.vec_id, got.component_id)]


def test_op4(spark, docs):
    got = run(spark, "op4_suffix_dedup").set_index("doc_id")
    for i, want in zip(docs.doc_id, brute(docs.text, 400)):
        assert tuple(got.loc[i, ["n_bytes", "n_removed", "n_spans", "kept_sha256"]]) == want


def test_op5(spark, docs):
    got = run(spark, "op5_byte_bpe").set_index("doc_id")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, t in zip(docs.doc_id, docs.text):
        ids = coder.encode_ordinary(t or "")
        assert tuple(got.loc[i]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_op6(spark, docs):
    got = run(spark, "op6_license_scan").set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(k, label) for p, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = got.loc[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(sorted({x for _, x in places})))
        if places:
            assert (r.first_word, r.last_word, r.score) == (min(places)[0], max(places)[0], 1)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def test_op7(spark, docs):
    got = run(spark, "op7_minhash_dedup").set_index("doc_id")
    sets, want = brute_groups(list(zip(docs.doc_id, docs.text)), 3, 85, 100)
    for i in docs.doc_id:
        assert tuple(got.loc[i]) == (len(sets[i]), want[i], want[i] == i)


def test_op8(spark, docs):
    got = run(spark, "op8_quality").set_index("doc_id")
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")
    assert sorted(got.index) == sorted(docs.doc_id) and (got.kept == (got.score >= 0.5)).all() and got.score.between(0, 1).all()
    both = labels.join(got)
    assert both.score[both.quality == 1].min() > both.score[both.quality == 0].median()


def test_op9(spark, docs):
    got = run(spark, "op9_hilbert_shards").set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text):
        data = (t or "").encode()
        assert tuple(got.loc[i, ["size", "text_crc32", "law"]]) == (len(data) + 16, zlib.crc32(data), "rows")
    assert got.grown_shard.isna().all() and set(got.shard) == set(range(40))
    by = got.groupby("shard").slot.apply(sorted)
    assert all(s == list(range(len(s))) for s in by) and by.map(len).max() - by.map(len).min() <= 1


def test_op10(spark, docs):
    got = run(spark, "op10_best_fit_packing")
    coder = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    by = {i: rows.sort_values("piece") for i, rows in got.groupby("doc_id")}
    for i, t in zip(docs.doc_id, docs.text):
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        rows = by[i]
        assert rows.piece.tolist() == list(range(len(rows))) and rows.start.tolist() == list(range(0, len(ids), 2048)) and rows.length.sum() == len(ids)
        assert rows.ids_crc32.tolist() == [zlib.crc32(ids[s : s + 2048].tobytes()) for s in rows.start]
    fill = defaultdict(list)
    for r in got.itertuples():
        fill[r.sequence_id].append((r.offset, r.length))
    for pieces in fill.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(fill) <= -(-got.length.sum() // 2048) * 1.02 + 2  # few sequences more than the tokens fill


def test_all_eleven_are_registered():
    numbers = Counter(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES)
    assert numbers == Counter(range(1, 11))


def test_op11(spark, docs):
    from test_middles import plain

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = run(spark, "op11_fill_in_middle")
    want = {i: (plain(i, t), sha(t or "")) for i, t in zip(docs.doc_id, docs.text)}
    assert sorted(got.doc_id) == sorted(docs.doc_id) and got.form.nunique() == 3
    for r in got.itertuples():
        (n, form, prefix, middle, output), whole = want[r.doc_id]
        chars = (None, None) if form == "plain" else (r.prefix_chars, r.middle_chars)
        assert (r.n, r.form, chars, r.output_sha256, r.restored_sha256) == (n, form, (prefix, middle), sha(output), whole)


def test_op12(spark):
    from test_warc import plain

    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()
    got = QUERIES["op12_warc_archives"](spark, SF).collect()
    want = [(page, size, digest, kind, refers) for page, _, kind, size, digest, refers, _ in plain(pages)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_op13(spark, docs):
    from test_phrases import brute as collocated

    got = QUERIES["op13_collocations"](spark, SF).collect()
    assert sorted(map(tuple, got)) == collocated(list(zip(docs.lang, docs.text)))
