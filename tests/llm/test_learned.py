import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def split(spark, sf=SF):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return docs, labels, held


def auc(score, y):
    order = np.argsort(np.argsort(score)) + 1
    n1, n0 = y.sum(), len(y) - y.sum()
    return (order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_toxicity_on_held_out_rows(spark):
    docs, labels, held = split(spark, "/root/testdata/sf0.1")  # the smaller table holds out 14 toxic rows only
    model = toxicity.train(docs, labels.where(~held))
    got = toxicity.score_texts(docs, model).join(labels.where(held), "doc_id").toPandas()
    assert auc(got.score.to_numpy(), got.toxic.to_numpy()) > 0.95
    assert ((got.predicted == 1) & (got.toxic == 0)).mean() < 0.01
    assert got[got.toxic == 1].predicted.mean() > 0.85
    assert got.score.between(0, 1).all()


def test_toxicity_ignores_other_columns_and_odd_rows(spark, make_docs):
    rng = random.Random(0)
    clean = [" ".join(rng.choice(["good", "day", "tree", "lake", "stone"]) for _ in range(rng.randint(3, 60))) for _ in range(120)]
    texts = [c + (" you vile wretch wretch" if i % 4 == 0 else "") for i, c in enumerate(clean)]
    docs = make_docs(texts, "score")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), "x") for i in range(100)] + [(None, 1, "x"), (3, None, "x"), (5, 7, "x")], "doc_id long, toxic int, text string")
    model = toxicity.train(docs, labels)
    new = make_docs([(1, "a wretch vile wretch"), (2, "good day lake"), (3, None), (4, ""), (None, "lake"), (2, "good day lake"), (6, "tree " * 200_000 + "wretch vile wretch")])
    got = [tuple(r) for r in toxicity.score_texts(new, model).collect()]
    by = {k: p for k, _, p in got}
    assert len(got) == 7 and by[1] == 1 and by[2] == 0 and by[3] == by[4] == 0 and by[6] == 1
    assert not toxicity.score_texts(make_docs([]), model).collect()


@pytest.mark.parametrize("labels", [[], [(0, 1)], [(0, 0), (1, 0)]])
def test_toxicity_without_two_classes(spark, make_docs, labels):
    docs = make_docs(["a b", "c d"])
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    s = {r.score for r in toxicity.score_texts(docs, model).collect()}
    assert len(s) == 1 and 0 <= s.pop() <= 1


@pytest.mark.parametrize("before", [b"x" * (toxicity.BLOCK - 8), b"ab " * (toxicity.BLOCK // 3 - 2), b"x" * (3 * toxicity.BLOCK - 9)])
def test_long_text_in_blocks_has_the_same_features(before):
    inner = np.frombuffer(b" some words here ", np.uint8)
    codes = np.unique(np.concatenate(list(toxicity.gram_codes(inner))))
    model = toxicity.Model(codes, np.ones(len(codes)), 0.0)
    assert b"".join(toxicity.pieces_of(b"short")) == b"short"
    assert set(model.features([before + b" some words here " + b"y" * 100])[1]) == set(range(len(codes)))


def test_quality_keeps_clean_documents(spark):
    docs, labels, _ = split(spark)
    got = quality.score_quality(docs, quality.train(docs)).join(labels, "doc_id").toPandas()
    assert auc(got.score.to_numpy(), got.quality.to_numpy()) > 0.95
    assert got[got.quality == 1].kept.mean() > 0.99 and got[got.quality == 0].kept.mean() < 0.2


def test_quality_of_odd_rows(make_docs):
    docs = make_docs([None, "", " ", "a", "x" * 100_000, "fine words of a text.", "fine words of a text.", "!!! *** ### " * 50], "score")
    got = quality.score_quality(docs, quality.train(docs)).collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    assert not quality.score_quality(make_docs([]), quality.train(make_docs([]))).collect()
    assert quality.keep_rows(docs, quality.train(docs).score, 0.0).columns == docs.columns


def test_label_model_finds_the_accurate_labellers():
    rng = np.random.default_rng(0)
    n = len(quality.LABELLERS)
    truth = rng.random(4000) < 0.8
    right = np.linspace(0.95, 0.7, n)
    vote = np.where(rng.random((4000, n)) < right, truth[:, None], ~truth[:, None]) + 1
    vote[rng.random((4000, n)) < 0.3] = 0
    codes, counts = np.unique(quality.pattern(vote), return_counts=True)
    post = dict(zip(codes, quality.label_model(codes, counts.astype(float))))
    guess = np.array([post[c] > 0.5 for c in quality.pattern(vote)])
    assert (guess == truth).mean() > 0.97
