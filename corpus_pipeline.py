"""A corpus from raw documents: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's documents. All but the last return the columns of documents, and those that the caller added, whatever their names.
Null texts count as empty; an empty table gives an empty table; rows that repeat are one group for the near-duplicates, of
which one stays. The operators' docstrings say more.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import minhash, packing, quality, suffixes, toxicity
from quillon.llm.common import Scratch

#: A document goes below this quality, and from this toxicity on.
LEAST_QUALITY, TOXIC = 0.5, 0.3
#: Repeated passages are searched by strings of so many bytes, and cut from so many words on.
PASSAGE_BYTES, PASSAGE_WORDS = 200, 51


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the weakly labelled scorer finds bad."""
    scorer = quality.train(docs)
    return quality.keep_rows(docs, scorer.score, LEAST_QUALITY)


def toxicity_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, trained on the labelled ones among them, finds toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return quality.keep_rows(docs, toxicity.train(docs, labels).score, TOXIC, below=True)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five words, similarity 0.8)."""
    return minhash.keep_one(docs, width=5, num=80, den=100)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of more than fifty words that also occur elsewhere.

    Repeats are found from 200 bytes on (the shortest 51 words of prose have more); removed runs of fewer words stay.
    """
    return suffixes.cut_repeats(docs, length=PASSAGE_BYTES, least_words=PASSAGE_WORDS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of 2048."""
    return packing.pack_texts(docs, public_tokenizers.path("word_bpe_49k.json"), room=2048)


STAGES = [
    ("quality classifier", quality_classifier),
    ("toxicity", toxicity_classifier),
    ("MinHash near-dedup", minhash_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("best-fit packing", best_fit_packing),
]
#: Trained models and BPE are beyond SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
