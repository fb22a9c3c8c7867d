from collections import Counter

import numpy as np

import corpus_pipeline
from quillon.llm import minhash

def repeated_runs(texts, length):
    """By key: maximal runs of bytes in strings of ``length`` bytes that start at another place as well."""
    seen = Counter(t[p : p + length] for t in texts.values() for p in range(len(t) - length + 1))
    out = {}
    for i, t in texts.items():
        gone = np.zeros(len(t) + 2, np.int8)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p + 1 : p + 1 + length] = 1
        out[i] = np.flatnonzero(np.diff(gone)).reshape(-1, 2).tolist()
    return out


SF = "/root/testdata/sf0.001"


def test_stages_end_to_end(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "toxicity", "MinHash near-dedup", "suffix-array dedup", "best-fit packing"]
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], SF)
        assert out.schema.names == docs.schema.names
        seen.append(spark.createDataFrame(out.collect(), docs.schema))
    ids = [{r.doc_id for r in d.collect()} for d in seen]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] == ids[4]
    good = set(labels[(labels.quality == 1)].doc_id)
    assert len(good & ids[1]) >= 0.97 * len(good)
    again = minhash.near_duplicates(seen[3], 5, 80, 100)
    assert again.where("not kept").count() == 0
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in seen[3:5])
    runs = repeated_runs({i: (t or "").encode() for i, t in before.items()}, corpus_pipeline.PASSAGE_BYTES)
    for i, t in before.items():
        own = [r for r in runs[i] if len(t.encode()[slice(*r)].split()) >= corpus_pipeline.PASSAGE_WORDS]
        at, kept = 0, b""
        for lo, hi in own:
            kept, at = kept + t.encode()[at:lo], hi
        assert after[i] == (t if not own else (kept + t.encode()[at:]).decode("utf-8", "ignore"))
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids[4]


def test_stages_over_odd_rows(spark, words, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and clashing names; and an empty table."""
    good = " ".join(f"The little house stood near river number {k} and nobody knew why." for k in range(40))
    rows = [(k, f"{words(30, seed=k)}. {words(20, seed=900 + k)}", "en", "web", 9) for k in range(60)]
    rows += [(100, None, None, None, None), (101, "", "en", None, 0), (None, good, "en", "web", len(good)), (102, good, "en", "web", len(good)), (102, good, "en", "web", len(good)), (103, words(200_000, seed=7), "en", "web", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' score", "1 `runs`", "2 r1", "3 `c0`", "4 `key`", "5 sig", "6 t")
    spark.createDataFrame([(k, 1, k % 2) for k in range(0, 60, 3)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, str(tmp_path))
            assert out.schema.names == docs.schema.names, name
            got = out.collect()
            assert len(got) <= table.count() and all((r.score, r.runs, r.r1, r.c0, r.key, r.sig, r.t) == ("x", 1, 2, 3, 4, 5, 6) for r in got), name
        packed = corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path)).collect()
        assert len({r.doc_id for r in packed}) == len({r.doc_id for r in table.collect()})
    kept = corpus_pipeline.minhash_dedup(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [*range(60), 100, 101, 102, 103] and len(kept) == 64
