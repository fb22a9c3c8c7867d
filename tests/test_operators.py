import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.config import EngineConfig
from quillon.functions import scoring as S
from quillon.operators import evals, fusion, lineage, store, vector
from quillon.operators.atlas import project
from quillon.queries import QUERIES
from quillon.sources import adapters
from quillon.streaming import ingest

CAND = "qid long, corpus string, id long, distance double, rank int"


def cand(spark, rows):
    return spark.createDataFrame([(1, "homelab", i, d, k) for k, (i, d) in enumerate(rows, 1)], CAND)


def test_union(spark):
    u = fusion.union_candidates(cand(spark, [(2, 0.2), (10, 0.3)]), cand(spark, [(2, 0.1), (3, 0.3)])).orderBy("pos").collect()
    assert [(r.id, r.distance, r.from_primary, r.alternate_rank) for r in u] == [(2, 0.1, True, 1), (10, 0.3, True, None), (3, 0.3, False, 2)]


@pytest.mark.parametrize("lexical, want", [
    ([1, 30, 31], [*range(1, 21), 30, 31, 21, 22, 23]),
    (list(range(100, 110)), [*range(1, 21), *range(100, 105)]),
])
def test_hybrid_merge(spark, lexical, want):
    semantic = cand(spark, [(i, i / 100) for i in range(1, 26)])
    lex = spark.createDataFrame([(1, "homelab", i, -1.0, k) for k, i in enumerate(lexical, 1)], "qid long, corpus string, id long, score double, rank int")
    got = fusion.hybrid_merge(semantic, lex, EngineConfig()).orderBy("pos").collect()
    assert [r.id for r in got] == want
    assert all(r.distance == 0.6 for r in got if r.from_lexical)


def test_admission(spark):
    schema = "qid long, corpus string, id long, from_primary boolean, alternate_rank int, relevance double"
    rows = [(1, "homelab", 1, False, 1, 0.3999), (1, "homelab", 2, False, 2, 0.40), (2, "homelab", 3, True, None, 0.5), (2, "homelab", 4, False, 1, 0.30), (2, "homelab", 5, False, 6, 0.9), (2, "ai", 6, False, 9, 0.1)]
    got = fusion.admit_alternates(spark.createDataFrame(rows, schema), EngineConfig())
    assert sorted(r.id for r in got.collect()) == [2, 3, 4, 6]


@pytest.mark.parametrize("home, ai, want", [
    (0.2, 0.1, "none/no_candidate"), (0.9, 0.1, "homelab/single_strong"), (0.9, 0.7, "both/both_strong"), (0.61, 0.58, "both/margin_tie"),
    (0.52, 0.50, "both/dead_zone_both"), (0.58, 0.41, "homelab/single_above_reject"), (None, 0.45, "ai/single_above_reject"), (None, None, "none/no_candidate"),
])
def test_shadow_route(spark, home, ai, want):
    df = spark.createDataFrame([(home, ai)], "h double, a double")
    assert df.select(S.shadow_route(F.col("h"), F.col("a"), EngineConfig(reject=0.4))).first()[0] == want


@pytest.mark.parametrize("text, want", [("kako da podesim", "sr"), ("how to restart the service", "en"), ("plex", "unknown"), ("čaj", "sr"), ("", "unknown"), ("nova konfiguracija", "sr"), ("host post", "unknown")])
def test_query_language(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(S.query_language(F.col("t"))).first()[0] == want


def test_decay(spark):
    df = spark.createDataFrame([(1.0, "homelab", 0.0, False), (1.0, "homelab", 0.0, True), (1.0, "homelab", 1e6, False), (1.0, "ai", 1e6, False)], "r double, c string, d double, s boolean")
    got = [r[0] for r in df.select(S.final_score(F.col("r"), F.col("c"), F.col("d"), F.col("s"), EngineConfig())).collect()]
    assert got == [1.0, 0.1, 0.3, 1.0]
    age = spark.createDataFrame([(None,), (datetime.datetime(2030, 1, 1),)], "t timestamp").select(S.age_days(F.col("t"), F.lit("2026-01-01").cast("timestamp")))
    assert [r[0] for r in age.collect()] == [0.0, 0.0]


def test_vectors_with_odd_parts(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0, 0.01])]
    v = spark.createDataFrame(rows, "id long, e array<float>").select("id", vector.unit("e").alias("x"))
    assert [tuple(r)[:2] for r in vector.near_duplicates(v, 0.1).collect()] == [(1, 5)]
    near = {r.id: r.other for r in vector.nearest(v, 1).collect()}
    assert near == {1: 5, 5: 1}


def test_lineage_cycle_and_chain(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8)], "src long, dst long")
    got = lineage.reachable(e, spark.createDataFrame([(1,), (7,)], "node long"))
    assert sorted((r.src, r.node) for r in got.collect()) == [(1, 1), (1, 2), (1, 3), (7, 7), (7, 8)]
    assert lineage.would_cycle(e, spark.createDataFrame([(8, 7), (7, 9)], "src long, dst long")).collect()[0].src == 8


def test_supersede_is_idempotent(spark):
    e = spark.createDataFrame([("homelab", 1, "t", "body", "x", "c"), ("ai", 1, "u", "other", "x", "c")], "corpus string, id long, title string, content string, embedded_at string, compiled_at string")
    to = lambda ref: spark.createDataFrame([("homelab", 1, ref)], "corpus string, id long, refs string")
    once = store.supersede_entries(e, to("ai:1"))
    row = {r.corpus: r for r in once.collect()}
    history = f"\n\n{store.NOTICE}\n\n{store.HISTORY}\n\nbody"
    assert row["homelab"].content == "SUPERSEDED — use ai:1" + history and row["homelab"].title == "[SUPERSEDED] t" and row["homelab"].embedded_at is None and row["homelab"].compiled_at is None
    assert row["ai"].embedded_at == "x" and row["ai"].compiled_at == "c" and row["ai"].content == "other"
    again = store.supersede_entries(once.withColumn("embedded_at", F.lit("y")), to("ai:1")).where("corpus = 'homelab'").first()
    assert again.embedded_at == "y" and again.content == row["homelab"].content
    other = store.supersede_entries(once, to("ai:2")).where("corpus = 'homelab'").first()
    assert other.content == "SUPERSEDED — use ai:2" + history and other.title == "[SUPERSEDED] t"


def test_retire(spark):
    key = "corpus string, id long"
    e, v = spark.createDataFrame([("ai", 1), ("ai", 2)], key), spark.createDataFrame([("ai", 1), ("ai", 3)], key)
    rows, vecs, report = store.retire(e, v, spark.createDataFrame([("ai", 1), ("ai", 3), ("ai", 9)], key))
    assert [r.id for r in rows.collect()] == [2] and not vecs.collect()
    assert {r.id: r.found for r in report.collect()} == {1: "retired", 3: "orphan_vector_only", 9: "nothing"}
    with pytest.raises(ValueError):
        store.parse_ref("homelab-7")


def test_evaluation(spark):
    df = spark.createDataFrame([([1, 2], [2, 3]), ([], [1]), ([1], [])], "f array<long>, e array<long>")
    got = df.select(evals.recall(F.col("f"), F.col("e")), evals.noise(F.col("f"), F.col("e")), evals.jaccard(F.col("f"), F.col("e")), evals.reciprocal_rank(F.col("f"), F.col("e"))).collect()
    assert [tuple(round(x, 3) for x in r) for r in got] == [(0.5, 0.5, 0.333, 0.5), (0.0, 0.0, 0.0, 0.0), (1.0, 1.0, 0.0, 0.0)]


@pytest.mark.parametrize("n, dim", [(3, 2), (40, 5), (300, 16)])
def test_scaling_equals_the_textbook(spark, n, dim):
    import numpy as np

    x = np.random.default_rng(n).standard_normal((n, dim)) * np.linspace(3, 0.3, dim)
    x /= np.linalg.norm(x, axis=1)[:, None]
    centre = np.eye(n) - 1 / n
    value, vector_ = np.linalg.eigh(-0.5 * centre @ (1 - x @ x.T) ** 2 @ centre)
    want = vector_[:, ::-1][:, :2] * np.sqrt(np.maximum(value[::-1][:2], 0))
    want /= np.abs(want).max()
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>")
    got = np.array([(r.px, r.py) for r in project(v).orderBy("id").collect()])
    assert np.abs(got).max() == pytest.approx(1)
    for k in range(2):
        assert min(np.abs(got[:, k] - want[:, k]).max(), np.abs(got[:, k] + want[:, k]).max()) < 1e-4


def test_config():
    assert EngineConfig().fingerprint() == EngineConfig().fingerprint() != EngineConfig(reject=0.3).fingerprint()
    for bad in ({"reject": 0.7}, {"dead_low": 0.9}, {"top_k": 0}, {"ai_decay": "x"}):
        with pytest.raises(ValueError):
            EngineConfig(**bad)


def test_raw_notes(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    (tmp_path / "urls").mkdir()
    (tmp_path / "notes" / "a.md").write_text('---\ntitle: "A \\"b\\""\ntags: x, y\n---\nbody\n')
    (tmp_path / "urls" / "plain.md").write_text("only text")
    got = {r.title: (r.type, r.tags, r.content) for r in adapters.raw_notes(spark, str(tmp_path)).collect()}
    assert got == {'A "b"': ("note", "x, y", "body\n"), "plain": ("url", "", "only text")}


def test_streamed_notes_are_upserted(spark, tmp_path):
    src, out, ck = tmp_path / "src", f"file://{tmp_path}/out", f"file://{tmp_path}/ck"
    src.mkdir()
    (src / "a.md").write_text("one")
    run = lambda: ingest.upsert_batches(ingest.read_notes(spark, str(src)), out, ["raw_path"], ck).awaitTermination()
    run()
    (src / "b.md").write_text("two")
    run()
    run()
    assert sorted(r.content for r in ingest.current(spark, out, ["raw_path"]).collect()) == ["one", "two"]


def test_long_lineage(spark):
    line = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(37, 100)], "src long, dst long")
    heads = lineage.chains(line)  # walks the whole line
    assert heads.count() == 0
    got = lineage.would_cycle(line, spark.createDataFrame([(40, 2), (40, 200)], "src long, dst long"))
    assert [tuple(r) for r in got.collect()] == [(40, 2)]


@pytest.mark.parametrize("pivots", [1, 3, 40])
@pytest.mark.parametrize("kind", ["clusters", "even", "grid", "few"])
def test_neighbours_of_all(spark, monkeypatch, pivots, kind):
    """Pruned by pivots or not: the pairs and neighbours of a comparison of all with all. Clusters leave most of it out."""
    rng = np.random.default_rng(pivots)
    if kind == "clusters":
        centres = rng.normal(size=(20, 16)) * 4
        x = centres[rng.integers(0, 20, 600)] + rng.normal(size=(600, 16)) * 0.6
    elif kind == "grid":  # equal vectors and equal distances
        x = rng.integers(0, 3, (300, 4)) + np.array([1, 0, 0, 0])
    else:
        x = rng.normal(size=(400 if kind == "even" else 4, 8))
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(vector, "BLOCK", 64)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(9999, None)], "id long, x array<double>")
    d = 1 - np.clip(x @ x.T, -1, 1)
    near = {(r.a, r.b) for r in vector.near_duplicates(df, 0.08, pivots).collect()}
    want = {(a, b) for a, b in zip(*np.nonzero(d <= 0.08)) if a < b}
    assert all(abs(d[p] - 0.08) < 1e-9 for p in near ^ want)
    got = vector.nearest(df, 5, pivots).orderBy("id", "rank").collect()
    by = {i: [(r.other, r.d) for r in got if r.id == i] for i in range(len(x))}
    for i in range(len(x)):
        order = [j for j in np.lexsort((np.arange(len(x)), np.round(d[i], 9))) if j != i][:5]
        assert len(by[i]) == len(order) and all(abs(v - d[i, j]) < 2e-9 for (_, v), j in zip(by[i], order))
        assert all(j == o or abs(d[i, j] - d[i, o]) < 2e-9 for (j, _), o in zip(by[i], order))
    if kind == "clusters" and pivots == 40:
        compared = lambda met: met.selectExpr("sum(na * nb) as n").first().n
        cells = vector.Cells(df, pivots)
        assert compared(vector.near_meetings(cells, 0.08)) < len(x) ** 2 / 3
        assert compared(vector.nearest_meetings(cells, 5)) < len(x) ** 2 / 3


def test_neighbours_of_none(spark):
    df = spark.createDataFrame([], "id long, x array<double>")
    assert vector.near_duplicates(df, 0.1).collect() == [] and vector.nearest(df, 3).collect() == []


def test_long_chains_close_in_few_rounds(spark):
    n = 4096
    chain = spark.range(n).selectExpr("id as src", "id + 1 as dst")
    ends = spark.createDataFrame([(0,), (n,)], "node long")
    short, rounds = lineage.contracted(chain, ends)
    assert [tuple(r) for r in short.collect()] == [(0, n)] and rounds <= 13
    wanted = spark.createDataFrame([(n, 0), (n, 5), (3, 4000), (0, n)], "src long, dst long")
    assert sorted(map(tuple, lineage.would_cycle(chain, wanted).collect())) == [(n, 0), (n, 5)]


@pytest.mark.parametrize("seed", range(3))
def test_contraction_keeps_what_is_reached(spark, seed):
    rng = np.random.default_rng(seed)
    edges = {(int(a), int(a) + int(rng.integers(1, 3))) for a in rng.integers(0, 60, 50)} | {(80, 81), (81, 82), (82, 80), (90, 91), (91, 90), (7, 7)}
    wanted = {(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))} | {(81, 80), (95, 90), (7, 7)}
    after: dict = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def reaches(a, b):
        seen, todo = {a}, [a]
        while todo:
            for x in after.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return b in seen

    got = lineage.would_cycle(spark.createDataFrame(sorted(edges), "src long, dst long"), spark.createDataFrame(sorted(wanted), "src long, dst long"))
    assert {tuple(r) for r in got.collect()} == {(a, b) for a, b in wanted if reaches(b, a)}


def test_sums_of_large_arrays(spark):
    """As at 768 dimensions: 16 columns of 1 + 768 + 768^2 features, of several tasks; the driver gets one array."""
    from quillon.operators.atlas import _summed

    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 768))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(5)
    size = 16 * (1 + 768 + 768 * 768)
    got = _summed(df, lambda rows: np.resize((rows.T @ rows).ravel(), size), size)
    assert got.nbytes < 100e6 and np.allclose(got, np.resize((x.T @ x).ravel(), size))


def test_candidates_by_tiles(spark, monkeypatch):
    """Tiles of both sides give what a comparison of all with all gives, ties by id; no nested loop over rows is planned."""
    monkeypatch.setattr(vector, "TILE_QUERIES", 16)
    monkeypatch.setattr(vector, "TILE_VECTORS", 32)
    monkeypatch.setattr(vector, "CHUNK", 7)
    rng = np.random.default_rng(3)
    x = rng.integers(-1, 3, (200, 4)) + np.array([0.5, 0, 0, 0])  # equal vectors and equal distances
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [("ai" if k % 3 else "homelab", k, v.tolist()) for k, v in enumerate(x)]
    v = spark.createDataFrame([*rows, ("ai", 999, None)], "corpus string, id long, x array<double>")
    found = vector.top_candidates(v.select(F.col("id").alias("qid"), F.col("x").alias("qx")), v, 0.4, 6)
    d = 1 - np.clip(x @ x.T, -1, 1)
    want = set()
    for q in range(len(x)):
        for corpus in ("ai", "homelab"):
            near = sorted((round(d[q, k], 4), k) for c, k, _ in rows if c == corpus and d[q, k] <= 0.4)[:6]
            want |= {(q, corpus, k, place) for place, (_, k) in enumerate(near, 1)}
    assert {(r.qid, r.corpus, r.id, r.rank) for r in found.collect()} == want
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


def test_no_candidates(spark):
    v = spark.createDataFrame([], "corpus string, id long, x array<double>")
    assert vector.top_candidates(v.select(F.col("id").alias("qid"), F.col("x").alias("qx")), v, 0.4, 6).collect() == []


def test_spread_vectors_go_by_tiles(spark):
    """Where cells leave nothing out, vectors aren't sent to each cell: no blocks of visitors are written."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 24))
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, x array<double>")
    near, pairs = vector.nearest(df, 2, 20), vector.near_duplicates(df, 0.6, 20)
    assert all("FlatMapCoGroupsInArrow" in t._jdf.queryExecution().toString() for t in (near, pairs))
    d = 1 - x @ x.T
    assert {(r.a, r.b) for r in pairs.collect()} == {(a, b) for a, b in zip(*np.nonzero(d <= 0.6)) if a < b}
    np.fill_diagonal(d, 9)
    assert {(r.id, r.other) for r in near.where("rank = 1").collect()} == {(k, int(d[k].argmin())) for k in range(300)}


def test_traces_by_tiles_equal_all_distances(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(90, 4)), 1) + 0.05
    x[40:60] = x[:20]  # ties
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [("ai" if k % 3 else "homelab", k, v.tolist()) for k, v in enumerate(x)]
    v = spark.createDataFrame(rows, "corpus string, id long, x array<double>")
    q = v.where("id % 7 = 0").select(F.col("id").alias("qid"), F.col("x").alias("qx"))
    watch = v.where("id % 5 = 0").select("corpus", "id")
    d = {(a, c, b): 1 - min(1, max(-1, float(x[a] @ x[b]))) for a in range(0, 90, 7) for c, b, _ in rows}
    order = lambda a, c: sorted((int(np.floor(e * 1e4 + 0.5)), b) for (p, k, b), e in d.items() if p == a and k == c)
    for vectors in (262144, 20):  # one block, several
        monkeypatch.setattr(vector, "RANKED_VECTORS", vectors)
        got = vector.places_of(q, v, watch, 0.85).collect()
        assert len(got) == 13 * 18
        for r in got:
            ahead = order(r.qid, r.corpus)
            at = ahead.index((int(np.floor(d[r.qid, r.corpus, r.id] * 1e4 + 0.5)), r.id))
            assert (r.raw, r.near) == (at, sum(d[r.qid, r.corpus, b] <= 0.85 for _, b in ahead[:at]))
    seen = vector.scan(q, v, 0.85, 3).collect()
    for a, c in {(r.qid, r.corpus) for r in seen}:
        mine = [r for r in seen if (r.qid, r.corpus) == (a, c)]
        assert sum(r.total for r in mine) == len(order(a, c)) and sum(r.within for r in mine) == sum(d[a, c, b] <= 0.85 for _, b in order(a, c))
        assert sorted((round(r.distance * 1e4), r.id) for r in mine if not r.total)[:3] == order(a, c)[:3]


def test_totals_by_tiles(spark, monkeypatch):
    """Tiles give what all distances give; no row is made for a pair and no nested loop is planned."""
    monkeypatch.setattr(vector, "TILE_QUERIES", 16)
    monkeypatch.setattr(vector, "TILE_VECTORS", 8)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    corpora = np.array(["homelab", "ai", "ai"] * 30)
    rows = [(c, k, v.tolist()) for k, (c, v) in enumerate(zip(corpora.tolist(), x))]
    v = spark.createDataFrame([*rows, ("ai", 999, None)], "corpus string, id long, x array<double>")
    found = vector.totals(v.select(F.col("id").alias("qid"), F.col("x").alias("qx")), v, 0.85)
    d = 1 - np.clip(x @ x.T, -1, 1)
    want = {(q, c): (int((corpora == c).sum()), int((d[q, corpora == c] <= 0.85).sum()), round(d[q, corpora == c].min(), 9)) for q in range(90) for c in ("ai", "homelab")}
    assert {(r.qid, r.corpus): (r.total, r.within, round(r.d, 9)) for r in found.collect()} == want
    plan = QUERIES["vec_scan_totals"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_visits_go_out_in_slices(spark, monkeypatch):
    """Vectors that visit all cells: a batch of visits is a slice of vectors times the pivots, and counting makes none."""
    monkeypatch.setattr(vector, "VISITORS", 16)
    rng, made = np.random.default_rng(6), []
    x = rng.normal(size=(400, 24))
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, x array<double>")
    cells = vector.Cells(df, 20)
    everywhere = cells.homes.withColumn("reach", F.lit(3.0))
    mapped = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *a, **k: made.append(f) or mapped(self, f, *a, **k))
    assert not cells.apart(everywhere, upwards=False)
    visits = cells.visits(everywhere, upwards=False)
    assert visits.count() == 400 * 20 and visits.select("id", "cell").distinct().count() == 400 * 20
    batch = pa.RecordBatch.from_pylist([r.asDict() for r in everywhere.select("id", "x", "cell", "reach").collect()])
    counted, out = ([b.num_rows for b in f(iter([batch]))] for f in made)
    assert counted == [1] and sum(out) == 400 * 20 and max(out) <= 16 * 20


@pytest.mark.parametrize("kind", ["even", "near", "grid", "equal", "few"])
@pytest.mark.parametrize("k", [1, 5])
def test_nearest_by_single_precision_is_exact(monkeypatch, kind, k):
    """Products in single precision leave what double precision orders; equal distances by id; a vector isn't its own."""
    monkeypatch.setattr(vector, "COLUMNS", 256)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3 if kind == "few" else 3000, 16))
    if kind == "near":  # differences below single precision
        x = np.repeat(x[:100], 30, 0) + rng.normal(size=x.shape) * 1e-6
    elif kind == "grid":
        x = rng.integers(0, 3, (3000, 4)) + np.array([1, 0, 0, 0])
    elif kind == "equal":
        x = np.ones((3000, 16))
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    ids, at = np.arange(len(x)) * 2, np.arange(0, len(x), 41)
    i, j, d = vector.nearest_places(ids[at], x[at], ids, vector.halved(x), k)
    exact = 1 - np.clip(x[at] @ x.T, -1, 1)
    exact[np.arange(len(at)), at] = np.inf
    want = np.sort(exact, axis=1)[:, : min(k, len(x) - 1)]
    assert np.array_equal(i, np.repeat(np.arange(len(at)), want.shape[1])) and np.allclose(d, want.ravel(), rtol=0, atol=2e-9)
    assert not (at[i] == j).any() and np.allclose(exact[i, j], d, rtol=0, atol=1e-12)
    if kind == "equal":
        assert [list(j[i == r]) for r in range(3)] == [[c for c in range(k + 1) if c != at[r]][:k] for r in range(3)]


def test_related_by_tiles(spark, monkeypatch):
    """Tiles give what a look at all pairs gives, exclusions as rows or as a function; no row is made for a pair before."""
    from quillon.operators.gate import related, with_topics

    monkeypatch.setattr(vector, "TILE_QUERIES", 16)
    monkeypatch.setattr(vector, "TILE_VECTORS", 8)
    monkeypatch.setattr(vector, "CHUNK", 70)
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(160, 4)), 1) + 0.05
    x[40:60] = x[:20]  # ties
    x /= np.linalg.norm(x, axis=1)[:, None]
    words = [set() if k % 11 == 0 else {f"wort{w}" for w in rng.integers(0, 30, 1 + k % 7)} for k in range(160)]
    v = spark.createDataFrame([("ai" if k % 3 else "homelab", k, e.tolist()) for k, e in enumerate(x)], "corpus string, id long, x array<double>")
    e = spark.createDataFrame([(k, "", " ".join(sorted(w)) or None) for k, w in enumerate(words)], "id long, tags string, title string")
    q = v.join(e, "id").select(F.col("id").alias("qid"), F.col("x").alias("qx"), F.col("tags").alias("qtags"), F.col("title").alias("qtitle"))
    out = lambda qids, ids: (qids % 4 == 0) & (ids % 3 == 1)
    rows = q.select("qid").join(e.select("id")).where("qid % 4 = 0 and id % 3 = 1")
    s = 1 - (1 - np.clip(x @ x.T, -1, 1))
    want = set()
    for a in range(160):
        near = sorted((-np.floor(s[a, b] * 1e4 + 0.5), b) for b in range(160) if b != a and s[a, b] >= 0.25 and words[a] & words[b] and not out(a, b))
        want |= {(a, b, -units / 1e4, place) for place, (units, b) in enumerate(near, 1)}
    for exclude in (out, rows):
        found = related(q, v, e, 0.25, exclude)
        assert {(r.qid, r.id, r.similarity, r.place) for r in found.collect()} == want
    assert {(r.qid, r.id) for r in related(q, v, e, 0.25).collect()} > {w[:2] for w in want}
    assert all(set(r.shared) == words[r.qid] & words[r.id] for r in with_topics(found, q, e).collect())
    plan = QUERIES["gate_related"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_general_words_are_a_parameter_of_topics(spark):
    from quillon.operators.gate import topic_tokens

    one = spark.createDataFrame([("src0", "nas superseded disk")], "tags string, title string")
    of = lambda *general: one.select(topic_tokens(F.col("tags"), F.col("title"), *general).alias("t")).first().t
    assert of() == ["src0", "disk"] and of(["superseded"]) == ["src0", "nas", "disk"]


def test_final_scores_round_the_binary_number(spark):
    from quillon.config import test_config

    row = spark.createDataFrame([(0.4686, "homelab", 340.0)], "rel double, corpus string, days double")
    assert row.select(S.final_score(F.col("rel"), F.col("corpus"), F.col("days"), F.lit(False), test_config()).alias("s")).first().s == 0.2875


def test_first_places_look_at_some_columns_for_a_bound(monkeypatch):
    rng, seen, partition = np.random.default_rng(5), [], np.partition
    d = np.round(rng.random((6, 8000)), 5)
    d[1], d[2, 30:], d[3] = np.inf, np.inf, 0.25  # nothing, fewer than asked for, all equal
    d[4, 1000:1200] = d[4].min() / 2  # many ties
    monkeypatch.setattr(np, "partition", lambda x, *a, **k: seen.append(x.size) or partition(x, *a, **k))
    for most in (np.inf, 0.01):
        i, j = vector.first_places(d, 25, vector.rounded, 1.5 / 10**vector.PLACES, min(most, np.finfo(float).max))
        fine = np.where(d <= most, vector.rounded(d), np.inf)
        want = [(r, c) for r in range(6) for c in np.lexsort((np.arange(8000), fine[r]))[:25] if np.isfinite(fine[r, c])]
        assert list(zip(i, j)) == want
    assert max(seen) <= d.size // vector.SAMPLED
