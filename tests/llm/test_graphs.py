import numpy as np
import pytest

from quillon.llm import minhash, nndescent
from quillon.llm.common import Scratch, connected_components


def classes(pairs, nodes):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("edges", [[(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)], [(5, 5), (3, 9), (9, 3), (7, 9), (1, 4)]])
def test_components(spark, edges):
    got = connected_components(Scratch(spark), spark.createDataFrame(edges, "a long, b long")).collect()
    real = [(a, b) for a, b in edges if a != b]
    want = classes(real, {n for e in real for n in e})
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


def brute_groups(docs, width, num, den):
    sets = {}
    for i, t in docs:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        k = min(width, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    ids = sorted(sets)
    pairs = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    return sets, classes(pairs, ids)


@pytest.mark.parametrize("width, num", [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(make_docs, words, width, num):
    rng = np.random.default_rng(width)
    texts = [None, "", " \n", "one", "One", "two words", "one two three four five six seven", "A b c d e f g h", "a B c d e f g h"]
    for k in range(25):
        base = words(int(rng.integers(8, 220)), seed=k).split()
        texts.append(" ".join(base))
        for _ in range(int(rng.integers(0, 6))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(len(copy)))] = f"new{rng.integers(1000)}"
            texts.append(" ".join(copy))
    common = words(60, seed=99)
    texts += [f"{common} {words(12, seed=1000 + k)}" for k in range(30)]  # a shared passage, most pairs below the threshold
    texts += ["exact copy of a text with words"] * 5
    rows = list(enumerate(texts))
    sets, want = brute_groups(rows, width, num, 100)
    got = minhash.near_duplicates(make_docs(texts, "sketch"), width, num, 100).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id), texts[r.doc_id]
    kept = minhash.keep_one(make_docs(texts, "sketch"), width, num, 100)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in want.items() if i == c)
    assert "sketch" in kept.columns


def test_near_duplicates_of_odd_tables(make_docs):
    assert not minhash.near_duplicates(make_docs([])).collect()
    rows = minhash.near_duplicates(make_docs([(1, "a b"), (1, "a b"), (None, "a b"), (None, "z")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in rows) == [("1", "1", True)] * 2 + [("None", "1", False), ("None", "None", True)]
    assert minhash.keep_one(make_docs([(1, "a b"), (1, "a b"), (2, "c")])).count() == 2


def table(spark, x, labels=None, ids=None):
    rows = [(int(i), None if v is None else [None if c is None else float(c) for c in v], None if labels is None or labels[k] is None else int(labels[k]), "e") for k, (i, v) in enumerate(zip(ids or range(len(x)), x))]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, x string")


def test_search_recall_and_order(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 24)).astype(np.float32)
    x[700:760] = x[700]
    df = table(spark, x)
    got = nndescent.nearest_neighbours(df, df.where("vec_id % 50 = 0")).toPandas()
    hits = 0
    for q, rows in got.groupby("query_id"):
        d = np.sqrt(((x.astype(float) - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(x)), d))[:10]
        rows = rows.sort_values("rank")
        assert rows["rank"].tolist() == list(range(1, 11)) and np.allclose(rows.score, d[rows.vec_id], rtol=1e-12, atol=0)
        hits += len(set(want) & set(rows.vec_id))
        if q == 700:
            assert rows.vec_id.tolist() == list(range(701, 711)) and (rows.score == 0).all()
    assert hits >= 0.95 * 10 * got.query_id.nunique()


def test_search_of_odd_tables(spark):
    x = [[1, 0], [1, 0], [0, 0], None, [float("nan"), 1], [None, 1], [2, 0], [float("inf"), 0], []]
    df = table(spark, x)
    got = [tuple(r) for r in nndescent.nearest_neighbours(df, df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 6, 1.0), (1, 1, 0, 0.0), (1, 2, 6, 1.0), (6, 1, 0, 1.0), (6, 2, 1, 1.0)]
    assert not nndescent.nearest_neighbours(df.where("vec_id < 0"), df).collect()
    twice = df.union(df)
    assert nndescent.nearest_neighbours(twice, twice).count() == len(got)


def brute_links(x, labels, least):
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) and labels[k] is not None for k, v in enumerate(x)]
    n, pairs = [0] * len(x), []
    for a in range(len(x)):
        for b in range(a + 1, len(x)):
            if ok[a] and ok[b] and labels[a] == labels[b] and len(x[a]) == len(x[b]):
                p, q = np.array(x[a], np.float32).astype(float), np.array(x[b], np.float32).astype(float)
                if p @ q / np.sqrt((p @ p) * (q @ q)) >= least:
                    n[a] += 1
                    n[b] += 1
                    pairs.append((a, b))
    return n, classes(pairs, range(len(x)))


def test_links_against_brute_force(spark):
    rng = np.random.default_rng(8)
    x, labels = [], []
    for k in range(60):
        base = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 30 if k == 0 else 6))):
            x.append((base + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.2])).tolist())
            labels.append(k % 3 if rng.random() < 0.9 else None)
    x += [[0.0] * 16, None, [float("nan")] * 16, [None] * 16, x[0], x[0], [2 * c for c in x[0]]]
    labels += [0, 0, 0, 0, labels[0], labels[0], labels[0]]
    n, comp = brute_links(x, labels, 0.98)
    got = {r.vec_id: r for r in nndescent.near_duplicate_vectors(table(spark, x, labels), 0.98).collect()}
    assert len(got) == len(x)
    for k in range(len(x)):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (n[k], comp[k], comp[k] == k)


def test_links_of_odd_tables(spark):
    empty = table(spark, [[1, 0]], [1]).where("vec_id < 0")
    assert not nndescent.near_duplicate_vectors(empty).collect()
    rows = table(spark, [[1, 0], [1, 0], [0, 1]], [1, 1, 1], ids=[4, 4, 5])
    assert sorted(tuple(r) for r in nndescent.near_duplicate_vectors(rows).collect()) == [(4, 0, 4, True), (5, 0, 5, True)]


def test_links_between_saturated_parts(spark):
    rng = np.random.default_rng(4)
    a, b = np.linalg.qr(rng.standard_normal((32, 2)))[0].T
    b = 0.985 * a + np.sqrt(1 - 0.985**2) * b
    x = np.concatenate([side + rng.standard_normal((100, 32)) * 0.0055 for side in (a, b)]).astype(np.float32)
    n, comp = brute_links(x, [1] * 200, 0.98)
    assert min(n) > 150 and set(comp.values()) == {0}  # each is linked with most of the other side
    got = {r.vec_id: r for r in nndescent.near_duplicate_vectors(table(spark, x, [1] * 200), 0.98).collect()}
    assert [got[k].n_links for k in range(200)] == n and {r.component_id for r in got.values()} == {0}


def test_links_when_the_audit_fails(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "audit_recall", lambda *a, **k: 0.0)
    monkeypatch.setattr(nndescent, "neighbour_graph", lambda scratch, nodes, *a, **k: nodes.sparkSession.createDataFrame([(0, 1, 0.0)], "v long, u long, d double"))
    x = [[1.0, 0.01 * k] for k in range(6)] + [[0.0, 1.0]]
    n, comp = brute_links(x, [1] * 7, 0.98)
    got = {r.vec_id: r for r in nndescent.near_duplicate_vectors(table(spark, x, [1] * 7), 0.98).collect()}
    assert [(got[k].n_links, got[k].component_id) for k in range(7)] == [(n[k], comp[k]) for k in range(7)]


def audited(spark, groups, alone, known):
    """The audit of groups of unit vectors that are equal but for 1e-4, and of others; known(size): links found of each."""
    rng, rows, links = np.random.default_rng(6), [], []
    for size in [*groups, *[1] * alone]:
        base = rng.standard_normal(24)
        for _ in range(size):
            x = base + 1e-4 * rng.standard_normal(24)
            links.append((len(rows), known(size)))
            rows.append((len(rows), "24:1", (x / np.sqrt(x @ x)).tobytes(), 1))
    nodes = spark.createDataFrame(rows, "v long, grp string, x binary, m long")
    return nndescent.audit_recall(nodes, spark.createDataFrame(links, "v long, links long"), 0.98)


def test_audit_counts_small_groups_and_rare_links(spark):
    groups = [1500] + [3] * 300
    assert audited(spark, groups, 600, lambda size: size - 1) >= 0.99
    assert audited(spark, groups, 600, lambda size: min(size - 1, 1) if size < 9 else size - 1) < 0.99  # a link of each small group lost
    assert audited(spark, groups, 600, lambda size: 0 if size < 9 else size - 1) < 0.99  # all of them
    assert audited(spark, [2] * 5, 2000, lambda size: 0) < 0.99  # nothing found where links are rare
    assert audited(spark, [], 500, lambda size: 0) == 1


def test_search_is_repaired_below_the_wanted_recall(spark, monkeypatch):
    x = np.random.default_rng(9).standard_normal((400, 12)).astype(np.float32)
    x[50:60] = x[50]
    ring = [(i, (i + 1) % 400, 1.0) for i in range(400)]  # no neighbour but the next row
    monkeypatch.setattr(nndescent, "neighbour_graph", lambda scratch, nodes, *a, **k: nodes.sparkSession.createDataFrame(ring, "v long, u long, d double"))
    df = table(spark, x)
    got = nndescent.nearest_neighbours(df, df.where("vec_id % 10 = 0"), beam=20).toPandas()
    for q, rows in got.groupby("query_id"):
        d = np.sqrt(((x.astype(float) - x[q]) ** 2).sum(1))
        d[q] = np.inf
        assert rows.sort_values("rank").vec_id.tolist() == np.lexsort((np.arange(400), d))[:10].tolist()


def test_walk_goes_on_until_no_beam_has_a_new_node(spark):
    rows = [(i, "1:all", np.array([100.0 - i]).tobytes(), 1) for i in range(20)]  # each next node is nearer to the query
    nodes = spark.createDataFrame(rows, "v long, grp string, x binary, m long")
    roads = spark.createDataFrame([(i, i + 1, 1.0) for i in range(19)], "v long, u long, d double")
    starts = spark.createDataFrame([(0, np.array([81.0]).tobytes(), 0)], "q long, qx binary, u long")
    options = {"steps": 6} if "steps" in nndescent.greedy_search.__code__.co_varnames else {}
    found = nndescent.greedy_search(Scratch(spark), nodes, roads, starts, beam=4, kind="<f8", **options).collect()
    assert {r.u for r in found} == {16, 17, 18, 19}


def test_exact_search_ties(spark):
    """Many equal distances at the edge: the smallest ids are taken, in whatever block they are."""
    from quillon.llm.nndescent import exact_search

    rows = [(0, 0, [0.0, 0.0])] + [(v, 0, [float(np.cos(v)), 0.0] if v % 50 == 7 else [1.0, 0.0] if v % 2 else [0.0, 1.0]) for v in range(1, 3000)]
    nodes = spark.createDataFrame(rows, "v long, grp int, x array<double>").selectExpr("v", "grp", "x")
    packed = nodes.rdd.map(lambda r: (r.v, r.grp, np.array(r.x).tobytes())).toDF("v long, grp int, x binary")
    asked = packed.where("v = 0").selectExpr("v as q", "grp", "x as qx")
    for few in (True, False):
        got = exact_search(packed, asked, 40, "<f8", few).orderBy("d", "u").collect()
        d = sorted((float(np.linalg.norm(x)), v) for v, _, x in rows)[:40]
        assert [(r.u, r.d) for r in got] == [(v, pytest.approx(dist)) for dist, v in d]


def test_two_large_groups_of_near_copies(spark):
    """Two groups of 600 vectors at cosine 0.985 of each other: every link counted, one component each."""
    rng = np.random.default_rng(5)
    rows = []
    for g in range(2):
        base = rng.normal(size=32)
        base /= np.linalg.norm(base)
        for k in range(600):
            other = rng.normal(size=32)
            other -= other @ base * base
            v = base + other / np.linalg.norm(other) * np.sqrt(1 / 0.985 - 1)
            rows.append((g * 600 + k, (v / np.linalg.norm(v)).tolist(), 1))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in nndescent.near_duplicate_vectors(df, least=0.98).collect()}
    x = np.array([r[1] for r in rows])
    counts = (x @ x.T >= 0.98).sum(1) - 1
    assert [got[k].n_links for k in range(1200)] == counts.tolist()
