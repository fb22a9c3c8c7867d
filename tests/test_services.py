"""What surrounds the search: logs, models, answers, stored notes, health, and the library without its llm subpackage."""

import json
import os
import shutil
import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillon.config import EngineConfig
from quillon.functions import embedding, synthesis
from quillon.operators import evals, integrity, lineage, querylog, store
from quillon.operators.atlas import page
from quillon.operators.relations import NewerNotes
from quillon.plans.search import Request, RequestError, SearchEngine
from quillon.sources import adapters, settings
from quillon.streaming import ingest

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # Python workers can't import tests

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("without", ["folders", "pipeline"])
def test_library_without_llm(tmp_path, without):
    copy = tmp_path / "repo"
    gone = shutil.ignore_patterns("llm", "__pycache__", ".git", "corpus_pipeline.py") if without == "folders" else shutil.ignore_patterns("__pycache__", ".git", "corpus_pipeline.py")
    shutil.copytree(HERE, copy, ignore=gone)
    code = "import __spark_entry__ as e; q = sorted(e.queries()); assert set(e.oracle_sql()) <= set(q); print(len(q), any(n.startswith('op1_') for n in q), 'pipeline' in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}  # else the whole repository could be found there
    got = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    n, llm, pipeline = got.stdout.split()
    assert int(n) > 80 and pipeline == "False" and llm == str(os.path.isdir(copy / "quillon" / "llm")), got.stderr


# --- Query log ------------------------------------------------------------------------------------------------------

GOOD = {"client": "a.b-1", "scope": "both", "selected_scope": "ai", "query": "password: hunter2 dns", "query_alt": None, "query_alt_language": None, "ranked": [("ai:7", 0.5)], "elapsed_ms": 1.23456, "status": None, "category": None}


@pytest.mark.parametrize("change, fault", [
    ({}, None), ({"client": "a b"}, "client"), ({"client": "x" * 65}, "client"), ({"client": None}, "client"), ({"scope": "all"}, "scope"), ({"query": None}, "query"),
    ({"elapsed_ms": float("nan")}, "elapsed_ms"), ({"elapsed_ms": -1.0}, "elapsed_ms"), ({"query_alt_language": "de"}, "query_alt_language"), ({"selected_scope": "none"}, None),
    ({"selected_scope": "x"}, "selected_scope"), ({"ranked": [("ai:0", 0.5)]}, "ranked"), ({"ranked": [("ai:7", float("inf"))]}, "ranked"), ({"ranked": [("ai:7", 0.5)] * 11}, "ranked"),
    ({"ranked": None}, "result"), ({"selected_scope": None}, "result"), ({"ranked": None, "selected_scope": None, "status": 503, "category": "conflict"}, None),
    ({"status": 200, "category": "conflict"}, "status"), ({"status": 404, "category": "lost"}, "category"), ({"status": 404}, "category"), ({"query": "x" * 40_000}, "length"),
])
def test_log_records(spark, change, fault):
    row = querylog.checked(spark.createDataFrame([GOOD | change], querylog.FIELDS)).first()
    assert row.fault == fault and (row.line is None) == (fault is not None)


def test_log_lines_hold_no_secrets(spark, tmp_path):
    rows = spark.createDataFrame([GOOD, GOOD | {"query": "plain"}, GOOD | {"scope": "x"}], querylog.FIELDS).withColumn("ts", F.lit("2026-01-05 10:00:00").cast("timestamp"))
    querylog.append(rows, str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log")).collect()
    lines = sorted((json.loads(r.line) for r in back), key=lambda x: x["query"])
    assert [x["query"] for x in lines] == ["<REDACTED> dns", "plain"] and {str(r.day) for r in back} == {"2026-01-05"}
    assert lines[0]["redacted"] is True and "redacted" not in lines[1] and lines[0]["elapsed_ms"] == 1.235
    audit = spark.range(1).select(querylog.audit_line("search", scope=F.lit("both"), client=F.lit("c"))).first()[0]
    assert audit == '{"client":"c","event":"search","scope":"both"}'


def test_logged_stream(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = spark.createDataFrame([GOOD, GOOD | {"scope": "x"}], querylog.FIELDS).withColumn("ts", F.lit("2026-01-05 10:00:00").cast("timestamp"))
    rows.write.parquet(src)
    for _ in range(2):  # again: nothing new
        stream = spark.readStream.schema(rows.schema).parquet(src)
        ingest.log_queries(stream, f"file://{tmp_path}/log", f"file://{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log/records")).count() == 1
    assert spark.read.parquet(str(tmp_path / "log/faults")).select("fault", "count").collect() == [("scope", 1)]
    assert ingest.pace(5) == {"processingTime": "5 seconds"}


# --- Models and answers ---------------------------------------------------------------------------------------------


class Counts(embedding.HashEmbedder):
    """Counts its calls and the texts in them; fails on lists with a bad text."""

    def __init__(self, path=None):
        super().__init__()
        self.path = path

    def passage_embed(self, texts):
        with open(self.path, "a") as out:
            out.write(f"{len(texts)}\n")
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return super().query_embed(texts)


def test_vectors_of_lists():
    model = embedding.HashEmbedder()
    two = embedding.vectors_of(model, ["network", "networks"], "query")
    assert two[0] == two[1] and len(two[0]) == 768 and sum(v * v for v in two[0]) == pytest.approx(1)
    assert embedding.vectors_of(model, ["x"], "passage", dimension=5) == [None]

    class Odd(embedding.HashEmbedder):
        def query_embed(self, texts):
            return ([float("nan")] * 768 if "bad" in t else [1.0] * (5 if "short" in t else 768) for t in texts)

    got = embedding.vectors_of(Odd(), ["a", "bad", "short", "b"], "query")
    assert [v is None for v in got] == [False, True, True, False]


def test_entries_are_embedded(spark, tmp_path):
    calls = str(tmp_path / "calls")
    rows = [("ai", 1, "net", "", "x" * 9000, "a"), ("ai", 2, "", None, " ", "")] + [("ai", k, f"t{k}", "", "", None) for k in range(10, 130)] + [("ai", 3, "bad", "", "", None)]
    e = spark.createDataFrame(rows, "corpus string, id long, title string, summary string, content string, tags string").coalesce(1)
    made, failed = embedding.embed_entries(e, lambda: Counts(calls))
    assert made.count() == 121 and [r.id for r in failed.collect()] == [3] and made.count() == 121
    sizes = [int(x) for x in open(calls)]
    assert sorted(sizes) == sorted([50, 50, 22] + [1] * 22)  # the model ran once; the texts of the failed list went one by one
    text = e.select(embedding.embed_text(F.col("title"), F.col("summary"), F.col("content"), F.col("tags"))).first()[0]
    assert text == "Title: net\n" + "x" * 8000 + "\nTags: a"


ANSWER = {"answer": " yes ", "kb_match_confirmed": True, "operational_relevance": "indirect", "supporting_evidence": [{"entry_id": 7, "match_reason": " same "}]}
ODD_ANSWERS = [
    {"answer": " "}, {"answer": "x" * 4001}, {"kb_match_confirmed": False}, {"operational_relevance": "maybe"}, {"supporting_evidence": [{"entry_id": 8, "match_reason": "x"}]},
    {"supporting_evidence": [{"entry_id": 7, "match_reason": " "}]}, {"supporting_evidence": [{"entry_id": 7, "match_reason": "x" * 501}]}, {"supporting_evidence": ANSWER["supporting_evidence"] * 2},
    {"supporting_evidence": []}, {"supporting_evidence": [], "kb_match_confirmed": False},
]


def test_answers_of_a_model(spark):
    got = synthesis.accept(ANSWER, {7})
    assert got["answer"] == "yes" and got["supporting_evidence"] == [{"entry_id": 7, "match_reason": "same"}]
    assert synthesis.status_of(got) == "operationally_relevant" and synthesis.status_of(got | {"operational_relevance": "not_confirmed"}) == "kb_match_only" and synthesis.status_of(None) == "not_confirmed"
    for odd in [*ODD_ANSWERS, {"more": 1}, {"kb_match_confirmed": 1}]:
        with pytest.raises(ValueError):
            synthesis.accept(ANSWER | odd, {7})
    rows = [(ANSWER | odd,) for odd in ({}, *ODD_ANSWERS)]
    df = spark.createDataFrame(rows, f"a struct<{synthesis.ANSWER.replace(' ', ':')}>".replace(",:", ","))
    fine = [r[0] for r in df.select(synthesis.acceptable(F.col("a"), F.array(F.lit(7).cast("long")))).collect()]
    assert fine == [True] + [False] * len(ODD_ANSWERS)
    results = [{"entry_id": 7, "title": "", "content": "c" * 3000, "final_score": 0.9}]
    seen = []
    out = synthesis.synthesize({"title": "t"}, "q", results, lambda c: seen.append(c) or ANSWER)
    assert out["supporting_entries"][0]["title"] == "Untitled" and len(seen[0]["kb_entries"][0]["excerpt"]) == 2000
    assert synthesis.synthesize({}, "q", [], lambda c: 1 / 0)["model_calls"] == 0
    assert synthesis.without_thoughts("<think>a\nb</think>\n answer") == "answer"
    r = spark.createDataFrame([(1, 7, "", "sum", "", 0.5, 1)], "qid long, id long, title string, summary string, content string, final_score double, n int")
    assert synthesis.excerpts(r).first().entries[0].asDict() == {"n": 1, "entry_id": 7, "title": "Untitled", "final_score": 0.5, "excerpt": "sum"}


def corpus(spark):
    rows = [("homelab", 1, "Docker networking", "", "bridge and ports"), ("homelab", 2, "WireGuard", "", "peers and keys"), ("ai", 3, "Plex", "transcoding", "")]
    e = spark.createDataFrame(rows, "corpus string, id long, title string, summary string, content string").withColumn("tags", F.lit("")).withColumn("created_at", F.lit("2026-01-01").cast("timestamp"))
    made, _ = embedding.embed_entries(e, embedding.HashEmbedder)
    return e, made.withColumn("x", F.col("x"))


def test_search_with_models(spark):
    e, v = corpus(spark)
    engine = SearchEngine(e, v, EngineConfig(max_distance=2.0), embedder=embedding.HashEmbedder, scorer=embedding.OverlapScorer)
    q = engine.queries(spark.createDataFrame([(1, "plex transcoding"), (2, "docker bridge")], "qid long, text string"))
    got = {r.qid: r for r in engine.search(q).where("rank = 1").collect()}
    assert (got[1].ref, got[2].ref) == ("ai:3", "homelab:1") and got[1].relevance == round(1 / (1 + np.exp(-1)), 4)  # the text alone is judged: one of two words
    answer = {r.qid: r for r in engine.respond(q, Request("x")).collect()}
    assert answer[1].ranked[0] == "ai:3" and answer[1].ai["count"] == 1 and answer[1].homelab.searched and answer[1].lexical_candidates == 0  # all are in the semantic list
    audit = json.loads(answer[2].audit)
    assert audit["event"] == "search" and "docker" not in answer[2].audit and audit["homelab_count"] == answer[2].homelab["count"]
    half = engine.respond(q, Request("x", allow_degraded=True), available={"ai"}).where("qid = 1").first()
    assert (half.selected_scope, half.routing_reason, half.degraded, half.homelab.available) == ("ai", "degraded_explicit_both", ["homelab"], False)
    with pytest.raises(RequestError):
        SearchEngine(e, v, EngineConfig()).queries(q)
    folder = engine._made[0]._quillon_path.removeprefix("file://")
    assert os.path.isdir(folder)
    engine.forget()
    assert not os.path.isdir(folder)


def test_search_goes_on_without_its_index(spark, tmp_path):
    from quillon.operators.lexical import LexicalIndex

    e, v = corpus(spark)
    index = LexicalIndex(spark, str(tmp_path / "index"), lambda: e, EngineConfig())
    engine = SearchEngine(e, v, EngineConfig(max_distance=2.0), index=index, embedder=embedding.HashEmbedder)
    q = engine.queries(spark.createDataFrame([(1, "docker bridge")], "qid long, text string"))
    assert engine.candidates(q).where("id = 1").count() == 1 and not engine.status
    shutil.rmtree(tmp_path / "index")
    assert engine.candidates(q).count() == 3 and engine.status == {"lexical": "lexical index unusable"}


def test_newer_notes_follow_their_source(spark, tmp_path):
    rows, now = [("ai", 1, "old", "x", "2026-01-01"), ("ai", 2, "updates ai:1", "text", "2026-01-02")], [0.0]
    source = lambda: spark.createDataFrame(rows, "corpus string, id long, title string, content string, created_at string")
    notes = NewerNotes(spark, str(tmp_path / "newer"), source, clock=lambda: now[0])
    results = spark.createDataFrame([(5, "ai", 1)], "qid long, corpus string, id long")
    assert notes.warn(results)[1] == "newer notes unusable" and notes.warn(results)[0].first().newer is None
    assert notes.refresh() is None and [n.src_id for n in notes.warn(results)[0].first().newer] == [2]
    rows.append(("ai", 3, "corrects ai:1", "text", "2026-01-03"))
    now[0] = 40
    assert notes.refresh() is None and [n.src_id for n in notes.warn(results)[0].first().newer] == [3, 2]


# --- Stored notes ---------------------------------------------------------------------------------------------------


def test_quarantine(spark):
    rows = [("ai", 1, "t", None, "password: hunter2", "x"), ("ai", 2, "t", "", "mail a@b.org", ""), ("ai", 3, None, None, None, None)]
    e = spark.createDataFrame(rows, "corpus string, id long, title string, summary string, content string, tags string")
    clean, found = store.quarantine(e)
    assert {r.id: r.content for r in clean.collect()} == {1: "password: <REDACTED>", 2: "mail a@b.org", 3: None}
    assert [(r.id, r.rules) for r in found.collect()] == [(1, ["password"])] and clean.columns == e.columns


@pytest.mark.parametrize("raw, want", [
    ("no secrets\u2028here\r\n", "no secrets\u2028here\r\n"),
    ("---\ntitle: \"password: hunter2\"\ntype: note\n---\nbody", "---\ntitle: \"password: <REDACTED>\"\ntype: note\n---\nbody"),
    ("---\r\ntags: pwd=abcd, x\r\nother: password: hunter2\r\n---\r\npassword: hunter2 x", "---\r\ntags: \"pwd=<REDACTED> x\"\r\nother: password: hunter2\r\n---\r\npassword: <REDACTED> x"),
    ("---\ntitle: password: hunter2", "---\ntitle: password: <REDACTED>"),
])
def test_raw_notes_are_sanitised(raw, want):
    assert store.sanitise_note(raw) == want


def test_raw_files_are_written_once(spark, tmp_path):
    rows = [("ai", 1, "note", 'A "b" <c>', "x, y", "body", "2026-01-05T00:00:00"), ("ai", 2, "url", "", "", "http", None)]
    e = spark.createDataFrame(rows, "corpus string, id long, type string, title string, tags string, content string, created_at string")
    assert sorted(r.written for r in store.write_raw_files(e, str(tmp_path)).collect()) == [True, True]
    first = (tmp_path / "notes/2026-01-05-a-b-c.md").read_text()
    assert first == '---\ntype: note\ntitle: "A \\"b\\" <c>"\ntags: "x, y"\nsaved: 2026-01-05T00:00:00\n---\n\nbody' and (tmp_path / "urls/unknown-entry-2.md").exists()
    again = store.write_raw_files(e.withColumn("content", F.lit("other")), str(tmp_path))
    assert sorted(r.written for r in again.collect()) == [False, False] and (tmp_path / "notes/2026-01-05-a-b-c.md").read_text() == first
    back = adapters.raw_notes(spark, str(tmp_path)).where("type = 'note'").first()
    assert (back.title, back.tags, back.content, back.saved) == ('A "b" <c>', "x, y", "body", "2026-01-05T00:00:00")
    known = spark.createDataFrame([(back.raw_path,)], "raw_path string")
    assert [r.type for r in adapters.raw_notes(spark, str(tmp_path), known).collect()] == ["url"]
    (tmp_path / "notes/latin.md").write_bytes("caf\u00e9".encode("latin-1"))
    assert adapters.raw_notes(spark, str(tmp_path)).where("title = 'latin'").first().content == "caf\u00e9"


def test_meta_and_versions(spark, tmp_path):
    meta = spark.createDataFrame([("a", "1")], "key string, value string")
    assert store.is_stale(meta)
    meta = store.put(meta, spark.createDataFrame([("edges_stale", "0"), ("a", "2")], "key string, value string"))
    assert not store.is_stale(meta) and {r.key: r.value for r in meta.collect()} == {"a": "2", "edges_stale": "0"}
    assert store.is_stale(store.put(meta, spark.createDataFrame([("edges_stale", "1")], "key string, value string")))
    for n in (1, 2):
        store.publish(spark.range(n), str(tmp_path / "t"))
    os.makedirs(tmp_path / "t/version=99999999999999999999-x")  # not whole
    assert store.latest(spark, str(tmp_path / "t")).count() == 2
    v = spark.createDataFrame([("ai", 1), ("ai", 9)], "corpus string, id long")
    e = spark.createDataFrame([("ai", 1)], "corpus string, id long")
    assert [r.id for r in store.prune(v, e).collect()] == [1] == [r.id for r in store.remove_late(v, e).collect()]
    new = store.add(e.withColumn("title", F.lit("x")), e.withColumn("id", F.lit(2).cast("long")).withColumn("title", F.lit("A b/c")))
    assert {r.id: r.raw_path for r in new.collect()} == {1: None, 2: "notes/a-b-c.md"}


def test_evaluation_sets(spark, tmp_path):
    (tmp_path / "golden.json").write_text(json.dumps([{"id": "q1", "category": "c", "query": "x", "expected_refs": ["ai:1"]}, {"id": "q2", "category": "c", "query": "y"}]))
    g = {r.id: r for r in adapters.eval_set(spark, str(tmp_path / "golden.json"), "golden").collect()}
    assert g["q1"].expected_scope == "both" and g["q1"].must_find_min == 1 and g["q2"].expected_refs == []
    rows = [("a", ["1", "2"], ["2", "3"], 1, ["1"]), ("a", [], ["9"], 1, None), ("b", ["5"], [], 0, None)]
    judged = evals.golden(spark.createDataFrame(rows, "category string, found array<string>, expected array<string>, must_find int, alt array<string>"))
    report = {r.category: r for r in evals.golden_report(judged).collect()}
    assert (report[None].total, report[None].passed, report[None].recall, report[None].noise, report[None].parity, report[None].pass_rate) == (3, 2, 0.5, 0.5, 0.5, 0.667)
    evals.write_report(evals.golden_report(judged), judged, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/report")).count() == 3


def test_history_contract(spark):
    e = spark.createDataFrame([((i - 1) // 2, i) for i in range(1, 251)] + [(900, 901), (901, 900), (902, 903)], "src long, dst long")
    known = spark.createDataFrame([(i,) for i in [*range(300), 900, 901, 902]], "node long")
    starts = spark.createDataFrame([(0,), (900,), (902,), (5000,)], "node long")
    got = {r.src: r for r in lineage.histories(e, starts, known).collect()}
    assert len(got[0].nodes) == 200 and got[0].truncated and got[0].completeness == "partial" and len(got[0].edges) == 250
    assert [n.node for n in got[900].nodes] == [900, 901] and len(got[900].edges) == 2 and got[900].completeness == "complete"
    assert [(b.src, b.dst) for b in got[902].broken] == [(902, 903)] and got[902].completeness == "partial"
    assert [n.missing for n in got[5000].nodes] == [True] and got[5000].edges == [] and got[5000].completeness == "complete"
    assert lineage.histories(e, starts, known, stale=True).where("src = 900").first().completeness == "partial"
    edges = spark.createDataFrame([("ai", 1, "ai", 2)], "src_corpus string, src_id long, dst_corpus string, dst_id long")
    assert lineage.edge_health(edges, edges, False) == {"stale": False, "missing": 0, "extra": 0, "consistent": True}
    assert lineage.edge_health(edges.limit(0), edges, False)["missing"] == 1


def test_corpus_health(spark):
    e = spark.createDataFrame([("ai", 1, "x", "2026-01-01"), ("homelab", 2, None, "2026-01-01")], "corpus string, id long, embedded_at string, created_at string")
    v = spark.createDataFrame([("ai", 1, [1.0])], "corpus string, id long, x array<double>")
    meta = integrity.METADATA | {"corpus": "ai", "embedding_model": "m", "embedding_dimension": 1, "created_at": "t"}
    ask = lambda **k: integrity.corpus_health("ai", e, k.get("v", v), k.get("meta", meta), "m", 1, k.get("ready", True))["reason"]
    assert ask() is None and ask(meta=None) == ask(meta=meta | {"space": "l2"}) == "collection_metadata_mismatch"
    assert ask(ready=False) == "reranker_unavailable" and ask(v=v.limit(0)) == "id_mismatch missing=1 orphan=0"
    assert ask(v=v.withColumn("x", F.array(F.lit(float("nan"))))) == "vector_faults" and ask(v=v.drop("x")) == "dependency_unavailable"
    assert integrity.valid_ids(spark.createDataFrame([("7",), ("0",), ("x",), ("",), ("9" * 30,)], "id string")).collect() == [(7,)]


def test_switches_and_places():
    assert settings.switch(None) is False and settings.switch(" TRUE ") is True and settings.switch("false") is False
    with pytest.raises(ValueError):
        settings.switch("yes")
    assert settings.isolated({}) is None and settings.isolated(dict.fromkeys(settings.ISOLATION, "/x"))["raw"] == "/x"
    for bad in ({"raw": "/x"}, {"other": "/x"}):
        with pytest.raises(ValueError):
            settings.isolated(bad)
    assert page({"a": "</script>"}, "x __ATLAS_DATA__ y") == 'x {"a":"\\u003c/script>"} y'


def test_order_statistics(spark):
    rng = np.random.default_rng(1)
    values = {"a": rng.random(1001), "b": rng.integers(0, 3, 500).astype(float), "c": np.array([4.0]), "d": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [("a", None)], "g string, v double")
    got = {r.g: r for r in evals.order_statistics(df, "g", "v").collect()}
    for k, v in values.items():
        assert (got[k].n, got[k].p50, got[k].p95) == (len(v), pytest.approx(np.median(v)), np.sort(v)[int(len(v) * 0.95)])


def test_corpus_store(spark, tmp_path):
    from quillon.plans.corpus import CorpusStore

    raw_file = lambda n: str(tmp_path / f"{n}.md")
    rows = [("ai", n, f"title {n}", "", f"text {n}" + (" password: hunter2" if n == 3 else ""), "", "2026-01-01 00:00:00", None, raw_file(n)) for n in (1, 2, 3)] + [("ai", 4, "t", "", "password: hunter2", "", "2026-01-01 00:00:00", "x", None)]
    for n in (1, 2, 3):
        (tmp_path / f"{n}.md").write_text("raw")
    e = spark.createDataFrame(rows, "corpus string, id long, title string, summary string, content string, tags string, created_at string, embedded_at string, raw_path string")
    v = spark.createDataFrame([("ai", 4, [1.0] * 768), ("ai", 77, [1.0] * 768)], "corpus string, id long, x array<double>")
    c = CorpusStore.create(spark, str(tmp_path / "store"), e, v)
    assert c.embed_pending(embedding.HashEmbedder, F.lit("now")) == {"embedded": 3, "failed": 0, "vanished": 0, "quarantined": 1}
    texts = {r.id: r.content for r in c.table("entries").collect()}
    assert texts[3] == "text 3 password: <REDACTED>" and texts[4] == "password: hunter2"  # embedded entries aren't touched
    assert c.embed_pending(embedding.HashEmbedder, F.lit("now"))["embedded"] == 0
    assert sorted(r.id for r in c.table("vectors").collect()) == [1, 2, 3, 4]
    meta = integrity.METADATA | {"corpus": "ai", "embedding_model": "m", "embedding_dimension": 768, "created_at": "t"}
    health = c.health("ai", meta, "m")
    assert health["ready"] and health["edges"]["stale"] and c.history("ai:1")["completeness"] == "partial"
    c.rebuild_edges()
    c.supersede("ai:1", ["ai:2"])
    c.supersede("ai:2", ["ai:3"])
    raw = (tmp_path / "1.md").read_text()
    assert raw.startswith('---\ntype: note\ntitle: "[SUPERSEDED] title 1"\n') and raw.endswith(f"\n---\n\nSUPERSEDED — use ai:2\n\n{store.NOTICE}\n\n{store.HISTORY}\n\ntext 1")
    assert (tmp_path / "1.md").stat().st_mode & 0o777 == 0o600 and (tmp_path / "3.md").read_text() == "raw"
    got = c.history("ai:2")
    assert got["chain"] == ["ai:1", "ai:2", "ai:3"] and got["completeness"] == "complete" and not got["warnings"]
    for ref, to, says in (("ai:3", ["ai:1"], "leads back"), ("ai:3", ["ai:3"], "replaces itself"), ("ai:3", ["ai:9"], "does not exist"), ("ai:3", [], "no replacement"), ("ai:8", ["ai:1"], "no such entry"), ("ai:4", ["ai:3"], "no raw file")):
        with pytest.raises(ValueError, match=says):
            c.supersede(ref, to)
    assert c.health("ai", meta, "m")["edges"]["consistent"]
    assert c.retire("ai:3") == "retired" and not (tmp_path / "3.md").exists() and (tmp_path / "2.md").exists() and c.history("ai:1")["broken"] == [("ai:2", "ai:3")]
    with pytest.raises(LookupError):
        c.retire("ai:3")
    report, warnings = c.rebuild_edges()
    assert {r.kind: r.n for r in report.collect()} == {"edges": 2, "self": 0, "malformed": 0, "dangling": 1} and warnings == ["ai:2: no ai:3"]
    assert c.recover_raw(str(tmp_path / "raw")) == 3 and c.stale
    raw = adapters.raw_notes(spark, str(tmp_path / "raw"))
    assert c.recover_entries(raw, "ai") == 3 and c.recover_entries(raw, "ai") == 0
    assert c.table("entries").where("raw_path is not null and id > 4").count() == 3


def test_rewriters(spark):
    class Thinks:
        def rewrite(self, query):
            return f"<think>hm</think> {query.upper()}" if query != "none" else "<think></think>"

    q = spark.createDataFrame([("how do the networks work",), ("none",), (None,)], "q string")
    assert [r[0] for r in q.select(embedding.rewritten(Thinks, F.col("q"))).collect()] == ["HOW DO THE NETWORKS WORK", None, None]
    assert q.select(embedding.rewritten(embedding.KeywordRewriter, F.col("q"))).first()[0] == "networks work"


def test_windows_of_event_time(spark, tmp_path):
    rows = [("2026-01-01 10:00:00", "a"), ("2026-01-01 11:00:00", "a"), ("2026-01-03 10:00:00", "b"), ("2026-01-01 09:00:00", "a")]
    spark.createDataFrame(rows, "ts string, event_type string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "src"))
    query = ingest.windowed_counts(stream).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.event_type, r.n) for r in spark.table("windows").collect()) == [("a", 3), ("b", 1)]
