import pytest
from pyspark.sql import functions as F

from quillon.config import EngineConfig
from quillon.functions import render
from quillon.operators import integrity, lineage
from quillon.plans.search import Request, RequestError, SearchEngine, plan_scope
from quillon.sources import settings


@pytest.mark.parametrize("bad", [{"query": ""}, {"query": " x"}, {"query": "x" * 1501}, {"query": "x", "top_k": 6}, {"query": "x", "top_k": True}, {"query": "x", "query_alt": "y"}, {"query": "x", "query_alt": "y", "query_alt_language": "de"}])
def test_requests(bad):
    with pytest.raises(RequestError) as e:
        Request(**bad)
    assert e.value.status == 422


def test_scopes():
    assert plan_scope("both") == (["homelab", "ai"], None)
    assert plan_scope("both", available={"ai"}, allow_degraded=True) == (["ai"], "degraded_explicit_both")
    for args, status in (({"scope": "auto"}, 409), ({"scope": "x"}, 422), ({"scope": "both", "granted": {"ai"}}, 403), ({"scope": "ai", "available": set(), "allow_degraded": True}, 503), ({"scope": "both", "available": {"ai"}}, 503)):
        with pytest.raises(RequestError) as e:
            plan_scope(**args)
        assert e.value.status == status


def engine(spark, newer=None):
    rows = [("homelab", 1, "Docker networking", "bridge and ports", "docker", "2026-01-01"), ("homelab", 2, "[SUPERSEDED] WireGuard", "peers", "vpn", "2026-01-01"), ("ai", 3, " ", "plex transcoding", "https://x.org/a", "2020-01-01"), ("homelab", 4, "Plex nexus", "transcoding plex", "", "2026-01-01")]
    e = spark.createDataFrame(rows, "corpus string, id long, title string, content string, tags string, created_at string").withColumn("created_at", F.to_timestamp("created_at")).withColumn("summary", F.lit(""))
    v = spark.createDataFrame([(1, "homelab", [1.0, 0.0]), (2, "homelab", [0.95, 0.3122]), (3, "ai", [0.8, 0.6]), (9, "homelab", [1.0, 0.0])], "id long, corpus string, x array<double>")
    return SearchEngine(e, v, EngineConfig(), newer)


def test_search_end_to_end(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0], "plex transcoding")], "qid long, qx array<double>, text string")
    newer = spark.createDataFrame([("homelab", 1, "homelab", 4, "updates", 1), ("homelab", 1, "homelab", 77, "corrects", 2)], "dst_corpus string, dst_id long, src_corpus string, src_id long, relation string, rank int")
    got = {r.ref: r for r in engine(spark, newer).search(q).collect()}
    assert set(got) == {"homelab:1", "homelab:2", "ai:3", "homelab:4"}  # 9 has no entry, 4 comes from the lexical lane
    assert got["homelab:1"].rank == 1 and got["homelab:2"].final_score < 0.11
    assert got["ai:3"].title == "Untitled" and got["ai:3"].link == "https://x.org/a" and got["homelab:1"].link == "kb://homelab/1"
    assert [n.src_id for n in got["homelab:1"].newer] == [77]  # the other one is a result itself
    route = engine(spark).route(q.drop("text")).first()
    assert (route.scope, route.reason) == ("both", "both_strong")
    watch = spark.createDataFrame([("homelab", 1), ("homelab", 2), ("ai", 3), ("homelab", 9)], "corpus string, id long")
    trace = {r.id: r.eliminated_before for r in engine(spark).watched(q, watch).collect()}
    assert trace == {1: None, 2: None, 3: None, 9: "no_entry"}
    assert engine(spark).evidence(q.drop("text"), 0.42).count() == 1
    assert engine(spark).trace_dual(q.drop("text"), spark.createDataFrame([(1, [0.0, 1.0])], "qid long, qx array<double>")).count() == 0
    assert engine(spark).search(q.where("qid > 1")).count() == 0


def test_chains(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (5, 7), (8, 9), (10, 9), (11, 12), (12, 11)], "src long, dst long")
    assert sorted((r.head, r.node, r.level) for r in lineage.chains(e).collect()) == [(1, 1, 0), (1, 2, 1), (1, 3, 2)]


def test_health(spark):
    e = spark.createDataFrame([("ai", 1, "x"), ("ai", 2, None), ("ai", 3, "x")], "corpus string, id long, embedded_at string")
    v = spark.createDataFrame([("ai", 1, [1.0]), ("ai", 9, [float("nan")]), ("ai", 8, None)], "corpus string, id long, x array<double>")
    assert integrity.health(e, v, {"dim": 1}, {"dim": 2}) == {"healthy": False, "missing": 1, "orphan": 2, "settings": ["dim"]}
    assert {r.id: r.fault for r in integrity.vector_faults(v, 1).collect()} == {9: "not finite", 8: "null"}


def test_settings():
    assert settings.load_config("reject: 0.3\n") == EngineConfig(reject=0.3)
    for bad in ("nope: 1", "reject: true", "reject: x", "reject: 0.9"):
        with pytest.raises(ValueError):
            settings.load_config(bad)
    settings.check_pin(EngineConfig(), EngineConfig().fingerprint())
    with pytest.raises(ValueError):
        settings.check_pin(EngineConfig(reject=0.1), EngineConfig().fingerprint())
    ok = "clients: {a: {token_env: A, allowed_corpora: [ai], allowed_scopes: [ai]}}"
    assert settings.load_grants(ok)["a"]["allowed_corpora"] == ["ai"]
    for bad in (ok.replace("[ai], allowed_s", "[x], allowed_s"), ok.replace("scopes: [ai]", "scopes: [both]")):
        with pytest.raises(ValueError):
            settings.load_grants(bad)
    rules, allowed = settings.load_rules('{"patterns": [{"name": "p", "regex": "k=(\\\\w+)", "action": "redact", "capture_group": 1}], "allowlist": [" ABC "]}')
    assert rules[0].group == 1 and allowed == {"abc"}
    with pytest.raises(ValueError):
        settings.load_rules('{"patterns": [], "patterns": []}')


def test_rendering():
    r = lambda c, n: {"corpus": c, "ref": f"{c}:{n}", "title": "t", "score": 0.5, "content": "body"}
    text = render.mixed_text([r("ai", 1), r("homelab", 2), r("ai", 3), r("ai", 4), r("homelab", 5)])
    assert "ai:4" not in text and text.endswith("1 more AI result(s) omitted") and text.index("ai:1") < text.index("homelab:2") < text.index("ai:3")
    assert render.mixed_text([]) == "No results."
    note = {"relation": "updates", "ref": "homelab:9", "title": "x", "preview": "p"}
    assert render.warning_line(note) == "⚠ newer note updates this: homelab:9 — x\n  p"
    assert "p" not in render.warning_line(note | {"relation": "extends"}).split("—")[1]
    assert render.history_text(["a", "b"], [], "b", ["c"], ["w"], True) == "a → b ← current\nbroken link: c\ntruncated\nwarning: w"
