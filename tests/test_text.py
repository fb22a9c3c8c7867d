import sqlite3
import sys

import pytest
from pyspark import cloudpickle

from quillon.functions import passages
from quillon.functions import text as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # Python workers can't import tests


@pytest.mark.parametrize("query, terms", [
    ("How do I restart the Docker container?", ["restart", "docker", "container"]),
    ("the a of", []),
    ("Kako da podesim serverima pi-hole", ["podesim", "server", "pi-hole"]),
    ("Žuti ČAJ café café", ["zuti", "caj", "cafe"]),
])
def test_query_terms(query, terms):
    assert T.query_terms(query) == terms


def match_expression(terms):
    """What FTS5 is asked for: any of the terms, some as beginnings."""
    return " OR ".join(f'"{t}"' + "*" * T.is_prefix(t) for t in terms)


def test_match_expression():
    assert match_expression(["plex", "pi-hole", "dns"]) == '"plex"* OR "pi-hole" OR "dns"'
    assert T.query_phrases("the networks, pi-hole and dns") == [(["network"], True), (["pi", "hole"], False), (["dn"], False)]


def test_porter_equals_sqlite():
    words = """caresses ponies ties cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing
    fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli
    analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti
    triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable
    defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize
    probate rate cease controll roll transcodings keys networking containers generalizations oscillators""".split()
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61 remove_diacritics 2')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, row)")
    for w in words:
        con.execute("DELETE FROM t")
        con.execute("INSERT INTO t VALUES (?)", (w,))
        assert con.execute("SELECT term FROM v").fetchone()[0] == T.porter(w), w


class Letters:
    """A tokenizer of letters; ``wide``: in a text that begins inside a word, that word counts twice."""

    special, limit = 3, 43

    def offsets(self, text):
        return [(k, k + 1) for k in range(len(text))]


class Pieces(passages.WordTokenizer):
    limit, special = 23, 3

    def offsets(self, text):
        return [(a, a + 1) if k == 0 and text[a].islower() else (a, b) for a, b in super().offsets(text) for k in range(1 + text[a].islower())]


@pytest.mark.parametrize("query, content, want", [
    ("x", "short text", "short text"),
    ("wireguard peers", "filler " * 300 + "wireguard " + "filler " * 300, "wireguard"),
    ("network", "pad " * 200 + 'see "network-bridge" (network) here ' + "pad " * 200, "(network)"),  # marks about a word don't hide it
    ("Café", "pad " * 200 + "the CAFÉS " + "pad " * 200, "CAFÉS"),
    ("nothing of it", "first " + "pad " * 400, "first"),  # no evidence: the beginning
    ("kako mreza serverima", "pad " * 200 + "server " + "pad " * 200, "server"),  # the query's case endings
    ("bridge", "pad " * 200 + "footbridge " + "pad " * 250 + "bridges " + "pad " * 200, "bridges"),  # words begin with a term
    ("rare common", "common " + "pad " * 150 + "common " * 3 + "pad " * 150 + "rare " + "pad " * 150 + "common", "rare"),
    ("  leading", "\n pad\t" * 200 + "leading\x0b", "leading"),
])
def test_passages(spark, query, content, want):
    rows = spark.createDataFrame([(query, content)], "q string, c string")
    got = passages.with_passage(rows, passages.WordTokenizer, "q", "c").first().passage
    assert want in got and got in content and (got == content or len(got.split()) <= 125 - len(query.split()))


def test_passages_by_the_scorers_tokens(spark):
    """Windows are in the tokenizer's units, and shorter where a cut text has more tokens than it had in its place."""
    content = "abcdefghij " * 20 + "needle " + "abcdefghij " * 20
    rows = spark.createDataFrame([("needle", content), ("q", None)], "q string, c string")
    got = {r.q: r.passage for r in passages.with_passage(rows, Letters, "q", "c").collect()}
    assert "needle" in got["needle"] and len(got["needle"]) == 34 and got["q"] == ""
    assert abs(got["needle"].index("needle") + 3 - 17) <= 9  # the window in which it stands near the middle
    assert passages.room_for(Letters(), "x" * 1000) == 20 and passages.room_for(Letters(), "x" * 7) == 33
    with pytest.raises(ValueError):
        passages.room_for(type("Narrow", (Letters,), {"limit": 3})(), "x")
    text = "One two three Four five six Seven eight"
    for window in passages.spans(Pieces(), text, 4):
        assert len(Pieces().offsets(window)) <= 4 or len(window.split()) == 1


def test_equal_windows_go_by_the_middle_then_by_place(spark):
    content = " ".join(["pad"] * 100 + ["needle"] + ["pad"] * 400 + ["needle"] + ["pad"] * 100)
    windows = passages.spans(passages.WordTokenizer(), content, 124)
    central = [passages.centrality(w, ["needle"]) for w in windows]
    got = passages.with_passage(spark.createDataFrame([("needle", content)], "q string, c string"), passages.WordTokenizer, "q", "c").first().passage
    assert got == windows[central.index(max(central))] and max(central) > 0.6


@pytest.mark.parametrize("title, want", [
    ("This updates homelab:963", [("homelab", 963, "updates", "ref")]),
    ("This no longer mentions homelab:963", []),
    ("not updates homelab:963", []),
    ("corrects #5 and #7", [("homelab", 5, "corrects", "hash"), ("homelab", 7, "corrects", "hash")]),
    ("corrects #6", []),
    ("replaces KB 413", [("homelab", 413, "replaces", "label")]),
    ("replaces KB 414", []),
    ("replaces KB 99", []),
    ("updates one two three four five six homelab:3", [("homelab", 3, "updates", "ref")]),
    ("updates one two three four five six seven homelab:3", []),
    ("It updates things. See homelab:3", []),
    ("ispravlja ai:12", [("ai", 12, "corrects", "ref")]),
    # a bare number is of the note's own corpus, and known
    ("updates ai:882 and 529", [("ai", 882, "updates", "ref"), ("homelab", 529, "updates", "bare")]),
    ("updates homelab:3 and 4", [("homelab", 3, "updates", "ref")]),
    ("corrects #36403 and 529", []),
    ("updates homelab:3 or 5 & 7", [("homelab", 3, "updates", "ref"), ("homelab", 5, "updates", "bare"), ("homelab", 7, "updates", "bare")]),
    ("updates section 5 and 7", []),
    # every reference has a verb of its own near enough
    ("updates homelab:3 one two three four five and six #5", [("homelab", 3, "updates", "ref")]),
    ("updates homelab:3 and corrects ai:9", [("homelab", 3, "updates", "ref"), ("ai", 9, "corrects", "ref")]),
    ("updates homelab:992 and homelab:3", [("homelab", 3, "updates", "ref")]),
    ("first\nupdates homelab:3", []),
    ("this corrects: homelab:3, which updates homelab:3", [("homelab", 3, "corrects", "ref")]),
])
def test_change_relations(title, want):
    known = {3, 5, 7, 413, 529, 963}
    got = [(r["dst_corpus"], r["dst_id"], r["relation"], r["form"]) for r in T.change_relations("homelab", 992, title, "", known)]
    assert got == want


def test_title_goes_before_the_opening():
    got = T.change_relations("ai", 1, "extends ai:2", "corrects ai:2 and updates ai:3\n\nreplaces ai:4", set())
    assert [(r["dst_id"], r["relation"], r["where"]) for r in got] == [(2, "extends", "title"), (3, "updates", "content")]
    assert T.change_relations("ai", 1, "", "\nupdates ai:3", set()) == []  # a blank first line


@pytest.mark.parametrize("content, title, want", [
    ("", "t", ""),
    ("\n\n# The Title\n\nTags: a, b\nfirst  line\nsecond\n \nother", "the title", "first line second"),
    ("Tags: a\n\nbody", "t", "body"),
    ("body\nTags: a", "t", "body Tags: a"),
    ("word " * 100, "t", "word " * 59 + "word …"),
    ("x" * 301, "t", "x" * 300 + " …"),
])
def test_preview(content, title, want):
    assert T.preview(content, title) == want


def test_redaction():
    assert T.redact("password: hunter2 extra words") == ("password: <REDACTED> extra words", ["password"])
    assert T.redact("password: <REDACTED> x")[0] == "password: <REDACTED> x"
    assert T.redact("mail a@b.org")[1] == ["email"] and "a@b.org" in T.redact("mail a@b.org")[0]
    assert T.redact("password: abc", allowed=frozenset(["abc"]))[0] == "password: abc"
    assert T.redact_query("password: hunter2 and more") == "<REDACTED> and more"
    assert T.shannon("") == 0 and abs(T.shannon("ab") - 1) < 1e-12


def test_cuts():
    assert T.paragraph_cut("x" * 2000) == "x" * 2000
    assert T.paragraph_cut("a " * 1001).endswith(" …")
    body = "p" * 1300 + "\n\n" + "q " * 500
    assert T.paragraph_cut(body) == "p" * 1300 + " …"
    assert T.content_head("\nfirst") == "" and T.content_head("a\nb\n\nc") == "a\nb"
    assert T.preview("# Title\nTags: x\nBody text here", "Title") == "Body text here"


def test_lexical_lane_equals_sqlite(spark):
    """Candidates and scores of random notes and queries against SQLite's own index of the same words."""
    import random

    from quillon.config import EngineConfig
    from quillon.operators import lexical

    rng = random.Random(7)
    stems = "network networks networking pi hole pi-hole Größe grosse café cafes key keys transcoding transcodings transcoder dns host hosting hosted relation relational x1 v2.5 über container the and servera serverima mreza naïve".split()
    text = lambda n: " ".join(rng.choice(stems) + rng.choice(["", "", ".", ",", "_a", "-b"]) for _ in range(rng.randint(0, n)))
    entries = [("homelab" if k % 3 else "ai", k, text(4), text(3) if k % 2 else None, text(30)) for k in range(120)] + [("ai", 900, "", None, "")]
    queries = [(k, text(6)) for k in range(40)] + [(90, "kako da serverima"), (91, "the of"), (92, "pi-hole network_bridge"), (93, "relati keys")]
    df = spark.createDataFrame(entries, "corpus string, id long, title string, summary string, content string")
    index = lexical.index_of(df, EngineConfig())
    got = {(r.qid, r.corpus, r.id): (r.score, r["rank"]) for r in lexical.bm25(index, spark.createDataFrame(queries, "qid long, text string"), EngineConfig()).collect()}
    found = {}
    for corpus in ("homelab", "ai"):
        con = sqlite3.connect(":memory:")
        con.execute("CREATE VIRTUAL TABLE e USING fts5(id UNINDEXED, title, summary, content, tokenize='porter unicode61 remove_diacritics 2')")
        con.executemany("INSERT INTO e VALUES (?, ?, ?, ?)", [r[1:] for r in entries if r[0] == corpus])
        for qid, q in queries:
            expression = match_expression(T.query_terms(q))
            if expression:
                rows = con.execute("SELECT id, bm25(e, 0, 3, 2, 1) FROM e WHERE e MATCH ?", (expression,)).fetchall()
                found[qid, corpus] = sorted((score, i) for i, score in rows)
    assert sum(map(len, found.values())) > 1000
    same_ranks(got, found, 100)
    index = lexical.index_of(df, EngineConfig())
    for limit in (1, 5, 20):  # limits that leave phrases out
        cut = lexical.bm25(index, spark.createDataFrame(queries, "qid long, text string"), EngineConfig(lexical_limit=limit), direct=0)
        same_ranks({(r.qid, r.corpus, r.id): (r.score, r["rank"]) for r in cut.collect()}, found, limit)


def same_ranks(got, found, limit):
    """``found``: by query and corpus all scores of another engine. Ranks are equal, but for scores that are equal up to
    the order in which their parts are added."""
    by: dict = {}
    for (qid, corpus, i), (score, rank) in got.items():
        by.setdefault((qid, corpus), []).append((rank, i, score))
    assert by.keys() == {k for k, rows in found.items() if rows}
    for key, rows in by.items():
        theirs = dict((i, score) for score, i in found[key])
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, min(limit, len(theirs)) + 1))
        assert all(abs(theirs[i] - score) <= 5.1e-5 for _, i, score in rows)
        for (_, i, _), (score, j) in zip(rows, found[key]):
            assert i == j or abs(theirs[i] - score) < 1e-12


def scanned(df):
    """What the Parquet scan of a plan read: (its text, files, rows)."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    if leaf.nodeName().startswith("AdaptiveSparkPlan"):
        leaf = leaf.executedPlan().collectLeaves().head()
    metrics = leaf.metrics()
    return plan.toString(), metrics.apply("numFiles").value(), metrics.apply("numOutputRows").value()


def test_searches_read_what_they_ask_for(spark):
    from quillon.config import EngineConfig
    from quillon.operators import lexical

    rows = [("ai", k, f"title{k % 50}", None, f"network word{k} common") for k in range(400)]
    index = lexical.index_of(spark.createDataFrame(rows, "corpus string, id long, title string, summary string, content string"), EngineConfig())
    words = spark.createDataFrame([("word7", 0), ("network", 0)], "term string, b int").select("term", lexical.bucket("term").alias("bucket"))
    _, all_files, all_rows = scanned(index.postings)
    text, files, read = scanned(lexical.pruned(index, words))
    assert all_rows > 450 and files <= 2 < all_files and read < all_rows / 5
    assert "In(term, [network,word7])" in text and "bucket#" in text.split("PartitionFilters: [")[1].split("]")[0]


def test_lexical_index_takes_what_changed(spark, tmp_path):
    """A refreshed index gives what a new one gives; a generation has the postings of changed entries only."""
    import random

    from quillon.config import EngineConfig
    from quillon.operators import lexical

    rng, cfg, path = random.Random(3), EngineConfig(lexical_limit=7), str(tmp_path / "index")
    text = lambda n: " ".join(rng.choice("network bridge dns pi-hole café keys relation hosting v2.5 serverima".split()) for _ in range(rng.randint(0, n)))
    schema = "corpus string, id long, title string, summary string, content string"
    entries = {k: ("homelab" if k % 3 else "ai", k, text(3), None, text(20)) for k in range(200)}
    frame = lambda: spark.createDataFrame(list(entries.values()), schema)
    queries = spark.createDataFrame([(k, text(5)) for k in range(10)], "qid long, text string")
    lexical.build(frame(), cfg, path)
    assert lexical.refresh(frame(), cfg, path) == {} and lexical.generations(spark, path) == [0]
    for turn in (1, 2):
        gone, changed, new = [turn * 10, turn * 10 + 1], [5, turn * 20 + 3], [300 + turn]
        for k in gone:
            del entries[k]
        for k in changed:
            entries[k] = (*entries[k][:4], f"changed {turn} " + text(9))
        for k in new:
            entries[k] = ("ai", k, "new", text(3), text(9))
        assert lexical.refresh(frame(), cfg, path) == {"gone": 2, "changed": 2, "new": 1}
        index = lexical.read(spark, path)
        ids = index.postings.where(f"gen = {turn}").selectExpr("explode(ids) as id").distinct()
        assert {r.id for r in ids.collect()} == {*changed, *new}
        fresh = lexical.index_of(frame(), cfg)
        same = lambda f: sorted(map(tuple, f(index).collect())) == sorted(map(tuple, f(fresh).collect()))
        assert same(lexical.document_frequency) and same(lexical.statistics)
        assert same(lambda i: lexical.bm25(i, queries, cfg)) and same(lambda i: lexical.bm25(i, queries, cfg, direct=0))
        assert same(lambda i: lexical.bm25(i.of(["ai"]), queries, cfg)) and lexical.changes(frame(), index).count() == 0
    lexical.build(frame(), cfg, path)
    assert lexical.generations(spark, path) == [3]


def test_lexical_index_follows_its_source(spark, tmp_path):
    from quillon.config import EngineConfig
    from quillon.operators.lexical import LexicalIndex

    rows, now = [("ai", 1, "network", None, "bridge")], [0.0]

    def source():
        if rows is None:
            raise OSError("gone")
        return spark.createDataFrame(rows, "corpus string, id long, title string, summary string, content string")

    index = LexicalIndex(spark, str(tmp_path / "index"), source, EngineConfig(), clock=lambda: now[0])
    q = spark.createDataFrame([(1, "bridges")], "qid long, text string")
    found = lambda: [r.id for r in index.lookup(q)[0].orderBy("id").collect()]
    assert index.lookup(q)[1] == "lexical index unusable" and found() == []
    assert index.refresh() is None and found() == [1]
    first = index.version
    rows.append(("ai", 2, "the bridge", None, ""))
    assert index.refresh() is None and index.version == first and found() == [1]  # looked at once in 30 seconds
    now[0] = 31
    assert index.refresh() is None and index.version != first and found() == [1, 2]
    second, rows, now[0] = index.version, None, 62
    assert index.refresh() == "source fingerprint failed (OSError)" and index.version == second and found() == [1, 2]
    rows, now[0] = [("ai", 1, "network", None, "bridge")], 93
    index.path = "/proc/no/such/folder"  # can't be written
    assert index.refresh().startswith("lexical index rebuild failed") and index.version == second


def test_stems_as_sql():
    """The SQL of the registered queries stems as the library does, words with a leading y among them."""
    import duckdb

    from quillon.functions.text import porter
    from quillon.queries import porter_sql

    listed = "ynjall yells yelling yes yearly yield yielded yyes yoking yammered say saying syzygy eye toying sky skies agreed feed plastered motoring conflated hopping falling failing filing relational rational valenci vileness triplicate formative controll roll probate cease y yy".split()
    values = ", ".join(f"('{w}')" for w in listed)
    got = dict(duckdb.sql(f"WITH w(word) AS (VALUES {values}), {porter_sql('w')} SELECT word, stem FROM stems").fetchall())
    assert got == {w: porter(w) for w in listed}


def test_blocks_are_put_together_where_entries_are_read(spark, monkeypatch):
    """Nothing is sent to make blocks of postings; entries that are read in several goes give the same search."""
    from quillon.config import EngineConfig
    from quillon.operators import lexical

    rows = [("ai" if k % 2 else "homelab", 4090 + k, "", None, f"çommon wörd{k % 5} pair of words" if k != 3 else None) for k in range(40)]
    entries = spark.createDataFrame(rows, "corpus string, id long, title string, summary string, content string").coalesce(1)
    made = lexical.blocks(lexical.forward(entries, EngineConfig()))
    assert "Exchange" not in made._jdf.queryExecution().toString()
    got = {(r.term, r.corpus, r.block): list(r.ids) for r in made.collect()}
    assert got["common", "ai", 0] == [4091, 4095] and len(got["common", "ai", 1]) == 17
    asked = spark.createDataFrame([(1, "wörd3 common"), (2, "pair-of")], "qid long, text string")
    find = lambda: sorted(map(tuple, lexical.bm25(lexical.index_of(entries, EngineConfig()), asked, EngineConfig()).collect()))
    whole = find()
    monkeypatch.setattr(lexical, "GATHERED", 1)
    assert whole == find() and {r[0] for r in whole} == {1, 2}


def test_searches_meet_postings_as_blocks(spark):
    from quillon.config import EngineConfig
    from quillon.operators import lexical

    rows = [("ai", k, "", "", f"network nets word{k % 3} nest-egg" if k % 2 else "other") for k in range(-3, 6000)]
    index = lexical.index_of(spark.createDataFrame(rows, "corpus string, id long, title string, summary string, content string"), EngineConfig())
    asked = lexical.phrases(spark.createDataFrame([(1, "network word1"), (2, "nest-egg network")], "qid long, text string"))
    words = lexical.spelled(index, asked.select("phrase", "prefix", "words").distinct())
    found = lexical.hits(index, words, EngineConfig()).collect()
    assert len(found) == len({(r.phrase, r.prefix, r.block) for r in found})  # arrays, not a row for an entry
    ids = lambda phrase: sorted(i for r in found if r.phrase == phrase for i in r.ids)
    assert ids("network") == ids("nest egg") == [k for k in range(-3, 6000) if k % 2] and sum(r.n for r in found if r.phrase == "network") == 3002


def test_passages_tie_whatever_order_their_terms_are_added_in(spark):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from quillon.functions.passages import WINDOW, best_passage

    windows = [("first", ["x"], 0.1 + 0.2), ("second", ["x"], 0.3 + 2e-16), ("third", ["x"], 0.6 - 0.3 + 1e-15)]
    df = spark.createDataFrame([(windows,)], T.StructType([T.StructField("w", T.ArrayType(WINDOW))]))
    assert df.select(best_passage(F.col("w")).alias("p")).first().p == "first"
