"""Searches as one lazy plan over a table of queries; a single query is a table of one row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import CORPORA, EngineConfig
from ..functions import scoring as S
from ..functions.embedding import DIMENSION, embedded, with_model_relevance
from ..functions.passages import with_passage
from ..operators import fusion, lexical, vector
from ..operators.querylog import audit_line
from ..operators.relations import with_warnings
from ..workspace import discard, written


class RequestError(ValueError):
    """A request that can't be served, with the status that a service would answer."""

    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


@dataclass(frozen=True)
class Request:
    query: str
    scope: str = "both"
    top_k: int = 5
    query_alt: str | None = None
    query_alt_language: str | None = None
    allow_degraded: bool = False

    def __post_init__(self):
        for text in (self.query, self.query_alt):
            if text is not None and not (1 <= len(text) <= 1500 and text == text.strip()):
                raise RequestError(422, "queries have 1 to 1500 characters and no white space at the ends")
        if (self.query_alt is None) != (self.query_alt_language is None):
            raise RequestError(422, "an alternate wording and its language go together")
        if self.query_alt_language not in (None, "sr", "en"):
            raise RequestError(422, "the alternate wording is in sr or en")
        if not isinstance(self.top_k, int) or isinstance(self.top_k, bool) or not 1 <= self.top_k <= 5:
            raise RequestError(422, "top_k is from 1 to 5")


def plan_scope(scope: str, granted: set[str] | None = None, available: set[str] | None = None, allow_degraded: bool = False) -> tuple[list[str], str | None]:
    """Corpora to search, and why fewer than asked for: grants come first, then what is available."""
    if scope == "auto":
        raise RequestError(409, "automatic routing is not on")
    if scope not in (*CORPORA, "both"):
        raise RequestError(422, f"no scope {scope!r}")
    wanted = list(CORPORA) if scope == "both" else [scope]
    if granted is not None and not set(wanted) <= granted:
        raise RequestError(403, "not granted")
    there = [c for c in wanted if available is None or c in available]
    if len(there) < len(wanted) and not (scope == "both" and allow_degraded and there):
        raise RequestError(503, "a corpus is not available")
    return there, "degraded_explicit_both" if len(there) < len(wanted) else None


class SearchEngine:
    """Entries (corpus, id, title, summary, content, tags, created_at), vectors (id, corpus, x), edges of newer notes and a
    stored lexical index (``lexical.Index`` or ``lexical.LexicalIndex``; both optional: without the latter one is made by
    the first search that needs it).

    ``embedder`` and ``scorer`` make the models that are used in Python workers (functions.embedding): with the first,
    queries need only a text; with the second, relevance is its judgement of query and text instead of the curve over
    the distance. ``status`` holds why parts of a search were left out.
    """

    def __init__(self, entries: DataFrame, vectors: DataFrame, cfg: EngineConfig, newer: DataFrame | None = None, index: DataFrame | None = None, embedder=None, scorer=None, dimension: int = DIMENSION):
        self.entries, self.vectors, self.cfg, self.newer, self.index = entries, vectors, cfg, newer, index
        self.embedder, self.scorer, self.dimension = embedder, scorer, dimension
        self.status: dict[str, str] = {}
        self._made: list[DataFrame] = []

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        """A written table, which ``forget`` deletes."""
        self._made.append(written(df, name))
        return self._made[-1]

    def forget(self) -> None:
        """Delete the tables that searches wrote: none of their results can be read after it."""
        discard(*self._made)
        self._made.clear()

    def queries(self, texts: DataFrame) -> DataFrame:
        """qid, text and qx of query texts (qid, text); an error where the embedder gives no vector."""
        if self.embedder is None:
            raise RequestError(503, "no embedder")
        made = texts.select("qid", "text").withColumn("qx", embedded(self.embedder, F.col("text"), "query", self.dimension))
        return made.withColumn("qx", F.when(F.col("qx").isNull(), F.raise_error(F.lit("a query has no vector"))).otherwise(F.col("qx")))

    def candidates(self, queries: DataFrame, alternate: DataFrame | None = None, corpora: list[str] | None = None) -> DataFrame:
        """qid, corpus, id, distance, pos and flags. ``queries``: qid, qx and, for the lexical lane, text; ``alternate``: qid, qx."""
        cfg, vectors = self.cfg, self.vectors
        if corpora:
            vectors = vectors.where(F.col("corpus").isin(corpora))
        semantic = vector.top_candidates(queries.select("qid", "qx"), vectors, cfg.max_distance, cfg.candidate_k)
        if alternate is not None:
            home = vectors.where("corpus = 'homelab'")
            second = vector.top_candidates(alternate, home, cfg.max_distance, cfg.candidate_k)
            both = fusion.prune_alternates(fusion.union_candidates(semantic, second), cfg)
            semantic = both.withColumn("rank", F.row_number().over(W.partitionBy("qid", "corpus").orderBy("pos"))).drop("pos")
        else:
            semantic = semantic.withColumn("from_primary", F.lit(True)).withColumn("alternate_rank", F.lit(None).cast("int"))
        if "text" not in queries.columns:
            return semantic.withColumn("from_lexical", F.lit(False)).withColumnRenamed("rank", "pos")
        index = self.index
        if isinstance(index, lexical.LexicalIndex):
            self.status.pop("lexical", None)
            refused = index.refresh()
            index, reason = index.table()
            if reason or refused:
                self.status["lexical"] = reason or refused
            if index is None:  # go on without lexical candidates
                return semantic.withColumn("from_lexical", F.lit(False)).withColumnRenamed("rank", "pos")
        elif index is None:
            index = self.index = lexical.index_of(self.entries, cfg)
        index = index.of(corpora) if corpora else index
        found = lexical.bm25(index, queries, cfg)
        self._made.append(found)
        merged = fusion.hybrid_merge(semantic, found, cfg)
        flags = semantic.select("qid", "corpus", "id", "from_primary", "alternate_rank")
        out = merged.join(flags, ["qid", "corpus", "id"], "left")
        primary = F.when(F.col("from_lexical"), True).otherwise(F.col("from_primary"))  # lexical rows count as first-hand
        return out.withColumn("from_primary", primary).withColumn("alternate_rank", F.when(~F.col("from_lexical"), F.col("alternate_rank")))

    def scored(self, candidates: DataFrame, queries: DataFrame | None = None) -> DataFrame:
        """Candidates that have an entry, with relevance, admission of alternates, and final score.

        With a scorer, ``queries`` (qid, text): the first wording judges all candidates, of both corpora and wordings.
        """
        cfg = self.cfg
        # the mark is read before the join, so that titles which nobody asks for aren't sent
        entries, shown = self.entries.withColumn("_superseded", S.is_superseded(F.col("title"))), ["corpus", "id", "title", "tags", "created_at", "_superseded"]
        if self.scorer is not None and queries is not None:
            e = entries.select(*shown, F.coalesce(F.nullif("content", F.lit("")), "summary").alias("_body"))
            c = candidates.join(e, ["corpus", "id"]).join(queries.select("qid", F.col("text").alias("_query")), "qid")
            seen = self._kept(with_passage(c, self.scorer, "_query", "_body", "_passage").drop("_body"), "passages")
            c = with_model_relevance(seen, self.scorer, "_query", "_passage").drop("_passage", "_query")
        else:
            c = candidates.join(entries.select(*shown), ["corpus", "id"]).withColumn("relevance", S.relevance(F.col("distance"), cfg))
        c = fusion.admit_alternates(c, cfg)
        days = S.age_days(F.col("created_at"), F.lit(cfg.as_of).cast("timestamp"))
        return c.withColumn("final_score", S.final_score(F.col("relevance"), F.col("corpus"), days, F.col("_superseded"), cfg)).drop("_superseded")

    def search(self, queries: DataFrame, alternate: DataFrame | None = None, corpora: list[str] | None = None) -> DataFrame:
        """The best of each corpus with their place, merged rank, title, link and, if edges are given, newer notes."""
        return self.ranked(self.scored(self.candidates(queries, alternate, corpora), queries if "text" in queries.columns else None))

    def ranked(self, scored: DataFrame) -> DataFrame:
        """Of scored candidates those that are relevant, the best of each corpus, with what a reader is shown."""
        cfg = self.cfg
        kept = scored.where(F.col("relevance") >= cfg.reject)
        place = F.row_number().over(W.partitionBy("qid", "corpus").orderBy(F.desc("final_score"), "pos"))
        top = kept.withColumn("place", place).where(F.col("place") <= cfg.top_k)
        order = F.when(F.col("corpus") == CORPORA[0], 0).otherwise(1)
        rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("final_score"), order, "place"))
        title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled"))
        out = top.withColumn("rank", rank).select(
            "qid", "corpus", "id", F.concat_ws(":", "corpus", "id").alias("ref"), title.alias("title"), "relevance", "final_score", "place", "rank",
            S.display_link(F.col("tags"), F.col("corpus"), F.col("id")).alias("link"),
        )
        return out if self.newer is None else with_warnings(self._kept(out, "results"), self.newer)

    def route(self, queries: DataFrame) -> DataFrame:
        """What a router would have done with searches of both corpora."""
        s = self.scored(self.candidates(queries))
        of = lambda c: F.max(F.when(F.col("corpus") == c, F.col("relevance"))).alias(c)
        best = queries.select("qid").join(s.groupBy("qid").agg(*map(of, CORPORA)), "qid", "left")
        route = F.split(S.shadow_route(F.col("homelab"), F.col("ai"), self.cfg), "/")
        return best.select("qid", "homelab", "ai", route[0].alias("scope"), route[1].alias("reason"))

    def respond(self, queries: DataFrame, request: Request, available: set[str] | None = None, granted: set[str] | None = None, client: str = "local") -> DataFrame:
        """One row for each query (qid, qx, text) as a service would answer: scopes, results by corpus, merged references,
        counts, and the audit line, which tells the query's language and never its text."""
        corpora, reason = plan_scope(request.scope, granted, available, request.allow_degraded)
        wanted = list(CORPORA) if request.scope == "both" else [request.scope]
        gone = [c for c in wanted if c not in corpora]
        chosen = corpora[0] if len(corpora) == 1 else request.scope
        found = self._kept(self.candidates(queries, corpora=corpora), "candidates")
        results = self._kept(self.ranked(self.scored(found, queries if "text" in queries.columns else None)).where(F.col("place") <= request.top_k), "results")
        newer = "newer" if "newer" in results.columns else F.lit(None).cast("array<string>")
        shown = F.struct("place", "ref", "title", "relevance", "final_score", "link")
        mine = lambda c: F.array_sort(F.collect_list(F.when(F.col("corpus") == c, shown)))
        merged = F.transform(F.array_sort(F.collect_list(F.struct("rank", "ref"))), lambda r: r["ref"])
        notes = F.sum(F.greatest(F.lit(0), F.size(F.coalesce(newer, F.array().cast(results.schema["newer"].dataType if "newer" in results.columns else "array<string>")))))
        per = results.groupBy("qid").agg(merged.alias("ranked"), notes.alias("newer_notes"), *(mine(c).alias(f"_{c}") for c in CORPORA))
        lexical_rows = found.groupBy("qid").agg(F.count_if("from_lexical").alias("lexical_candidates"))
        out = queries.join(per, "qid", "left").join(lexical_rows, "qid", "left")

        def corpus(c: str) -> Column:
            list_ = F.coalesce(F.col(f"_{c}"), F.array().cast(per.schema[f"_{c}"].dataType))
            return F.struct(F.lit(c in corpora).alias("searched"), F.lit(c in corpora).alias("available"), F.size(list_).alias("count"), list_.alias("results"))

        zero = lambda c: F.coalesce(c, F.lit(0))
        out = out.withColumns({c: corpus(c) for c in CORPORA} | {"lexical_candidates": zero("lexical_candidates"), "newer_notes": zero("newer_notes"), "ranked": F.coalesce("ranked", F.array().cast("array<string>"))})
        counts = {f"{c}_count": F.col(f"{c}.count") for c in CORPORA}
        language = S.query_language(F.col("text")) if "text" in queries.columns else F.lit("unknown")
        degraded = F.array(*map(F.lit, gone)).cast("array<string>")
        audit = audit_line("search", client=F.lit(client), scope=F.lit(request.scope), selected_scope=F.lit(chosen), qlang=language, status=F.lit(200), degraded=degraded, lexical_candidates=F.col("lexical_candidates"), newer_notes=F.col("newer_notes"), lexical_degraded=F.lit(self.status.get("lexical")), **counts)
        return out.select(
            "qid", F.lit(request.scope).alias("requested_scope"), F.lit(chosen).alias("selected_scope"), F.lit(reason or "explicit_scope").alias("routing_reason"),
            degraded.alias("degraded"), F.size("ranked").alias("total_count"), *CORPORA, "ranked", "lexical_candidates", "newer_notes", audit.alias("audit"),
        )

    def stages(self, queries: DataFrame) -> DataFrame:
        """qid, corpus, stage, count, entries: how many vectors are left after each stage, and the first of them in order.

        Stages: raw, max_distance, candidate_k (ten entries each: id, distance), scored, reject (up to 25 entries, with
        title and scores). Tiles of vectors give their numbers and first entries, so no distance is written. No lexical lane.
        """
        cfg = self.cfg
        seen = self._kept(vector.scan(queries.select("qid", "qx"), self.vectors, cfg.max_distance, max(10, cfg.candidate_k)), "scan")
        scan = seen.where("total = 0")
        key = ["qid", "corpus"]
        near = scan.where("near")
        tally = lambda n: seen.groupBy(*key).agg(F.sum(n).alias("count")).where("count > 0")
        first = lambda rows, n: rows.withColumn("place", F.row_number().over(W.partitionBy(*key).orderBy("distance", "id"))).where(F.col("place") <= n)
        candidates = first(near, cfg.candidate_k).withColumn("rank", F.col("place"))
        plain = candidates.withColumn("from_primary", F.lit(True)).withColumn("alternate_rank", F.lit(None).cast("int")).withColumnRenamed("rank", "pos").drop("place", "near", "total", "within")
        scored = self._kept(self.scored(plain.withColumn("from_lexical", F.lit(False))), "scored")
        kept = scored.where(F.col("relevance") >= cfg.reject)
        place = lambda *order: F.row_number().over(W.partitionBy(*key).orderBy(*order))
        blank = {"title": F.lit(None).cast("string"), "relevance": F.lit(None).cast("double"), "final_score": F.lit(None).cast("double")}
        short = {"title": F.substring("title", 1, 80)}

        count = lambda rows: rows.groupBy(*key).agg(F.count("*").alias("count"))

        def stage(name, counted, listed):
            entry = F.struct("place", "id", "title", "distance", "relevance", "final_score")
            lists = listed.groupBy(*key).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
            return counted.join(lists, key, "left").select(*key, F.lit(name).alias("stage"), "count", "entries")

        rows = stage("raw", tally("total"), first(scan, 10).withColumns(blank))
        rows = rows.union(stage("max_distance", tally("within"), first(near, 10).withColumns(blank)))
        rows = rows.union(stage("candidate_k", count(candidates), first(near, min(10, cfg.candidate_k)).withColumns(blank)))
        rows = rows.union(stage("scored", count(scored), scored.withColumn("place", place("pos")).withColumns(short).where("place <= 25")))
        return rows.union(stage("reject", count(kept), kept.withColumn("place", place(F.desc("final_score"), "pos")).withColumns(short).where("place <= 25")))

    def watched(self, queries: DataFrame, watch: DataFrame) -> DataFrame:
        """Where each entry of ``watch`` (corpus, id) is in each query's search: ranks and scores, and the stage it fell out at.

        Ranks of watched entries are numbers of nearer ones, looked up among a query's sorted distances.
        """
        cfg = self.cfg
        within = F.col("within")
        m = vector.places_of(queries.select("qid", "qx"), self.vectors, watch, cfg.max_distance)
        m = m.withColumn("raw_rank", F.col("raw") + 1).withColumn("distance_rank", F.when(within, F.col("near") + 1))
        s = self.scored(self.candidates(queries.select("qid", "qx"))).withColumn("kept", F.col("relevance") >= cfg.reject)
        s = s.withColumn("final_rank", F.when(F.col("kept"), F.row_number().over(W.partitionBy("qid", "corpus", "kept").orderBy(F.desc("final_score"), "pos"))))
        m = m.join(s.select("qid", "corpus", "id", "relevance", "final_score", "kept", "final_rank"), ["qid", "corpus", "id"], "left")
        out_at = (
            F.when(~within, "max_distance").when(F.col("distance_rank") > cfg.candidate_k, "candidate_k").when(F.col("relevance").isNull(), "no_entry").when(~F.col("kept"), "reject")
        )
        return m.select("qid", "corpus", "id", "distance", "raw_rank", "distance_rank", "relevance", F.when(F.col("kept"), F.col("final_score")).alias("final_score"), "final_rank", out_at.alias("eliminated_before"))

    def trace_dual(self, queries: DataFrame, alternate: DataFrame) -> DataFrame:
        """qid, ref, change: what the alternate wording gains and loses among the results."""
        a, b = self.search(queries).select("qid", "ref"), self.search(queries, alternate).select("qid", "ref")
        gained = b.join(a, ["qid", "ref"], "left_anti").withColumn("change", F.lit("gained"))
        return gained.union(a.join(b, ["qid", "ref"], "left_anti").withColumn("change", F.lit("lost")))

    def evidence(self, queries: DataFrame, least: float, most: int = 3) -> DataFrame:
        """Homelab results for a synthesis: above ``least``, the best few."""
        s = self.scored(self.candidates(queries, corpora=[CORPORA[0]]), queries if "text" in queries.columns else None).where((F.col("relevance") >= self.cfg.reject) & (F.col("final_score") >= least))
        return s.withColumn("n", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("final_score"), "pos"))).where(F.col("n") <= most)
