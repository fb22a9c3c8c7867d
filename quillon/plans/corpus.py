"""The stored corpus: what can be done to it, each change a new version of the tables that it touches.

One writer at a time; readers keep the version that they began with. Tables: entries (corpus, id, title, content, ...,
created_at, embedded_at, raw_path), vectors (corpus, id, x), edges of replacements, meta (key, value).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embedding import DIMENSION, Embedder, embed_entries
from ..operators import integrity, lineage, store
from ..workspace import discard, written

EDGES, META = "src_corpus string, src_id long, dst_corpus string, dst_id long", "key string, value string"


class CorpusStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return store.latest(self.spark, f"{self.path}/{name}")

    def put(self, **tables: DataFrame) -> None:
        """New versions, in the order given: after a fault later ones still are as they were."""
        for name, df in tables.items():
            store.publish(df, f"{self.path}/{name}")

    @classmethod
    def create(cls, spark: SparkSession, path: str, entries: DataFrame, vectors: DataFrame) -> CorpusStore:
        made = cls(spark, path)
        made.put(entries=entries, vectors=vectors, edges=spark.createDataFrame([], EDGES), meta=spark.createDataFrame([], META))
        return made

    @property
    def stale(self) -> bool:
        return store.is_stale(self.table("meta"))

    def _mark(self, stale: bool) -> None:
        self.put(meta=store.put(self.table("meta"), self.spark.createDataFrame([("edges_stale", "1" if stale else "0")], META)))

    def _refs(self, edges: DataFrame) -> DataFrame:
        ref = lambda side: F.concat_ws(":", f"{side}_corpus", f"{side}_id").alias(side)
        return edges.select(ref("src"), ref("dst"))

    def _known(self) -> DataFrame:
        return self.table("entries").select(F.concat_ws(":", "corpus", "id").alias("node"))

    def add(self, new: DataFrame) -> None:
        self.put(entries=store.add(self.table("entries"), new))

    def supersede(self, ref: str, replacements: list[str]) -> None:
        """Mark an entry as replaced, in its raw file too, and put its edges in place of its old ones; ValueError names what
        is wrong, and then nothing is changed. An entry without a raw file is refused rather than marked in part.

        The raw file is written first, in one step: after a fault the entry is as it was, and marking it again ends well.
        """
        (corpus, number), targets = store.parse_ref(ref), [store.parse_ref(r) for r in replacements]
        names = [f"{c}:{n}" for c, n in targets]
        wanted = self.spark.createDataFrame([(f"{corpus}:{number}", names)], "src string, dsts array<string>")
        edges, known = self.table("edges"), self._known()
        errors = sorted(f"{r.dst or ref}: {r.error}" for r in lineage.write_errors(self._refs(edges), wanted, known).collect())
        if not known.where(F.col("node") == f"{corpus}:{number}").head(1):
            errors.append(f"{ref}: no such entry")
        entries, of = self.table("entries"), (F.col("corpus") == corpus) & (F.col("id") == number)
        if not errors and not entries.where(of & (F.col("raw_path") != "")).head(1):
            errors.append(f"{ref}: no raw file; it would be marked in part")
        if errors:
            raise ValueError("; ".join(errors))
        line = self.spark.createDataFrame([(corpus, number, ", ".join(names))], "corpus string, id long, refs string")
        new = self.spark.createDataFrame([(corpus, number, *t) for t in targets], EDGES)
        marked = store.supersede_entries(entries, line)
        store.replace_raw_files(marked.where(of).exceptAll(entries.where(of))).collect()
        self.put(entries=marked, edges=lineage.replace_edges(edges, new))

    def retire(self, ref: str) -> str:
        """Take an entry out of vectors, then of entries, then its raw file; what was found of it. LookupError if it is
        nowhere. After a fault the health check tells of what is left, and retiring it again ends well."""
        corpus, number = store.parse_ref(ref)
        gone = self.spark.createDataFrame([(corpus, number)], "corpus string, id long")
        entries, vectors, report = store.retire(self.table("entries"), self.table("vectors"), gone)
        found = report.first().found
        if found == "nothing":
            raise LookupError(ref)
        raw = written(self.table("entries").join(gone, store.KEY, "left_semi").select("raw_path"), "raw")
        self.put(vectors=vectors, entries=entries)
        store.remove_raw_files(raw).collect()
        discard(raw)
        return found

    def rebuild_edges(self) -> tuple[DataFrame, list[str]]:
        """Edges anew from the entries' first lines; a report and warnings. The edges can be trusted after it."""
        entries = self.table("entries")
        markers = written(lineage.parse_markers(entries), "markers")
        self.put(edges=lineage.edges_of(markers))
        self._mark(False)
        odd = markers.where("not ok").select(F.concat("corpus", F.lit(":"), "id", F.lit(": malformed "), "ref"))
        own = markers.where(F.col("ok") & (F.col("ref") == F.concat_ws(":", "corpus", "id"))).select(F.concat("ref", F.lit(": names itself")))
        lost = lineage.dangling(self.table("edges"), entries).select(F.concat("src_corpus", F.lit(":"), "src_id", F.lit(": no "), "dst_corpus", F.lit(":"), "dst_id"))
        return lineage.rebuild_report(markers, entries), sorted(r[0] for r in odd.union(own).union(lost).collect())

    def history(self, ref: str, limit: int = 200) -> dict:
        """The lineage of an entry, with its chain from old to new if it is one, and what makes it incomplete."""
        corpus, number = store.parse_ref(ref)
        edges = self._refs(self.table("edges"))
        start = self.spark.createDataFrame([(f"{corpus}:{number}",)], "node string")
        row = lineage.histories(edges, start, self._known(), limit, self.stale).first()
        own = [(e.src, e.dst) for e in row.edges]
        follow, out = dict(own), []
        heads = {a for a, _ in own} - {b for _, b in own}
        if len(heads) == 1 and len(follow) == len(own) == len({b for _, b in own}):
            node = heads.pop()
            while node is not None:
                out.append(node)
                node = follow.get(node)
        chain = out or ([ref] if not own and len(row.nodes) == 1 else None)
        missing = [n.node for n in row.nodes if n.missing]
        warnings = [f"{n} is referenced but not found" for n in missing] + (["the edges are stale: rebuild them"] if row.stale else [])
        return {"start": ref, "nodes": [n.node for n in row.nodes], "missing": missing, "edges": own, "chain": chain, "broken": [(b.src, b.dst) for b in row.broken], "warnings": warnings, "truncated": row.truncated, "stale": row.stale, "completeness": row.completeness}

    def embed_pending(self, make: Callable[[], Embedder], now, dimension: int = DIMENSION) -> dict:
        """Vectors for entries that wait for one: secrets are taken out first, failures wait on, and vectors of entries that
        vanished meanwhile go. Only waiting entries are looked at, and the model sees each once. Running it again changes
        nothing."""
        entries = self.table("entries")
        waiting, found = entries.where("embedded_at is null"), None
        if set(store.TEXTS) <= set(entries.columns):
            waiting, found = store.quarantine(waiting)
        waiting = written(waiting, "waiting")
        entries = entries.where("embedded_at is not null").unionByName(waiting)
        secrets = found.count() if found is not None else 0
        made, failed = embed_entries(waiting, make, dimension)
        stamped, vanished = store.mark_embedded(entries, made, now)
        vectors = store.remove_late(store.upsert(self.table("vectors"), made, store.KEY), entries)
        counts = {"embedded": made.count(), "failed": failed.count(), "vanished": vanished.count(), "quarantined": secrets}
        self.put(vectors=vectors, entries=stamped)
        return counts

    def recover_entries(self, raw: DataFrame, corpus: str) -> int:
        """Entries for raw notes (adapters.raw_notes) that have none; the edges can't be trusted until they are built anew."""
        entries = self.table("entries")
        top = entries.where(F.col("corpus") == corpus).agg(F.max("id")).first()[0] or 0
        new = raw.join(entries.select("raw_path"), "raw_path", "left_anti")
        new = written(new.withColumn("id", F.monotonically_increasing_id() + top + 1), "recovered")  # new numbers, with gaps
        if not new.head(1):
            return 0
        rows = new.select(F.lit(corpus).alias("corpus"), "id", "title", "content", "tags", F.col("saved").try_cast("timestamp").alias("created_at"), "raw_path")
        self.put(entries=entries.unionByName(rows.select([c for c in rows.columns if c in entries.columns]), allowMissingColumns=True))
        self._mark(True)
        return new.count()

    def recover_raw(self, folder: str) -> int:
        """Raw files for entries that have none; how many were written."""
        n = store.write_raw_files(self.table("entries"), folder).where("written").count()
        self._mark(True)
        return n

    def health(self, corpus: str, metadata: dict | None, model: str, dimension: int = DIMENSION) -> dict:
        """As the corpus's health, and whether its edges are what its entries say."""
        entries = self.table("entries")
        want = lineage.edges_of(lineage.parse_markers(entries))
        return integrity.corpus_health(corpus, entries, self.table("vectors"), metadata, model, dimension) | {"edges": lineage.edge_health(self.table("edges"), want, self.stale)}
