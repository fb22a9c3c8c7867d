"""Replacement lineage: markers, edges, reachability, history and chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..workspace import shared_folder

EDGE = ["src_corpus", "src_id", "dst_corpus", "dst_id"]
#: Fixed value: how the first line of a replaced entry begins.
MARKER = "SUPERSEDED — use "


def parse_markers(entries: DataFrame) -> DataFrame:
    """corpus, id, ref, ok: the references in the first line of entries that it marks as replaced; ok: well-formed."""
    line = F.split_part(F.ltrim("content"), F.lit("\n"), F.lit(1))
    marked = entries.where(line.startswith(MARKER)).withColumn("refs", F.expr(f"substring(split_part(ltrim(content), '\n', 1), {len(MARKER) + 1})"))
    refs = marked.select("corpus", "id", F.explode(F.split("refs", ",")).alias("ref")).withColumn("ref", F.trim("ref"))
    return refs.withColumn("ok", F.col("ref").rlike("^(homelab|ai):[0-9]+$"))


def edges_of(markers: DataFrame) -> DataFrame:
    """Distinct edges of well-formed references, none to the entry itself."""
    ref = F.split("ref", ":")
    e = markers.where("ok").select(
        F.col("corpus").alias("src_corpus"), F.col("id").alias("src_id"), ref[0].alias("dst_corpus"), ref[1].cast("long").alias("dst_id")
    )
    return e.where("not (src_corpus = dst_corpus and src_id = dst_id)").dropDuplicates(EDGE)


def dangling(edges: DataFrame, entries: DataFrame) -> DataFrame:
    known = entries.select(F.col("corpus").alias("dst_corpus"), F.col("id").alias("dst_id"))
    return edges.join(known, ["dst_corpus", "dst_id"], "left_anti").select(*EDGE)


def replace_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """All outgoing edges of the sources in ``new`` become those in ``new``."""
    return edges.join(new.select("src_corpus", "src_id").distinct(), ["src_corpus", "src_id"], "left_anti").select(*EDGE).unionByName(new.select(*EDGE).dropDuplicates())


def _checkpointed(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """src, node, level: what can be reached from each start along the edges (src, dst), cycles included once.

    Joins the frontier with the edges and drops what was seen; goes on until the frontier is empty, however long the
    chains are. checkpoint() cuts the lineage, so the plan doesn't grow.
    """
    few = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = _checkpointed(starts.select(F.col("node").alias("src"), "node", F.lit(0).alias("level")))
    front, level = seen, 0
    while front.head(1):
        level += 1
        step = front.join(edges.select(F.col("src").alias("node"), "dst"), "node").select("src", F.col("dst").alias("node")).distinct()
        front = step.join(seen.select("src", "node"), ["src", "node"], "left_anti").withColumn("level", F.lit(level)).coalesce(few).checkpoint()
        seen = seen.union(front)
        if level % 16 == 0:  # fronts are written once; now and then they are put together
            seen = seen.coalesce(few).checkpoint()
    return seen


def history(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """As ``reachable``, along edges in both directions: the whole lineage of each start."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return reachable(both, starts)


def contracted(edges: DataFrame, kept: DataFrame) -> tuple[DataFrame, int]:
    """Edges (src, dst) without what lies between: nodes with one edge in and one out, unless they are ``kept`` (node), and
    the rounds that it took. What a kept node reaches among the kept and branching ones stays the same.

    Each inner node points to its successor, and in a round to its successor's, so a chain is walked in as many rounds as
    its length has binary digits. Inner nodes that point to each other for ever are rings that nothing else touches: they go.
    """
    few = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = _checkpointed(edges.select("src", "dst").distinct())
    inner = degrees(once).where("n_in = 1 and n_out = 1").select("node").join(kept.select("node"), "node", "left_anti")
    jump = _checkpointed(once.join(inner.withColumnRenamed("node", "src"), "src").select(F.col("src").alias("node"), F.col("dst").alias("next")))
    rounds, most = 0, jump.count().bit_length() + 1
    while rounds < most:
        further = jump.select(F.col("node").alias("next"), F.col("next").alias("_after"))
        step = jump.join(further, "next", "left")
        if not step.where("_after is not null").head(1):
            break
        jump = _checkpointed(step.select("node", F.coalesce("_after", "next").alias("next")).coalesce(few))
        rounds += 1
    ends = jump.join(jump.select(F.col("node").alias("next")), "next", "left_anti")  # what a chain leads to
    ends = ends.select(F.col("node").alias("dst"), F.col("next").alias("_end"))
    outer = once.join(jump.select(F.col("node").alias("src")), "src", "left_anti")
    plain = outer.join(jump.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
    return plain.union(outer.join(ends, "dst").select("src", F.col("_end").alias("dst"))).distinct(), rounds


def would_cycle(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted edges (src, dst) that would close a cycle. Chains between their ends are contracted first, so that the
    walk takes a round for each branching node, not for each edge."""
    ends = wanted.select(F.col("src").alias("node")).union(wanted.select(F.col("dst").alias("node"))).distinct()
    short, _ = contracted(edges, ends)
    reach = reachable(_checkpointed(short), wanted.select(F.col("dst").alias("node")).distinct())
    back = reach.select(F.col("src").alias("dst"), F.col("node").alias("src"))
    return wanted.join(back, ["src", "dst"], "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_out, n_in of each node of an edge (src, dst)."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    ends = ends.union(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def drift(have: DataFrame, want: DataFrame) -> DataFrame:
    """Edges that are stored but not implied, or implied but not stored."""
    a, b = have.select(*EDGE).distinct(), want.select(*EDGE).distinct()
    return a.subtract(b).withColumn("kind", F.lit("extra")).union(b.subtract(a).withColumn("kind", F.lit("missing")))


def chains(edges: DataFrame) -> DataFrame:
    """head, node, level of the linear parts of a graph (src, dst): a node without predecessor, and what follows it, if no
    node of the whole part has more than one predecessor or successor. Level 0 is the head, the oldest."""
    d = degrees(edges)
    heads = d.where("n_in = 0").select("node")
    walk = reachable(edges, heads).select(F.col("src").alias("head"), "node", "level")
    odd = walk.join(d.where("n_in > 1 or n_out > 1"), "node", "left_semi").select("head").distinct()
    return walk.join(odd, "head", "left_anti")


def rebuild_report(markers: DataFrame, known: DataFrame) -> DataFrame:
    """kind, n: what a rebuild from markers (corpus, id, ref, ok) does. edges: edges put in, repeated ones each time;
    malformed and self: references that make none; dangling: edges to entries that aren't ``known`` (corpus, id)."""
    ref = F.split("ref", ":")
    m = markers.withColumn("dst_corpus", F.when(F.col("ok"), ref[0])).withColumn("dst_id", F.when(F.col("ok"), ref[1].try_cast("long")))
    there = known.select(F.col("corpus").alias("dst_corpus"), F.col("id").alias("dst_id"), F.lit(True).alias("there")).distinct()
    m = m.join(there, ["dst_corpus", "dst_id"], "left")
    own = (F.col("dst_corpus") == F.col("corpus")) & (F.col("dst_id") == F.col("id"))
    kinds = {"malformed": ~F.col("ok"), "self": F.col("ok") & own, "edges": F.col("ok") & ~own, "dangling": F.col("ok") & ~own & F.col("there").isNull()}
    counts = m.agg(*(F.count_if(c).alias(k) for k, c in kinds.items()))
    return counts.unpivot([], list(kinds), "kind", "n")


def write_errors(edges: DataFrame, wanted: DataFrame, known: DataFrame) -> DataFrame:
    """src, dst, error: why ``wanted`` replacements (src, dsts: an array) can't be written; no row if they can.

    ``edges``: src, dst; ``known``: node. An entry needs a replacement, other than itself, that exists and doesn't lead back.
    """
    each = wanted.select("src", F.explode("dsts").alias("dst")).distinct()
    empty = wanted.where(F.size("dsts") < 1).select("src", F.lit(None).cast(edges.schema["dst"].dataType).alias("dst"), F.lit("no replacement").alias("error"))
    itself = each.where("src = dst").withColumn("error", F.lit("replaces itself"))
    missing = each.join(known.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst", F.lit("target does not exist").alias("error"))
    back = would_cycle(edges, each).select("src", "dst", F.lit("target leads back").alias("error"))
    return empty.union(itself).union(missing).union(back)


def histories(edges: DataFrame, starts: DataFrame, known: DataFrame, limit: int = 200, stale: bool = False) -> DataFrame:
    """The lineage of each start (node), both ways: src, nodes, edges, broken, truncated, stale, completeness.

    nodes: (level, node, missing) of the first ``limit`` in order of level and node; nothing is looked up beyond the level
    at which there are more, so a start with a large lineage costs no more than its limit. edges: those of these nodes.
    broken: edges to a missing one. A lineage is ``complete`` if it is neither truncated, nor broken, nor from stale edges.
    """
    spark = edges.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    one_way = edges.select("src", "dst").distinct()
    steps = one_way.union(one_way.select("dst", "src")).distinct().toDF("node", "next")
    seen = starts.select(F.col("node").alias("src"), "node", F.lit(0).alias("level"), F.lit(False).alias("cut")).distinct().checkpoint()
    front, level = seen, 0
    while front.head(1):
        level += 1
        fresh = front.join(steps, "node").select("src", F.col("next").alias("node")).distinct().join(seen.select("src", "node"), ["src", "node"], "left_anti")
        have = seen.groupBy("src").agg(F.count("*").alias("have"))
        place = F.row_number().over(W.partitionBy("src").orderBy("node")) + F.col("have")
        fresh = fresh.join(have, "src").withColumn("place", place).where(F.col("place") <= limit + 1)
        fresh = fresh.select("src", "node", F.lit(level).alias("level"), (F.col("place") > limit).alias("cut")).checkpoint()
        seen = seen.union(fresh).checkpoint()
        full = fresh.where("cut").select("src")
        front = fresh.join(full, "src", "left_anti")
    truncated = seen.where("cut").select("src", F.lit(True).alias("truncated"))
    nodes = seen.where("not cut").join(known.select("node", F.lit(False).alias("missing")).distinct(), "node", "left").withColumn("missing", F.coalesce("missing", F.lit(True)))
    listed = nodes.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("level", "node", "missing"))).alias("nodes"))
    near = nodes.select(F.col("src").alias("of"), "node")
    touching = near.join(one_way, near.node == one_way.src).select("of", "src", "dst").union(near.join(one_way, near.node == one_way.dst).select("of", "src", "dst")).distinct()
    gone = nodes.where("missing").select(F.col("src").alias("of"), F.col("node").alias("dst"), F.lit(True).alias("gone"))
    touching = touching.join(gone, ["of", "dst"], "left")
    edge = F.struct("src", "dst")
    links = touching.groupBy(F.col("of").alias("src")).agg(F.sort_array(F.collect_list(edge)).alias("edges"), F.sort_array(F.collect_list(F.when(F.col("gone"), edge))).alias("broken"))
    out = listed.join(links, "src", "left").join(truncated, "src", "left")
    none = F.array().cast(links.schema["edges"].dataType)
    out = out.select("src", "nodes", F.coalesce("edges", none).alias("edges"), F.coalesce("broken", none).alias("broken"), F.coalesce("truncated", F.lit(False)).alias("truncated"), F.lit(stale).alias("stale"))
    whole = ~F.col("truncated") & ~F.col("stale") & (F.size("broken") == 0)
    return out.withColumn("completeness", F.when(whole, "complete").otherwise("partial"))


def edge_health(have: DataFrame, want: DataFrame, stale: bool) -> dict:
    """Numbers of edges that are missing or too many, and whether the edge table can be trusted."""
    n = {r.kind: r["count"] for r in drift(have, want).groupBy("kind").count().collect()}
    return {"stale": stale, "missing": n.get("missing", 0), "extra": n.get("extra", 0), "consistent": not n and not stale}
