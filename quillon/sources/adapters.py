"""The test tables as the engine's tables: pure projections, so Catalyst prunes and pushes through them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators.vector import unit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corpus, id, title, summary (the second line), content, tags, created_at, embedded_at (null for every ninth
    entry); every eleventh entry is marked obsolete in its title."""
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    mark = F.when(F.col("doc_id") % 11 == 0, "[SUPERSEDED] ").otherwise("")
    made = F.expr("timestamp '2026-01-01 00:00:00' - make_dt_interval(cast(doc_id % 1000 as int))")
    return table(spark, sf_dir, "documents").select(
        F.when(F.col("lang") == "en", "homelab").otherwise("ai").alias("corpus"),
        F.col("doc_id").alias("id"),
        F.concat(mark, first).alias("title"),
        F.split_part("text", F.lit("\n"), F.lit(2)).alias("summary"),
        F.col("text").alias("content"),
        F.col("source").alias("tags"),
        made.alias("created_at"),
        F.when(F.col("doc_id") % 9 != 0, made).alias("embedded_at"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, x: vectors of length one."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", unit("embedding").alias("x"))


def corpus_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that have an entry, with its corpus."""
    ids = entries(spark, sf_dir).select("id", "corpus")
    return vectors(spark, sf_dir).join(ids, "id")


def vector_queries(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """qid, qx: every row whose id is divisible by 20; with ``shift`` the vector of a later id (the alternate wording)."""
    v = vectors(spark, sf_dir)
    return v.where((F.col("id") - shift) % 20 == 0).where(F.col("id") >= shift).select((F.col("id") - shift).alias("qid"), F.col("x").alias("qx"))


def raw_notes(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """Markdown files below notes/ and urls/: raw_path, type, title and tags of the front matter (title: else the file's
    name), saved (else the file's time), content. Files that aren't UTF-8 are read as Latin-1; those in ``known``
    (raw_path) are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(path)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    files = files.select(F.col("path").alias("raw_path"), "modificationTime", text.alias("value"))
    if known is not None:
        files = files.join(known.select("raw_path"), "raw_path", "left_anti")
    head = F.regexp_extract("value", r"(?s)\A---\r?\n(.*?)\n---\r?\n", 1)
    scalar = lambda k: front_matter_value(F.regexp_extract(head, rf"(?m)^{k}:[ \t]*(.*)$", 1))
    stem = F.regexp_extract("raw_path", r"([^/]+)\.md$", 1)
    kind = F.when(F.col("raw_path").contains("/urls/"), "url").otherwise("note")
    return files.select(
        "raw_path",
        F.when(scalar("type").isin("note", "url"), scalar("type")).otherwise(kind).alias("type"),
        F.coalesce(F.nullif(scalar("title"), F.lit("")), stem).alias("title"),
        scalar("tags").alias("tags"),
        F.coalesce(F.nullif(scalar("saved"), F.lit("")), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss")).alias("saved"),
        F.regexp_replace("value", r"(?s)\A---\r?\n.*?\n---\r?\n\n?", "").alias("content"),
    )


EVAL_SETS = {
    "golden": "id string, category string, query string, expected_scope string, expected_refs array<string>, must_find_min int, query_alt string, query_alt_language string",
    "rewrite": "id string, category string, natural_query string, keyword_hint string",
    "gate": "id string, label string, origin string, title string, tags string, content string, expected_ids array<long>",
}


def eval_set(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """An evaluation set from JSON; defaults as they count: scope both, one reference to be found."""
    df = spark.read.schema(EVAL_SETS[kind]).json(path, multiLine=True, mode="FAILFAST")
    if kind == "golden":
        defaults = {"expected_scope": F.lit("both"), "expected_refs": F.array().cast("array<string>"), "must_find_min": F.lit(1)}
        df = df.withColumns({c: F.coalesce(c, v) for c, v in defaults.items()})
    return df


def front_matter_value(raw):
    """A scalar of front matter: a JSON string, or the bare text of older files."""
    text = F.trim(raw)
    decoded = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v string")["v"]
    return F.when(text.startswith('"'), F.coalesce(decoded, text)).otherwise(text)


def as_of(cfg: EngineConfig):
    return F.lit(cfg.as_of).cast("timestamp")
