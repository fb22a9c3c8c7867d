"""The corpus as tables: reads by reference, rewrites as whole-table expressions, and retention."""

from __future__ import annotations

import contextlib
import json
import os
import re
import tempfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scoring import is_superseded
from ..functions.text import may_hold_secret, redact, redact_udf
from ..workspace import written
from .lineage import MARKER

KEY = ["corpus", "id"]
#: What stands between the line that names a replacement and the history.
NOTICE = "The operational guidance below is historical and must not be followed. Use the replacement records above for the current interpreter mapping."
HISTORY = "--- Historical incident content ---"


def parse_ref(ref: str) -> tuple[str, int]:
    m = re.fullmatch(r"(homelab|ai):([0-9]+)", ref.strip())
    if not m:
        raise ValueError(f"no reference of the form corpus:id: {ref!r}")
    return m[1], int(m[2])


def fetch(entries: DataFrame, ref: str) -> DataFrame:
    corpus, n = parse_ref(ref)
    e = entries.where((F.col("corpus") == corpus) & (F.col("id") == n))
    return e.select(F.concat_ws(":", "corpus", "id").alias("ref"), "title", F.length("content").alias("chars"))


def add(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries with new ones; raw_path from a slug of the title."""
    slug = F.substring(F.regexp_replace(F.lower("title"), "[^a-z0-9-]", "-"), 1, 60)
    new = new.withColumn("raw_path", F.concat(F.lit("notes/"), slug, F.lit(".md"))).withColumn("embedded_at", F.lit(None).cast("string"))
    return entries.unionByName(new, allowMissingColumns=True)


def supersede_entries(entries: DataFrame, replaced: DataFrame) -> DataFrame:
    """Mark entries as replaced (``replaced``: corpus, id, refs): the title's prefix, a first line that names the
    replacement, a notice before the history, and compilation and embedding due anew.

    The same replacement again changes nothing; another one swaps the first line only.
    """
    e = entries.join(replaced, KEY, "left")
    line, body = F.concat(F.lit(MARKER), "refs"), F.coalesce("content", F.lit(""))
    first = F.split_part(body, F.lit("\n"), F.lit(1))
    change, marked = F.col("refs").isNotNull() & (first != line), first.startswith(MARKER)
    rest = F.substring(body, F.length(first) + 2, F.length(body))
    content = F.when(marked, F.concat(line, F.lit("\n"), rest)).otherwise(F.concat(line, F.lit(f"\n\n{NOTICE}\n\n{HISTORY}\n\n"), body))
    named = F.coalesce("title", F.lit(""))
    title = F.when(marked | is_superseded(named), F.col("title")).otherwise(F.concat(F.lit("[SUPERSEDED] "), named))
    due = {c: F.when(F.col("_new"), F.lit(None)).otherwise(F.col(c)) for c in ("embedded_at", "compiled_at") if c in entries.columns}
    out = e.withColumns({"_new": change, "_content": content, "_title": title}).withColumns(due)
    out = out.withColumns({c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) for c in ("content", "title")})
    return out.select(entries.columns)


def retire(entries: DataFrame, vectors: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries and vectors without those in ``gone``, and what was found of each: row, vector, orphan_vector_only, nothing."""
    keep = lambda d: d.join(gone, KEY, "left_anti")
    has = lambda d, c: d.select(*KEY).distinct().withColumn(c, F.lit(True))
    report = gone.join(has(entries, "row"), KEY, "left").join(has(vectors, "vec"), KEY, "left")
    kind = F.when(F.col("row") & F.col("vec"), "retired").when(F.col("row"), "row_only").when(F.col("vec"), "orphan_vector_only").otherwise("nothing")
    return keep(entries), keep(vectors), report.select(*KEY, kind.alias("found"))


def mark_embedded(entries: DataFrame, done: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Entries stamped where their vectors are ``done`` (corpus, id), and those of ``done`` that vanished meanwhile."""
    hit = entries.join(done.select(*KEY).distinct().withColumn("_done", F.lit(True)), KEY, "left")
    stamped = hit.withColumn("embedded_at", F.when(F.col("_done"), now).otherwise(F.col("embedded_at"))).drop("_done")
    return stamped, done.select(*KEY).join(entries.select(*KEY), KEY, "left_anti")


def prune(vectors: DataFrame, entries: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Vectors without those whose entry is gone, written and read back; an error if one is left."""
    key = key or KEY
    ids = entries.select(*key)
    kept = written(vectors.join(ids, key, "left_semi"), "vectors")
    if kept.join(ids, key, "left_anti").head(1):
        raise RuntimeError("vectors without an entry are left")
    return kept


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` that it doesn't replace."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def retained(log: DataFrame, today: str, days: int = 180) -> DataFrame:
    """Days of the log that are kept; one exactly ``days`` old is. On a table partitioned by day whole folders are pruned."""
    return log.where(F.col("day") >= F.date_sub(F.lit(today).cast("date"), days))


def put(meta: DataFrame, new: DataFrame) -> DataFrame:
    """Key and value pairs with ``new`` ones in place of old ones of the same key."""
    return upsert(meta, new, ["key"])


def is_stale(meta: DataFrame) -> bool:
    """Whether the edge table can't be trusted: nothing says that it can until it has been built."""
    row = meta.where("key = 'edges_stale'").select("value").head()
    return row is None or row[0] != "0"


# --- Secrets in what is stored --------------------------------------------------------------------------------------

TEXTS = ["content", "title", "summary", "tags"]


def quarantine(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries with secrets taken out of their texts, and a row (corpus, id, rules) for each entry that had any.

    A rule that only logs changes nothing and makes no row of its own.
    """
    made = entries
    for c in TEXTS:  # only texts that have what a rule needs go through Python
        text = F.coalesce(c, F.lit(""))
        made = made.withColumn(f"_{c}", F.when(may_hold_secret(text), redact_udf(text)).otherwise(F.struct(text.alias("text"), F.array().cast("array<string>").alias("rules"))))
    changed = F.lit(False)
    for c in TEXTS:
        changed = changed | (F.col(f"_{c}.text") != F.coalesce(F.col(c), F.lit("")))
    made = made.withColumn("_changed", changed).withColumn("_rules", F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"_{c}.rules") for c in TEXTS])))))
    shown = [F.when(F.col("_changed"), F.col(f"_{c}.text")).otherwise(F.col(c)).alias(c) if c in TEXTS else F.col(c) for c in entries.columns]
    return made.select(*shown), made.where("_changed").select(*KEY, F.col("_rules").alias("rules"))


def encode_value(value: str) -> str:
    """A scalar of front matter: a JSON string, which is one of YAML as well."""
    return json.dumps(value, ensure_ascii=False)


def decode_value(raw: str) -> str:
    """A JSON string, or the bare text of older files."""
    text = raw.strip()
    try:
        value = json.loads(text) if text.startswith('"') else text
    except ValueError:
        value = text
    return value if isinstance(value, str) else text


def sanitise_note(raw: str) -> str:
    """A raw note without secrets: in its front matter title and tags are decoded, cleaned and written anew, then its body;
    a note without front matter is one text. Lines end at line feeds only; what holds no secret comes back as it is."""
    clean = lambda t: redact(t)[0]
    lines = re.findall(r"[^\n]*\n|[^\n]+", raw)
    ends = [k for k, x in enumerate(lines) if x.rstrip("\n").removesuffix("\r") == "---"]
    if not ends or ends[0] != 0 or len(ends) < 2:
        return clean(raw)
    head = list(lines[: ends[1] + 1])
    for k in range(1, ends[1]):
        name, colon, value = head[k].rstrip("\r\n").partition(":")
        if colon and name.strip() in ("title", "tags"):
            text = decode_value(value)
            if clean(text) != text:
                head[k] = f"{name}: {encode_value(clean(text))}" + head[k][len(head[k].rstrip("\r\n")) :]
    return "".join(head) + clean("".join(lines[ends[1] + 1 :]))


@F.pandas_udf(T.StringType())
def sanitise_note_udf(raw: pd.Series) -> pd.Series:
    return raw.fillna("").map(sanitise_note)


# --- Raw files and pages --------------------------------------------------------------------------------------------


def slug(title: Column, id_: Column) -> Column:
    """A file's name from a title: lower case, spaces as hyphens, nothing but a-z, 0-9 and hyphens, 60 characters at most."""
    name = F.substring(F.regexp_replace(F.replace(F.lower(title), F.lit(" "), F.lit("-")), "[^a-z0-9-]", ""), 1, 60)
    return F.when(F.coalesce(title, F.lit("")) == "", F.concat(F.lit("entry-"), id_.cast("string"))).otherwise(name)


def raw_files(entries: DataFrame) -> DataFrame:
    """name and text of the raw file of each entry (type, title, tags, content, created_at): front matter, then the content."""
    day = F.coalesce(F.substring(F.col("created_at").cast("string"), 1, 10), F.lit("unknown"))
    entries = entries if "type" in entries.columns else entries.withColumn("type", F.lit("note"))
    folder = F.when(F.col("type") == "note", "notes").otherwise("urls")
    name = F.concat(folder, F.lit("/"), day, F.lit("-"), slug(F.col("title"), F.col("id")), F.lit(".md"))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v"))), r'(?s)^\{"v":(".*")\}$', 1)
    head = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("type: "), "type"), F.concat(F.lit("title: "), quoted("title")), F.concat(F.lit("tags: "), quoted("tags")), F.concat(F.lit("saved: "), F.coalesce(F.col("created_at").cast("string"), F.lit(""))), F.lit("---"))
    return entries.select(*KEY, name.alias("name"), F.concat(head, F.lit("\n\n"), F.coalesce("content", F.lit(""))).alias("text"))


def replace_raw_files(entries: DataFrame) -> DataFrame:
    """Write the raw files of entries anew at their raw_path, each in one step; raw_path and the bytes written.

    A reader, or a task that runs again, finds the old text or the new one. Lazy: files are written when the result is read.
    """

    def run(frames):
        for f in frames:
            for path, text in zip(f.raw_path, f.text):
                handle, made = tempfile.mkstemp(dir=os.path.dirname(path))
                with open(handle, "w", encoding="utf-8") as out:
                    out.write(text)
                os.replace(made, path)  # mkstemp's mode, 0600, stays
            yield pd.DataFrame({"raw_path": f.raw_path, "bytes": [len(t.encode()) for t in f.text]})

    texts = raw_files(entries).join(entries.select(*KEY, "raw_path"), KEY)
    return texts.select("raw_path", "text").mapInPandas(run, "raw_path string, bytes long")


def remove_raw_files(entries: DataFrame) -> DataFrame:
    """Delete the raw files of entries (raw_path); raw_path and removed (False: it was gone). Lazy."""

    def run(frames):
        for f in frames:
            there = [os.path.exists(p) for p in f.raw_path]
            for path in f.raw_path:
                with contextlib.suppress(FileNotFoundError):
                    os.unlink(path)
            yield pd.DataFrame({"raw_path": f.raw_path, "removed": there})

    return entries.where("raw_path <> ''").select("raw_path").mapInPandas(run, "raw_path string, removed boolean")


def write_raw_files(entries: DataFrame, folder: str) -> DataFrame:
    """Write raw files that aren't there yet, below a folder that all executors see; name and written (False: it was there).

    Files are made in the executors; one that exists is never replaced, so a task that runs again, or a second entry of
    the same name, changes nothing. Lazy: files are written when the result is read.
    """

    def run(frames):
        for f in frames:
            done = []
            for name, text in zip(f.name, f.text):
                path = os.path.join(folder, name)
                os.makedirs(os.path.dirname(path), mode=0o700, exist_ok=True)
                try:
                    with open(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600), "w", encoding="utf-8") as out:
                        out.write(text)
                    done.append(True)
                except FileExistsError:
                    done.append(False)
            yield pd.DataFrame({"name": f.name, "written": done})

    return raw_files(entries).select("name", "text").mapInPandas(run, "name string, written boolean")


def fetched(pages: DataFrame) -> DataFrame:
    """page_id, url, title and content of pages as a reader service gives them: the title from the page, its text without
    tags, 4000 characters at most. Offline stand-in for a connector; pages without text make no row."""
    title = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>\s*(.*?)\s*</title>", 1))
    text = F.regexp_replace("html", r"(?is)<(script|style|title)\b.*?</\1\s*>", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<[^>]*>", " "), r"\s+", " "))
    got = pages.select("page_id", "url", F.when(title == "", "Untitled").otherwise(title).alias("title"), F.substring(text, 1, 4000).alias("content"))
    return got.where("content <> ''")


def refresh(entries: DataFrame, fresh: DataFrame, now: Column) -> DataFrame:
    """Entries whose ``fresh`` text (corpus, id, title, content) replaces theirs: no summary, new, to be embedded again."""
    new = fresh.select(*KEY, F.col("title").alias("_title"), F.col("content").alias("_content"))
    e = entries.join(new, KEY, "left")
    hit = F.col("_content").isNotNull()
    change = {"title": F.col("_title"), "content": F.col("_content"), "summary": F.lit(""), "created_at": now, "embedded_at": F.lit(None), "compiled_at": F.lit(None)}
    cols = [F.when(hit, change[c]).otherwise(F.col(c)).alias(c) if c in change else F.col(c) for c in entries.columns]
    return e.select(*cols)


def publish(table: DataFrame, path: str) -> str:
    """Write a new version of a table beside the old ones; readers go on with theirs until ``latest`` names the new one,
    which Spark's success marker makes visible only when it is whole."""
    import time
    import uuid

    version = f"{path}/version={time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    table.write.parquet(version)
    return version


def latest(spark, path: str) -> DataFrame:
    """The newest whole version of a published table."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = [p.getPath().toString() for p in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(p.getPath(), "_SUCCESS"))]
    return spark.read.parquet(max(whole))


def remove_late(vectors: DataFrame, entries: DataFrame) -> DataFrame:
    """Vectors whose entry was deleted while they were made go after the batch."""
    return vectors.join(entries.select(*KEY), KEY, "left_semi")
