"""Log of queries: records are checked, redacted and appended by day."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import RULES, redact_query

#: What records may hold.
SCOPES, CHOSEN = ("homelab", "ai", "both", "auto"), ("homelab", "ai", "both", "auto", "none")
LANGUAGES = ("sr", "en")
FAILURES = ("forbidden", "conflict", "unavailable", "retrieval_unavailable", "reranker_unavailable", "http_error", "internal_error")
MOST_RANKED, MOST_BYTES = 10, 32 * 1024
CLIENT, REF = "^[A-Za-z0-9_.-]{1,64}$", "^(homelab|ai):[1-9][0-9]{0,18}$"
#: Records: what was asked, and either what was found (selected_scope, ranked) or how it failed (status, category).
FIELDS = (
    "client string, scope string, selected_scope string, query string, query_alt string, query_alt_language string, "
    "ranked array<struct<ref:string,final_score:double>>, elapsed_ms double, status int, category string"
)


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def fault() -> Column:
    """The first thing that is wrong with a record; null for a good one."""
    unlike = lambda c, allowed: ~F.coalesce(F.col(c).isin(*allowed), F.lit(False))
    odd = F.exists("ranked", lambda r: ~F.coalesce(r["ref"].rlike(REF), F.lit(False)) | ~_finite(r["final_score"]))
    failed = F.col("status").isNotNull() | F.col("category").isNotNull()
    checks = {
        "client": ~F.coalesce(F.col("client").rlike(CLIENT), F.lit(False)),
        "scope": unlike("scope", SCOPES),
        "query": F.col("query").isNull(),
        "elapsed_ms": ~_finite(F.col("elapsed_ms")) | (F.col("elapsed_ms") < 0),
        "query_alt_language": F.col("query_alt_language").isNotNull() & unlike("query_alt_language", LANGUAGES),
        "selected_scope": F.col("selected_scope").isNotNull() & unlike("selected_scope", CHOSEN),
        "ranked": F.coalesce((F.size("ranked") > MOST_RANKED) | odd, F.lit(False)),
        "status": failed & ~F.coalesce(F.col("status").between(400, 599), F.lit(False)),
        "category": failed & unlike("category", FAILURES),
        "result": ~failed & (F.col("ranked").isNull() | F.col("selected_scope").isNull()),
    }
    return F.coalesce(*(F.when(wrong, name) for name, wrong in checks.items()))


@F.pandas_udf(T.StringType())
def _redacted(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else redact_query(t, RULES))


def checked(records: DataFrame) -> DataFrame:
    """All records with ``fault``, and ``line``: a good one as JSON, redacted; too long a line is a fault as well.

    Both wordings are redacted before anything is written, and elapsed_ms is rounded to three digits.
    """
    r = records.withColumn("fault", fault())
    safe = r.withColumn("q", _redacted("query")).withColumn("a", _redacted("query_alt"))
    hit = (F.col("q") != F.col("query")) | F.coalesce(F.col("a") != F.col("query_alt"), F.lit(False))
    shown = {"query": F.col("q"), "query_alt": F.col("a"), "elapsed_ms": F.round("elapsed_ms", 3)}
    names = [f.split()[0] for f in FIELDS.split(", ")]
    fields = [shown.get(n, F.col(n)).alias(n) for n in names] + [F.when(hit, True).alias("redacted")]
    safe = safe.withColumn("line", F.when(F.col("fault").isNull(), F.to_json(F.struct(*fields))))
    long = F.octet_length("line") > MOST_BYTES
    return safe.withColumn("fault", F.when(long, "length").otherwise(F.col("fault"))).withColumn("line", F.when(~long, F.col("line"))).drop("q", "a")


def append(records: DataFrame, path: str) -> None:
    """Good records (with ts) below one folder a day; a job writes all of its files or none that a reader sees."""
    good = checked(records).where("line is not null").select(F.to_date("ts").alias("day"), "line")
    good.write.mode("append").partitionBy("day").parquet(path)


def audit_line(event: Column | str, **fields: Column) -> Column:
    """An audit event as JSON with sorted keys; give the language of a query, never its text."""
    named = {"event": F.lit(event) if isinstance(event, str) else event, **fields}
    return F.to_json(F.struct(*(named[k].alias(k) for k in sorted(named))))
