"""Tables made from a source and made anew when it has changed."""

from __future__ import annotations

import time
import uuid
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source_signature(source: DataFrame) -> list:
    """What tells states of a source (with a corpus and an id) apart: its files, and by corpus the number of rows, the
    largest id and time, and the length of all texts."""
    texts = [f.name for f in source.schema.fields if f.dataType.simpleString() == "string" and f.name != "corpus"]
    length = sum((F.coalesce(F.length(F.col(c)), F.lit(0)) for c in texts), F.lit(0)).cast("long")
    made = F.max(F.col("created_at").cast("string")) if "created_at" in source.columns else F.lit(None).cast("string")
    state = source.groupBy("corpus").agg(F.count("*").alias("n"), F.max("id").alias("top"), made.alias("last"), F.sum(length).alias("length"))
    return [sorted(source.inputFiles()), *sorted(([r.corpus, r.n, r.top, r["last"], r.length] for r in state.collect()), key=repr)]


class FollowedTable:
    """``make`` of ``source()``, stored, and made anew when the source has changed.

    Each version is a folder of its own below ``path``, and readers keep the one they have until the new one is whole, so
    a half-made table is never read. A source that can't be read or a version that can't be made leaves the current one
    in place and gives a reason, fixed words without anything of a query; so does a table that can't be read.
    """

    name = "table"

    def __init__(self, spark: SparkSession, path: str, source: Callable[[], DataFrame], make: Callable[[DataFrame], DataFrame], recheck: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.spark, self.path, self.source, self.make, self.recheck, self.clock = spark, path, source, make, recheck, clock
        self.version: str | None = None
        self.schema = self.signature = None
        self.checked_at = float("-inf")
        self.reasons: Counter = Counter()

    def build(self) -> None:
        rows = self.source()
        signature, version = source_signature(rows), uuid.uuid4().hex[:12]
        made = self.make(rows)
        made.write.parquet(f"{self.path}/{version}")
        self.version, self.signature, self.schema = version, signature, made.schema

    def refresh(self) -> str | None:
        """Make it anew if the source has changed, which is looked at once in ``recheck`` seconds; the reason if that fails."""
        now = self.clock()
        if now - self.checked_at < self.recheck:
            return None
        self.checked_at = now
        try:
            signature = source_signature(self.source())
        except Exception as e:
            return self.degraded(f"source fingerprint failed ({type(e).__name__})")
        if signature == self.signature and self.version:
            return None
        try:
            self.build()
        except Exception as e:
            return self.degraded(f"{self.name} rebuild failed ({type(e).__name__})")
        return None

    def table(self) -> tuple[DataFrame | None, str | None]:
        """The current version, or why there is none."""
        try:
            df = self.spark.read.parquet(f"{self.path}/{self.version}")
            if df.schema.names != self.schema.names:
                raise ValueError("other columns")
            return df, None
        except Exception:
            return None, self.degraded(f"{self.name} unusable")

    def degraded(self, reason: str) -> str:
        """Said once for each different reason."""
        self.reasons[reason] += 1
        if self.reasons[reason] == 1:
            print(f"[{self.name}] {reason}", flush=True)
        return reason
