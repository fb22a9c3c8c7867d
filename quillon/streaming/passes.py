"""The compile pass as a stream with state: edits of notes, out of order, come out once each note is quiet."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENTS = "corpus string, id long, content string, at timestamp, deleted boolean"
#: The store that keeps keyed state with timers.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
QUIET_MS, SKEW_MS, KEPT_MS = 5_000, 60_000, 7 * 24 * 3600 * 1000


class QuietNotes(StatefulProcessor):
    """A note's latest edit waits until nothing more has come for ``quiet`` milliseconds.

    Edits count by their own time, so one that comes late changes nothing; of equal times a deletion goes last. A clock
    that runs ahead by more than ``skew`` is not believed: its edit counts as made when it came, or it would shut out the
    edits after it. What was last seen of a note, its deletion too, is kept for ``kept``, then forgotten.
    """

    def __init__(self, quiet: int, skew: int, kept: int):
        self.quiet, self.skew, self.kept = quiet, skew, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.note = handle.getValueState("note", "content string, at long, deleted boolean", self.kept)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        seen = self.note.get() if self.note.exists() else None
        best = (seen[1], bool(seen[2]), seen[0]) if seen else None
        changed = False
        for frame in rows:
            for content, at, deleted in zip(frame["content"], frame["at"], frame["deleted"]):
                at = int(at.timestamp() * 1000) if pd.notna(at) else now
                one = (now if at > now + self.skew else at, bool(deleted), "" if deleted or content is None else content)
                if best is None or one[:2] > best[:2]:
                    best, changed = one, True
        if changed:
            self.note.update((best[2], best[0], best[1]))
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(now + self.quiet)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.note.exists():
            content, at, deleted = self.note.get()
            yield pd.DataFrame({"corpus": [key[0]], "id": [key[1]], "content": [None if deleted else content], "at": [pd.Timestamp(at, unit="ms")], "deleted": [bool(deleted)]})

    def close(self) -> None:
        pass


def quiet_notes(events: DataFrame, quiet_ms: int = QUIET_MS, skew_ms: int = SKEW_MS, kept_ms: int = KEPT_MS) -> DataFrame:
    """Events (corpus, id, content, at, deleted) of a stream, the latest of each note once it is quiet. The session's state
    store must be STATE_STORE."""
    processor = QuietNotes(quiet_ms, skew_ms, kept_ms)
    return events.select("corpus", "id", "content", "at", "deleted").groupBy("corpus", "id").transformWithStateInPandas(processor, EVENTS, "Update", "ProcessingTime")


def apply_passes(passes: DataFrame, target: str, checkpoint: str, seconds: int = 1):
    """Write each pass as its own version below ``target``; a pass that runs again overwrites its folder."""

    def write(batch: DataFrame, version: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/version={version}")

    return passes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def notes_now(versions: DataFrame) -> DataFrame:
    """corpus, id, content, at of the notes that are there: the latest pass of each, without deleted ones."""
    last = versions.groupBy("corpus", "id").agg(F.max_by(F.struct("content", "at", "deleted"), F.struct("at", "deleted", "version")).alias("r"))
    return last.select("corpus", "id", "r.*").where("not deleted").drop("deleted")
