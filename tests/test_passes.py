"""The compile pass as keyed state: edits out of order, a restart, deletions, a clock that runs ahead."""

import time

from pyspark.sql import functions as F

from quillon.streaming import passes


def test_passes(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", passes.STATE_STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    source, target, checkpoint = (str(tmp_path / name) for name in ("events", "notes", "checkpoint"))
    now = time.time()

    def arrive(*rows):
        """corpus, id, content, seconds from now, deleted."""
        made = [("ai", i, c, float(now + s), d) for i, c, s, d in rows]
        df = spark.createDataFrame(made, "corpus string, id long, content string, s double, deleted boolean").withColumn("at", F.timestamp_seconds("s"))
        df.select("corpus", "id", "content", "at", "deleted").coalesce(1).write.mode("append").parquet(source)

    def started():
        events = spark.readStream.schema(passes.EVENTS).parquet(source)
        return passes.apply_passes(passes.quiet_notes(events, quiet_ms=1500), target, checkpoint)

    def settled(want, query):
        end = time.time() + 120
        got = None
        while time.time() < end:
            if query.exception():
                raise query.exception()
            try:
                got = {r.id: r.content for r in passes.notes_now(spark.read.schema(passes.EVENTS + ", version int").parquet(target)).collect()}
            except Exception:  # no pass yet
                got = None
            if got == want:
                return
            time.sleep(1)
        raise AssertionError(got)

    try:
        arrive((1, "second", -10, False), (1, "first", -20, False), (2, "two", -20, False), (3, "ahead", 9999, False), (4, None, -5, False))
        query = started()
        settled({1: "second", 2: "two", 3: "ahead", 4: ""}, query)
        arrive((1, "late", -15, False))  # older than what came before: nothing changes
        arrive((2, None, -8, True))
        settled({1: "second", 3: "ahead", 4: ""}, query)
        query.stop()
        arrive((2, "late, after its deletion", -9, False), (1, "third", -1, False))
        now = time.time() + 30  # a clock within the bound
        arrive((3, "edited after the clock that ran ahead", 0, False))
        query = started()  # goes on where it was
        settled({1: "third", 3: "edited after the clock that ran ahead", 4: ""}, query)
        versions = spark.read.schema(passes.EVENTS + ", version int").parquet(target)
        assert versions.where("id = 1").count() == 2  # a pass for each time the note was quiet
    finally:
        for q in spark.streams.active:
            q.stop()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
