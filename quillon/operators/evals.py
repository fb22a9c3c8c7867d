"""Retrieval quality: recall, noise, parity, outcomes, tallies and sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..workspace import written


def recall(found: Column, expected: Column) -> Column:
    """Share of the expected that was found; 1 if nothing was expected."""
    n = F.size(F.array_distinct(expected))
    return F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(found, expected)) / n)


def noise(found: Column, expected: Column) -> Column:
    return F.when(F.size(found) == 0, 0.0).otherwise(F.size(F.array_except(found, expected)) / F.size(F.array_distinct(found)))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def reciprocal_rank(found: Column, expected: Column) -> Column:
    """1 / rank of the first found one that was expected."""
    at = F.array_position(F.transform(found, lambda r: F.array_contains(expected, r)), True)
    return F.when(at > 0, 1.0 / at).otherwise(0.0)


def outcome(gained: Column, lost: Column) -> Column:
    return (
        F.when((gained > 0) & (lost == 0), "pure_gain").when((gained > 0) & (lost > 0), "mixed").when(lost > 0, "regression").otherwise("no_change")
    )


def stratified_split(items: DataFrame, strata: list[str], key: str) -> DataFrame:
    """Of each stratum every third item in order of the key is held out."""
    at = F.row_number().over(W.partitionBy(*strata).orderBy(key)) - 1
    return items.withColumn("split", F.when(at % 3 == 2, "holdout").otherwise("train"))


def tally(items: DataFrame, by: list[str], err: str = "err") -> DataFrame:
    return items.groupBy(*by).agg(F.count("*").alias("total"), F.sum(F.col(err).cast("int")).alias("errors"))


def within_bound(errors: Column, total: Column, bound: float) -> Column:
    return errors / total <= bound + 1e-9


def sweep(items: DataFrame, thresholds: list[float], score: str, by: list[str]) -> DataFrame:
    """Numbers of items at or above each threshold, one pass over the items."""
    grid = F.array(*[F.lit(t) for t in thresholds])
    each = items.select(*by, F.col(score), F.explode(grid).alias("threshold"))
    return each.groupBy("threshold", *by).agg(F.count("*").alias("total"), F.sum((F.col(score) >= F.col("threshold")).cast("int")).alias("surfaced"))


def golden(items: DataFrame) -> DataFrame:
    """Each item (found, expected, must_find and, where there is another wording, alt) with recall, noise, passed, parity."""
    found, expected = F.array_distinct("found"), F.array_distinct("expected")
    hits = F.size(F.array_intersect(found, expected))
    odd = F.size(F.filter("found", lambda r: ~F.array_contains("expected", r)))
    return items.select(
        "*", recall(found, expected).alias("recall"), F.when(F.size("found") > 0, odd / F.size("found")).otherwise(0.0).alias("noise"),
        (hits >= F.col("must_find")).alias("passed"), F.when(F.col("alt").isNotNull(), jaccard(found, F.array_distinct("alt"))).alias("parity"),
        F.array_sort(F.array_except(expected, found)).alias("missed"),
    )


def golden_report(judged: DataFrame) -> DataFrame:
    """category (null: all), total, passed, pass_rate, recall, noise, parity (of items with another wording), rounded to 3."""
    mean = lambda c: F.round(F.avg(c), 3).alias(c)
    out = judged.rollup("category").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), mean("recall"), mean("noise"), mean("parity"))
    return out.withColumn("pass_rate", F.round(F.col("passed") / F.col("total"), 3))


def rewrites(items: DataFrame) -> DataFrame:
    """Each item (original, united, keyword: arrays of results) with what the rewritten wording gains and loses, its outcome,
    and how many of the keyword search's results each has."""
    gained, lost = F.array_sort(F.array_except("united", "original")), F.array_sort(F.array_except("original", "united"))
    common = lambda c: F.size(F.array_intersect(c, "keyword"))
    out = items.withColumn("gained", gained).withColumn("lost", lost)
    return out.select("*", outcome(F.size("gained"), F.size("lost")).alias("outcome"), common("original").alias("original_overlap"), common("united").alias("united_overlap"))


def rewrite_report(judged: DataFrame) -> DataFrame:
    """outcome (null: all), n, gained, lost and mean overlaps, rounded to 2."""
    mean = lambda c: F.round(F.avg(c), 2).alias(c)
    return judged.rollup("outcome").agg(F.count("*").alias("n"), F.sum(F.size("gained")).alias("gained"), F.sum(F.size("lost")).alias("lost"), mean("original_overlap"), mean("united_overlap"))


def write_report(report: DataFrame, details: DataFrame, path: str) -> None:
    """A report and its items as JSON lines."""
    report.coalesce(1).write.json(f"{path}/report")
    details.write.json(f"{path}/details")


def order_statistics(rows: DataFrame, by: str, value: str) -> DataFrame:
    """``by``, n, p50 (the median) and p95 (the value at 95 % of the sorted ones), exact.

    Rows are sorted by range, so that no task gets all rows of a group; what the driver gets is a row for each partition
    and group in it. The wanted rows are then found by their numbers.
    """
    r = rows.where(F.col(value).isNotNull()).select(F.col(by).alias("g"), F.col(value).alias("v"))
    at = F.monotonically_increasing_id()
    ranged = written(r.repartitionByRange("g", "v").sortWithinPartitions("g", "v").withColumn("at", at), "sorted").withColumn("part", F.shiftright("at", 33))
    counts = sorted(ranged.groupBy("g", "part").agg(F.count("*").alias("n"), F.min("at").alias("low")).collect(), key=lambda c: c.part)
    spark, total, wanted = rows.sparkSession, {}, []
    for c in counts:
        total[c.g] = total.get(c.g, 0) + c.n
    before = dict.fromkeys(total, 0)
    for c in counts:
        n, lo = total[c.g], before[c.g]
        for name, k in (("p50", (n - 1) // 2), ("p50", n // 2), ("p95", int(n * 0.95))):
            if lo <= k < lo + c.n:
                wanted.append((c.g, name, c.low + k - lo))
        before[c.g] += c.n
    kind = r.schema["g"].dataType
    schema = T.StructType([T.StructField("g", kind), T.StructField("name", T.StringType()), T.StructField("at", T.LongType())])
    picked = ranged.join(F.broadcast(spark.createDataFrame(wanted, schema)), ["g", "at"])  # three rows for each group
    of = lambda name: F.avg(F.when(F.col("name") == name, F.col("v"))).alias(name)
    sizes = F.broadcast(spark.createDataFrame(list(total.items()), T.StructType([T.StructField("g", kind), T.StructField("n", T.LongType())])))
    return picked.groupBy("g").agg(of("p50"), of("p95")).join(sizes, "g").select(F.col("g").alias(by), "n", "p50", "p95")
