"""Daily sketches of the audit trail that merge: distinct bodies, quantiles of a number, and the most frequent keys.

A day and group is one row of three sketches, whatever the number of its events, so that a report over any span reads stored days and not the trail.

* distinct: HyperLogLog (2 ** lg registers), relative error about 1.04 / sqrt(2 ** lg): 1.6 % at the default of 12.
* quantiles: KLL with k = 200: rank error about 1.65 % at one quantile (99 % of the time).
* top: counters of the CAPACITY most frequent keys of a day (Misra-Gries: what is counted less is taken off all). A key's count is too small by at
  most n / (CAPACITY + 1), of the n events of all merged days; `slack` says by how much at most. Keys with more events are always there.

Days are stored by name, so a day that is sketched again is not stored twice (append_days).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 256
QUANTILES = (0.5, 0.9, 0.99)


def _cut(counts: Column, capacity: int) -> Column:
    """Struct top, slack: counters (key, n) in falling order, less the count of the first that doesn't fit."""
    ordered = F.array_sort(counts, lambda a, b: F.when(a["n"] != b["n"], F.when(a["n"] > b["n"], -1).otherwise(1)).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    off = F.coalesce(F.get(ordered, F.lit(capacity))["n"], F.lit(0).cast("long"))
    less = F.filter(F.transform(F.slice(ordered, 1, capacity), lambda c: F.struct(c["key"].alias("key"), (c["n"] - off).alias("n"))), lambda c: c["n"] > 0)
    return F.struct(less.alias("top"), off.alias("slack"))


def daily(events: DataFrame, day: Column, group: Column, item: Column, value: Column, key: Column, capacity: int = CAPACITY, lg: int = 12) -> DataFrame:
    """day, grp, n, distinct (of item), quantiles (of value), top (of key), slack: one row for each day and group.

    Null items, values and keys are in n only. Keys are counted exactly first, by partial sums, and then cut to the most frequent by a ranking, so no
    task holds all keys of a day.
    """
    rows = events.select(day.alias("day"), group.alias("grp"), item.alias("item"), value.cast("double").alias("value"), key.cast("string").alias("key"))
    sketched = rows.groupBy("day", "grp").agg(F.count("*").alias("n"), F.hll_sketch_agg("item", lg).alias("distinct"), F.kll_sketch_agg_double("value").alias("quantiles"))
    counts = rows.where("key is not null").groupBy("day", "grp", "key").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("at", F.row_number().over(Window.partitionBy("day", "grp").orderBy(F.desc("n"), "key"))).where(F.col("at") <= capacity + 1)
    tops = ranked.groupBy("day", "grp").agg(_cut(F.collect_list(F.struct("key", "n")), capacity).alias("cut"))
    same = [F.col("s.day").eqNullSafe(F.col("t.day")), F.col("s.grp").eqNullSafe(F.col("t.grp"))]
    none = F.array().cast("array<struct<key:string,n:bigint>>")
    joined = sketched.alias("s").join(tops.alias("t"), same[0] & same[1], "left")
    return joined.select("s.day", "s.grp", "s.n", "distinct", "quantiles", F.coalesce("cut.top", none).alias("top"), F.coalesce("cut.slack", F.lit(0).cast("long")).alias("slack"))


def merged(days: DataFrame, *by: str, capacity: int = CAPACITY) -> DataFrame:
    """Stored rows -> by, n, distinct, quantiles, top, slack of their spans; again sketches, that merge on. Without by: of all rows."""
    whole = days.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"), F.sum("slack").alias("lost"))
    # at most capacity counters of each stored row, summed before they are cut again
    sums = days.select(*by, F.explode("top").alias("c")).groupBy(*by, "c.key").agg(F.sum("c.n").alias("n"))
    ranked = sums.withColumn("at", F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("n"), "key"))).where(F.col("at") <= capacity + 1)
    tops = ranked.groupBy(*by).agg(_cut(F.collect_list(F.struct("key", "n")), capacity).alias("cut"))
    cond = F.lit(True)
    for c in by:
        cond = cond & F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}"))
    none = F.array().cast("array<struct<key:string,n:bigint>>")
    joined = whole.alias("s").join(tops.alias("t"), cond, "left")
    return joined.select(*[f"s.{c}" for c in by], "s.n", "distinct", "quantiles", F.coalesce("cut.top", none).alias("top"), (F.col("lost") + F.coalesce("cut.slack", F.lit(0))).alias("slack"))


def report(spans: DataFrame, *by: str, k: int = 10) -> DataFrame:
    """by, n, items (estimated distinct), p50, p90, p99, top (the k most frequent keys with their least counts), slack."""
    at = F.kll_sketch_get_quantile_double("quantiles", F.array(*map(F.lit, QUANTILES)))
    some = F.kll_sketch_get_n_double("quantiles") > 0
    values = F.when(some, at)
    named = [F.get(values, F.lit(i)).alias(f"p{round(q * 100)}") for i, q in enumerate(QUANTILES)]
    return spans.select(*by, "n", F.hll_sketch_estimate("distinct").alias("items"), *named, F.slice("top", 1, k).alias("top"), "slack")


def append_days(days: DataFrame, path: str) -> None:
    """Stores each day once: a day that is sketched again replaces what was stored of it, other days stay."""
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
