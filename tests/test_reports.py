"""Merged sketches within their bounds, and event-time reports with late, repeated and out-of-order rows."""

import collections
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewall.sources import sketches
from tidewall.streaming import reports


@pytest.fixture(scope="module")
def trail(spark):
    rows = spark.range(60_000).select(
        F.date_add(F.lit("2024-03-01").cast("date"), (F.col("id") % 31 % 30).cast("int")).alias("day"), (F.col("id") % 3).cast("string").alias("tool"),
        (F.xxhash64("id") % 20_000).alias("body"), (F.pmod(F.xxhash64(F.col("id") + 1), F.lit(100_000)) / 10).alias("size"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("hot"), F.col("id") % 14)).otherwise(F.concat(F.lit("rare"), F.pmod(F.xxhash64("id", "id"), F.lit(9000)))).alias("key"),
    )
    return rows.cache()


def test_a_month_from_stored_days(spark, trail, tmp_path):
    c = F.col
    days = sketches.daily(trail, c("day"), c("tool"), c("body"), c("size"), c("key"), capacity=64)
    for _ in range(2):  # a day that is sketched again is there once
        sketches.append_days(days, str(tmp_path / "days"))
    stored = spark.read.parquet(str(tmp_path / "days"))
    assert stored.count() == 90 and stored.agg(F.max(F.size("top"))).first()[0] <= 64
    for by in ((), ("grp",)):
        for r in sketches.report(sketches.merged(stored, *by, capacity=64), *by).collect():
            rows = trail if not by else trail.where(F.col("tool") == r["grp"])
            data = rows.select("body", "size", "key").toPandas()
            assert r["n"] == len(data) and abs(r["items"] / data["body"].nunique() - 1) < 0.05
            ranks = [(data["size"] <= r[p]).mean() for p in ("p50", "p90", "p99")]
            assert np.allclose(ranks, [0.5, 0.9, 0.99], atol=0.02)
            exact = collections.Counter(data["key"])
            assert r["slack"] <= len(data) / 65 + 1
            assert {x["key"] for x in r["top"][:7]} == {k for k, _ in exact.most_common(7)}
            assert all(exact[x["key"]] - r["slack"] <= x["n"] <= exact[x["key"]] for x in r["top"])


def test_sketches_of_nothing(spark):
    schema = "day date, grp string, item long, value double, key string"
    c = F.col
    make = lambda rows: sketches.daily(spark.createDataFrame(rows, schema), c("day"), c("grp"), c("item"), c("value"), c("key"))
    assert make([]).count() == 0
    (row,) = sketches.report(sketches.merged(make([(None, None, None, None, None)] * 3), "grp"), "grp").collect()
    assert (row["n"], row["items"], row["p50"], row["top"], row["slack"]) == (3, 0, None, [], 0)


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def fed(spark, folder, schema, batches, make, out, mode="append"):
    """Runs a query once for each batch of rows, going on from its checkpoint."""
    src = folder / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / f"b{k}"))
        stream = spark.readStream.schema(schema).parquet(str(src / "*"))
        query = make(stream).writeStream.format("parquet").option("checkpointLocation", str(folder / "c")).outputMode(mode).trigger(availableNow=True).start(str(folder / out))
        query.awaitTermination(120)
    return spark.read.parquet(str(folder / out))


def test_repeats_are_dropped_within_the_delay(spark, tmp_path):
    batches = [[("a", at(0)), ("b", at(1)), ("a", at(0))], [("a", at(3)), ("c", at(4))], [("c", at(4)), ("d", at(60))], [("b", at(61)), ("old", at(2))]]
    got = fed(spark, tmp_path, "id string, ts timestamp", batches, lambda s: reports.once(s, ["id"]), "out")
    # b comes again long after, which is another event; what is older than the watermark goes
    assert sorted((r["id"], r["ts"]) for r in got.collect()) == [("a", at(0)), ("b", at(1)), ("b", at(61)), ("c", at(4)), ("d", at(60))]
    table = spark.createDataFrame([x for b in batches for x in b], "id string, ts timestamp")
    assert reports.once(table, ["id"]).count() == 5


def test_sessions_close_after_the_watermark(spark, tmp_path):
    v = lambda user, minute, verdict="allow", policy=None: (user, at(minute), verdict, policy)
    batches = [[v("u", 20, "deny", "p"), v("u", 0), v("w", 5)], [v("u", 45), v("w", 38, "deny", "q")], [v("x", 300)], [v("u", 46), v("x", 301)], [v("z", 900)]]
    schema = "user string, ts timestamp, verdict string, policy string"
    got = fed(spark, tmp_path, schema, batches, lambda s: reports.sessions(s, "user"), "out").collect()
    want = {("u", at(0), at(75), 3, 1, ("p",)), ("w", at(5), at(35), 1, 0, ()), ("w", at(38), at(68), 1, 1, ("q",)), ("x", at(300), at(331), 2, 0, ())}
    assert {(r["user"], r["start"], r["end"], r["n"], r["denials"], tuple(r["policies"])) for r in got} == want
    table = reports.sessions(spark.createDataFrame([x for b in batches for x in b], schema), "user").collect()
    assert {(r["user"], r["start"], r["n"]) for r in table} == {("u", at(0), 4), ("w", at(5), 1), ("w", at(38), 1), ("x", at(300), 2), ("z", at(900), 1)}


def test_denials_meet_advisories_of_two_streams(spark, tmp_path):
    verdicts, advice = "session string, ts timestamp, verdict string, policy string", "session string, ts timestamp, event string"
    one = [[("s", at(10), "deny", "p"), ("s", at(2), "allow", None), (None, at(5), "deny", "n")], [("s", at(14), "deny", "late arrival"), ("t", at(30), "deny", "q")], [("s", at(200), "deny", "far")]]
    two = [[("s", at(0), "scan"), ("s", at(11), "later"), (None, at(5), "null")], [("t", at(16), "edit"), ("t", at(31), "after")], [("s", at(190), "last")]]
    for k in range(3):
        spark.createDataFrame(one[k], verdicts).coalesce(1).write.parquet(str(tmp_path / f"v/b{k}"))
        spark.createDataFrame(two[k], advice).coalesce(1).write.parquet(str(tmp_path / f"a/b{k}"))
        joined = reports.denials_after_advisories(spark.readStream.schema(verdicts).parquet(str(tmp_path / "v/*")), spark.readStream.schema(advice).parquet(str(tmp_path / "a/*")))
        joined.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
    want = {("s", at(0), at(10), "scan", "p"), ("s", at(0), at(14), "scan", "late arrival"), ("s", at(11), at(14), "later", "late arrival"), ("t", at(16), at(30), "edit", "q"), ("s", at(190), at(200), "last", "far")}
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
    flat = lambda rows, schema: spark.createDataFrame([x for b in rows for x in b], schema)
    assert {tuple(r) for r in reports.denials_after_advisories(flat(one, verdicts), flat(two, advice)).collect()} == want
