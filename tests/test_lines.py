"""Chunks of byte streams that arrive in pieces, in batch and on streams, against cutting the whole stream at once."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tidewall.streaming import lines

PIECES = "stream string, piece long, data binary, last boolean"
TOKEN = b"AKIA" + b"A" * 16


def whole_chunks(data, cap):
    out = []
    while data:
        end = data.find(b"\n", 0, cap)
        end = end + 1 if end >= 0 else min(cap, len(data))
        out.append(data[:end])
        data = data[end:]
    return out


def cut(rng, stream, data, n):
    at = sorted(rng.randrange(len(data) + 1) for _ in range(n - 1))
    return [(stream, k, bytearray(data[a:b]), b == len(data) and k == n - 1) for k, (a, b) in enumerate(zip([0, *at], [*at, len(data)], strict=True))]


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["stream"], r["number"])):
        out.setdefault(r["stream"], []).append(bytes(r["chunk"]))
        assert r["number"] == len(out[r["stream"]]) - 1
    return out


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, lines.ROCKS)
    yield spark
    spark.conf.set(key, before)


def test_chunks_of_tables(spark):
    rng = random.Random(1)
    alphabet = [b"a", b"\n", "é".encode(), b"\xff", b"bb", b"\n\n"]
    want, rows = {}, []
    for k in range(30):
        data = b"".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 80)))
        pieces = cut(rng, f"s{k}", data, rng.randrange(1, 8))
        want[f"s{k}"] = whole_chunks(data, 7)
        rows += pieces + [p for p in pieces if rng.random() < 0.3]  # some are sent twice, all out of order
    rng.shuffle(rows)
    rows += [(None, 0, bytearray(b"x"), True), ("n", None, bytearray(b"x"), True), ("z", 0, None, None)]
    assert found(lines.chunks(spark.createDataFrame(rows, PIECES).repartition(3), cap=7).collect()) == want
    assert lines.chunks(spark.createDataFrame([], PIECES)).count() == 0


def test_cap_of_a_mebibyte(spark):
    data = b"x" * (1 << 20) + b"\n" + b"y" * ((1 << 21) + 5)
    rows = [("s", 0, bytearray(data[:1000]), False), ("s", 1, bytearray(data[1000:]), True)]
    assert [len(c) for c in found(lines.chunks(spark.createDataFrame(rows, PIECES)).collect())["s"]] == [(1 << 20) + 1, (1 << 20) + 1, (1 << 20) + 1, 3]


def test_carry_between_micro_batches_and_restarts(rocks, tmp_path):
    # a token, a character and a line are each cut by two arrivals; the query stops and starts in between
    data = b"one " + TOKEN + b" two\n" + "naïve ".encode() + b"\xff" + TOKEN + b"\nopen"
    cuts = [0, 10, 31, data.index("ï".encode()) + 1, len(data) - 15, len(data)]
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()

    def run():
        stream = rocks.readStream.schema(PIECES).parquet(str(src / "*"))
        query = lines.redacted_chunks(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(out))
        query.awaitTermination(120)

    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        rocks.createDataFrame([("s", k, bytearray(data[a:b]), k == len(cuts) - 2)], PIECES).coalesce(1).write.parquet(str(src / f"p{k}"))
        run()
    mark = b"<redacted:aws-access-key>"
    assert found(rocks.read.parquet(str(out)).collect()) == {"s": [b"one " + mark + b" two\n", "naïve ".encode() + b"\xff" + mark + b"\n", b"open"]}


def test_idle_streams_are_flushed(rocks, tmp_path):
    src = tmp_path / "in"
    rocks.createDataFrame([("s", 0, bytearray(b"a\nb"), False), ("s", 2, bytearray(b"d"), False)], PIECES).coalesce(1).write.parquet(str(src / "p0"))
    stream = rocks.readStream.schema(PIECES).parquet(str(src / "*"))
    query = lines.chunks(stream, idle_ms=200).writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 90
        while time.time() < until and rocks.table("idle").count() < 2:
            time.sleep(0.3)
        assert found(rocks.table("idle").collect()) == {"s": [b"a\n", b"bd"]}
    finally:
        query.stop()


def test_bytes_that_are_no_text_stay(spark):
    raw = os.urandom(2000).replace(b"A", b"B") + TOKEN + b"\xff\xfe"
    (row,) = spark.createDataFrame([(bytearray(raw),)], "x binary").select(lines.redacted_bytes(F.col("x")).alias("x")).collect()
    assert bytes(row["x"]) == raw.replace(TOKEN, b"<redacted:aws-access-key>")
