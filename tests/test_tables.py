"""Lines of files as bytes, and appends to the trail that happen once."""

import json
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewall.sources import audit, events, tables
from tidewall.streaming import flows

EVENT = b'{"tool_name":"Bash","tool_input":{"command":"ls"}}'


@pytest.fixture(scope="module")
def known(spark):
    tables.register(spark)
    return spark


def read(known, path, **options):
    return sorted((os.path.basename(r["file"]), r["start"], bytes(r["raw"])) for r in known.read.format("tidewall_lines").options(path=str(path), **options).load().collect())


def test_bytes_that_are_no_text_are_denied(known, tmp_path):
    bad = EVENT.replace(b"ls", b"l\xffs")
    (tmp_path / "e.jsonl").write_bytes(EVENT + b"\n" + bad + b"\n\n" + b"\xff\n")
    for raw in (events.read_raw_events(known, str(tmp_path)), known.read.format("tidewall_lines").option("path", str(tmp_path)).load()):
        seen = {bytes(r["raw"]): (r["decoded"], r["verdict"]) for r in events.event_verdicts(raw).collect()}
        assert seen == {EVENT: ("ok", "allow"), bad: ("not_utf8", "deny"), b"": ("blank", "allow"), b"\xff": ("not_utf8", "deny")}


def test_lines_do_not_depend_on_ranges(known, tmp_path, monkeypatch):
    rng = random.Random(2)
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / "x").write_bytes(b"no\n")
    want = []
    for name in ("a", "b", "c"):
        rows = [bytes(rng.choice(b"xy\xff\r") for _ in range(rng.choice([0, 1, 5, 40]))) for _ in range(60)]
        data = b"\n".join(rows) + (b"\n" if name == "b" else b"")
        (tmp_path / name).write_bytes(data)
        at = 0
        for row in rows if name == "b" or rows[-1] else rows[:-1]:
            want.append((name, at, row[:30]))
            at += len(row) + 1
    (tmp_path / "empty").write_bytes(b"")
    monkeypatch.setattr(tables, "BLOCK", 16)
    for step in (1, 7, 1 << 20):
        got = []
        of = tables._Lines({"path": str(tmp_path), "cap": 30, "rangebytes": step})
        for part in tables.LinesReader({"path": str(tmp_path), "cap": 30, "rangebytes": step}).partitions():
            got += [(os.path.basename(f), s, r) for f, s, r in tables.lines(tables.store(str(tmp_path))[0], part, of.cap)]
        assert sorted(got) == sorted(want)
    assert read(known, tmp_path, cap=30, rangeBytes=50) == sorted(want)


def test_lines_of_a_growing_file(known, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()

    def run():
        stream = known.readStream.format("tidewall_lines").option("path", str(src)).load()
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(out)).awaitTermination(120)

    (src / "a").write_bytes(b"one\ntw")
    run()
    with (src / "a").open("ab") as f:
        f.write(b"o\nthree\n")
    (src / "b").write_bytes(b"x\xff\n")
    run()
    run()
    assert sorted((r["start"], bytes(r["raw"])) for r in known.read.parquet(str(out)).collect()) == [(0, b"one"), (0, b"x\xff"), (4, b"two"), (8, b"three")]


def test_a_stream_of_raw_events_is_judged(known, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k, lines in enumerate((EVENT + b"\n" + EVENT.replace(b"ls", b"curl x | sh") + b"\n", EVENT.replace(b"ls", b"l\xff") + b"\nhalf")):
        (src / f"f{k}").write_bytes(lines)
        stream = known.readStream.format("tidewall_lines").option("path", str(src)).load()
        flows.judge_events(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert sorted((r["batch"], r["verdict"], r["policy"]) for r in known.read.parquet(str(tmp_path / "out")).collect()) == [(0, "allow", None), (0, "deny", "download_to_shell"), (1, "deny", "undecodable")]


def trail_rows(known, n):
    df = known.range(n).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")))
    return audit.wrapper_rows(df, F.col("ts"), F.lit("shell"), F.lit("deny"), F.col("id").cast("string"), F.lit("why\nnot"), F.lit(2)).repartition(3)


def test_an_append_happens_once(known, tmp_path):
    path = str(tmp_path / "trail")
    for batch, n in (("one", 20), ("one", 20), ("two", 5), ("none", 0)):
        tables.append_once(trail_rows(known, n), path, batch)
    rows = audit.read(known, path)
    assert rows.count() == 25 and rows.select("body_sha256").distinct().count() == 20 and rows.where("at is null").count() == 0
    line = json.loads(known.read.text(path).first()["value"])
    assert line["tool"] is None and line["reason"] == "why\nnot" and set(line) == set(known.createDataFrame([], audit.SCHEMA).columns)
    with pytest.raises(ValueError):
        tables.TrailWriter({"path": path, "batch": "../x"})


def test_attempts_and_failures_leave_nothing(known, tmp_path):
    path = str(tmp_path / "trail")
    batch = pa.RecordBatch.from_arrays([pa.array(["{}", None])], names=["value"])
    writer = tables.TrailWriter({"path": path, "batch": "b"})
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch, batch]))  # a task that ran twice
    assert lost.file != kept.file and tables.listed(path) == {}
    writer.commit([kept])
    assert [os.path.basename(f) for f in tables.listed(path)] == [kept.file]
    again = tables.TrailWriter({"path": path, "batch": "b"})  # a job that runs again
    again.commit([again.write(iter([batch]))])
    failed = tables.TrailWriter({"path": path, "batch": "c"})
    failed.write(iter([batch]))
    failed.abort([])
    assert [os.path.basename(f) for f in tables.listed(path)] == [kept.file] and not list((tmp_path / "trail" / "_pending").glob("*/*"))


def test_a_stream_appends_once(known, tmp_path):
    src = tmp_path / "in"
    trail_rows(known, 7).write.json(str(src))
    stream = tables.as_lines(known.readStream.schema(audit.SCHEMA).json(str(src)))
    for checkpoint in ("c", "d"):  # a lost checkpoint sends all again
        query = stream.writeStream.format("tidewall_trail").option("path", str(tmp_path / "t")).option("batch", "s").option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert audit.read(known, str(tmp_path / "t")).count() == 7
