"""Strings of JSON texts against Python's parser and a walk of the tree."""

import json
import random
import re

from pyspark.sql import functions as F

from tidewall.functions import jsontext
from tidewall.operators.advisory import flatten_json
from tidewall.sources.audit import sanitize_json


def leaves(value, depth=0):
    if depth > 64:
        return
    if isinstance(value, str):
        yield value
    for k, v in value.items() if isinstance(value, dict) else ((None, x) for x in value) if isinstance(value, list) else ():
        if k is not None:
            yield k
        yield from leaves(v, depth + 1)


def clean(value):
    if isinstance(value, str):
        value = re.sub("\x1b\\[[0-9;?]*[A-Za-z]", "", value)
        raw = value.encode()
        kept = raw[:4000].decode(errors="ignore")
        return value if len(raw) <= 4000 else f"{kept}...[truncated {len(raw) - len(kept.encode())} bytes]"
    if isinstance(value, dict):
        return {clean(k): clean(v) for k, v in value.items()}
    return [clean(v) for v in value] if isinstance(value, list) else value


def tree(rng, depth=0):
    kind = rng.random()
    if depth > 6 or kind < 0.3:
        return "".join(rng.choice(['a', '"', "\\", "é", "\n", "[", "}", ":", " ", "\x1b[1m", "😀", "\u0001", "/"]) for _ in range(rng.randrange(8)))
    if kind < 0.4:
        return rng.choice([1, -2.5, True, None, 0])
    if kind < 0.7:
        return [tree(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f'k{n}{rng.choice(["", chr(34), " :", "é", chr(92)])}': tree(rng, depth + 1) for n in range(rng.randrange(4))}


def test_against_a_parser(spark):
    rng = random.Random(6)
    texts = [json.dumps(tree(rng), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for _ in range(400)]
    deep = '"leaf"'
    for k in range(70):
        deep = f'["at {k}", {{"key {k}": {deep}, "after {k}": "x"}}]' if k % 3 else f"[{deep}]"
    texts += [deep, "[" * 64 + '"in"' + "]" * 64, "[" * 65 + '"out"' + "]" * 65, "[" * 64 + '{"key": "out"}' + "]" * 64, '"top"', "12", "null", "{}", ' {"a" : "b"} ']
    texts += [json.dumps({"long": "é" * 3000, "x" * 5000: ["\x1b[31mred\x1b[0m"]}), json.dumps([["s"]] * 3000), json.dumps("z\\\"" * 200_000)]
    bad = ["", " ", "{", '{"a": }', '["a" "b"]', "a", '{"a": "b"} x', '"open', None, '["a\tb"]'[:-1]]
    df = spark.createDataFrame([(t,) for t in texts + bad], "raw string").repartition(4)
    for r in df.select("raw", flatten_json(F.col("raw")).alias("flat"), sanitize_json(F.col("raw")).alias("clean")).collect():
        if r["raw"] in bad:
            assert r["flat"] == "" and r["clean"] is None, r["raw"]
            continue
        value = json.loads(r["raw"])
        assert r["flat"] == (value if isinstance(value, str) else " ".join(leaves(value)))
        assert json.loads(r["clean"]) == clean(value)


def test_repeated_keys_are_all_scanned(spark):
    (row,) = spark.createDataFrame([('{"a": "one", "a": "two"}',)], "raw string").select(flatten_json(F.col("raw")).alias("x")).collect()
    assert row["x"] == "a one a two"


def test_no_python_worker(spark):
    df = spark.createDataFrame([("[]",)], "raw string").select(flatten_json(F.col("raw")), sanitize_json(F.col("raw")), jsontext.strings(F.col("raw")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
