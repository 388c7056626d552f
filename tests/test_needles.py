"""Needles of a table against a search for each."""

import random
import re

from pyspark.sql import functions as F

from tidewall.operators import needles


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


def places(text, needle):
    return [k for k in range(len(text) - len(needle) + 1) if text.startswith(needle, k)]


def test_against_a_search_for_each(spark, monkeypatch):
    rng = random.Random(9)
    draw = lambda n: "".join(rng.choice(["a", "b", "A", "é", "İ", "_", " ", "😀", "1"]) for _ in range(n))
    words = [w for w in {draw(rng.randrange(1, 5)) for _ in range(300)}]
    texts = [draw(rng.randrange(0, 60)) for _ in range(120)] + ["", None, "aB" * 50_000]
    df = spark.createDataFrame([(t, "x") for t in texts], "text string, needle string").repartition(3)
    table = spark.createDataFrame([(w,) for w in [*words, *words[:5], "", None]], "needle string")
    least = {}
    for w in words:
        least[lower(w)] = min(w, least.get(lower(w), w))
    for part, word in ((1 << 20, False), (300, False), (1 << 20, True)):
        monkeypatch.setattr(needles, "PART_BYTES", part)
        for r in needles.needle_hits(df, table, word=word).collect():
            if r["text"] is None:
                assert r["hits"] is None
                continue
            low, want = lower(r["text"]), {}
            for plain, w in least.items() if len(low) < 1000 else list(least.items())[:40]:
                at = [k for k in places(low, plain) if not word or not re.search("[a-z0-9_]", low[max(0, k - 1) : k] + low[k + len(plain) : k + len(plain) + 1])]
                if at:
                    want[w] = (len(at), at[0])
            got = {h["needle"]: (h["n"], h["first"]) for h in r["hits"]}
            assert len(got) == len(r["hits"]) and (got == want if len(low) < 1000 else all(got.get(w) == x for w, x in want.items()))


def test_no_needles(spark):
    df = spark.createDataFrame([("a",), (None,)], "text string")
    assert [r["hits"] for r in needles.needle_hits(df, spark.createDataFrame([], "needle string")).collect()] == [[], None]


def test_thousands_of_needles_in_one_pass(spark):
    table = spark.range(20_000).select(F.concat(F.lit("N"), "id", F.lit(".")).alias("needle"))
    df = spark.range(200).select(F.concat(F.lit("see n"), F.col("id") * 150, F.lit(". and n5.")).alias("text"))
    found = needles.needle_hits(df, table)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.agg(F.sum(F.size("hits"))).first()[0] == 200 + len([k for k in range(200) if k * 150 < 20_000 and k * 150 != 5])
