"""URL lists, source divergence and hard negatives against brute force, and on edge cases."""

import collections
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewall.llm import divergence, negatives, urls

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"), ("block", "a.b", ""), ("allow", "a.b", "/x"), ("block", "b", "/xyz"), ("block", "", "/lost")]
URLS = [
    "https://www.example.com/en/1", "https://WWW.Example.com/EN/1", "http://m.example.com/en/", "http://m.example.com/en", "http://example.com", "https://xexample.com/en/a",
    "x://net/es/1?u=://com/", "https://a.net/fr/#t", "https://a.net/de/", "ftp://a.b", "ftp://c.a.b?x/x", "ftp://c.a.b/xyz", "ftp://a.b/x", "//no.scheme/en/", "", None,
    "https://user@net:80/es/", "https://net/es/é\nü", "http://..com/", "http://" + "a." * 3000 + "net/es/" + "p" * 30_000, "http:///lost", "://com/",
]


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_urls_against_brute_force(spark):
    rows = [(k, u, "x") for k, u in enumerate(URLS)] * 2 + [(None, URLS[0], "x")]
    # columns of the input that the results replace, or that have the names of inner ones
    pages = spark.createDataFrame(rows, "page_id long, url string, Host string").withColumn("_row", F.lit(1)).withColumn("_host", F.lit(2)).repartition(3)
    got = urls.judge(pages, spark.createDataFrame(RULES, "verdict string, host string, path string"))
    assert got.columns == ["page_id", "url", "_row", "_host", "host", "path", "rule", "verdict"]
    found = got.collect()
    assert len(found) == len(rows)
    assert all((r["host"], r["path"], r["rule"], r["verdict"]) == judged(r["url"], RULES) for r in found)


def test_urls_without_rows(spark):
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "https://a.com/")], "page_id long, url string")
    assert urls.judge(pages.limit(0), rules).count() == 0
    assert [tuple(r) for r in urls.judge(pages, rules.limit(0), default="block").collect()] == [(1, "https://a.com/", "a.com", "/", None, "block")]
    # listed with both verdicts, with null parts, and twice
    both = spark.createDataFrame([("allow", "com", None), ("block", "com", None), ("block", "com", None)], "verdict string, host string, path string")
    assert [r["verdict"] for r in urls.judge(pages, both).collect()] == ["block"]


def test_filter_misses_nothing_and_passes_little(spark):
    listed = spark.range(20_000).select(F.concat("id", F.lit(".com")).alias("host"), F.concat(F.lit("/"), F.col("id") % 7).alias("path"))
    blocks = 20_000 * urls.ENTRY_BITS // urls.BLOCK_BITS
    words = urls.bloom_words(listed, blocks)
    place = lambda df: [c.to_numpy() for c in df.select(*[c.alias(n) for c, n in zip(urls._place(F.col("host"), F.col("path"), blocks), "ab", strict=True)]).toArrow().columns]
    assert urls.may_hold(words, *place(listed)).all()
    assert urls.may_hold(words, *place(listed.withColumn("path", F.lit("/other")))).mean() < 0.03
    # a list as long as this against the exact rule, and the shuffled join with its salt
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("x://s."), F.col("id") * 11, F.lit(".com/"), F.col("id") % 7).alias("url"))
    rules = listed.withColumn("verdict", F.lit("block"))
    want = sum(11 * k < 20_000 and (11 * k) % 7 == k % 7 for k in range(3000))
    assert urls.judge(pages, rules).where("verdict = 'block'").count() == want
    before, urls.small_side = urls.small_side, lambda df, *_: df
    try:
        assert urls.judge(pages, rules).where("verdict = 'block'").count() == want
    finally:
        urls.small_side = before


TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def divergence_rows(docs, least=10, top=10):
    docs = [(t or "", g or "", s or "") for t, g, s in docs]
    terms = [TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t, _, _ in docs]
    df = collections.Counter((g, w) for (_, g, _), ws in zip(docs, terms, strict=True) for w in set(ws))
    counts = collections.defaultdict(collections.Counter)
    groups = {(g, s) for _, g, s in docs}
    for (_, g, s), ws in zip(docs, terms, strict=True):
        counts[g, s].update(w for w in ws if df[g, w] >= least)
    out = set()
    for lang in {g for g, _ in groups}:
        kept = sorted((w for g, w in df if g == lang and df[g, w] >= least), key=str.encode)
        mine = sorted(s for g, s in groups if g == lang)
        share = lambda n, total: 1 + 10**9 * (n + 2) // (total + 2 * len(kept))  # noqa: E731, B023
        p = {s: {w: share(counts[lang, s][w], counts[lang, s].total()) for w in kept} for s in mine}
        all_ = sum((counts[lang, s] for s in mine), collections.Counter())
        q = {w: share(all_[w], all_.total()) for w in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in mine:
            pairs = sorted(((-sum(f(p[s][w], p[t][w]) for w in kept), t.encode()) for t in mine if t != s))
            best = sorted(((-f(p[s][w], q[w]), w.encode()) for w in kept if counts[lang, s][w] and p[s][w] > q[w]))[:top]
            for part, rows in (("pair", pairs), ("term", best)):
                out |= {(lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(rows)}
    return out


@pytest.mark.parametrize("limits", [(1 << 18, 1 << 20, 512), (40, 30, 3)])
def test_divergence_against_brute_force(spark, limits, monkeypatch):
    # with small limits: several blocks, tiles and strips
    for name, value in zip(("BLOCK", "TILE", "STRIP"), limits, strict=True):
        monkeypatch.setattr(divergence, name, value)
    rng = np.random.default_rng(5)
    vocab = [*"abcdefghijklmnop", "Ünï", "ß", "naïve", "日本", "x" * 300, "ABC"]
    docs = [(" ,0".join(rng.choice(vocab, int(rng.integers(0, 40)))) + "\x00Tail_end", f"l{k % 2}", f"s{k % 7 if k % 3 else 0}") for k in range(300)]
    docs += [(None, "l0", None), ("12 34", None, "only"), ("rare words here", "l9", "a"), ("rare", "l9", "b"), ("", "l9", ""), ("a b " * 30_000, "l1", "s1"), *[docs[0]] * 60]
    frame = spark.createDataFrame([(k, *d) for k, d in enumerate(docs)], "doc_id long, text string, lang string, source string").withColumn("term", F.lit("clash")).withColumn("n", F.lit("clash")).repartition(4)
    got = [tuple(r) for r in divergence.divergences(frame).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == divergence_rows(docs)


def test_divergence_of_nothing_and_large_counts(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.divergences(empty).count() == 0
    count, total = 8 * 10**15, 9 * 10**15
    assert divergence.shares(np.array([count]), np.array([total])).tolist() == [1 + 10**9 * (count + 2) // total]


def floors(v):
    return [int(np.floor(float(x) * 256)) for x in v]


def hard_rows(rows, positives=5, least=3):
    rows = sorted({(i, lab, tuple(v)) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)})
    whole = [floors(v) for _, _, v in rows]
    out = []
    for a, (i, lab, v) in enumerate(rows):
        if i % 50:
            continue
        s = [(-sum(map(int.__mul__, whole[a], whole[b])), rows[b][0], b) for b in range(len(rows)) if b != a and len(rows[b][2]) == len(v)]
        for top, j, b in sorted(x for x in s if rows[x[2]][1] == lab)[:positives]:
            found = sorted(x for x in s if rows[x[2]][1] != lab and 50 * -top <= 100 * -x[0] <= 95 * -top)[:least]
            out += [(i, j, k + 1, x[1], -top, -x[0]) for k, x in enumerate(found)]
    return sorted(out)


NEG = "vec_id long, embedding array<float>, label int"


def mined(df):
    return sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("id") % 50 == 0).collect())


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_against_brute_force(spark, small, monkeypatch):
    if small:  # many cells, blocks of rows and of anchors, and deep trees
        for name, value in {"CELL": 40, "ROWS": 30 * 8, "ASKS": 3 * 8, "LEAF": 4, "GROUP": 2, "STEP": 2}.items():
            monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(6, 8))
    # few distinct values make ties; a group of copies holds a third of all rows
    data = [(k, np.round(centers[k % 6] + rng.normal(size=8) * 0.3, 1).tolist(), int(rng.integers(0, 3))) for k in range(500)]
    data += [(k, [1.0, 0.5, *[0.0] * 6], k % 2) for k in range(500, 750)]
    odd = [(None, [1.0] * 8, 1), (800, None, 1), (850, [1.0] * 8, None), (900, [float("nan")] * 8, 1), (901, [None] * 8, 1), (950, [1.0, 2.0], 1), (951, [2.0, 1.0], 1), (952, [1.5, 1.0], 2), (1000, [], 1), (1001, [], 1), (1050, [0.0] * 8, 7), (1051, [float("inf")] * 8, 2)]
    df = spark.createDataFrame([*data, *odd, data[0], data[50]], NEG).withColumn("score", F.lit("clash")).withColumn("cell", F.lit("clash")).repartition(3)
    want = hard_rows([(i, lab, v) for i, v, lab in [*data, *odd]])
    assert mined(df) == want and len(want) > 50


def test_hard_negatives_of_shared_ids_and_large_numbers(spark):
    rows = [(50, [1.0, 0.0], 1), (50, [0.9, 0.1], 1), (50, [1.0, 0.0], 2), (7, [0.95, 0.0], 1), (8, [0.8, 0.2], 2), (9, [0.7, 0.2], 2)]
    got = mined(spark.createDataFrame(rows, NEG))
    anchors = collections.Counter(r[0] for r in hard_rows([(i, lab, v) for i, v, lab in rows]))
    assert {r[0] for r in got} == set(anchors) and len(got) == sum(anchors.values())
    # products beyond what doubles hold exactly, and beyond 64 bits
    huge = [(0, [2.0**26, 3.0, 1.0], 1), (1, [2.0**20, 1.0, 1.0], 1), (2, [2.0**19 + 1, 1.0, 1.0], 2), (3, [2.0**19, 2.0, 1.0], 2)]
    assert mined(spark.createDataFrame(huge, NEG)) == hard_rows([(i, lab, v) for i, v, lab in huge])
    beyond = [(0, [3e38, 1.0], 1), (1, [3e38, 1.0], 1), (2, [1e38, 1.0], 2)]
    assert mined(spark.createDataFrame(beyond, NEG)) == []
    assert mined(spark.createDataFrame([], NEG)) == []


def test_bounds_hold_every_score():
    rng = np.random.default_rng(3)
    a, b = rng.integers(-300, 300, (200, 5)).astype(float), rng.integers(-300, 300, (300, 5)).astype(float)
    x, y = negatives.Balls(a, 8), negatives.Balls(b, 16)
    s = negatives.scores(a, b)
    for i, j in itertools.product(range(1, len(x.start)), range(1, len(y.start))):
        low, high = negatives.interval(x, np.array([i]), y, np.array([j]))
        part = s[np.ix_(x.order[x.start[i] : x.stop[i]], y.order[y.start[j] : y.stop[j]])]
        assert not part.size or (low[0] <= part.min() and part.max() <= high[0])
