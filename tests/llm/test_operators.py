"""The training-data operators against brute force, and on edge cases: nulls, empty and long texts, repeats, no rows."""

import collections
import hashlib
import itertools
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewall.llm import _components, decontaminate, jaccard, langid, mixing, packing, secrets, sharding, substrings, toxicity, vectors
from tidewall.llm._components import components
from tidewall.llm._spark import stash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus(seed=3, n=60):
    """Random texts with exact and near copies, a shared passage, and edge cases."""
    rng = np.random.default_rng(seed)
    vocab = ["".join(rng.choice(list("abcdefgh"), 3)) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(vocab, k))
    passage = text(70)
    texts = [text(int(k)) for k in rng.integers(3, 200, n)]
    for k in range(0, n, 6):
        words = texts[k].split(" ")
        texts.append(" ".join(words))
        words[len(words) // 2] = "edited"
        texts.append(" ".join(words))
    texts += [f"{text(20)} {passage} {text(20)}" for _ in range(8)]
    texts += ["", None, "   ", "one", "One", "a b c d", text(3000), "ß é x y \x1cz", passage]
    return [(i, t, "en" if i % 3 else None, f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    # a repeated row, a null id, and an extra column whose name clashes with inner ones
    return spark.createDataFrame([*rows, rows[5], (None, "null id text of six words", None, None, None)], DOCS).withColumn("key", F.lit("x")).repartition(3)


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect() if r["doc_id"] is not None}


def texts_of(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}


def union_find(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingle_sets(texts, n=5):
    out = {}
    for i, t in texts.items():
        w = WORD.findall(lower(t))
        out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (30, 30)] + [(100, 100 + k) for k in range(1, 40)] + [(200 + k, 201 + k) for k in range(30)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = union_find({x for ab in links for x in ab}, links)
    assert got == {k: v for k, v in want.items() if k != 30}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    rounds, real = [], _components.contracted
    monkeypatch.setattr(_components, "contracted", lambda live: rounds.append(1) or real(live))
    got = components(spark.range(1000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))).groupBy("root").count().collect()
    assert [tuple(r) for r in got] == [(0, 1001)] and len(rounds) <= 8


def test_jaccard(docs):
    texts = texts_of(docs)
    sets = shingle_sets(texts)
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0]
    want = union_find(ids, links)
    got = by_id(jaccard.jaccard_classes(docs))
    assert len(links) > 10 and {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(sets[i]), want[i]) for i in ids}
    assert jaccard.jaccard_classes(docs).count() == docs.count()


def test_jaccard_of_many_near_copies(spark):
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for k in rng.choice(120, int(rng.integers(0, 4)), replace=False):
            words[k] = f"x{i}_{k}"
        rows.append((i, " ".join(words), "en", "s", 0))
    sets = shingle_sets({r[0]: r[1] for r in rows})
    want = union_find(list(sets), [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert {i: r["component_id"] for i, r in by_id(jaccard.jaccard_classes(spark.createDataFrame(rows, DOCS))).items()} == want


def test_prefix_choice():
    length, matches = jaccard.choose_prefix(np.ones(100, int), 100, 80)
    assert (length, matches) == (21, 1)
    length, matches = jaccard.choose_prefix(np.full(100, 500), 100, 80)
    assert length == 20 + matches and matches > 1


def test_substrings(docs):
    texts = {i: WORD.findall(t or "") for i, t in sorted(texts_of(docs).items())}
    first, want = {}, {}
    for i, w in texts.items():
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            window = tuple(w[k : k + 50])
            if first.setdefault(window, i) < i:
                gone[k : k + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = by_id(substrings.dedup_substrings(docs))
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == want
    assert sum(v[1] for v in want.values()) > 500
    assert all(sum(b - a for a, b in r["factors"]) == r["n_removed"] for r in got.values())


def words_left(rows, span=50):
    """By brute force: (id, words, removed words) of every row."""
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    holders = collections.defaultdict(set)
    for i, w in words:
        for k in range(len(w) - span + 1):
            holders[tuple(w[k : k + span])].add(i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - span + 1):
            if min(holders[tuple(w[k : k + span])]) < i:
                gone[k : k + span] = [True] * span
        out.append((i, len(w), sum(gone)))
    return sorted(out)


def test_substrings_tell_texts_of_one_id_apart(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(80)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (5, b), (7, b), (6, f"{c} {b}"), (6, c)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.dedup_substrings(d).collect())
    assert got == words_left(rows) and (5, 80, 0) in got and (5, 80, 80) in got and (6, 80, 0) in got


def test_substrings_cross_the_boundaries_of_factors(spark):
    w = [f"w{k}" for k in range(400)]
    join = " ".join
    # 10 is covered by two references that overlap in 60 words, 11 by two that only touch, 12 has a copy within itself
    rows = [(1, join(w[:120])), (2, join(w[60:200])), (3, join(w[200:300])), (10, join(w[:200])), (11, join(w[100:300])), (12, join([*w[300:360], "x", *w[300:360]])), (13, join([*w[300:360], "y", *w[300:360]]))]
    long = join([*w[:60], *[f"z{k}" for k in range(30_000)], *w[210:290]])
    rows += [(20, long), (21, join(w[:49])), (22, None), (23, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ref", F.lit("x")).withColumn("marks", F.lit(1))
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.dedup_substrings(d).collect())
    assert got == words_left(rows)


def test_substrings_compare_the_words_of_factors(spark, monkeypatch):
    # two texts whose windows and blocks hash alike lose nothing, as their words differ
    d = spark.createDataFrame([(k, " ".join(f"{x}{j}" for j in range(60))) for k, x in enumerate("ab")], "doc_id long, text string").coalesce(1)
    windows = spark.createDataFrame([(k, 100 + k, s, s) for k in range(2) for s in range(11)], "doc_id long, key long, start int, window long")
    (factor,) = substrings.factored(windows, 50).collect()
    assert factor.asDict() == {"doc_id": 1, "key": 101, "start": 0, "n": 60, "ref": 0, "ref_key": 100, "ref_start": 0}
    monkeypatch.setattr(substrings, "_of_class", lambda entries, words: entries or [])
    marked = d.where("doc_id = 1").withColumn("marks", F.array(F.struct(F.lit(101).alias("key"), F.lit(0).alias("start"), F.lit(60).alias("n"), F.lit(bytearray(b"other")).alias("digest"))))
    (parsed,) = substrings._parsed(marked.toArrow().to_batches())
    assert parsed.to_pylist()[0]["n_removed"] == 0


def test_secrets(spark, monkeypatch):
    hexes, key = "0123456789abcdef" * 2, "AKIA" + "Z9" * 8
    texts = [f'token = "{hexes}" end', f"é😀 {key} x", "password: short secret=abc PASSWORD='longenough1'", "secret=token : abcdef12", None, "", "AKIA123", f"{hexes}g{hexes} {hexes}", f"api_key={key}"]
    rows = [(i, t) for i, t in enumerate([*texts, texts[0], texts[0]])]
    findings, ledger = secrets.scan_documents(spark.createDataFrame([*rows, rows[0], (None, texts[0])], "doc_id long, text string"))
    kinds = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
    digest = secrets.digest(findings)
    for i, r in by_id(digest).items():
        spans = sorted((m.start(), k, m.end(), name) for k, (name, p, g, least) in enumerate(kinds) for m in p.finditer(rows[i][1] or "") if len(m[g]) >= least)
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, b, n in spans).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in spans) for k in range(3)]
    assert digest.count() == len(rows) + 2 and ledger.count() == len(set(texts) - {None})
    # a second run scans nothing that the ledger has, and finds the same
    again, new = secrets.scan_documents(spark.createDataFrame([*rows, (99, "fresh token=abcdefgh")], "doc_id long, text string"), ledger)
    assert new.count() == 1 and by_id(secrets.digest(again))[0] == by_id(digest)[0]
    # a rule with a new version goes over all blobs by itself, the others over none
    monkeypatch.setitem(secrets.VERSIONS, "hex", 2)
    changed, rows_of = secrets.scan_documents(spark.createDataFrame(rows, "doc_id long, text string"), ledger)
    assert {tuple(r["seen"]) for r in rows_of.collect()} == {("hex@2",)} and rows_of.count() == len(set(texts) - {None})
    assert by_id(secrets.digest(changed)) == {i: r for i, r in by_id(digest).items() if i < len(rows)}
    part, base_ledger = secrets.scan_documents(spark.createDataFrame(rows, "doc_id long, text string"), kinds=["access"])
    assert {s["rule"] for r in part.collect() for s in r["spans"]} == {1}
    whole, more = secrets.scan_documents(spark.createDataFrame(rows, "doc_id long, text string"), base_ledger)
    assert by_id(secrets.digest(whole)) == by_id(secrets.digest(changed)) and all("access@1" not in r["seen"] for r in more.collect())
    clean = findings.where("doc_id = 0").limit(1).select(secrets.redact(F.lit(texts[0]), F.col("spans")).alias("t")).first()["t"]
    assert clean == '[secret]" end'


def test_sharding(docs, spark):
    got = sharding.shard_plan(docs, shards=7).collect()
    assert len(got) == docs.count()
    shards = collections.defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in s) == list(range(len(s))) for s in shards.values())
    total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
    assert all(abs(sum(r["size"] for r in shards[k]) - total / 7) <= most for k in range(7))
    texts = texts_of(docs)
    assert all(r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in got if r["doc_id"] is not None)
    hot = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot text")).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    sizes = sharding.shard_plan(hot, shards=40).groupBy("shard").agg(F.sum("size").alias("s")).toPandas()["s"]
    assert len(sizes) == 40 and sizes.max() < 1.05 * sizes.mean()


def test_shards_are_written_whole(docs, tmp_path, spark):
    rows = docs.union(docs.where("doc_id = 5")).withColumn("same", F.lit(1))
    sharding.write_shards(rows, str(tmp_path / "out"), shards=5)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, got.select(*rows.columns).collect())) == sorted(map(str, rows.collect()))
    plan = sharding.shard_plan(rows, shards=5).select("doc_id", "shard", "slot")
    assert sorted(map(tuple, got.select("doc_id", "shard", "slot").collect()), key=str) == sorted(map(tuple, plan.collect()), key=str)


def test_packing_plan():
    rng = np.random.default_rng(0)
    counts = collections.Counter(rng.integers(1, 4096, 3000).tolist())
    patterns = packing.plan(counts)
    used = collections.Counter()
    for times, chosen in patterns:
        assert sum(n * k for n, k in chosen.items()) <= 4096
        for n, k in chosen.items():
            used[n] += n * 0 + k * times
    assert used == counts
    windows = sum(t for t, _ in patterns)
    assert sum(n * c for n, c in counts.items()) > 0.97 * 4096 * (windows - 1)
    assert packing.best_fill({3: 1, 5: 2, 8: 1}, 13) in ({8: 1, 5: 1}, {5: 2, 3: 1})


def test_packing(docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    plain = tokenizers.Tokenizer.from_file(path)
    odd = "Don't 'VE <|endoftext|> İ ΑΣ ﬁ 😀 ́e a\x0bb\x1cc ½"
    assert packing.Encoder(path).encode([odd, "", "It's 12 O'Neil's—ok"])[0].tolist() == [*plain.encode(odd, add_special_tokens=False).ids, 2]
    got = packing.pack(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), path).collect()
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    for i, t in texts_of(docs).items():
        ids, at = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        assert [o for o, _ in sorted(s)] == np.cumsum([0] + [n for _, n in sorted(s)])[:-1].tolist() and sum(n for _, n in s) <= 4096


def test_decontamination(spark):
    rng = np.random.default_rng(2)
    vocab = [f"w{k}" for k in range(300)]
    items = [" ".join(rng.choice(vocab, 30)) for _ in range(6)] + ["too short", None]
    clean = [" ".join(rng.choice(vocab, 200)) for _ in range(30)]
    edited = items[2].split()
    edited[7], edited[19] = "xx", "yy"
    rows = [*clean, f"{clean[0]} {items[0]} {clean[1]}", clean[2] + " " + " ".join(edited), items[3].upper().replace(" ", ", "), " ".join(items[4].split()[:20]), None, ""]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(rows)] + [(30, rows[30]), (None, items[0])], "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(d, b).collect()}
    assert set(got) == {(30, 0), (31, 2), (32, 3), (33, 4)} and got[31, 2]["n_equal"] == 28 and got[30, 0]["first_word"] == 200
    assert decontaminate.leaks(d.limit(0), b).count() == 0 and decontaminate.leaks(d, b.limit(0)).count() == 0


def test_masks_miss_no_substitutions_that_the_rule_allows(spark):
    item = [f"w{k}" for k in range(40)]
    items = {11: item[:11], 12: item[11:23], 40: item}
    rows, want = [], set()
    for n, most in ((11, 2), (12, 3)):
        for s in range(most + 1):
            for places in itertools.combinations(range(n), s):
                rows.append([f"x{k}" if k in places else w for k, w in enumerate(items[n])])
                want.add((len(rows) - 1, n))
    for s in range(4):
        for places in itertools.combinations(range(13), s):
            # an overlap of exactly 13 words with the long item
            rows.append(["p"] * 5 + [f"x{k}" if k in places else w for k, w in enumerate(item[23:36])] + ["q"] * 5)
            want.add((len(rows) - 1, 40))
    rows.append([f"x{k}" if k in (1, 4, 7, 10) else w for k, w in enumerate(items[12])])
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    b = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(d, b).collect()}
    # the long item begins with the short ones
    assert {(i, n) for i, n in got if n != 40 or (i, 40) in want} == want and len(rows) - 1 not in {i for i, n in got if n == 12}


def test_decontamination_of_short_items_and_unspaced_scripts(spark):
    han = "机器学习模型在训练之前必须先清除所有测试题目否则成绩不可信"
    thai = "การเรียนรู้ของเครื่องต้องล้างข้อมูลทดสอบก่อนการฝึก"
    items = ["what is the capital of france", "Paris", "", None, han, thai, "one two three four five six seven eight nine ten"]
    edited = han[:14] + "全" + han[15:]
    rows = ["so: What is the capital of France? i know", "what is the capital of spain", "in paris, paris", "parisian", f"前言{han}后记", f"他说{edited}。", f"ก่อน{thai}", "机器学习很好", "zero one two three four five six seven eight nine ten", "one two three four five six seven eight nine", None, ""]
    d = spark.createDataFrame([*enumerate(rows), (0, rows[0]), (None, "paris")], "doc_id long, text string")
    b = spark.createDataFrame([*enumerate(items), (None, "paris"), (1, "Paris")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["first_word"], r["n_aligned"], r["n_equal"], r["n_item"]) for r in decontaminate.leaks(d, b).collect()}
    n = len(han)
    assert {k: v for k, v in got.items() if k[1] != 5} == {(0, 0): (1, 6, 6, 6), (1, 0): (0, 6, 5, 6), (2, 1): (1, 1, 1, 1), (4, 4): (2, n, n, n), (5, 4): (2, n, n - 1, n), (8, 6): (1, 10, 10, 10)}
    assert [k for k in got if k[1] == 5] == [(6, 5)] and got[6, 5][1] == got[6, 5][2] == got[6, 5][3] > 13


def test_language(spark):
    rng = np.random.default_rng(4)
    syllables = {"aa": ["ba", "da", "ga", "ta"], "bb": ["sko", "pri", "elm", "ust"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[x], 3)) for _ in range(40)), x) for i in range(60) for x in [("aa", "bb")[i % 2]]]
    train = spark.createDataFrame([*rows, (90, "x", None), (91, None, "aa")], "doc_id long, text string, lang string")
    profiles = langid.prototypes(train)
    assert list(profiles) == ["aa", "bb"]
    test = spark.createDataFrame([(1, "Bada gata TAGA", "z"), (2, "skopri elmust", None), (3, None, "aa"), (4, "12 ###", "aa"), (5, "", None), (None, "badaga", None)], "doc_id long, text string, score string")
    got = langid.predict(test, profiles)
    assert {r["doc_id"]: r["lang_pred"] for r in got.collect()} == {1: "aa", 2: "bb", 3: "und", 4: "und", 5: "und", None: "aa"}
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    assert {r["lang_pred"] for r in langid.predict(test, langid.prototypes(train.limit(0))).collect()} == {"und"}
    long = "bada gata " * 150_000
    assert np.allclose(langid.bundle(long) / 150_000, langid.bundle("bada gata " * 1000) / 1000, rtol=0.01, atol=0.01)


def test_toxicity(spark):
    rng = np.random.default_rng(5)
    vocab = [f"{a}{b}" for a in "klmnp" for b in ("ato", "ire", "usk", "olen")]
    rows, labels = [], []
    for i in range(600):
        words, bad = list(rng.choice(vocab, 30)), i % 5 == 0
        # neither term alone is toxic: the pair is
        pair = [["zorg", "blix"], ["zorg", "fine"], ["nice", "blix"], ["nice", "fine"], ["zorg"]][0 if bad else 1 + i % 4]
        rows.append((i, " ".join([*words, *pair])))
        labels.append((i, int(bad)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    machine = toxicity.train(d.where("doc_id < 450"), spark.createDataFrame([*labels, (7, None), (None, 1)], "doc_id long, toxic int").where("doc_id < 450"))
    scored = toxicity.score(d.union(spark.createDataFrame([(900, None), (901, "")], "doc_id long, text string")).withColumn("held_out", F.lit(True)), machine)
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    held = [(got[i] >= 0.3) == bool(bad) for i, bad in labels if i >= 450]
    assert np.mean(held) > 0.97 and all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    empty = toxicity.train(d.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert empty.score(np.zeros(0, int)) < 1e-6


def test_mixing(spark):
    rng = np.random.default_rng(6)
    words = {k: [f"{k}{j}" for j in range(40)] for k in "ab"}
    rows = [(i, " ".join(rng.choice(words["ab"[i % 2]], 60))) for i in range(300)] + [(300, None), (301, ""), (302, "UNSEEN Word a1")]
    d = spark.createDataFrame([*rows, rows[302]], "doc_id long, text string").withColumn("held_out", F.col("doc_id") % 7 == 2)
    got = mixing.score_documents(d, d.where("not held_out")).collect()
    counts = collections.Counter(w for i, t in [*rows, rows[302]] if i % 7 != 2 for w in [*WORD.findall(lower(t)), None])
    n, v = sum(counts.values()), len(counts)
    for r in got:
        tokens = [*WORD.findall(lower(dict(rows)[r["doc_id"]])), None]
        base = sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        assert abs(base - r["base_score"]) < 1e-6 and r["n_tokens"] == len(tokens) and r["n_known"] == sum(w in counts for w in tokens) and r["train_tokens"] == n
    assert len(got) == len(rows) + 1
    held = [r for r in got if r["held_out"] and r["n_tokens"] > 10]
    # the contexts tell the two registers apart, which single words can't
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    none = mixing.score_documents(d.limit(3), d.limit(0)).collect()
    assert len(none) == 3 and all(r["n_known"] == 0 for r in none)


def mixing_chunks(spark, rows):
    """(chunks with answers, vocabulary) of training texts."""
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    vocab = spark.sparkContext.broadcast(mixing.vocabulary(mixing.word_counts(texts)))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(mixing.FOLDS)).cast("int")
    chunks = mixing.cut_chunks(texts.select("doc_id", F.lit(False).alias("held_out"), F.lit(True).alias("scored"), fold.alias("fold"), "text")).cache()
    bits = mixing.key_bits(1 << 16)
    return chunks, mixing.answered(chunks, stash(mixing.answers_to(chunks, vocab, 5, bits)), 5, bits, 1, 0), vocab


def test_mixing_counts_every_context_apart(spark):
    # far more words than any list of frequent ones, each with a word that always follows it
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(w for k in rng.integers(0, 9000, 60) for w in (f"a{k}", f"b{k}", f"c{k}"))) for i in range(400)]
    chunks, answered, vocab = mixing_chunks(spark, rows)
    texts = {}
    ready = [(r, mixing.Chunk.read(r, vocab.value)) for r in (x.asDict() for x in answered.collect())]
    counts = {r["chunk"]: [collections.Counter() for _ in range(mixing.CONTEXTS)] for r, _ in ready}
    before = lambda c, w, k: (w[k - 1] if k else None) if c == 0 else (w[k - 2] if k > 1 else None, w[k - 1] if k else None)
    for r, chunk in ready:
        tokens = chunk.words[chunk.places].tolist()
        for i, lo, hi in zip(r["doc_ids"], chunk.first[:-1], chunk.first[1:], strict=True):
            texts[i] = w = tokens[lo:hi]
            for k in range(len(w)):
                for c in (0, 2):
                    for d in range(mixing.CLASS_BITS + 1):
                        counts[r["chunk"]][c][before(c, w, k), d, w[k] >> 64 - d] += 1
    assert len(texts) == 400 and len(ready) >= mixing.FOLDS
    for r, chunk in ready:
        made = {apart: mixing.model_of(chunk, r, mixing.class_totals(chunks), apart) for apart in (False, True)}
        for lo, hi in list(zip(chunk.first[:-1], chunk.first[1:], strict=True))[:2]:
            w = chunk.words[chunk.places[lo:hi]].tolist()
            for k in range(len(w)):
                for c in (0, 2):
                    for d in range(mixing.CLASS_BITS):
                        for apart, (_, odds, seen) in made.items():
                            n = [sum(counts[f][c][before(c, w, k), e, x] for f in counts if not (apart and f == r["chunk"])) for e, x in ((d, w[k] >> 64 - d), (d + 1, w[k] >> 63 - d & ~1), (d + 1, w[k] >> 63 - d | 1))]
                            at = chunk.of_token[c, lo + k] * mixing.CLASS_BITS + d
                            assert abs(odds[c][at] - np.log((n[2] + 0.4) / (n[1] + 0.4))) < 1e-4 and seen[c][at] == (n[0] > 2) + (n[0] > 30)


def test_mixing_requests_go_from_the_disk_as_answers_come(spark, monkeypatch):
    rng = np.random.default_rng(12)
    chunks, _, vocab = mixing_chunks(spark, [(i, " ".join(f"w{k}" for k in rng.integers(0, 3000, 60))) for i in range(200)])
    left, bits = [], mixing.key_bits(1 << 16)
    once = {(r["chunk"], r["part"]): (r["counts"], r["words"]) for r in mixing.answers_to(chunks, vocab, 7, bits).collect()}

    def unstash(table, only):
        gone(table, only=only)
        left.append(sum(os.path.exists(f.removeprefix("file://")) for f in table.inputFiles()))

    gone = mixing.unstash
    monkeypatch.setattr(mixing, "unstash", unstash)
    grouped = {(r["chunk"], r["part"]): (r["counts"], r["words"]) for r in mixing.answers_to(chunks, vocab, 7, bits, 3).collect()}
    assert grouped == once and len({part for _, part in once}) == 7
    assert left[0] > left[1] > left[2] == 0


def test_keys_are_ranked_by_one_sort():
    rng = np.random.default_rng(13)
    for bits, n in ((20, 0), (20, 1), (14, 5000), (49, 40000), (57, 40000), (62, 3000), (64, 3000)):
        keys = rng.integers(0, 1 << bits, n, dtype=np.uint64)
        # contexts that differ only in their last bits, each with several classes
        keys[n // 2 :] = keys[: n - n // 2] ^ rng.integers(0, 1 << 14, n - n // 2, dtype=np.uint64)
        want = np.unique(keys, return_inverse=True)
        got = mixing.ranked(keys)
        assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])


def test_packed_numbers_come_back():
    for n, kind in ([], np.uint32), ([0, 0], np.uint64), ([255, 1 << 63, 3], np.uint64), (range(1000), np.uint32):
        n = np.array(n, kind)
        assert np.array_equal(mixing.unpack(mixing.pack(n), kind), n) and np.array_equal(mixing.unpack_small(mixing.pack_small(n)), n.astype(np.int64))


def test_mixer_learns_from_every_training_text(spark):
    rows = [(i, f"w{i % 50} x y") for i in range(2600)]
    chunks, answered, vocab = mixing_chunks(spark, rows)
    learned = mixing.learned_sums(answered, vocab, mixing.class_totals(chunks))
    # every bit of every token of every text is in one cell
    assert learned[0] == 2600 * 4 * mixing.CLASS_BITS == learned[1 + mixing.GATES * mixing.INPUTS :].sum()


def test_every_class_bit_is_a_probability():
    weights, refined = np.tile(mixing.START, (mixing.GATES, 1)), np.full((mixing.GATES, mixing.CELLS), 0.3)
    base, odds, seen = np.zeros(1 << mixing.CLASS_BITS, np.float32), np.zeros((3, 1 << mixing.TABLE_BITS), np.float16), np.zeros((3, 1 << mixing.TABLE_BITS), np.uint8)
    every = np.arange(1 << mixing.CLASS_BITS)
    x, gate, bits = mixing._inputs((base, odds, seen), every, np.zeros((3, len(every)), np.uint32))
    z = np.einsum("kn,nk->n", x, weights[gate])
    p = 0.5 * mixing._squash(z) + 0.5 * refined.ravel()[gate * mixing.CELLS + mixing._cell(z)]
    p = np.where(bits, p, 1 - p).reshape(-1, mixing.CLASS_BITS).prod(axis=1)
    assert abs(p.sum() - 1) < 1e-5


def test_vectors(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((300, 16))
    near = base[:60] + rng.standard_normal((60, 16)) * 0.12
    every = [*base.tolist(), *near.tolist(), *base[:20].tolist(), *([base[0].tolist()] * 30)]
    every = [[float(np.float32(x)) for x in v] for v in every]
    rows = list(enumerate(every)) + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None, 1.0]), (1004, [1.0, 1.0]), (1005, [2.0, 2.0]), (1006, [])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))[0].collect()}
    unit = np.array(every) / np.linalg.norm(every, axis=1)[:, None]
    hit = unit @ unit.T >= 0.9
    want = union_find(range(len(every)), list(zip(*np.nonzero(np.triu(hit, 1)), strict=True)))
    assert {i: got[i] for i in range(len(every))} == {i: (int(hit[i].sum()) - 1, int(want[i])) for i in range(len(every))}
    assert [got[i] for i in range(1000, 1007)] == [(0, 1000), (0, 1001), (0, 1002), (0, 1003), (1, 1004), (1, 1004), (0, 1006)]
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))[0].count() == 0


def test_forest_compares_large_leaves_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 20)
    rng = np.random.default_rng(8)
    every = (np.ones(8) + rng.standard_normal((90, 8)) * 0.05).astype(np.float32)
    got = vectors.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(every)], "vec_id long, embedding array<float>"))[0].collect()
    assert all((r["n_links"], r["component_id"]) == (89, 0) for r in got)


@pytest.mark.parametrize("operator", [jaccard.jaccard_classes, substrings.dedup_substrings, sharding.shard_plan, lambda d: secrets.digest(secrets.scan_documents(d)[0])])
def test_no_rows(spark, operator):
    assert operator(spark.createDataFrame([], DOCS)).count() == 0
