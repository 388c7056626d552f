"""Repeated ids, rows that can't be told apart, short benchmark items, and columns named like inner ones."""

import collections
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tidewall.llm import decontaminate, mixing, sharding, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def near(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("name", F.lit("clash")).repartition(3)
    return sorted(tuple(r) for r in vectors.near_vectors(df)[0].collect())


def linked(rows):
    unit = np.array([v for _, v in rows], np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.9
    np.fill_diagonal(hit, False)
    reach = np.linalg.matrix_power((hit | np.eye(len(rows), dtype=bool)).astype(float), len(rows)) > 0
    return sorted((i, int(hit[k].sum()), min(rows[j][0] for j in np.flatnonzero(reach[k]))) for k, (i, _) in enumerate(rows))


def test_different_vectors_of_one_id(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    assert near(spark, [(1, a), (1, b), (2, [1.0, 0.1, 0.0]), (3, [0.1, 1.0, 0.0])]) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 25)), np.round(rng.normal(size=3), 1).tolist()) for _ in range(60)]
    rows = [r for r in rows if any(r[1])]
    assert near(spark, rows) == linked(rows)


def test_short_masks_miss_no_substitutions():
    for n in range(1, decontaminate.SPAN):
        wrong = n - -(-n * 75 // 100)
        masks = decontaminate.short_masks(n, 75)
        assert all(len(m) == n and "1" in m for m in masks)
        assert all(any(all(m[p] == "0" for p in places) for m in masks) for places in combinations(range(n), wrong))


def test_short_items_with_substitutions(spark):
    rows, want = [], set()
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(1, 11)]
    for n, item in items:
        allowed = n - -(-n * 75 // 100)
        for changed in range(4):
            for places in list(combinations(range(n), changed))[:: max(1, n // 4)]:
                words = [w if k not in places else f"new{k}" for k, w in enumerate(item.split())]
                rows.append((len(rows), f"before it {' '.join(words)} and after"))
                if changed <= allowed and changed < n:
                    want.add((rows[-1][0], n, n, n - changed))
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["n_item"], r["n_equal"]) for r in got} == want


def test_shards_of_rows_that_cannot_be_told_apart(spark):
    rows = [(7, "same text of one id")] * 1500 + [(None, "same text without an id")] * 1500 + [(None, f"text {k}") for k in range(500)] + [(k, f"text number {k} of its own") for k in range(1000, 1500)]
    sizes = []
    for parts in (2, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        plan = sharding.shard_plan(df, shards=20)
        found = plan.collect()
        assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in found)) == sorted(((i is None, i or 0, len(t) + 16) for i, t in rows))
        shards = collections.defaultdict(list)
        for r in found:
            shards[r["shard"]].append(r)
        mean = sum(r["size"] for r in found) / 20
        assert all(abs(sum(r["size"] for r in x) - mean) <= 0.01 * mean + 45 for x in shards.values()) and len(shards) == 20
        assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in shards.values())
        sizes.append(sorted((s, len(x)) for s, x in shards.items()))
    assert sizes[0] == sizes[1]


def test_written_shards_of_repeated_rows(spark, tmp_path):
    rows = [(7, "same text", k) for k in range(300)] + [(k, f"other {k}", k) for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra int").repartition(3)
    sharding.write_shards(df, str(tmp_path / "out"), shards=5)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["doc_id"], r["text"], r["extra"]) for r in back) == sorted(rows)
    for s in range(5):
        slots = [r["slot"] for r in back if r["shard"] == s]
        assert sorted(slots) == list(range(len(slots))) and 70 <= len(slots) <= 90


def test_columns_named_like_inner_ones_pass_the_stages(spark, tmp_path):
    names = ["_row", "_blob", "row_id", "row_id_", "blob_id", "odd", "odd_id", "blob_spans", "spans", "_odd", "key"]
    words = [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(4)]
    rows = [(1, words[0]), (1, words[1]), (2, words[0]), (None, words[2]), (3, words[3] + " token = " + "0123456789abcdef" * 2)]
    docs = spark.createDataFrame([(i, t, "aa", "s", 1) for i, t in rows], DOCS)
    for name in names:
        docs = docs.withColumn(name, F.lit(f"my {name}"))
    spark.createDataFrame([(0, words[1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = docs
    for _, stage in corpus_pipeline.STAGES[1:4]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["2", "3", "None"] and all(r[name] == f"my {name}" for r in rows for name in names)
    assert "[secret]" in next(r["text"] for r in rows if r["doc_id"] == 3)


def test_scores_do_not_hang_on_partitions_or_slices(spark, monkeypatch):
    rng = np.random.default_rng(7)
    vocab = ["".join(rng.choice(list("abcdefgh"), 3)) for _ in range(300)]
    rows = [(k, k % 5 == 2, " ".join(rng.choice(vocab, int(rng.integers(0, 60))))) for k in range(300)]
    rows += [(None, False, "one text without an id")] * 60 + [(None, False, None), rows[7], rows[7]]
    schema, found = "doc_id long, held_out boolean, text string", []
    for parts, least in ((2, 1 << 22), (7, 0)):
        monkeypatch.setattr(mixing, "SLICE_TOKENS", least)
        scored = mixing.score_documents(spark.createDataFrame(rows, schema).repartition(parts)).collect()
        found.append(sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["score"]) for r in scored))
    assert len(found[0]) == len(rows) and [x[:3] for x in found[0]] == [x[:3] for x in found[1]]
    assert np.allclose([x[3] for x in found[0]], [x[3] for x in found[1]], rtol=1e-6, atol=1e-9)
    # equal texts score alike wherever they are
    assert np.ptp([x[3] for x in found[0] if x[0] and x[2] > 1]) < 1e-6
