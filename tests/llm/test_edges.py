"""Edge cases of the training-data operators: no rows, nulls, repeats, very long texts, columns with clashing names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewall.llm import decontaminate, jaccard, langid, mixing, packing, secrets, substrings, toxicity, vectors

TEXTS = "doc_id long, text string, held_out boolean"
#: Names that operators use inside
CLASHING = ["key", "n", "chunk", "spans", "words", "marks", "seed", "row", "word", "blob", "shard", "size", "hits", "gram", "root"]


def texts(spark):
    long = " ".join(f"w{k % 977}" for k in range(150_000))
    rows = [(1, "a plain text of some words", False), (1, "a plain text of some words", False), (1, "another text", True), (2, None, False), (3, "", True), (None, "no id here", False), (4, long, False), (5, long, True)]
    df = spark.createDataFrame(rows, TEXTS)
    for name in CLASHING:
        df = df.withColumn(name, F.lit("x"))
    return df


def op2(spark, d):
    bench = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(40, 70))), (None, "x"), (2, None)], "item_id long, text string")
    return decontaminate.leaks(d, bench.withColumn("seed", F.lit(1)).withColumn("at", F.lit(1)))


def op3(spark, d):
    machine = toxicity.train(d, spark.createDataFrame([(1, 1), (4, 0), (9, 1)], "doc_id long, toxic int").withColumn("text", F.lit("x")))
    return toxicity.score(d.select("doc_id", "held_out", "text"), machine)


def op7(spark, d):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    return packing.pack(d, path)


def op10(spark, d):
    rows = d.withColumn("lang", F.lit("aa"))
    return langid.predict(d.select("doc_id", "held_out", "text"), langid.prototypes(rows))


RUNS = {
    "2": op2, "3": op3, "4": lambda s, d: jaccard.jaccard_classes(d), "5": lambda s, d: mixing.score_documents(d), "7": op7,
    "8": lambda s, d: substrings.dedup_substrings(d), "9": lambda s, d: secrets.digest(secrets.scan_documents(d)[0]), "10": op10,
}


@pytest.mark.parametrize("name", RUNS)
def test_no_rows(spark, name):
    assert RUNS[name](spark, texts(spark).limit(0)).count() == 0


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows(spark, name):
    d = texts(spark)
    got = RUNS[name](spark, d).collect()
    if name == "2":
        assert {(r["doc_id"], r["item_id"]) for r in got} == {(4, 1), (5, 1)}
    elif name == "7":
        assert {r["doc_id"] for r in got} == {1, 2, 3, 4, 5, None} and all(r["length"] > 0 for r in got)
    else:
        # a row for every row
        assert sorted(map(str, [r["doc_id"] for r in got])) == sorted(map(str, [r["doc_id"] for r in d.collect()]))
    if name in ("3", "10"):
        assert all(0 <= r["score"] <= 1 for r in got)
    if name == "4":
        assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] not in (None, 1)} == {2: 2, 3: 3, 4: 4, 5: 4}
    if name == "8":
        assert {r["doc_id"]: r["n_removed"] for r in got if r["n_words"] > 50} == {4: 0, 5: 150_000}


def test_languages_that_score_alike(spark):
    # of two languages with the same profile, always the same one is named
    rows = [(k, "bada gata", lang) for k in range(4) for lang in ("aa", "bb")]
    profiles = langid.prototypes(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    d = spark.createDataFrame([(k, "bada") for k in range(20)], "doc_id long, text string").repartition(4)
    assert len({r["lang_pred"] for r in langid.predict(d, profiles).collect()}) == 1


def planted(rng, n, dim, pairs):
    base = rng.standard_normal((n, dim))
    # partners at cosines from just under to well over the threshold
    noise = rng.standard_normal((pairs, dim))
    noise *= (np.linalg.norm(base[:pairs], axis=1) / np.linalg.norm(noise, axis=1))[:, None]
    return np.concatenate((base, base[:pairs] + noise * rng.uniform(0.1, 0.5, (pairs, 1)))).astype(np.float32)


def test_forest_of_many_levels_finds_the_links(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LEAF", 12)
    every = planted(np.random.default_rng(5), 1200, 32, 400)
    forest = vectors.Forest(every / np.linalg.norm(every, axis=1, keepdims=True), len(every), 0.9)
    assert forest.levels >= 7 and len(forest.at[0]) > 20
    unit = every.astype(float) / np.linalg.norm(every.astype(float), axis=1, keepdims=True)
    row, leaf = forest.leaves(unit)
    # rows near a threshold lie in several leaves of a tree, all in one at least
    assert len(row) > 1.2 * vectors.TREES * len(every) and all(len(set(row[leaf & 255 == t])) == len(every) for t in range(vectors.TREES))
    hit = unit @ unit.T >= 0.9
    np.fill_diagonal(hit, False)
    rows = [(i, v.tolist()) for i, v in enumerate(every)] + [(None, every[0].tolist()), (7, every[7].tolist())]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("key", F.lit("x")).withColumn("leaf", F.lit("x")).withColumn("label", F.lit(3))
    got = vectors.near_vectors(d)[0].collect()
    links = {r["vec_id"]: r["n_links"] for r in got if r["vec_id"] is not None and r["vec_id"] != 7}
    want = {i: int(hit[i].sum()) for i in links}
    partner = {i for i in links if hit[i, 7]}
    # the repeated row of id 7 is one more member of its class
    assert all(links[i] <= want[i] + (i in partner) for i in links)
    assert sum(links.values()) >= 0.97 * sum(want.values()) and sum(want.values()) > 300
    assert [(r["n_links"], r["component_id"]) for r in got if r["vec_id"] is None] == [(0, None)]
