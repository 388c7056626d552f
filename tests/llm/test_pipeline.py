"""The pipeline's stages on a small corpus whose right outcome is known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewall.llm._spark import stash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    syllables = {"aa": ["ba", "da", "ga", "ta", "na"], "bb": ["sko", "pri", "elm", "ust", "ork"]}
    text = lambda x, k: " ".join("".join(rng.choice(syllables[x], int(n))) for n in rng.integers(2, 5, k))
    rows = [(i, text(x, 60), x) for i in range(40) for x in [("aa", "bb")[i % 2]]]
    item = text("aa", 25)
    copy = rows[3][1].split()
    copy[30] = "prielm"
    token = "token = " + "0123456789abcdef" * 2
    rows += [(40, rows[2][1], "aa"), (41, " ".join(copy), "bb"), (42, f"{text('aa', 30)} {item}", "aa"), (43, f"{text('bb', 30)} {token} {text('bb', 30)}", "bb"), (44, "123 456", "aa"), (45, None, "aa"), (46, "", "bb")]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, x, "s", len(t or "")) for i, t, x in rows], DOCS).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        rows = out.collect()
        kept[name] = {r["doc_id"]: r for r in rows}
        if name != "packing":
            assert out.columns == columns
            docs = spark.createDataFrame(rows, DOCS)
    every = set(range(47))
    assert set(kept["language_id"]) == every - {44, 45, 46}
    assert set(kept["ngram_jaccard_join"]) == every - {40, 41, 44, 45, 46}
    assert set(kept["decontamination"]) == every - {40, 41, 42, 44, 45, 46}
    assert set(kept["secret_scan"]) == set(kept["decontamination"])
    clean = kept["secret_scan"][43]
    assert "[secret]" in clean["text"] and "0123456789abcdef" not in clean["text"] and clean["n_chars"] == len(clean["text"])
    assert all(kept["secret_scan"][i]["text"] == kept["decontamination"][i]["text"] for i in set(kept["secret_scan"]) - {43})
    assert set(kept["packing"]) == set(kept["secret_scan"])


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in rows} == set(range(47)) - {40, 41, 42, 44, 45, 46}


def through(spark, rows, folder):
    docs = spark.createDataFrame(rows, DOCS).withColumn("key", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stash(stage(spark, docs, folder))
    return sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None), sorted(r["text"] for r in docs.collect() if r["doc_id"] is None)


def test_rows_that_share_an_id_or_have_none(spark, folder):
    text = {k: " ".join(f"{k}{j}" for j in range(40)) for k in "abcdef"}
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"]
    rows = [(1, "a"), (2, "a"), (2, "b"), (3, "c"), (3, "c"), (None, "d"), (None, "d"), (None, "a"), (None, "e"), (4, "e"), (5, "f"), (5, "leak"), (None, "leak too")]
    text |= {"leak": f"{text['f'][:60]} {item}", "leak too": f"x y z {item}"}
    got = through(spark, [(i, text[k], "aa", "s", 1) for i, k in rows], folder)
    # one row of every text: with an id where there is one, and without leaks
    assert got == (sorted([(1, text["a"]), (2, text["b"]), (3, text["c"]), (4, text["e"]), (5, text["f"])]), [text["d"]])


def test_no_documents(spark, folder, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_very_long_document(spark, folder):
    long = " ".join(f"w{j}" for j in range(200_000))
    got, _ = through(spark, [(1, long, "aa", "s", 1), (2, long + " end", "aa", "s", 1), (3, "short text of some words", "aa", "s", 1)], folder)
    assert [i for i, _ in got] == [1, 3]
