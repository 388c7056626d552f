"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewall.llm import decontaminate, divergence, jaccard, langid, mixing, negatives, packing, secrets, sharding, sql, substrings, toxicity, urls, vectors
from tidewall.llm._spark import documents, held_out, stash


def op1_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]
    return rows.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op2_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_toxicity_factorization(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = toxicity.train(docs, labels.where(~held_out(4)))
    scored = toxicity.score(docs.select("doc_id", held_out(4).alias("held_out"), "text"), machine)
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op5_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", held_out(7).alias("held_out"), "text")
    return mixing.score_documents(docs)


def op6_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = sharding.shard_plan(documents(spark, sf_dir))
    return plan.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_min_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op8_relative_lz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base rules fill the ledger; the run with all rules then scans each blob for the others alone."""
    docs = documents(spark, sf_dir)
    _, ledger = secrets.scan_documents(docs, kinds=[kind for kind, *_ in secrets.RULES[: secrets.BASE]])
    return secrets.digest(secrets.scan_documents(docs, stash(ledger))[0])


def op10_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profiles = langid.prototypes(docs.where(~held_out(4)))
    rows = docs.select("doc_id", held_out(4).alias("held_out"), "text")
    return langid.predict(rows, profiles).select("doc_id", "held_out", "lang_pred", "score")


def op11_blocked_bloom_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    listed = spark.createDataFrame(sql.LISTED, "verdict string, host string, path string")
    return urls.judge(pages, listed).select("page_id", "host", "path", "rule", "verdict")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(documents(spark, sf_dir))


def op13_dual_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", moved)
    return negatives.hard_negatives(rows, F.col("id") % 50 == 0)


QUERIES = {
    "op1_projection_forest": op1_projection_forest,
    "op2_spaced_seed_decontamination": op2_spaced_seed_decontamination,
    "op3_toxicity_factorization": op3_toxicity_factorization,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_context_mixing": op5_context_mixing,
    "op6_histogram_shards": op6_histogram_shards,
    "op7_min_bin_slack_packing": op7_min_bin_slack_packing,
    "op8_relative_lz_dedup": op8_relative_lz_dedup,
    "op9_secret_ledger": op9_secret_ledger,
    "op10_hyperdimensional_langid": op10_hyperdimensional_langid,
    "op11_blocked_bloom_urls": op11_blocked_bloom_urls,
    "op12_source_divergence": op12_source_divergence,
    "op13_dual_tree_negatives": op13_dual_tree_negatives,
}

ORACLE_SQL = {
    "op4_ngram_jaccard": sql.OP4,
    "op8_relative_lz_dedup": sql.OP8,
    "op9_secret_ledger": sql.OP9,
    "op11_blocked_bloom_urls": sql.OP11,
    "op12_source_divergence": sql.OP12,
    "op13_dual_tree_negatives": sql.OP13,
}
