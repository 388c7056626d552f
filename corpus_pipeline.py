"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes the documents that its predecessor kept and decides by one operator. Only the last returns
other columns than those of documents. Operators name documents by id; rows without an id, and ids that several rows
have, get ids of their own from their text for that (larger than any other, so that named documents win). So of
identical rows one stays, and rows that share an id are judged each by its own text. Null and empty texts have no
language and are dropped by the first stage. An empty table gives no rows. Texts of any length are judged whole. Further
columns of documents stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewall.llm import decontaminate, jaccard, langid, packing, secrets
from tidewall.llm._spark import held_out, small_side, stash, unstash
from tidewall.llm.queries import tokenizer_path

#: Texts whose best cosine is under this resemble no language
LEAST_LIKENESS = 0.05

#: SQL cannot express the trained stages; tests hold the stages against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts unlike every language; lang is replaced by the prediction."""
    profiles = langid.prototypes(docs.where(~held_out(4)))
    found = langid.predict(docs, profiles).where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_LIKENESS))
    return found.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


#: Ids made from texts begin here
OWN_IDS = 1 << 62


def unused(docs: DataFrame, name: str) -> str:
    """name, made longer until no column of docs has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def with_row_ids(docs: DataFrame, row: str, once: bool = False) -> DataFrame:
    """docs with a column `row`: the id, or for rows that don't have one for themselves an id made from id and text. once: of identical rows only one."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    id_, odd_ = unused(docs, "odd_id"), unused(docs, "odd")
    ids = stash(ids.select(F.col("doc_id").alias(id_), F.lit(True).alias(odd_)))
    own = docs.withColumn(row, F.col("doc_id").cast("long"))
    if ids.isEmpty():
        return own
    marked = own.join(small_side(ids), F.col("doc_id").eqNullSafe(F.col(id_)), "left").drop(id_)
    made = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2) + F.lit(OWN_IDS)
    odd = marked.where(odd_).withColumn(row, made)
    return marked.where(F.col(odd_).isNull()).unionByName(odd.dropDuplicates([row]) if once else odd).drop(odd_)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of every component of linked documents, and one of identical rows."""
    row = unused(docs, "row_id")
    rows = with_row_ids(docs, row, once=True)
    classes = jaccard.jaccard_classes(rows.select(F.col(row).alias("doc_id"), "text"))
    dropped = classes.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(row)).distinct()
    return rows.join(small_side(stash(dropped)), row, "left_anti").select(*docs.columns)


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    row = unused(docs, "row_id")
    rows = with_row_ids(docs, row)
    found = decontaminate.leaks(rows.select(F.col(row).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaked = found.select(F.col("doc_id").alias(row)).distinct()
    return rows.join(small_side(stash(leaked)), row, "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in a text; n_chars follows the new text. Keeps all documents."""
    findings, _ = secrets.scan_documents(docs)
    blob_, spans_ = unused(docs, "blob_id"), unused(docs, "blob_spans")
    found = findings.where(F.size("spans") > 0).groupBy(F.col("blob").alias(blob_)).agg(F.first("spans").alias(spans_))
    marked = docs.withColumn(blob_, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))).join(small_side(stash(found), 100_000), blob_, "left")
    text = F.when(F.col(spans_).isNotNull(), secrets.redact(F.col("text"), F.col(spans_))).otherwise(F.col("text"))
    chars = F.when(F.col(spans_).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return marked.withColumn("text", text).withColumn("n_chars", chars).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences of at most 4096 ids."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("decontamination", remove_benchmark_leaks),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir))
        if before is not None:
            unstash(before)  # what a stage left goes when the next one has read it
        before = docs
    return docs
