"""Shared Spark plumbing of the training-data operators: scratch tables and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of (id, small payload) that may be broadcast; larger sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: Items of its arrays and eighths of its texts' bytes, together
BROADCAST_ITEMS = 8_000_000

_local_dir: dict[str, str] = {}
_folders: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. A temporary folder stands in for it in local mode only."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _local_dir.setdefault("dir", tempfile.mkdtemp(prefix="tidewall-"))


def _tables(spark: SparkSession) -> str:
    """This application's folder of stashed tables, which goes when its driver ends."""
    name = spark.sparkContext.applicationId
    if name not in _folders:
        _folders[name] = f"{scratch_dir(spark)}/tidewall/{name}"
        path = spark._jvm.org.apache.hadoop.fs.Path(_folders[name])
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return _folders[name]


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stash(df: DataFrame, by: str | None = None) -> DataFrame:
    """Cut the lineage: write df as a Parquet table in the shared folder and read it back.

    Unlike localCheckpoint() the table outlives any executor. It is also what size checks count. The shuffle files of
    the plan go once the table is written. by: the column whose values have folders of their own.
    """
    spark = df.sparkSession
    path = f"{_tables(spark)}/{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstash(*tables: DataFrame, only: str = "") -> None:
    """Delete the files of stashed tables that no later plan reads. only: in folders of this name."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if not name.endswith(only):
                continue
            path = sc._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def small_side(stashed: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a stashed table for broadcast if it has at most `rows` rows and BROADCAST_ITEMS items; else Spark shuffles it."""
    held = [F.greatest(F.size(c), F.lit(0)).cast("long") for c, kind in stashed.dtypes if kind.startswith("array")]
    held += [F.coalesce(F.octet_length(c) / 8, F.lit(0)).cast("long") for c, kind in stashed.dtypes if kind in ("string", "binary")]
    items = F.sum(sum(held, F.lit(0).cast("long")))
    count, held = stashed.agg(F.count("*"), F.coalesce(items, F.lit(0))).first()
    return F.broadcast(stashed) if count <= rows and held <= BROADCAST_ITEMS else stashed


def arrow_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of whole texts small. The session's own smaller setting wins.

    It is a setting of the session, as results are planned after this returns. Spark bounds a batch's bytes too.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(mod: int) -> Column:
    """True where the CRC-32 of doc_id as text leaves 2; such rows don't train. A null id is not held out."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % mod == 2, F.lit(False))
