"""Tables of intermediate results in the folder that all executors share, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of texts, that a broadcast side may have; larger sides are shuffled
SMALL_ROWS, SMALL_BYTES = 1_000_000, 64 << 20

PART_BYTES = "64k"

_stand_in: dict[str, str] = {}
_own: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir; it goes when the driver ends. Local mode may do without the setting."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            shared = _stand_in.setdefault("dir", tempfile.mkdtemp(prefix="tidewall-"))
        _own[app] = f"{shared.rstrip('/')}/tidewall/{app}-core"
        path = spark._jvm.org.apache.hadoop.fs.Path(_own[app])
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return _own[app]


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session (with _ for .) for a while."""
    before = {key.replace("_", "."): spark.conf.get(key.replace("_", "."), None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key.replace("_", "."), value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def new_folder(spark: SparkSession) -> str:
    """A name in the shared folder that nothing has."""
    return f"{_folder(spark)}/{uuid.uuid4().hex}"


def _write(df: DataFrame) -> str:
    path = new_folder(df.sparkSession)
    with settings(df.sparkSession, spark_sql_adaptive_coalescePartitions_minPartitionSize=PART_BYTES, spark_sql_files_openCostInBytes=PART_BYTES):
        df.write.parquet(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table of the shared folder: later plans start there, and a lost executor costs no more than its tasks.

    These tables are small for the work that a row takes, so partitions are merged only down to PART_BYTES and not to megabytes.
    """
    return df.sparkSession.read.schema(df.schema).parquet(_write(df))


class Pile:
    """Tables of one schema, written one after another and read in one scan."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def add(self, df: DataFrame) -> DataFrame:
        """Writes df; returns it as read from there."""
        self.spark, self.schema = df.sparkSession, df.schema
        self.paths.append(_write(df))
        return self._read(self.paths[-1])

    def _read(self, *paths: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths)

    def all(self) -> DataFrame:
        return self._read(*self.paths)


def small(table: DataFrame, times: int = 1) -> DataFrame:
    """A written table, marked for broadcast if its rows and the bytes of its texts were counted and are few.

    times: how many joins of a loop may send such a table through the driver; together they may send what one may.
    """
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in table.dtypes if kind in ("string", "binary")]
    rows, held = table.agg(F.count("*"), F.coalesce(F.sum(sum(texts, F.lit(0)).cast("long")), F.lit(0))).first()
    return F.broadcast(table) if rows * times <= SMALL_ROWS and held * times <= SMALL_BYTES else table
