"""Histogram sort: exact byte counts below candidate key boundaries choose the shard splitters.

Rows are ordered by (hash of the text, hash of the id), so equal texts lie together and only a splitter
that would otherwise miss its tolerance cuts through a group. Each round counts, over all partitions, the
exact bytes in 256 equal key ranges around every splitter that is not settled yet; a splitter settles on a
range edge as soon as that edge is within the tolerance of its byte target. A text that a large part of the
rows repeats has one text hash, so its rounds go on in the id hash. Only (splitters x 256) sums reach the driver.

Null texts have size 16 and the CRC of the empty text. Rows that share id and text (repeated rows, rows without an id) are
numbered, and the number goes into their id hash, so a splitter can cut through any number of them. They are numbered by
the tasks that read them, each from where the tasks before it end, so that no task holds a group; as such rows are equal in all that
is returned, the result doesn't depend on who numbers which. An empty table gives an empty table. Texts of any length count with
all their bytes. Other columns are carried only by write_shards, where their names must differ from PLACED.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewall.llm._spark import small_side, stash

BITS = 8
#: Rows of one shard that one task puts in order, about; and the least number of such slices
SLICE_ROWS, LEAST_SLICES = 1 << 18, 8


def _range_of(key: str, level: int) -> Column:
    """The key range of a row at a level: the top BITS * (level + 1) bits, in signed order."""
    return F.shiftright(F.col(key), 64 - BITS * (level + 1)) if level < 7 else F.col(key)


def splitters(rows: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int | None] | None]:
    """Lower bounds (k1, k2) of shards 1..n-1 over rows (k1, k2, size); None: no row is above.

    tolerance is a part of the mean shard's bytes.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    targets = {s: total * s / shards for s in range(1, shards)}
    slack = tolerance * total / shards
    found: dict[int, tuple[int, int | None] | None] = {}
    #: Unsettled: splitter -> (k1 once fixed, range at the last level, exact bytes below that range)
    open_: dict[int, tuple[int | None, int | None, int]] = {s: (None, None, 0) for s in targets} if total else {}
    for depth in range(16):
        if not open_:
            break
        key, level = ("k1", depth) if depth < 8 else ("k2", depth - 8)
        bins = rows
        if depth:
            inside = [(F.col("k1") == k1 if key == "k2" else F.lit(True)) & (_range_of(key, level - 1) == r if level else F.lit(True)) for k1, r in {(k1, r) for k1, r, _ in open_.values()}]
            cond = inside[0]
            for more in inside[1:]:
                cond = cond | more
            bins = rows.where(cond)
        group = ([F.col("k1").alias("at")] if key == "k2" else [F.lit(None).cast("long").alias("at")]) + [_range_of(key, level).alias("r")]
        sums: dict[int | None, list[tuple[int, int, int]]] = {}
        for at, r, size, n in bins.groupBy(*group).agg(F.sum("size"), F.count("*")).collect():
            sums.setdefault(at, []).append((r, size, n))
        for s, (k1, parent, below) in list(open_.items()):
            here = sorted(x for x in sums.get(k1, []) if level == 0 or (x[0] >> BITS) == parent)
            for r, size, n in here:
                if below + size >= targets[s] or r == here[-1][0]:
                    break
                below += size
            width = 64 - BITS * (level + 1)
            edges = [(abs(targets[s] - below), r), (abs(below + size - targets[s]), r + 1)]
            gap, edge = min(edges)
            if gap <= slack or n == 1 or depth == 15:  # one row can't be cut
                bound = edge << width
                if key == "k1":
                    found[s] = (bound, None) if bound < 1 << 63 else None
                else:
                    found[s] = (k1, bound) if bound < 1 << 63 else ((k1 + 1, None) if k1 + 1 < 1 << 63 else None)
                del open_[s]
            elif depth == 7:
                open_[s] = (r, None, below)
            else:
                open_[s] = (k1, r, below)
    return [found.get(s) for s in range(1, shards)]


PLACED = ["doc_id", "size", "text_crc32", "shard", "slot", "k1", "k2", "slice"]


def _keyed(docs: DataFrame, id_col: str, text_col: str, *carried: Column) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.col(id_col)).alias("k2"),
        *carried,
    )


def repeated(keys: DataFrame) -> DataFrame:
    """k1, k2 of the rows that can't be told apart."""
    return stash(keys.groupBy("k1", "k2").count().where("count > 1").select("k1", "k2"))


def numbered(rows: DataFrame, twice: DataFrame) -> DataFrame:
    """rows with a k2 of its own for each of the rows that share (k1, k2)."""
    if twice.isEmpty():
        return rows
    side = small_side(twice)
    again = stash(rows.join(side, ["k1", "k2"], "left_semi").select(*rows.columns, F.spark_partition_id().alias("_task")))
    parts = again.groupBy("k1", "k2", "_task").count()
    before = (F.sum("count").over(Window.partitionBy("k1", "k2").orderBy("_task")) - F.col("count")).alias("_before")
    parts = stash(parts.select("k1", "k2", "_task", before))
    nth = F.row_number().over(Window.partitionBy("k1", "k2", "_task").orderBy("size"))
    told = again.join(small_side(parts), ["k1", "k2", "_task"]).withColumn("_n", F.col("_before") + nth)
    told = told.withColumn("k2", F.when(F.col("_n") == 1, F.col("k2")).otherwise(F.xxhash64("k2", "_n")))
    return rows.join(side, ["k1", "k2"], "left_anti").select(*rows.columns).unionByName(told.select(*rows.columns))


def _placed(rows: DataFrame, keys: DataFrame, shards: int, tolerance: float) -> DataFrame:
    """rows with shard and slot. keys: the table whose bytes the splitters count.

    slot counts from 0 without gaps in each shard. Rows are numbered within hash slices of a shard, of about
    SLICE_ROWS rows, and shifted by the rows of the slices before, so that no task orders a whole shard. The rows
    are exchanged once, by shard and slice.
    """
    slices = max(LEAST_SLICES, -(-keys.count() // (shards * SLICE_ROWS)))
    shard = F.lit(0)
    for bound in splitters(keys, shards, tolerance):
        if bound is not None:
            k1, k2 = bound
            above = F.col("k1") >= k1 if k2 is None else (F.col("k1") > k1) | ((F.col("k1") == k1) & (F.col("k2") >= k2))
            shard = shard + above.cast("int")

    def put(df):
        return df.withColumn("shard", shard.cast("int")).withColumn("slice", F.pmod(F.xxhash64("k1", "k2"), F.lit(slices)).cast("int"))

    counts = put(keys).groupBy("shard", "slice").count()
    before = stash(counts.select("shard", "slice", (F.sum("count").over(Window.partitionBy("shard").orderBy("slice")) - F.col("count")).alias("before")))
    nth = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("k1", "k2", "text_crc32"))
    return put(rows).join(small_side(before), ["shard", "slice"]).withColumn("slot", F.col("before") + nth - 1)


def shard_plan(docs: DataFrame, shards: int = 40, tolerance: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place every row: doc_id, size, text_crc32, shard, slot."""
    keys = stash(_keyed(docs, id_col, text_col))
    twice = repeated(keys)
    keys = keys if twice.isEmpty() else stash(numbered(keys, twice))
    return _placed(keys, keys, shards, tolerance).select("doc_id", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 40, tolerance: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the rows of docs, with their slots, as one folder for each shard.

    The splitters are found from keys alone; then whole rows go through one exchange, by shard and slice (those that
    can't be told apart are written once before). Each slice is written in slot order by one task.
    """
    keys = stash(_keyed(docs, id_col, text_col).select("size", "k1", "k2"))
    twice = repeated(keys)
    keys = keys if twice.isEmpty() else stash(numbered(keys, twice))
    rows = numbered(_keyed(docs, id_col, text_col, F.struct("*").alias("row")), twice)
    placed = _placed(rows, keys, shards, tolerance)
    placed.select("shard", "slot", "row.*").write.partitionBy("shard").parquet(path)
