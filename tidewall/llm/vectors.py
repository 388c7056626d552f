"""Near-duplicate vectors by a forest of random-projection trees with spill overlap.

A tree splits its rows again and again at a threshold along a random direction (one for each tree and level).
Rows within the spill margin of the threshold go to both sides, as a pair that is alike enough can lie on
either. The margin is half the spread of the difference of such a pair along a random direction. Thresholds
are medians of a bounded sample of vectors (SAMPLE of them, the smallest hashes of all ids); below
nodes that hold fewer than NODE of these, the median over the whole sample along that direction. Every row
is indexed in every tree.

Rows are compared within leaves by their cosines in double precision. Only pairs at or above the threshold
are links. A pair that meets in several leaves counts in the smallest of them, which both rows' leaf lists
tell, so that sums of links need no list of pairs. A leaf sends a count for each of its rows, and for the
components one pair for each row, with the smallest row that it reaches along links in the leaf. A leaf with more than BLOCK rows is dealt to
tasks in pairs of blocks, whatever its size.

Equal vectors are one class, compared once. Null and zero vectors and those with null or non-finite
components link with nothing. Vectors of different lengths never link. Rows with a null id are left out of
links. Repeated rows (of one id) are members of their class like other copies; rows that share an id and have different vectors
are members each of their own vector's class. Columns other than vec_id and embedding are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewall.llm._components import components
from tidewall.llm._spark import arrow_rows, small_side, stash

TREES, LEAF, BLOCK = 6, 400, 1500
SAMPLE, NODE = 20_000, 16
MARGIN = 0.5
#: Names of classes whose smallest id is not theirs alone begin here; ids stay below
OWN_NAMES = 1 << 62


class Forest:
    """Directions and thresholds for vectors of one length."""

    def __init__(self, sample: np.ndarray, rows: int, alike: float, trees: int = TREES):
        dim = sample.shape[1]
        self.levels = max(0, math.ceil(math.log2(max(1, rows) / LEAF)))
        rng = np.random.Generator(np.random.PCG64([17, dim]))
        ways = rng.standard_normal((trees, self.levels, dim))
        self.ways = ways / np.linalg.norm(ways, axis=2, keepdims=True)
        self.margin = MARGIN * math.sqrt(2 - 2 * alike) / math.sqrt(dim)
        self.middle = np.zeros((trees, self.levels))
        self.at: list[dict[int, float]] = [{} for _ in range(trees)]
        for t in range(trees):
            cast = sample @ self.ways[t].T
            self.middle[t] = np.median(cast, axis=0) if len(sample) else 0
            node = np.ones(len(sample), np.int64)
            for k in range(self.levels):
                order = np.argsort(node, kind="stable")
                names, starts = np.unique(node[order], return_index=True)
                for name, part in zip(names.tolist(), np.split(order, starts[1:]), strict=True):
                    if len(part) >= NODE:
                        self.at[t][name] = float(np.median(cast[part, k]))
                node = node * 2 + (cast[:, k] > self._thresholds(t, k, node))

    def _thresholds(self, t: int, k: int, node: np.ndarray) -> np.ndarray:
        names, of = np.unique(node, return_inverse=True)
        return np.array([self.at[t].get(n, self.middle[t, k]) for n in names.tolist()])[of] if len(names) else np.zeros(0)

    def leaves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every row in every tree."""
        rows, leaves = [], []
        for t in range(len(self.ways)):
            cast = unit @ self.ways[t].T
            row, node = np.arange(len(unit)), np.ones(len(unit), np.int64)
            for k in range(self.levels):
                gap = cast[row, k] - self._thresholds(t, k, node)
                left, right = gap <= self.margin, gap >= -self.margin
                row, node = np.concatenate((row[left], row[right])), np.concatenate((node[left] * 2, node[right] * 2 + 1))
            rows.append(row)
            leaves.append(node << 8 | t)
        return np.concatenate(rows), np.concatenate(leaves)


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    raw = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _valid(vector: Column) -> Column:
    sums = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return sums.isNotNull() & ~F.isnan(sums) & (sums > 0) & (sums < float("inf"))


def _routed(forests):
    def run(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                mine = batch.filter(pa.array(dims == dim))
                unit = _matrix(mine.column(1), dim)
                row, leaf = forests.value[dim].leaves(unit)
                order = np.lexsort((leaf, row))
                row, leaf = row[order], leaf[order]
                counts = np.bincount(row, minlength=len(unit))
                ends = np.cumsum(counts)
                lists = pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), pa.array(leaf))
                where = pa.array(row)
                # a leaf's name holds the vectors' length, so leaves of different lengths never meet
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf), mine.column(2).take(where), mine.column(0).take(where), mine.column(3).take(where), lists.take(where), mine.column(1).take(where)],
                    names=["leaf", "dim", "key", "copies", "leaves", "vector"],
                )

    return run


def _first_shared(lists: list[np.ndarray], leaf: int) -> np.ndarray:
    """shared[i, j]: rows i and j meet in a smaller leaf than this."""
    parts = [x[x < leaf] for x in lists]
    names, of = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_inverse=True)
    member = np.zeros((len(lists), len(names)), np.float32)
    member[np.repeat(np.arange(len(lists)), [len(p) for p in parts]), of] = 1
    return member @ member.T > 0


def _lowest_reached(hit: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The smallest key that each row reaches along links; to its smallest neighbour alone a row could lose touch with the others."""
    low = keys
    while len(keys):
        new = np.minimum(low, np.where(hit, low[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == low).all():
            break
        # and on from there at once, as far as it has come
        low = np.minimum(new, new[np.searchsorted(keys, new)]) if (keys[:-1] < keys[1:]).all() else new
    return low


def _compared(alike: float):
    """The rows of one pair of blocks of a leaf -> key, links that are first met here, the smallest key that it reaches here."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key").combine_chunks()
        leaf, dim = table["leaf"][0].as_py(), table["dim"][0].as_py()
        one, two = table["one"][0].as_py(), table["two"][0].as_py()
        unit = _matrix(table["vector"].combine_chunks(), dim)
        block, keys, copies = table["block"].to_numpy(), table["key"].to_numpy(), table["copies"].to_numpy()
        if one == two:
            hit = unit @ unit.T >= alike
        else:
            a, b = np.flatnonzero(block == one), np.flatnonzero(block == two)
            hit = np.zeros((len(unit), len(unit)), bool)
            hit[np.ix_(a, b)] = unit[a] @ unit[b].T >= alike
            hit |= hit.T
        np.fill_diagonal(hit, False)
        some = np.flatnonzero(hit.any(axis=1))
        hit, keys, copies = hit[np.ix_(some, some)], keys[some], copies[some]
        lists = [np.asarray(x) for x in table["leaves"].take(pa.array(some)).to_pylist()]
        new = hit & ~_first_shared(lists, leaf)
        low = _lowest_reached(hit, keys)
        return pa.table({"key": keys, "links": (new @ copies.astype(np.int64)).astype(np.int64), "low": low})

    return run


def near_vectors(rows: DataFrame, alike: float = 0.9, trees: int = TREES) -> tuple[DataFrame, DataFrame]:
    """rows (vec_id, embedding) -> (links of every row: vec_id, n_links, component_id; pairs of classes that reach each other: a, b).

    The pairs hold all components together. Classes are named by their smallest vec_id, where no other class has it.
    """
    spark = rows.sparkSession
    arrow_rows(spark, 4000)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("vector"))
    valid = rows.where(F.col("vec_id").isNotNull() & F.coalesce(_valid(F.col("vector")), F.lit(False)))
    name = F.unhex(F.md5(F.array_join(F.col("vector").cast("array<string>"), ",")))
    named = stash(valid.select("vec_id", name.alias("name")))
    classes = stash(named.groupBy("name").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies")))
    # a class is a node named by its smallest id; classes that share one get names of their own, above all ids
    shared = stash(classes.groupBy("low").count().where("count > 1").select("low", F.lit(True).alias("odd")))
    own = F.shiftrightunsigned(F.xxhash64("name"), 2) + F.lit(OWN_NAMES)
    classes = classes.join(small_side(shared), "low", "left").select("name", "low", "copies", F.when(F.col("odd"), own).otherwise(F.col("low")).alias("key"))
    classes = stash(classes)
    firsts = valid.select(name.alias("name"), F.col("vec_id").alias("low"), "vector").join(classes, ["name", "low"]).dropDuplicates(["key"])
    firsts = stash(firsts.select("key", "vector", F.size("vector").alias("dim"), "copies"))
    forests = {}
    for dim, count in firsts.groupBy("dim").count().collect():
        sample = firsts.where(F.col("dim") == dim).orderBy(F.xxhash64("key")).limit(SAMPLE).select("vector").toArrow()["vector"]
        forests[dim] = Forest(_matrix(sample.combine_chunks(), dim), count, alike, trees)
    known = spark.sparkContext.broadcast(forests)
    met = stash(firsts.mapInArrow(_routed(known), "leaf long, dim int, key long, copies long, leaves array<long>, vector array<float>"))
    large = stash(met.groupBy("leaf", "dim").count().where(F.col("count") > BLOCK).select("leaf", "dim", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    met = met.join(small_side(large), ["leaf", "dim"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    met = met.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("one"), F.greatest("block", k).alias("two")))
    dealt = met.withColumn("pair", F.explode(others)).select("leaf", "dim", "pair.one", "pair.two", "block", "key", "copies", "leaves", "vector")
    found = stash(dealt.groupBy("leaf", "dim", "one", "two").applyInArrow(_compared(alike), "key long, links long, low long"))
    links = found.select(F.least("key", "low").alias("a"), F.greatest("key", "low").alias("b")).distinct()
    labels = components(links)
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    of_class = classes.join(counts, "key", "left").join(labels, F.col("key") == F.col("node"), "left")
    of_class = of_class.select("name", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "key").alias("root"))
    of_class = stash(of_class)
    roots = small_side(stash(of_class.groupBy("root").agg(F.min("low").alias("component_id"))))
    of_class = stash(of_class.join(roots, "root").select("name", "n_links", "component_id"))
    out = named.join(small_side(of_class), "name").select("vec_id", "n_links", "component_id")
    rest = rows.where(~(F.col("vec_id").isNotNull() & F.coalesce(_valid(F.col("vector")), F.lit(False))))
    alone = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone), links
