"""Hard negatives by dual-tree search: trees of balls over anchors and candidates, pruned by pairs of nodes.

A row's vector is floor(256 * x) of its components; a score is the integer inner product with the anchor. An anchor's positives
are its best rows of the same label; a positive's negatives are the best rows of other labels with scores in a band
below the positive's. Higher scores come first, ties by smaller vec_id.

Two balls of vectors bound every score between them: the product of the centers, give or take
|c| * r' + |c'| * r + r * r'. A pair of nodes goes on only if that interval meets what some anchor below still asks for: a score
in one of its bands, not under the worst of the best that it has. So one test drops a whole group of anchors for a whole subtree.

1. A coarse tree is fit on a bounded sample (SAMPLE vectors of the smallest hashes of all ids) with at most 2 ** DEPTH cells,
   and every row is routed to a cell. The cells' balls hold all their rows, not only the sampled ones. They are what is broadcast.
2. Each anchor searches its own cell, which gives it a floor for its best.
3. Sorted by cell, anchors are put into trees batch by batch and descend with the coarse tree; surviving pairs of
   anchor groups and cells are shuffled by cell.
4. A task holds a block of a cell's rows and a block of the anchors that ask there, builds both trees and
   scores the pairs of leaves that survive, best bounds first. The answers of cells meet in a ranking by anchor.

Positives and negatives are searched in the same way. Results are exact: bounds only ever keep too much. In data without
structure nothing is pruned and all blocks of anchors meet all blocks of rows. A cell with more rows than a task should hold is dealt
in blocks by hash of the id, as are the anchors that ask there, so a vector that a third of all rows share is no task of its own.

Rows take part if id, label and vector are not null and all components are finite. Of rows that are equal in id, label and vector one
takes part; rows that share an id but differ are rows of their own. Only vectors of one length meet. Scores that 64 bits don't
hold count as the nearest number that they do. Empty tables give no rows. Columns other than vec_id, embedding and label are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewall.llm._spark import arrow_rows, small_side, stash

SAMPLE, CELL, DEPTH = 20_000, 8192, 12
#: Components of the vectors that a task holds of rows, and of anchors
ROWS, ASKS = 1 << 22, 1 << 21
LEAF, GROUP = 128, 32
#: Candidate leaves scored in one step
STEP = 8
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max

_ASK = "dim int, cell int, block int, id long, tag long, label long, no array<int>, low array<long>, high array<long>, floor array<long>, vector {0}"
_HIT = "id long, tag long, no int, score long, other long, other_tag long"


def whole_parts(vectors: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """floor(256 * x) as doubles, which hold it exactly."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * 256).reshape(-1 if dim else len(vectors), dim)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products, in doubles where these hold every sum."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2.0**53:
        return (a @ b.T).astype(np.int64)
    exact = [[int(x) for x in row] for row in b]
    out = np.empty((len(a), len(b)), np.int64)
    for k, row in enumerate(a):
        mine = [int(x) for x in row]
        out[k] = [min(HIGH, max(LOW + 1, sum(map(int.__mul__, mine, other)))) for other in exact]
    return out


class Balls:
    """A binary tree of balls over rows: node i has the rows order[start[i]:stop[i]] and the halves 2i and 2i + 1."""

    def __init__(self, x: np.ndarray, leaf: int, depth: int | None = None):
        self.depth = max(0, math.ceil(math.log2(max(1, len(x)) / leaf))) if depth is None else depth
        nodes = 2 << self.depth
        self.order = np.arange(len(x))
        self.start, self.stop = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        self.center, self.radius = np.zeros((nodes, x.shape[1])), np.zeros(nodes)
        self.way, self.split = np.zeros(nodes, np.int64), np.zeros(nodes)
        self.stop[1] = len(x)
        for i in range(1, nodes):
            part = self.order[self.start[i] : self.stop[i]]
            if len(part):
                mine = x[part]
                with np.errstate(over="ignore"):
                    self.center[i] = mine.mean(axis=0)
                    self.radius[i] = np.sqrt(((mine - self.center[i]) ** 2).sum(axis=1).max())
                if 2 * i < nodes:
                    # along the component of widest range; equal values stay in the order of ids
                    self.way[i] = way = np.ptp(mine, axis=0).argmax() if x.shape[1] else 0
                    if x.shape[1]:
                        by = np.argsort(mine[:, way], kind="stable")
                        self.order[self.start[i] : self.stop[i]] = part[by]
                        self.split[i] = mine[by[(len(part) - 1) // 2], way]
            if 2 * i < nodes:
                middle = (self.start[i] + self.stop[i] + 1) // 2
                self.start[2 * i], self.stop[2 * i], self.start[2 * i + 1], self.stop[2 * i + 1] = self.start[i], middle, middle, self.stop[i]
        self.norm = np.linalg.norm(self.center, axis=1)

    @property
    def leaves(self) -> range:
        return range(1 << self.depth, 2 << self.depth)

    def routed(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node = np.ones(len(x), np.int64)
        for _ in range(self.depth if x.shape[1] else 0):
            node = 2 * node + (x[np.arange(len(x)), self.way[node]] > self.split[node])
        return node if x.shape[1] else np.full(len(x), 1 << self.depth)

    def folded(self, values: np.ndarray, fold) -> np.ndarray:
        """Values of the leaves, folded up to all nodes."""
        out = np.concatenate((np.repeat(values[:1], 1 << self.depth, axis=0), values))
        for i in range((1 << self.depth) - 1, 0, -1):
            out[i] = fold(out[2 * i], out[2 * i + 1])
        return out


def interval(a: Balls, i: np.ndarray, b: Balls, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of all scores between nodes i of a and j of b, a little wider than rounding could move them."""
    with np.errstate(over="ignore", invalid="ignore"):
        middle = np.einsum("ij,ij->i", a.center[i], b.center[j])
        reach = a.norm[i] * b.radius[j] + b.norm[j] * a.radius[i] + a.radius[i] * b.radius[j]
        slack = 1 + 1e-9 * (reach + a.norm[i] * b.norm[j])
        low, high = middle - reach - slack, middle + reach + slack
    # where doubles overflow, anything is possible
    return np.where(np.isfinite(low), low, -np.inf), np.where(np.isfinite(high), high, np.inf)


def descended(a: Balls, b: Balls, useful) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of leaves (of a, of b) that survive at every level, and their upper bounds. useful(i, j, low, high): which pairs go on."""
    i, j, level = np.ones(1, np.int64), np.ones(1, np.int64), 0
    while True:
        low, high = interval(a, i, b, j)
        on = useful(i, j, low, high)
        i, j, high = i[on], j[on], high[on]
        if level >= max(a.depth, b.depth):
            return i, j, high
        if level < a.depth:
            i, j = np.concatenate((2 * i, 2 * i + 1)), np.tile(j, 2)
        if level < b.depth:
            i, j = np.tile(i, 2), np.concatenate((2 * j, 2 * j + 1))
        level += 1


class Asks:
    """What anchors ask for: bands of scores, padded to an equal number; a padded band asks for nothing."""

    def __init__(self, table: pa.Table | pa.RecordBatch):
        no = table["no"]
        count = pa.compute.list_value_length(no).to_numpy(zero_copy_only=False).astype(np.int64)
        width = int(count.max(initial=1))
        row, col = np.repeat(np.arange(len(count)), count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.id, self.tag, self.label = (table[c].to_numpy() for c in ("id", "tag", "label"))
        self.no, self.low = np.zeros((len(count), width), np.int64), np.full((len(count), width), HIGH)
        self.high, self.floor = np.full((len(count), width), LOW), np.full((len(count), width), LOW)
        for name in ("no", "low", "high", "floor"):
            flat = table[name].combine_chunks() if isinstance(table[name], pa.ChunkedArray) else table[name]
            getattr(self, name)[row, col] = flat.flatten().to_numpy()

    def bounds(self, tree: Balls) -> tuple[np.ndarray, np.ndarray]:
        """For each node, the least score of use to an anchor in it and the largest."""
        least, most = np.full(1 << tree.depth, np.inf), np.full(1 << tree.depth, -np.inf)
        for k, leaf in enumerate(tree.leaves):
            mine = tree.order[tree.start[leaf] : tree.stop[leaf]]
            if len(mine):
                least[k], most[k] = np.maximum(self.low[mine], self.floor[mine]).min(), self.high[mine].max()
        return tree.folded(least, min), tree.folded(most, max)


def _routed(trees):
    def run(batches):
        for batch in batches:
            dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
            for dim in np.unique(dims).tolist():
                mine = batch.filter(pa.array(dims == dim))
                x = whole_parts(mine.column(mine.schema.get_field_index("vector")), dim)
                tree = trees.value[dim]
                leaf = tree.routed(x)
                with np.errstate(over="ignore"):
                    far = np.sqrt(((x - tree.center[leaf]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*mine.columns, pa.array(leaf.astype(np.int32)), pa.array(far)], names=[*mine.schema.names, "cell", "far"])

    return run


def _planned(coarse, kinds: tuple[str, ...]):
    """Anchors -> a row for each cell that may hold what they ask for. coarse: dim -> (tree with whole balls, blocks of each leaf)."""

    def run(batches):
        for batch in batches:
            dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
            for dim in np.unique(dims).tolist():
                mine = batch.filter(pa.array(dims == dim))
                tree, blocks = coarse.value[dim]
                asks = Asks(mine)
                own = Balls(whole_parts(mine.column(mine.schema.get_field_index("vector")), dim), GROUP)
                least, most = asks.bounds(own)
                filled = tree.folded(blocks > 0, max)
                i, j, _ = descended(own, tree, lambda i, j, low, high: filled[j] & (high >= least[i]) & (low <= most[i]))  # noqa: B023
                home, home_block = (mine.column(mine.schema.get_field_index(c)).to_numpy() for c in ("cell", "block"))
                for leaf in np.unique(i):
                    members = own.order[own.start[leaf] : own.stop[leaf]]
                    cells = np.sort(j[i == leaf])
                    n = blocks[cells - (1 << tree.depth)]
                    cell, block = np.repeat(cells, n), np.concatenate([np.arange(k) for k in n.tolist()])
                    row, at = np.repeat(members, len(cell)), np.tile(np.arange(len(cell)), len(members))
                    new = (cell[at] != home[row]) | (block[at] != home_block[row])
                    row, at = row[new], at[new]
                    for k in range(0, len(row), 1 << 14):
                        some = mine.take(pa.array(row[k : k + (1 << 14)]))
                        where = {"cell": pa.array(cell[at[k : k + (1 << 14)]].astype(np.int32)), "block": pa.array(block[at[k : k + (1 << 14)]].astype(np.int32))}
                        yield pa.RecordBatch.from_arrays([where.get(c, some.column(some.schema.get_field_index(c))) for c in kinds], names=list(kinds))

    return run


def _searched(k: int, same: bool):
    """A block of anchors and a block of rows -> the k best rows of each band."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["id", "tag", "no", "score", "other", "other_tag"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int32() if c == "no" else pa.int64()) for c in names], names=names)
        dim = left["dim"][0].as_py()
        right = right.sort_by([("id", "ascending"), ("tag", "ascending")])
        x, asks, a = whole_parts(right["vector"], dim), Asks(left), whole_parts(left["vector"], dim)
        rid, rtag, rlabel = (right[c].to_numpy() for c in ("id", "tag", "label"))
        rows, own = Balls(x, LEAF), Balls(a, GROUP)
        least, most = asks.bounds(own)
        i, j, high = descended(own, rows, lambda i, j, low, high: (high >= least[i]) & (low <= most[i]) & (rows.stop[j] > rows.start[j]))
        by = np.lexsort((-high, i))
        i, j, high = i[by], j[by], high[by]
        out = []
        for leaf in np.unique(i):
            members = own.order[own.start[leaf] : own.stop[leaf]]
            at, to = np.searchsorted(i, [leaf, leaf + 1])
            band = np.maximum(asks.low[members], asks.floor[members])
            best, rank = np.full((*band.shape, k), LOW), np.full((*band.shape, k), HIGH)
            while at < to:
                step = min(to, at + (STEP if best.min() > LOW else 1))
                cut = np.maximum(band, best[:, :, -1]).min()
                if high[at] < cut:
                    break
                cand = np.sort(np.concatenate([rows.order[rows.start[n] : rows.stop[n]] for n in j[at:step]]))
                s = scores(a[members], x[cand])
                alike = asks.label[members][:, None] == rlabel[cand]
                if same:
                    alike &= ~((asks.id[members][:, None] == rid[cand]) & (asks.tag[members][:, None] == rtag[cand]))
                else:
                    alike = ~alike
                for b in range(band.shape[1]):
                    # columns stand in the order of ids, and argmax takes the first of equal ones
                    open_ = np.where(alike & (s >= np.maximum(band[:, b], best[:, b, -1])[:, None]) & (s <= asks.high[members, b][:, None]), s, LOW)
                    if not (open_ > LOW).any():
                        continue
                    tops, ranks, line = [best[:, b]], [rank[:, b]], np.arange(len(members))
                    for _ in range(min(k, len(cand))):
                        col = open_.argmax(axis=1)
                        top = open_[line, col]
                        tops.append(top[:, None])
                        ranks.append(np.where(top > LOW, cand[col], HIGH)[:, None])
                        open_[line, col] = LOW
                    tops, ranks = np.concatenate(tops, axis=1), np.concatenate(ranks, axis=1)
                    order = np.lexsort((ranks, ~tops), axis=1)[:, :k]
                    best[:, b], rank[:, b] = np.take_along_axis(tops, order, 1), np.take_along_axis(ranks, order, 1)
                at = step
            m, b, n = np.nonzero(rank < HIGH)
            r = rank[m, b, n]
            out.append((asks.id[members[m]], asks.tag[members[m]], asks.no[members[m], b].astype(np.int32), best[m, b, n], rid[r], rtag[r]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int32 if c == "no" else np.int64) for c in names]
        return pa.table(columns, names=names)

    return run


def _met(asks: DataFrame, rows: DataFrame, k: int, same: bool) -> DataFrame:
    """The k best rows for each band of asks (by cell and block), in each block of the cell."""
    keys = ["dim", "cell", "block"]
    load = stash(asks.groupBy(*keys).agg(F.ceil(F.count("*") / F.greatest(F.lit(1), F.floor(ASKS / F.greatest("dim", F.lit(1))))).cast("int").alias("parts")))
    dealt = asks.join(small_side(load), keys).withColumn("part", F.pmod(F.xxhash64("id", "tag"), "parts").cast("int"))
    asked = rows.join(small_side(load), keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left = dealt.select(*keys, "part", "id", "tag", "label", "no", "low", "high", "floor", "vector")
    right = asked.select(*keys, "part", "id", "tag", "label", "vector")
    by = [*keys, "part"]
    return stash(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_searched(k, same), _HIT))


class Index:
    """All rows of a table in cells: `rows` (dim, cell, block, id, tag, label, vector) and the coarse tree of each length of vectors."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        arrow_rows(spark, 4000)
        vector = F.col("embedding")
        whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(whole, F.lit(False)))
        self.kind = dict(rows.dtypes)["embedding"]
        rows = rows.select(F.size("embedding").alias("dim"), F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), vector.alias("vector"))
        rows = rows.withColumn("tag", F.xxhash64("label", "vector"))
        again = stash(rows.groupBy("id", "tag").count().where("count > 1").select("id", "tag"))
        if not again.isEmpty():
            twice = rows.join(small_side(again), ["id", "tag"], "left_semi").dropDuplicates(["id", "label", "vector"])
            rows = rows.join(small_side(again), ["id", "tag"], "left_anti").unionByName(twice)
        trees = {}
        for dim, count in rows.groupBy("dim").count().collect():
            sample = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("id", "tag")).limit(SAMPLE).select("vector").toArrow()["vector"]
            depth = min(DEPTH, max(0, math.ceil(math.log2(count / CELL))), max(0, int(math.log2(max(1, len(sample)) / 4))))
            trees[dim] = Balls(whole_parts(sample, dim), CELL, depth)
        known = spark.sparkContext.broadcast(trees)
        rows = rows.select("dim", "id", "label", "vector", "tag")
        routed = stash(rows.mapInArrow(_routed(known), f"dim int, id long, label long, vector {self.kind}, tag long, cell int, far double"))
        room = F.greatest(F.lit(1), F.floor(ROWS / F.greatest("dim", F.lit(1))))
        cells = stash(routed.groupBy("dim", "cell").agg(F.max("far").alias("far"), F.ceil(F.count("*") / room).cast("int").alias("blocks")))
        self.rows = routed.join(F.broadcast(cells.drop("far")), ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("id", "tag"), "blocks").cast("int")).drop("far", "blocks")
        self.coarse = spark.sparkContext.broadcast(_whole_balls(trees, cells.collect()))

    def nearest(self, asks: DataFrame, k: int, same: bool) -> DataFrame:
        """asks (dim, cell, block, id, tag, label, no, low, high: bands by number, vector) -> id, tag, no, rank, score, other, other_tag."""
        schema = _ASK.format(self.kind)
        names = tuple(part.strip().split(" ")[0] for part in schema.split(","))
        home = _met(asks.withColumn("floor", F.transform("no", lambda _: F.lit(LOW).cast("long"))), self.rows, k, same)
        floors = home.groupBy("id", "tag", "no").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") == k)
        floors = floors.groupBy("id", "tag").agg(F.map_from_entries(F.collect_list(F.struct("no", "score"))).alias("known"))
        known = F.transform("no", lambda n: F.coalesce(F.try_element_at("known", n), F.lit(LOW).cast("long")))
        more = asks.join(small_side(stash(floors)), ["id", "tag"], "left").withColumn("floor", known).select(*names)
        sorted_ = more.repartitionByRange("dim", "cell", "id").sortWithinPartitions("dim", "cell", "id")
        planned = stash(sorted_.mapInArrow(_planned(self.coarse, names), schema))
        found = home.unionByName(_met(planned, self.rows, k, same))
        rank = F.row_number().over(Window.partitionBy("id", "tag", "no").orderBy(F.desc("score"), "other", "other_tag"))
        return stash(found.select("*", rank.alias("rank")).where(F.col("rank") <= k))


def _whole_balls(trees: dict[int, Balls], cells: list) -> dict:
    """The coarse trees with balls around all rows, and the number of blocks of each leaf."""
    out = {}
    for dim, tree in trees.items():
        first = 1 << tree.depth
        blocks, radius = np.zeros(first, np.int64), np.zeros(2 * first)
        for cell in cells:
            if cell["dim"] == dim:
                blocks[cell["cell"] - first], radius[cell["cell"]] = cell["blocks"], cell["far"]
        for i in range(first - 1, 0, -1):
            for half in (2 * i, 2 * i + 1):
                with np.errstate(over="ignore", invalid="ignore"):
                    radius[i] = max(radius[i], np.nan_to_num(radius[half] + np.linalg.norm(tree.center[half] - tree.center[i]), nan=np.inf))
        tree.radius = radius
        out[dim] = tree, blocks
    return out


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, band: tuple[int, int] = (50, 95)) -> DataFrame:
    """rows (vec_id, embedding, label) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchor: a condition on column id that chooses the anchors. A negative's score is between the two percentages of the positive's.
    """
    index = Index(rows)
    base = index.rows.where(anchor)
    whole = [F.array(F.lit(x).cast(t)).alias(c) for c, x, t in (("no", 1, "int"), ("low", LOW + 1, "long"), ("high", HIGH, "long"))]
    near = index.nearest(stash(base.select("*", *whole)), positives, same=True)
    # least and most of score * band / 100, rounded inwards without leaving 64 bits
    share = lambda p: (F.col("score").cast("decimal(20,0)") * p) / F.lit(100).cast("decimal(3,0)")
    bands = near.withColumn("low", F.ceil(share(band[0])).cast("long")).withColumn("high", F.floor(share(band[1])).cast("long")).where("low <= high")
    of_anchor = bands.groupBy("id", "tag").agg(F.sort_array(F.collect_list(F.struct(F.col("rank").alias("no"), "low", "high"))).alias("bands"))
    asks = stash(base.join(small_side(stash(of_anchor)), ["id", "tag"]).select(base.columns + [F.col(f"bands.{c}").alias(c) for c in ("no", "low", "high")]))
    found = index.nearest(asks, negatives, same=False)
    pairs = near.select("id", "tag", F.col("rank").alias("no"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.join(small_side(pairs), ["id", "tag", "no"])
    return out.select(F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
