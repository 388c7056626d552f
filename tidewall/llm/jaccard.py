"""Exact Jaccard join on word shingles with adaptive multi-match prefixes.

A document's set is its distinct 5-word shingles, as 64-bit hashes. All sets are ordered alike: shingles that
tasks saw repeatedly last, by that count, the others by hash. If two sets of sizes m, n are similar enough,
then for every l their prefixes of size - ceil(t * size) + l items share l items. Each document chooses its
own l: longer prefixes cost more index rows, but a partner must then share l of them, so the candidates that
survive are at most the sum of the prefix's frequencies over l; the document takes the l of least estimated
cost. A pair is verified if it shares as many prefix items as the smaller l of both,
and as many as its sizes imply: at most the longer of what lies behind both prefixes can be shared outside.

Documents with equal sets form one class, which is joined as one row. Classes on one prefix item are first
matched with a single leader (a linear number of pairs, two rounds); links merge them, and only pairs of
classes that are still in different components are then matched with each other, counted and verified. So a
large group of near copies costs a row for each member and not for each pair, and no link between different
components is lost: pairs that are skipped are already connected.

Null and empty texts, and texts without words, have the empty set and link with nothing. A text of fewer than
five words is one shingle. A text that only rows with a null id have links with nothing; such
rows never name a component. Repeated rows of an id give a row each, different texts of an id too, each with its own
class. Columns besides doc_id and text are ignored, whatever their names. Shingles and classes stand for their words
by 64-bit hashes, and by 48 bits of these in the sets that are compared: links are exact but for collisions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewall.llm._components import components, merged
from tidewall.llm._spark import arrow_rows, small_side, stash
from tidewall.llm._words import gram_hashes, hashed_texts, mix

#: Frequent shingles that the order knows of, at most; the bound of what is broadcast. Any order gives the same links.
FREQUENT = 1 << 17
#: Rows of a frequent item that one task lists, about
PART_ROWS = 128
#: The longest match requirement, and the cost of verifying a candidate in index rows
MOST_MATCHES, VERIFY_COST = 8, 20
#: Bytes of text that a task hashes at a time, and shingles that it holds to find the repeated ones
PIECE, HELD = 1 << 19, 1 << 20
#: Bytes of a shingle's hash in verification
KEPT_BYTES = 6


def freeing(run):
    """run, and at the end of a task what Arrow holds without use goes back, as workers live on."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return whole


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's n-word shingles."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    # the length keeps a short text apart from a shingle of a longer one
    grams = gram_hashes(words, n) if len(words) >= n else mix(gram_hashes(words, len(words)) + np.uint64(len(words)))
    return np.unique(grams)


def _class_key(grams: np.ndarray) -> int:
    return int(mix(np.array([grams.sum(dtype=np.uint64) ^ (np.bitwise_xor.reduce(mix(grams + np.uint64(1)))) ^ np.uint64(len(grams))]))[0].view(np.int64)) if len(grams) else 0


def _described(n: int):
    """(doc_id, text) -> a row (kind 0) for each document: id, class, size; and for shingles that the task met in
    several of its classes (kind 1): shingle, count."""

    def run(batches):
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            ids, keys, sizes = [], [], []
            for i, words in hashed_texts(batch.column(0).to_pylist(), batch.column(1), lower=True, piece=PIECE):
                grams = shingles(words, n)
                key = _class_key(grams)
                ids.append(i)
                keys.append(key)
                sizes.append(len(grams))
                if len(grams) and key not in seen:
                    seen.add(key)
                    held.append(grams)
                    size += len(grams)
            yield _rows(np.zeros(len(ids), np.int8), ids, keys, sizes)
            if size > HELD:
                yield from repeated(held)
                held, size = [], 0
                seen.clear()
        yield from repeated(held)

    def repeated(held):
        if held:
            grams, counts = np.unique(np.concatenate(held), return_counts=True)
            many = counts > 1
            yield _rows(np.ones(int(many.sum()), np.int8), grams[many].view(np.int64), counts[many], counts[many])

    def _rows(kind, ids, keys, sizes):
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int8()), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64())], names=["kind", "id", "key", "n"])

    return run


def choose_prefix(ordered_counts: np.ndarray, size: int, percent: int) -> tuple[int, int]:
    """(prefix length, matches that it requires) of least estimated cost; counts in prefix order, 1 if unknown."""
    least = -(-size * percent // 100)
    lengths = size - least + np.arange(1, MOST_MATCHES + 1)
    lengths = lengths[lengths <= size]
    index = np.cumsum(ordered_counts[: lengths[-1]] - 1)[lengths - 1]
    cost = lengths + index + VERIFY_COST * index / np.arange(1, len(lengths) + 1)
    best = int(cost.argmin())
    return int(lengths[best]), best + 1


def _prefixes(n: int, percent: int, frequent):
    def run(batches):
        known, counts = frequent.value
        for batch in batches:
            out: list[tuple] = []
            copies = batch.column(1).to_pylist()
            for k, words in hashed_texts(list(range(batch.num_rows)), batch.column(0), lower=True, piece=PIECE):
                grams = shingles(words, n)
                if not len(grams) or (copies[k] and _class_key(grams) in copies[k]):
                    continue
                at = np.searchsorted(known, grams)
                at[at == len(known)] = 0
                freq = np.where(known[at] == grams, counts[at], 1) if len(known) else np.ones(len(grams), np.int64)
                order = np.lexsort((grams, freq))
                length, matches = choose_prefix(freq[order], len(grams), percent)
                key = _class_key(grams)
                # 0: an item of one part; else which part of its rows has this class
                parts = freq[order[:length]] // PART_ROWS + 1
                part = np.where(parts > 1, 1 + key % parts, 0)
                out.append((grams[order[:length]].view(np.int64), part, key, len(grams), matches))
            if out:
                reps = [len(x[0]) for x in out]
                column = lambda k, t: pa.array(np.repeat(np.array([x[k] for x in out], t), reps))
                items, part = (np.concatenate([x[k] for x in out]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(part), column(2, np.int64), column(3, np.int32), column(4, np.int32)], names=["gram", "part", "key", "n", "matches"])

    return run


def _sets(n: int):
    def run(batches):
        for batch in batches:
            keys, sets, wanted = [], [], batch.column(0).to_pylist()
            for k, words in hashed_texts(list(range(batch.num_rows)), batch.column(1), lower=True, piece=PIECE):
                grams = shingles(words, n)
                if _class_key(grams) != wanted[k]:
                    continue  # another text of a repeated id
                keys.append(wanted[k])
                sets.append(np.unique(grams & np.uint64((1 << 8 * KEPT_BYTES) - 1)).view(np.uint8).reshape(-1, 8)[:, :KEPT_BYTES].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], names=["key", "items"])

    return run


def _unpack(items: bytes) -> np.ndarray:
    raw = np.frombuffer(items, np.uint8).reshape(-1, KEPT_BYTES)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :KEPT_BYTES] = raw
    return full.view(np.uint64).ravel()


def _verified(percent: int):
    """(a, b, items_a, items_b) -> links a, b with 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            a, b = [], []
            last, of_a = None, None
            for x, y, p, q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if x != last:
                    last, of_a = x, _unpack(p)
                of_b = _unpack(q)
                both = len(np.intersect1d(of_a, of_b, assume_unique=True))
                if 100 * both >= percent * (len(of_a) + len(of_b) - both):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _enough(m: str, n: str, l_m: str, l_n: str, percent: int) -> Column:
    """(sizes fit, prefix items that a similar pair of sizes m, n with these requirements shares at least)"""
    behind = F.greatest(*[F.ceil(F.col(c) * percent / F.lit(100)) - F.col(k) for c, k in ((m, l_m), (n, l_n))])
    common = F.ceil((F.col(m) + F.col(n)) * percent / F.lit(100 + percent))
    return F.greatest(F.least(F.col(l_m), F.col(l_n)).cast("long"), common - behind)


def _alike_in_size(m: str, n: str, percent: int) -> Column:
    return (100 * F.least(F.col(m), F.col(n))) >= (percent * F.greatest(F.col(m), F.col(n)))


def jaccard_classes(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, key (the class; 0: empty), component_id."""
    spark = docs.sparkSession
    arrow_rows(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = stash(docs.mapInArrow(freeing(_described(n)), "kind byte, id long, key long, n long"))
    rows = described.where("kind = 0").select(F.col("id").alias("doc_id"), "key", F.col("n").alias("n_shingles"))
    top = described.where("kind = 1").groupBy("id").agg(F.sum("key").alias("count")).orderBy(F.desc("count"), "id").limit(FREQUENT).toPandas().sort_values("id", key=lambda s: s.astype("int64").to_numpy().view(np.uint64))
    frequent = spark.sparkContext.broadcast((top["id"].to_numpy(np.int64).view(np.uint64), top["count"].to_numpy(np.int64)))

    firsts = stash(rows.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null"))
    copies = rows.join(firsts.withColumnRenamed("doc_id", "first"), "key").where("doc_id > first")
    copies = stash(copies.groupBy("doc_id").agg(F.collect_set("key").alias("copies")))

    # classes on one prefix item: the lists that hold at least two. Items known to be frequent are listed in parts; they
    # are frequent because several classes have them, so each part stays
    each = docs.join(small_side(copies), "doc_id", "left").select("text", "copies")
    item = Window.partitionBy("gram", "part")
    prefix = each.mapInArrow(freeing(_prefixes(n, percent, frequent)), "gram long, part long, key long, n int, matches int")
    prefix = prefix.withColumn("low", F.min("key").over(item)).withColumn("high", F.max("key").over(item))
    met_lists = stash(prefix.where("low < high or part > 0").drop("low", "high"))

    def shared(lists: DataFrame, priority: Column) -> DataFrame:
        """Lists that hold classes of several components (root), with their leaders and lengths."""
        lead = F.struct(priority.alias("p"), "key", "n", "matches", "root")
        told = {"low": F.min("root"), "high": F.max("root"), "held": F.count("*"), "lead": F.max(lead)}
        lists = stash(lists.select("gram", "part", "key", "n", "matches", "met", "root", *[c.over(item).alias(name) for name, c in told.items()]))
        # what the parts of an item tell together: a row for each frequent item, FREQUENT at most
        parts = lists.where("part > 0").groupBy("gram", "part").agg(*[F.first(name).alias(name) for name in told])
        whole = stash(parts.groupBy("gram").agg(F.min("low").alias("low_"), F.max("high").alias("high_"), F.sum("held").alias("held_"), F.max("lead").alias("lead_")))
        lists = lists.join(F.broadcast(whole), "gram", "left").select("gram", "part", "key", "n", "matches", "met", "root", *[F.coalesce(f"{name}_", name).alias(name) for name in told])
        return lists.where("low < high").select("gram", "part", "key", "n", "matches", "met", "root", "held", F.col("lead.key").alias("lead"), F.col("lead.n").alias("lead_n"), F.col("lead.matches").alias("lead_matches"), F.col("lead.root").alias("lead_root"))

    # met: how many of its prefix items a class shares with any other
    met = stash(met_lists.groupBy("key").agg(F.count("*").cast("int").alias("met")))
    lists = met_lists.join(small_side(met), "key").withColumn("root", F.col("key"))
    # a leader shares the largest part of its prefix: an original rather than an edited copy
    length = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + F.col("matches")
    lists = shared(lists, F.struct(F.col("met") / length, "met"))

    def verify(pairs: DataFrame) -> DataFrame:
        keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
        wanted = small_side(stash(keys.join(firsts, "key")))
        sets = docs.join(wanted, "doc_id").select("key", "text").mapInArrow(freeing(_sets(n)), "key long, items binary")
        left = sets.select(F.col("key").alias("a"), F.col("items").alias("items_a"))
        right = sets.select(F.col("key").alias("b"), F.col("items").alias("items_b"))
        return stash(pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "items_a", "items_b").mapInArrow(freeing(_verified(percent)), "a long, b long"))

    def stars(lists: DataFrame) -> DataFrame:
        """Pairs of a class and a leader on enough lists."""
        star = lists.where((F.col("lead_root") != F.col("root")) & _alike_in_size("n", "lead_n", percent))
        enough = _enough("n", "lead_n", "matches", "lead_matches", percent)
        pairs = star.groupBy("key", "lead").agg(F.count("*").alias("shared"), F.first(enough).alias("enough")).where("shared >= enough")
        return pairs.select(F.least("key", "lead").alias("a"), F.greatest("key", "lead").alias("b")).distinct()

    def relabelled(lists: DataFrame, labels: DataFrame) -> DataFrame:
        return lists.join(small_side(labels), F.col("key") == F.col("node"), "left").select("gram", "part", "key", "n", "matches", "met", F.coalesce(labels["root"], "key").alias("root"))

    # two rounds of stars save pairs; what they pass over is met below. `met` bounds what a pair can share
    first = stash(stars(lists))
    labels = components(verify(first))
    later = shared(relabelled(lists.drop("root"), labels), F.xxhash64("key"))
    second = stash(stars(later).join(first, ["a", "b"], "left_anti"))
    labels = merged(labels, verify(second))
    # a class's items by frequency: a pair that shares enough of them meets early enough in both orders
    own = Window.partitionBy("key")
    now = shared(relabelled(later.drop("root"), labels), F.lit(0))
    now = now.withColumn("rank", F.row_number().over(own.orderBy("held", "gram"))).withColumn("met", F.count("*").over(own))
    now = stash(now.select("gram", "key", "n", "matches", "root", "rank", "met"))
    x, y = now.alias("x"), now.alias("y")
    enough = _enough("x.n", "y.n", "x.matches", "y.matches", percent)
    could = _alike_in_size("x.n", "y.n", percent) & (1 + F.least(F.col("x.met") - F.col("x.rank"), F.col("y.met") - F.col("y.rank")) >= enough)
    across = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.key") < F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & could)
    met_pairs = across.groupBy(F.col("x.key").alias("a"), F.col("y.key").alias("b")).agg(F.first(enough).alias("enough"))
    met_pairs = stash(met_pairs.join(first.union(second), ["a", "b"], "left_anti"))
    # of the pairs that met, those with enough shared items are verified
    items = now.groupBy("key").agg(F.collect_list("gram").alias("grams"))
    met_pairs = met_pairs.join(items.select(F.col("key").alias("a"), F.col("grams").alias("grams_a")), "a").join(items.select(F.col("key").alias("b"), F.col("grams").alias("grams_b")), "b")
    rest = stash(met_pairs.where(F.size(F.array_intersect("grams_a", "grams_b")) >= F.col("enough")).select("a", "b"))
    labels = merged(labels, verify(rest))
    # the smallest document of each class's component
    named = firsts.join(labels, firsts["key"] == labels["node"], "left").select("key", "doc_id", F.coalesce("root", "key").alias("root"))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = stash(named.join(smallest, "root").select("key", "component_id"))
    out = rows.join(small_side(classes), "key", "left")
    return out.select("doc_id", "n_shingles", "key", F.coalesce("component_id", "doc_id").alias("component_id"))
