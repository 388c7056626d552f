"""How sources of a language differ in their words: term-block dense matrices of integers.

Terms are longest runs of letters A-Z, a-z and of characters beyond ASCII, with only A-Z lower-cased. Each language keeps the terms
that at least `least_docs` of its documents hold (V of them). A group is a (lang, source) that occurs; null texts, langs and
sources are ''. A group's share of a term is p = 1 + floor(10**9 * (count + 2) / (N + 2 * V)), with N its occurrences of kept terms;
a language's is the same over all its groups. Two shares differ by f = floor((p - q) ** 2 / (p + q)).

Tasks count terms over NumPy arrays and send one row for each term, group and about COUNTED rows of a task, so that a hot
source or word is summed before the shuffle. The kept terms of a language are dealt to blocks by hash. A task fills
tiles of groups x terms with a block's shares, takes every pair of groups by broadcasting, and adds the tiles
up to one matrix of pairs; a second sum adds the blocks' matrices. Where a language has over STRIP groups, a block goes to
several tasks, with a strip of the pairs' first groups each. A tile has at most TILE cells. In the same pass each group keeps a heap of its
`top` terms of largest f against the language; the heaps of blocks are merged.

All arithmetic is exact in 64 bits: 10**9 is reached in three steps of 1000, so that counts up to 9 * 10**15 don't
overflow. Repeated rows count as documents of their own; ids are not read. An empty table gives no rows; a group
without terms has pairs (and no terms); a language without kept terms has pairs of value 0. Texts are read whole, in pieces between words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewall.llm._spark import arrow_rows, small_side, stash
from tidewall.llm._words import LOWER, text_slices, word_bounds

COUNTED = 1 << 20
#: Rows of (term, group, count) of a block, cells of a tile, first groups of a strip
BLOCK, TILE, STRIP = 1 << 18, 1 << 20, 512

NO_TERM = np.ones(256, bool)
NO_TERM[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False

_SUMS = "lang string, source string, term string, n long, docs long"


def _text_counts(groups: np.ndarray, texts: pa.Array):
    """(group, term, n, docs) of runs of texts, as Arrow arrays."""
    for some, data, offsets in text_slices(range(len(groups)), texts):
        starts, ends, first = word_bounds(data, offsets, NO_TERM)
        if not len(starts):
            continue
        place = np.concatenate(([0], np.cumsum(ends - starts)))
        letters = LOWER[data[~NO_TERM[data]]]
        kind, type_ = (np.int32, pa.string()) if place[-1] < 2**31 else (np.int64, pa.large_string())
        terms = pa.Array.from_buffers(type_, len(starts), [None, pa.py_buffer(place.astype(kind)), pa.py_buffer(letters)]).dictionary_encode()
        code, names = terms.indices.to_numpy().astype(np.int64), terms.dictionary.cast(pa.string())
        doc = np.repeat(np.arange(len(some)), np.diff(first))
        of_doc, n = np.unique(doc * len(names) + code, return_counts=True)
        key, at = np.unique(groups[some.start : some.stop][of_doc // len(names)] * len(names) + of_doc % len(names), return_inverse=True)
        yield key // len(names), names.take(pa.array(key % len(names))), np.bincount(at, n).astype(np.int64), np.bincount(at)


def _counted(batches):
    """Sums over a task's rows, sent when they are many; a row without a term names each group."""
    keys, held, rows = ["lang", "source", "term"], [], 0

    def summed():
        table = pa.concat_tables(held).group_by(keys).aggregate([("n", "sum"), ("docs", "sum")])
        return table.rename_columns([c.removesuffix("_sum") for c in table.column_names]).select([*keys, "n", "docs"])

    for batch in batches:
        lang, source = (batch.column(k).cast(pa.string()).fill_null("") for k in range(2))
        pairs = pa.table({"lang": lang, "source": source}).group_by(["lang", "source"], use_threads=False).aggregate([])
        names = {pair: k for k, pair in enumerate(zip(pairs["lang"].to_pylist(), pairs["source"].to_pylist(), strict=True))}
        groups = np.array([names[pair] for pair in zip(lang.to_pylist(), source.to_pylist(), strict=True)], np.int64)
        found = list(_text_counts(groups, batch.column(2)))
        found.append((np.arange(len(names)), pa.nulls(len(names), pa.string()), np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)))
        for group, term, n, docs in found:
            which = pa.array(group)
            held.append(pa.table([pairs["lang"].take(which), pairs["source"].take(which), term, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=[*keys, "n", "docs"]))
            rows += len(group)
        if rows > COUNTED:
            held = [summed()]
            rows = held[0].num_rows
            if rows > COUNTED // 2:
                yield from held[0].combine_chunks().to_batches(1 << 16)
                held, rows = [], 0
    if held:
        yield from summed().combine_chunks().to_batches(1 << 16)


def term_counts(docs: DataFrame) -> DataFrame:
    """docs (text, lang, source) -> lang, source, term, n (occurrences), docs (documents that hold it); term null: the group itself."""
    arrow_rows(docs.sparkSession)
    found = docs.select("lang", "source", "text").mapInArrow(_counted, _SUMS)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / total), digit by digit."""
    rest, out = count + 2, np.zeros_like(count + total)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return 1 + out


def _compared(top: int):
    """A block's rows and groups -> partial sums of pairs (a < b), and a heap of terms of each group of the strip."""

    def run(table: pa.Table) -> pa.Table:
        lang, strip = table["lang"][0], table["strip"][0].as_py()
        group, n, kept = table["group"].to_numpy(), table["n"].to_numpy(), table["kept"].to_numpy()
        is_group = table["term"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
        size = int(is_group.sum())
        total = np.zeros(size, np.int64)
        total[group[is_group]] = n[is_group] + 2 * kept[is_group]
        whole = np.array([int(n[is_group].sum()) + 2 * int(kept[0])], np.int64)
        group, n = group[~is_group], n[~is_group]
        coded = table["term"].combine_chunks().filter(pa.array(~is_group)).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        names, rank = coded.dictionary.take(pa.array(order)), np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        term = rank[coded.indices.to_numpy()]
        by = np.argsort(term, kind="stable")
        group, n, term = group[by], n[by], term[by]
        first, last = strip * STRIP, min(size, (strip + 1) * STRIP)
        sums = np.zeros((last - first, size), np.int64)
        heaps = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * (last - first)
        width = max(1, TILE // max(1, size))
        for left in range(0, len(names), width):
            right = min(len(names), left + width)
            lo, hi = np.searchsorted(term, [left, right])
            count = np.zeros((size, right - left), np.int64)
            count[group[lo:hi], term[lo:hi] - left] = n[lo:hi]
            p, q = shares(count, total[:, None]), shares(count.sum(axis=0), whole)
            for a in range(first, last):
                gap, both = p[a + 1 :] - p[a], p[a + 1 :] + p[a]
                sums[a - first, a + 1 :] += (gap * gap // both).sum(axis=1)
                over = np.flatnonzero((count[a] > 0) & (p[a] > q))
                f = (p[a, over] - q[over]) ** 2 // (p[a, over] + q[over])
                # columns are in the order of terms, and so are the heaps
                f, at = np.concatenate((heaps[a - first][0], f)), np.concatenate((heaps[a - first][1], over + left))
                best = np.sort(np.argsort(-f, kind="stable")[:top])
                heaps[a - first] = f[best], at[best]
        a, b = np.triu_indices(last - first, first + 1, size)
        per = np.array([len(f) for f, _ in heaps], np.int64)
        terms = names.take(pa.array(np.concatenate([at for _, at in heaps]))) if len(heaps) else names.slice(0, 0)
        ones = np.concatenate((a + first, np.repeat(np.arange(first, last), per)))
        value = np.concatenate((sums[a, b], *[f for f, _ in heaps]))
        others = pa.concat_arrays([pa.array(b.astype(np.int32)), pa.nulls(len(terms), pa.int32())])
        return pa.table([pa.repeat(lang, len(ones)), pa.array(ones.astype(np.int32)), others, pa.concat_arrays([pa.nulls(len(b), pa.string()), terms]), pa.array(value)], names=["lang", "a", "b", "term", "value"])

    return run


def divergences(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """docs (text, lang, source) -> lang, source, part, item, value, rank.

    Part `pair`: item is each other source of the language and value the sum of f over all kept terms. Part `term`: item is
    a term that the group uses more than the language does, of the `top` of largest f. Ranks go by value, then by item.
    """
    counts = stash(term_counts(docs))
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "term")
    kept = stash(kept)
    used = stash(counts.where("term is not null").join(small_side(kept), ["lang", "term"]).select("lang", "source", "term", "n"))
    groups = counts.select("lang", "source").distinct().join(used.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("rows")), ["lang", "source"], "left")
    numbered = groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("rows", F.lit(0)).alias("rows"))
    numbered = numbered.withColumn("group", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    numbered = stash(numbered)
    langs = numbered.groupBy("lang").agg(F.sum("rows").alias("rows"), F.count("*").alias("groups"))
    langs = langs.join(kept.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left")
    blocks, strips = F.greatest(F.ceil(F.col("rows") / BLOCK), F.lit(1)).cast("int"), F.ceil(F.col("groups") / STRIP).cast("int")
    langs = small_side(stash(langs.select("lang", F.coalesce("kept", F.lit(0)).alias("kept"), blocks.alias("blocks"), strips.alias("strips"))))

    index = numbered.select("lang", "source", "group")
    strip = F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("strip")
    cells = used.join(small_side(index), ["lang", "source"]).join(langs, "lang")
    cells = cells.select("lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), strip, "group", "term", "n", "kept")
    heads = numbered.join(langs, "lang").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    heads = heads.select("lang", "block", strip, "group", F.lit(None).cast("string").alias("term"), "n", "kept")
    tiles = cells.unionByName(heads).groupBy("lang", "block", "strip")
    found = stash(tiles.applyInArrow(_compared(top), "lang string, a int, b int, term string, value long"))

    sums = found.where("b is not null").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    sums = sums.select("lang", ways.alias("way"), "value").select("lang", F.col("way.a").alias("a"), F.col("way.b").alias("b"), "value")
    name = lambda at, to: small_side(index).select("lang", F.col("group").alias(at), F.col("source").alias(to))
    pairs = sums.join(name("b", "item"), ["lang", "b"]).select("lang", "a", F.lit("pair").alias("part"), "item", "value")
    terms = found.where("term is not null").select("lang", "a", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "a", "part").orderBy(F.desc("value"), "item")).alias("rank")
    ranked = pairs.select("*", rank).unionByName(terms.select("*", rank).where(F.col("rank") <= top))
    return ranked.join(name("a", "source"), ["lang", "a"]).select("lang", "source", "part", "item", "value", "rank")
