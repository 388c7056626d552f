"""Substring dedup by a Relative Lempel-Ziv parse: documents are factored against all documents with smaller ids.

The reference is indexed by content. Its blocks are runs of BLOCK words chosen from the text alone: the block of
least hash in every window of `span` words. Equal windows choose equal blocks, so a duplicate window always holds a
block that another document has too. Every window around such a shared block goes into the index, which tells the
first place (smallest id, then place) where its words start.

The parse is greedy along that index: a factor starts at the first window that a smaller id holds, and is extended
word by word as long as the next window follows at the next place of the same reference; then the next factor starts.
Factors have at least `span` words. At the boundary of two factors the windows that cross it are looked up like any
other, so a duplicate that no single reference holds is found too, and a crossing that nobody holds removes nothing.
A factor follows the first reference that holds its windows, which isn't always the one that could be followed longest;
the words that factors cover are the same. Each factor's words are compared with those of its reference, by a
128-bit digest, before they are removed.

Documents that repeat a whole word sequence are one class, parsed once: its smallest id is its reference, the
others are one factor. Words are runs of characters outside {0x20, 0x09-0x0D}, unchanged. Null and empty texts have
no words; texts under `span` words lose none. Rows are told apart by id and word sequence: repeated rows of one id
are each parsed, different texts of one id too, and never against each other. Rows with a null id are never a
reference and lose nothing. Columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewall.llm._spark import arrow_rows, small_side, stash, unstash
from tidewall.llm._words import gram_hashes, hash_words, hashed_texts, mix, text_slices, word_bounds

BLOCK = 20
#: Runs of one reference that one row asks for
RUNS = 4096
_MOST = np.uint64(2**64 - 1)


def _sequence_key(words: np.ndarray) -> int:
    """A hash of a whole word sequence."""
    return int(mix(gram_hashes(words, len(words)) + np.uint64(len(words)))[0].view(np.int64)) if len(words) else 0


def _running_min(x: np.ndarray, width: int) -> np.ndarray:
    """out[i] = min(x[i : i + width]); the array's end shortens the last ranges."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:-step]
        have += step
    return out


def block_starts(words: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the blocks that some window of `span` words chooses."""
    if len(words) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = gram_hashes(words, BLOCK)
    width = span - BLOCK + 1
    least = _running_min(grams, width)[: len(words) - span + 1]
    # a block is chosen if the largest least value among the windows that hold it is its own hash
    padded = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)))
    chosen = (_MOST - _running_min(_MOST - padded, width))[: len(grams)] == grams
    starts = np.flatnonzero(chosen)
    return starts, grams[starts]


def _described(span: int):
    """(doc_id, text) -> for each document its id, class and words (kind 0), for each block id, class and hash (kind 1)."""

    def run(batches):
        for batch in batches:
            ids, keys, sizes, of, classes, hashes = [], [], [], [], [], []
            for i, words in hashed_texts(batch.column(0).to_pylist(), batch.column(1), lower=False):
                ids.append(i)
                keys.append(_sequence_key(words))
                sizes.append(len(words))
                if i is not None:
                    grams = np.unique(block_starts(words, span)[1]).view(np.int64)
                    hashes.append(grams)
                    of.append(np.full(len(grams), i, np.int64))
                    classes.append(np.full(len(grams), keys[-1], np.int64))
            yield _row(0, ids, keys, sizes)
            if of:
                yield _row(1, np.concatenate(of), np.concatenate(classes), np.concatenate(hashes))

    def _row(kind, ids, keys, values):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind, np.int8)), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(values, pa.int64())], names=["kind", "id", "key", "value"])

    return run


def _of_class(entries: list[dict] | None, words: np.ndarray) -> list[dict]:
    """What is said of the text with these words; others of its id have other keys."""
    key = _sequence_key(words) if entries else 0
    return [e for e in entries or [] if e["key"] == key]


def _windows(span: int):
    """(doc_id, text, marks: key, blocks) -> id, class, start and hash of every window that holds one of the shared blocks."""

    def run(batches):
        for batch in batches:
            out = []
            ids, marks = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for k, words in hashed_texts(list(range(batch.num_rows)), batch.column(1), lower=False):
                last = len(words) - span
                for mark in _of_class(marks[k], words) if last >= 0 else []:
                    starts, grams = block_starts(words, span)
                    starts = starts[np.isin(grams.view(np.int64), np.array(mark["blocks"], np.int64))]
                    edge = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edge, np.maximum(starts - (span - BLOCK), 0), 1)
                    np.add.at(edge, np.minimum(starts, last) + 1, -1)
                    at = np.flatnonzero(np.cumsum(edge)[: last + 1] > 0)
                    out.append((np.full(len(at), ids[k], np.int64), np.full(len(at), mark["key"], np.int64), at.astype(np.int32), gram_hashes(words, span)[at].view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[j] for x in out])) for j in range(4)], names=["doc_id", "key", "start", "window"])

    return run


def _word_lists(texts: pa.Array):
    """(row, words as bytes, word hashes) of every text."""
    for some, data, offsets in text_slices(list(range(len(texts))), texts):
        starts, ends, of = word_bounds(data, offsets)
        hashes = hash_words(data, starts, ends, lower=False)
        raw = data.tobytes()
        for j, k in enumerate(some):
            lo, hi = of[j], of[j + 1]
            yield k, [raw[a:b] for a, b in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)], hashes[lo:hi]


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


DIGESTS = "ref long, ref_key long, ref_start int, n int, digest binary"


def _digests(batches):
    """(doc_id, text, wanted: key, start, n) -> the digest of each wanted run of a reference's words."""
    for batch in batches:
        out, ids, wanted = [], batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for k, words, hashes in _word_lists(batch.column(1)):
            out += [(ids[k], w["key"], w["start"], w["n"], _digest(words[w["start"] : w["start"] + w["n"]])) for w in _of_class(wanted[k], hashes)]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate(kinds)], names=["ref", "ref_key", "ref_start", "n", "digest"])


PARSED = "doc_id long, n_words long, n_removed long, kept_sha256 string, factors array<array<int>>, kept string"


def _parsed(batches):
    """(doc_id, text, marks: key, start, n, digest) -> the digest of each document; factors: [start, end) of removed words."""
    for batch in batches:
        out, ids, marks = [], batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for k, words, hashes in _word_lists(batch.column(1)):
            gone = np.zeros(len(words), bool)
            for m in _of_class(marks[k], hashes):
                to = m["start"] + m["n"]
                if _digest(words[m["start"] : to]) == m["digest"]:
                    gone[m["start"] : to] = True
            cuts = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0])))).reshape(-1, 2).tolist()
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
            out.append((ids[k], len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), cuts, kept.decode("utf-8", "replace")))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int32())), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate(kinds)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "factors", "kept"])


def factored(windows: DataFrame, span: int) -> DataFrame:
    """windows (doc_id, key, start, window) -> factors: doc_id, key, start, n (words), ref, ref_key, ref_start."""
    # of equal ids both take the same row, as they see all rows alike
    place = [F.min("doc_id").alias("ref"), F.min_by("key", "doc_id").alias("ref_key"), F.min_by("start", "doc_id").alias("at")]
    # a table of its own: a window that many documents hold can then be split in the join
    index = stash(windows.groupBy("window").agg(*place, F.max("doc_id").alias("last")).where("ref < last").drop("last"))
    held = windows.join(index, "window").where("ref < doc_id").select("doc_id", "key", "start", "ref", "ref_key", (F.col("at") - F.col("start")).alias("shift"))
    along = ["doc_id", "key", "ref", "ref_key", "shift"]
    # consecutive windows along one reference; repeated rows rank alike
    held = held.withColumn("run", F.col("start") - F.dense_rank().over(Window.partitionBy(*along).orderBy("start")))
    runs = held.groupBy(*along, "run").agg(F.min("start").alias("start"), (F.max("start") - F.min("start") + span).alias("n"))
    return runs.select("doc_id", "key", "start", "n", "ref", "ref_key", (F.col("start") + F.col("shift")).alias("ref_start"))


def reference_digests(docs: DataFrame, factors: DataFrame) -> DataFrame:
    """The digest of the words that each factor refers to, once for each run of a reference."""
    wanted = stash(factors.select("ref", "ref_key", "ref_start", "n").distinct())
    # a reference that very many factors use is read once for every RUNS of its runs
    parts = wanted.groupBy("ref").agg(F.ceil(F.count("*") / RUNS).alias("parts"))
    dealt = wanted.join(parts, "ref").withColumn("part", F.pmod(F.xxhash64("ref_start", "n"), F.col("parts")))
    lists = dealt.groupBy("ref", "part").agg(F.collect_list(F.struct(F.col("ref_key").alias("key"), F.col("ref_start").alias("start"), "n")).alias("wanted"))
    lists = stash(lists.select(F.col("ref").alias("doc_id"), "wanted"))
    return stash(docs.join(small_side(lists, 200_000), "doc_id").select("doc_id", "text", "wanted").mapInArrow(_digests, DIGESTS).distinct())


def dedup_substrings(docs: DataFrame, span: int = 50) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_removed, kept_sha256, factors, kept (the words left)."""
    if span < BLOCK:
        raise ValueError(f"span must be at least {BLOCK} words")
    arrow_rows(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = stash(docs.mapInArrow(_described(span), "kind byte, id long, key long, value long")).withColumnRenamed("id", "doc_id")
    rows = described.where("kind = 0 and doc_id is not null").select("doc_id", "key", F.col("value").cast("int").alias("n")).where(F.col("n") >= span)
    firsts = stash(rows.groupBy("key").agg(F.min("doc_id").alias("ref"), F.max("doc_id").alias("last")).where("ref < last").drop("last"))
    repeats = stash(rows.join(small_side(firsts), "key").where("doc_id > ref").select("doc_id", "key", "n", "ref").distinct())

    # blocks of several documents; repeats of a class don't count
    blocks = described.where("kind = 1").select("doc_id", "key", F.col("value").alias("block")).join(small_side(repeats.select("doc_id", "key")), ["doc_id", "key"], "left_anti")
    shared = stash(blocks.groupBy("block").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("block"))
    marks = blocks.join(small_side(shared), "block").groupBy("doc_id", "key").agg(F.collect_set("block").alias("blocks"))
    marks = stash(marks.groupBy("doc_id").agg(F.collect_list(F.struct("key", "blocks")).alias("marks")))
    windows = stash(docs.join(small_side(marks, 100_000), "doc_id").select("doc_id", "text", "marks").mapInArrow(_windows(span), "doc_id long, key long, start int, window long"))

    whole = repeats.select("doc_id", "key", F.lit(0).alias("start"), "n", "ref", F.col("key").alias("ref_key"), F.lit(0).alias("ref_start"))
    factors = stash(factored(windows, span).union(whole))
    unstash(described, windows)
    compared = factors.join(small_side(reference_digests(docs, factors)), ["ref", "ref_key", "ref_start", "n"])
    removed = stash(compared.groupBy("doc_id").agg(F.collect_list(F.struct("key", "start", "n", "digest")).alias("marks")))
    return docs.join(small_side(removed, 200_000), "doc_id", "left").select("doc_id", "text", "marks").mapInArrow(_parsed, PARSED)
