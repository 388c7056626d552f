"""Packing by minimum bin slack.

Every text is cut into pieces of at most `window` ids: whole windows, and a rest. The plan needs only how many
rests have each length, at most window - 1 counts whatever the input. A subset-sum table of bitsets over the
remaining lengths (a length's count is split into powers of two) gives the multiset that, with the longest rest
left, fills a window closest to its capacity; walking the table back gives how often each length occurs in it. That pattern is used as often
as the remaining counts allow, so each pattern uses up some length and there are few patterns. A rest then finds
its place from its length and its number among the rests of that length.

Null and empty texts are the end id alone. Null ids and repeated rows are pieces like any other.
"""

from __future__ import annotations

import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewall.llm._spark import arrow_rows, stash

WINDOW, END = 4096, 2
#: Words whose ids a worker keeps
KEPT_WORDS = 400_000

#: Fixed values of the tokenizer: how it cuts lower-cased plain text into words, and what ends a word's last token.
#: Letters and numbers are spelt out, as plain texts have no others
WORD = re.compile(r"[a-zªµºß-öø-ÿĀ-ſ]+|'s|'t|'re|'ve|'m|'ll|'d|[\d²³¹¼½¾]|(?:[^\s\w]|_)+")
WORD_END = "</w>"
#: Texts of these characters alone are normal, and lower-cased alike everywhere; others go to the tokenizer whole
PLAIN = re.compile("[\t\n\r\x20-\x7e\u00a1-\u012f\u0131-\u017f\u2010-\u2027\u2030-\u205e]*")


class Encoder:
    """The ids of texts, with each distinct word encoded once while it is kept.

    Ids of the kept words lie in one array; `at` and `size` say where each word's are.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith(WORD_END)]] = True
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def whole(self, text: str) -> np.ndarray:
        # the call for batches keeps no offsets, which nothing here needs
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def learn(self, words: list[str]) -> None:
        ids = self.whole(" ".join(words))
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            raise ValueError("the tokenizer cuts words otherwise than WORD says")
        for name, need in (("pool", self.used + len(ids)), ("at", len(self.number) + len(words)), ("size", len(self.number) + len(words))):
            old = getattr(self, name)
            if need > len(old):
                setattr(self, name, np.concatenate((old, np.zeros(max(need, 2 * len(old)) - len(old), old.dtype))))
        self.pool[self.used : self.used + len(ids)] = ids
        first = len(self.number)
        starts = np.concatenate(([0], stops[:-1]))
        self.at[first : first + len(words)] = self.used + starts
        self.size[first : first + len(words)] = stops - starts
        self.number.update(zip(words, range(first, first + len(words)), strict=True))
        self.used += len(ids)

    def encode(self, texts: list[str], end: int = END) -> list[np.ndarray]:
        """Each text's ids and the end id."""
        cut = [WORD.findall(t.lower()) if "<|" not in t and PLAIN.fullmatch(t) else None for t in texts]
        new = {w for words in cut if words for w in words}.difference(self.number)
        if len(self.number) + len(new) > KEPT_WORDS:
            self.clear()
            new = {w for words in cut if words for w in words}
        if new:
            self.learn(sorted(new))
        out, last = [], np.array([end], np.uint32)
        for text, words in zip(texts, cut, strict=True):
            if words is None:
                ids = self.whole(text)
            else:
                word = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
                size = self.size[word]
                stop = np.cumsum(size)
                ids = self.pool[np.repeat(self.at[word] - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)]
            out.append(np.concatenate((ids, last)))
        return out


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _encoded(batch: pa.RecordBatch, path: str, end: int):
    """(doc_id, ids) of a batch's rows, a few texts at a time."""
    names, texts, some, chars = batch.column(0).to_pylist(), batch.column(1), [], 0
    for k in range(len(names)):
        some.append(texts[k].as_py() or "")
        chars += len(some[-1])
        if chars > 1 << 20 or k == len(names) - 1:
            yield from zip(names[k + 1 - len(some) : k + 1], _encoder(path).encode(some, end), strict=True)
            some, chars = [], 0


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """docs (doc_id, text) -> the pieces, with the task that made them and their number there among equal lengths."""
    arrow_rows(docs.sparkSession)

    def run(batches):
        task = TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        for batch in batches:
            out = []
            for i, ids in _encoded(batch, path, end):
                for at in range(0, len(ids), window):
                    part = ids[at : at + window]
                    out.append((i, at, len(part), zlib.crc32(part.astype("<u4").tobytes()), len(ids), task, int(seen[len(part)])))
                    seen[len(part)] += 1
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth"]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(7)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, nth long")


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths whose sum is largest within the capacity. Longer lengths are preferred."""
    full = (1 << (capacity + 1)) - 1
    reach, table = 1, []
    for length in sorted(counts, reverse=True):
        left, part = min(counts[length], capacity // length), 1
        while left:
            take = min(part, left)
            table.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            part *= 2
        if reach >> capacity & 1:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(table):
        if not before >> total & 1:
            total -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """(times, multiset of lengths) of the patterns that use up all counts."""
    left = {n: c for n, c in counts.items() if c}
    out = []
    while left:
        # the longest rest goes first: filled up last, long rests would be left that fit no window together
        longest = max(left)
        others = {n: c - (n == longest) for n, c in left.items() if c > (n == longest) and n <= window - longest}
        chosen = best_fill(others, window - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[n] // k for n, k in chosen.items())
        out.append((times, chosen))
        for n, k in chosen.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


def _places(patterns: list[tuple[int, dict[int, int]]]) -> tuple[np.ndarray, ...]:
    """Ranges of rests by (length, number): key, first sequence, rests of this length in one, offset of the first."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, chosen in patterns:
        offset = 0
        for n, k in sorted(chosen.items(), reverse=True):
            at = used.get(n, 0)
            rows.append((n << 48 | at, at, sequence, k, offset))
            used[n] = at + k * times
            offset += n * k
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return tuple(table.T)


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """Pieces with sequence_id and offset."""
    spark = docs.sparkSession
    made = stash(pieces(docs, path, window, end))
    # a piece's number among all of its length: those of earlier tasks, and its number in its own
    here = made.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = here.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    numbered = made.join(before, ["length", "task"]).withColumn("nth", F.col("nth") + F.col("before"))
    counts = {r["length"]: r["n"] for r in here.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(_places(plan(counts, window)))

    def placed(batches):
        key, first, sequence, each, offset = places.value
        for batch in batches:
            length, nth = batch.column("length").to_numpy(), batch.column("nth").to_numpy()
            if not len(nth):
                continue
            row = np.searchsorted(key, length << 48 | nth, "right") - 1
            j = nth - first[row]
            at = sequence[row] + j // each[row], offset[row] + j % each[row] * length
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, at)], names=[*names, "sequence_id", "offset"])

    numbered = numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth")
    return numbered.mapInArrow(placed, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
