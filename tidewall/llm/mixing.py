"""Language-model scores by logistic context mixing over counted contexts.

A text is its lower-cased words and one end. The top CLASS_BITS bits of a word's hash are its class, which is
coded bit by bit; each bit is predicted in four contexts: none, the word before, the last two very frequent
words (which tell the language and the register), and the two words before. A logistic mixer adds the predictions'
log odds with weights that a gate selects (the bit's place and how much the contexts have seen), learned online; a
last table refines the mixed probability by what came true at such a probability. Within its class a word has its
add-one share. So score = log10 of a product of bit probabilities and shares: every bit's two probabilities add to one.

Counts (words, classes, bits) cover all training texts, each context under its own key: no table size and no
vocabulary bound them. Keys have as many bits as the corpus has contexts, and SPARE_BITS more, so that a context shares
its key with another by a chance of under 1 in 4096 at any size. Tasks cut texts into chunks; each distinct (context,
class) of a chunk is sent once, with its count, to the counting task that owns the context, so that a hot context is at
most 2**CLASS_BITS requests of a chunk. The counting task sends back how often, in other chunks, every prefix of the
class followed the context. Weights and refinement are learned on all training texts, each with counts that leave its
own chunk out (chunks hold texts of one fold of ids, so that a small corpus has several), and summed over chunks in Spark.
Texts are dealt to chunks by hash and in the order of hashes, and each chunk learns from the same start, so that scores hang on the
rows alone and not on how they are partitioned, or on which task runs again.
The counts of the FREQUENT most frequent words are broadcast; those of all others are asked for like contexts, by the
whole 64-bit hash.

Null and empty texts are one end token. Without training rows all counts are 0. Null ids and repeated rows keep
their rows. Texts of any length are scored whole. Columns other than doc_id, held_out and text are not read.
"""

from __future__ import annotations

import math
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewall.llm._spark import arrow_rows, setting, stash, unstash
from tidewall.llm._words import hash_words, mix, text_slices, word_bounds
from tidewall.llm.sharding import numbered, repeated

CLASS_BITS = 10
#: A counting task is given about 2 ** TABLE_BITS requests of chunks; the number of tasks follows the tokens
TABLE_BITS = 20
FREQUENT, MARKERS = 1 << 17, 256
FOLDS, CHUNK_TOKENS = 4, 1 << 20
SPARE_BITS, MOST_BITS = 12, 64 - CLASS_BITS
#: The hash that stands for the end of a text
END = np.uint64(0x5851F42D4C957F2D)
CONTEXTS, INPUTS, SEEN = 3, 5, 3
GATES, CELLS = CLASS_BITS * SEEN * SEEN, 41
RATE, CHUNK_WORDS, LEARN_WORDS, BLOCK_KEYS = 0.02, 1 << 12, 1 << 12, 1 << 13
#: Into how many parts texts are dealt: LEAST_PARTS, and one more for so many training tokens
LEAST_PARTS, PART_TOKENS = 8, 4 << 20
#: Into how many slices chunks are met with their answers, beyond so many tokens
SLICES, SLICE_TOKENS = 6, 1 << 22
#: Into how many groups counting tasks are then dealt
ASK_GROUPS = 8
_U = np.uint64


def token_slices(names: list, texts: pa.Array):
    """(names, token hashes, each text's first token with the count at the end, bytes of each text)."""
    for some, data, offsets in text_slices(names, texts, 1 << 20):
        starts, ends, first = word_bounds(data, offsets)
        words = hash_words(data, starts, ends, lower=True)
        # one end after each text
        out = np.insert(words, first[1:], END)
        yield some, out, first + np.arange(len(first)), np.diff(offsets)


@dataclass
class Vocabulary:
    """The most frequent words: hashes in order, with counts and ranks; and the totals of all words."""

    words: np.ndarray
    counts: np.ndarray
    ranks: np.ndarray
    tokens: int
    distinct: int
    class_mass: np.ndarray  # log10(count of the class + its distinct words + 1)

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, whether the word is there)"""
        if not len(self.words):
            return np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
        at = np.searchsorted(self.words, tokens)
        at[at == len(self.words)] = 0
        return at, self.words[at] == tokens


def classes(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> _U(64 - CLASS_BITS)).astype(np.int64)


def contexts(tokens: np.ndarray, marks: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(CONTEXTS, tokens) 64-bit hashes of each token's contexts. marks: whether a token is a very frequent word."""
    n = len(tokens)
    place = np.arange(n)
    start = np.repeat(first[:-1], np.diff(first))
    none = np.zeros(1, np.uint64)
    before = np.where(place - 1 >= start, np.concatenate((none, tokens[:-1]))[:n], _U(0))
    before2 = np.where(place - 2 >= start, np.concatenate((none, none, tokens[:-2]))[:n], _U(0))
    last = np.maximum.accumulate(np.where(marks, place, -1))
    m1 = np.concatenate(([-1], last[:-1]))[:n]
    m2 = np.where(m1 > 0, last[np.maximum(m1 - 1, 0)], -1)
    mark1 = np.where(m1 >= start, tokens[np.maximum(m1, 0)], _U(0))
    mark2 = np.where((m1 >= start) & (m2 >= start), tokens[np.maximum(m2, 0)], _U(0))
    both = np.stack((before, mix(mark1 * _U(0x9E3779B97F4A7C15) + mark2), mix(before * _U(0xC2B2AE3D27D4EB4F) + before2)))
    return mix(both + np.arange(1, CONTEXTS + 1, dtype=np.uint64)[:, None] * _U(0x632BE59BD9B4E019))


_PLACES = np.arange(CLASS_BITS)


def events(of_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, bits) of every bit of every token: which bit of the class, after which bits."""
    nodes = (1 << _PLACES) | (of_class[:, None] >> (CLASS_BITS - _PLACES))
    return nodes.astype(np.uint32), (of_class[:, None] >> (CLASS_BITS - 1 - _PLACES) & 1).astype(bool)


def word_counts(training: DataFrame) -> DataFrame:
    """word (hash), n of every word of the training texts, ends included."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, tokens, _, _ in token_slices([None] * batch.num_rows, batch.column(0)):
                held.append(tokens)
                size += len(tokens)
                if size > 1 << 22:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    def counted(held):
        words, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

    return training.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).toPandas()
    of_class = F.shiftrightunsigned("word", 64 - CLASS_BITS)
    mass = np.ones(1 << CLASS_BITS)
    tokens = distinct = 0
    for k, n, v in counts.groupBy(of_class.alias("k")).agg(F.sum("n"), F.count("*")).collect():
        mass[k] += n + v
        tokens += n
        distinct += v
    words = top["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    return Vocabulary(words[order], top["n"].to_numpy(np.int64)[order], order, tokens, distinct, np.log10(mass))


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned numbers of one dimension byte plane by byte plane, compressed; planes beyond the largest number are left out."""
    width = int(numbers.max()).bit_length() + 7 >> 3 if len(numbers) else 0
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.itemsize)
    raw = b"".join(planes[:, k].tobytes() for k in range(width))
    return width.to_bytes(1, "little") + len(raw).to_bytes(7, "little") + pa.compress(raw, codec="zstd", asbytes=True) + len(numbers).to_bytes(8, "little")


def unpack(raw: bytes, kind) -> np.ndarray:
    width, size, n = raw[0], int.from_bytes(raw[1:8], "little"), int.from_bytes(raw[-8:], "little")
    planes = np.frombuffer(pa.decompress(raw[8:-8], size, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    for k in range(width):
        out[:, k] = planes[k]
    return out.view(kind).ravel()


def pack_small(numbers: np.ndarray) -> bytes:
    """Like pack, for numbers of which few are over 254: those are packed apart."""
    low = np.minimum(numbers, 255).astype(np.uint8)
    first = pack(low)
    return len(first).to_bytes(8, "little") + first + pack(numbers[low == 255].astype(np.uint64))


def unpack_small(raw: bytes) -> np.ndarray:
    cut = 8 + int.from_bytes(raw[:8], "little")
    out = unpack(raw[8:cut], np.uint8).astype(np.int64)
    out[out == 255] = unpack(raw[cut:], np.uint64).astype(np.int64)
    return out


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique(keys, return_inverse=True) of (context, class) keys, by one sort of numbers that hold key and place.

    They leave the last bits of the context out if there is no room; contexts that then look alike are sorted again.
    """
    n = len(keys)
    if not n:
        return keys, np.zeros(0, np.int64)
    # the class stays in the last bits
    least = keys.min() >> _U(CLASS_BITS) << _U(CLASS_BITS)
    bits = n.bit_length()
    left_out = max(0, int(keys.max() - least).bit_length() + bits - 64)
    if left_out > SPARE_BITS:
        return np.unique(keys, return_inverse=True)
    mine = keys - least
    mine = (mine >> _U(CLASS_BITS + left_out) << _U(CLASS_BITS) | mine & _U((1 << CLASS_BITS) - 1)) << _U(bits) | np.arange(n, dtype=np.uint64)
    mine.sort()
    order = (mine & _U((1 << bits) - 1)).astype(np.int64)
    found = keys[order]
    if left_out:
        alike = mine >> _U(bits + CLASS_BITS)
        for x in np.unique(alike[1:][found[1:] < found[:-1]]):
            some = slice(np.searchsorted(alike, x), np.searchsorted(alike, x, "right"))
            again = np.argsort(found[some], kind="stable")
            order[some], found[some] = order[some][again], found[some][again]
    del mine
    new = np.concatenate(([True], found[1:] != found[:-1]))
    inverse = np.empty(n, np.int64)
    inverse[order] = np.cumsum(new) - 1
    return found[new], inverse


CHUNK = "chunk long, fold int, scored boolean, n long, doc_ids array<long>, held array<boolean>, bytes array<long>, lengths binary, words binary, places binary, class_counts array<long>"


def cut_chunks(rows: DataFrame) -> DataFrame:
    """rows (doc_id, held_out, scored, fold, text) -> chunks of texts of one fold (-1: no training) as places in a list of distinct words."""

    def run(batches):
        held, number = {}, TaskContext.get().partitionId() << 24
        for batch in batches:
            kinds = batch.column(3).to_numpy(zero_copy_only=False).astype(int) * 2 + batch.column(2).to_numpy(zero_copy_only=False)
            for kind in np.unique(kinds).tolist():
                part = batch.filter(pa.array(kinds == kind))
                ids, outs = part.column(0).to_pylist(), part.column(1).to_pylist()
                for some, tokens, first, sizes in token_slices(list(range(part.num_rows)), part.column(4)):
                    mine = held.setdefault(kind, [])
                    mine.append(([ids[k] for k in some], [outs[k] for k in some], tokens, np.diff(first), sizes))
                    if sum(len(m[2]) for m in mine) >= CHUNK_TOKENS:
                        yield closed(number, kind, held.pop(kind))
                        number += 1
        for kind, mine in held.items():
            yield closed(number, kind, mine)
            number += 1

    def closed(number, kind, mine):
        words, places = np.unique(np.concatenate([m[2] for m in mine]), return_inverse=True)
        seen = np.bincount(classes(words)[places], minlength=1 << CLASS_BITS)
        row = [number, kind >> 1, bool(kind & 1), len(places), [i for m in mine for i in m[0]], [h for m in mine for h in m[1]]]
        row += [np.concatenate([m[4] for m in mine]).tolist(), pack(np.concatenate([m[3] for m in mine]).astype(np.uint64)), pack(np.diff(words, prepend=_U(0))), pack(places.astype(np.uint32)), seen.tolist()]
        kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=[c.split(" ")[0] for c in CHUNK.split(", ")])

    return rows.select("doc_id", "held_out", "scored", "fold", "text").mapInArrow(run, CHUNK)


def rows_of(batch: pa.RecordBatch):
    """The rows as dicts, one at a time: each is a whole chunk."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


#: Chunks that go to a Python worker at a time, with the shuffle files of a plan dropped when it is done
FEW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def few_at_a_time(spark):
    with ExitStack() as stack:
        for key, value in FEW.items():
            stack.enter_context(setting(spark, key, value))
        yield


@dataclass
class Chunk:
    """A chunk's tokens, and its requests: distinct (context, class) keys in order, counts, each token's place in them by context."""

    words: np.ndarray
    places: np.ndarray
    first: np.ndarray
    known: np.ndarray  # position of each of `words` in the vocabulary, or -1
    rare: np.ndarray  # the places of words outside the vocabulary in `words`
    rare_counts: np.ndarray
    keys: np.ndarray
    counts: np.ndarray
    of_token: np.ndarray

    @classmethod
    def read(cls, row: dict, v: Vocabulary) -> Chunk:
        words, places = np.cumsum(unpack(row["words"], np.uint64), dtype=np.uint64), unpack(row["places"], np.uint32)
        first = np.concatenate(([0], np.cumsum(unpack(row["lengths"], np.int64))))
        at, there = v.find(words)
        marks = there & (v.ranks[at] < MARKERS) if len(v.words) else there
        of_class = classes(words).astype(np.uint64)[places]
        keys = contexts(words[places], marks[places], first) >> _U(64 - row["bits"]) << _U(CLASS_BITS) | of_class
        keys, of_token = ranked(keys.ravel())
        of_token = of_token.astype(np.uint32)
        counts = np.bincount(of_token, minlength=len(keys))
        rare = np.flatnonzero(~there)
        return cls(words, places, first, np.where(there, at, -1), rare, np.bincount(places, minlength=len(words))[rare], keys, counts, of_token.reshape(CONTEXTS, -1))


def key_bits(tokens: int) -> int:
    """Bits of a context's key for a corpus of so many tokens."""
    return min(MOST_BITS, max(24, (CONTEXTS * tokens).bit_length()) + SPARE_BITS)


def owners(keys: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """The counting task of each key of so many bits, by its first 24; it never falls with the key."""
    return ((keys >> _U(bits - 24)) * _U(parts) >> _U(24)).astype(np.int64)


def _by_owner(keys: np.ndarray, parts: int, bits: int) -> dict[int, slice]:
    """Which of the sorted keys each counting task has."""
    owner = owners(keys, parts, bits)
    cuts = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(owner))
    return {int(owner[lo]): slice(lo, hi) for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)}


#: From which depth on two classes that differ in such bits are apart
_DEPTH = np.array([CLASS_BITS + 1, *(CLASS_BITS + 1 - k.bit_length() for k in range(1, 1 << CLASS_BITS))], np.uint8)


def depths(keys: np.ndarray, first=0) -> np.ndarray:
    """From which depth on each sorted key is on another node than the key before it. 0: in another context, or at `first` of a list."""
    out = np.zeros(len(keys), np.uint8)
    step = keys[1:] ^ keys[:-1]
    out[1:] = np.where(step >> _U(CLASS_BITS), 0, _DEPTH[(step & _U((1 << CLASS_BITS) - 1)).astype(np.int64)])
    if len(keys):
        out[first] = 0
    return out


def climb(depth: np.ndarray):
    """For each depth from CLASS_BITS - 1 to 0: which nodes of the depth below are the first of a node, and where they are. A node is a context and the class's first bits."""
    for d in range(CLASS_BITS - 1, -1, -1):
        first = depth <= d
        lead = np.flatnonzero(first)
        depth = depth.take(lead)
        yield first, lead


def sums_before(counts: np.ndarray) -> np.ndarray:
    """What comes before each of the counts; np.diff of some of these with the sum is the counts from each to the next."""
    return np.cumsum(counts) - counts


def runs(cuts: np.ndarray):
    """Pairs of places in `cuts`, between which about BLOCK_KEYS keys lie: work on them stays in a core's cache."""
    at = 0
    while at < len(cuts) - 1:
        to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + BLOCK_KEYS, "right")) - 1)
        yield at, to
        at = to


def answers_to(chunks: DataFrame, vocab, parts: int, bits: int, groups: int = 1) -> DataFrame:
    """chunk, part, counts, words: by counting task, what other chunks' training texts have of the prefixes and words asked for.

    counts: each distinct prefix once, as the step from a longer one: most steps are 0. With groups, requests are written
    and answered one group of counting tasks after the other, so that requests go from the disk as answers come.
    """
    chunks = chunks.withColumn("bits", F.lit(bits))
    none = slice(0, 0)

    def ask(batches):
        for batch in batches:
            for row in rows_of(batch):
                chunk = Chunk.read(row, vocab.value)
                trains = row["fold"] >= 0
                words = chunk.words[chunk.rare]
                of_keys, of_words = _by_owner(chunk.keys, parts, bits + CLASS_BITS), _by_owner(words, parts, 64)
                blocks = []
                for part in sorted(of_keys | of_words):
                    k, w = of_keys.get(part, none), of_words.get(part, none)
                    numbers = [pack(n.astype(np.uint32)) if trains else None for n in (chunk.counts[k], chunk.rare_counts[w])]
                    blocks.append((part, row["chunk"], pack(np.diff(chunk.keys[k], prepend=_U(0))), numbers[0], pack(np.diff(words[w], prepend=_U(0))), numbers[1], part * groups // parts))
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([b[k] for b in blocks], t) for k, t in enumerate(kinds)], names=["part", "chunk", "keys", "counts", "words", "word_counts", "many"])

    def listed(keys, counts):
        """All requests, chunk by chunk; their own counts; how many each chunk has."""
        asked = [np.cumsum(unpack(raw, np.uint64), dtype=np.uint64) for raw in keys]
        # chunks that don't train ask without counts
        own = [np.zeros(len(a), np.int64) if raw is None else unpack(raw, np.uint32).astype(np.int64) for a, raw in zip(asked, counts, strict=True)]
        sizes = np.array([len(a) for a in asked])
        return np.concatenate(asked), np.concatenate(own), sizes

    def steps_of(keys, own, number):
        """By depth: each node's step and chunk, for requests that hold all of their contexts. number: the chunk of each."""
        distinct, at = ranked(keys)
        total = np.bincount(at, own, len(distinct)).astype(np.int64)
        before, mine, every, all_mine, all_every = sums_before(total), sums_before(own), total, own.sum(), total.sum()
        others = every.take(at) - own
        yield others, number
        new = np.flatnonzero(number[1:] != number[:-1]) + 1
        for (_, lead), (up, top) in zip(climb(depths(keys, np.append(0, new))), climb(depths(distinct)), strict=True):
            before = before.take(top)
            every = np.diff(before, append=all_every)
            mine, number, below = mine.take(lead), number.take(lead), others.take(lead)
            at = (np.cumsum(up) - 1).take(at.take(lead))
            others = every.take(at) - np.diff(mine, append=all_mine)
            yield others - below, number

    def count(key, frame):
        keys, own, sizes = listed(frame["keys"], frame["counts"])
        number = np.repeat(np.arange(len(sizes), dtype=np.min_scalar_type(len(sizes))), sizes)
        found, narrow = [([], []) for _ in range(CLASS_BITS + 1)], np.uint32 if own.sum() < 1 << 32 else np.int64
        if len(keys):
            # ranges of contexts, so that what is looked up stays in a core's cache
            context = keys >> _U(CLASS_BITS)
            least, ranges = context.min(), min(1 + len(keys) // (4 * BLOCK_KEYS), 1 << 15)
            context -= least
            context //= context.max() // _U(ranges) + _U(1)
            of_range = context.astype(np.uint16)
            del context
            order, ends = np.argsort(of_range, kind="stable"), np.cumsum(np.bincount(of_range, minlength=ranges))
            for lo, hi in zip(ends - np.diff(ends, prepend=0), ends, strict=True):
                if hi > lo:
                    some = order[lo:hi]
                    for (steps, numbers), (x, k) in zip(found, steps_of(keys.take(some), own.take(some), number.take(some)), strict=True):
                        steps.append(x.astype(narrow))
                        numbers.append(k)
            del order, of_range
        del keys, own, number
        by_depth = []
        while found:
            steps, numbers = found.pop(0)
            if steps:
                k = np.concatenate(numbers)
                by_depth.append((np.concatenate(steps).take(np.argsort(k, kind="stable")), np.concatenate(([0], np.cumsum(np.bincount(k, minlength=len(sizes)))))))
        none = [np.zeros(0, np.int64)]
        of_keys = [pack_small(np.concatenate([x[at[k] : at[k + 1]] for x, at in by_depth] or none)) for k in range(len(sizes))]
        words, own, sizes = listed(frame["words"], frame["word_counts"])
        distinct, place = ranked(words)
        others = (np.bincount(place, own, len(distinct)).astype(np.int64).take(place) - own).astype(np.uint32)
        ends = np.cumsum(sizes)
        pa.default_memory_pool().release_unused()
        return pd.DataFrame({"chunk": frame["chunk"], "part": key[0], "counts": of_keys, "words": [pack(others[lo:hi]) for lo, hi in zip(ends - sizes, ends, strict=True)]})

    def counted(asked):
        return asked.groupBy("part").applyInPandas(count, "chunk long, part int, counts binary, words binary")

    asked = chunks.select("chunk", "fold", "lengths", "words", "places", "bits").mapInArrow(ask, "part int, chunk long, keys binary, counts binary, words binary, word_counts binary, many int")
    if groups == 1:
        return counted(asked.drop("many"))
    asked, answers = stash(asked, "many"), []
    for k in range(groups):
        answers.append(stash(counted(asked.where(F.col("many") == k))))
        unstash(asked, only=f"/many={k}")
    return reduce(DataFrame.unionByName, answers)


def answered(chunks: DataFrame, answers: DataFrame, parts: int, bits: int, slices: int, k: int) -> DataFrame:
    """One slice of the chunks, each with all its answers. Slices are met one by one, as chunks with answers are the largest thing that is shuffled."""
    mine = F.pmod(F.xxhash64("chunk"), F.lit(slices)) == k
    by_chunk = answers.where(mine).groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("part", "counts", "words"))).alias("answers"))
    return chunks.where(mine).drop("n").withColumn("parts", F.lit(parts)).withColumn("bits", F.lit(bits)).join(by_chunk, "chunk")


#: 1 for each bit of a class that is set, else -1
_SIGNS = np.where(events(np.arange(1 << CLASS_BITS))[1], np.float32(1), np.float32(-1))


def _odds(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    return np.log(ones.astype(np.float32) + np.float32(0.4)) - np.log(zeros.astype(np.float32) + np.float32(0.4))


def class_totals(chunks: DataFrame) -> np.ndarray:
    """How often each class came in all training texts."""
    counts = np.zeros(1 << CLASS_BITS, np.int64)
    for k, n in chunks.where("fold >= 0").select(F.posexplode("class_counts").alias("k", "n")).groupBy("k").agg(F.sum("n")).collect():
        counts[k] = n
    return counts


def base_odds(counts: np.ndarray) -> np.ndarray:
    """Counts of classes -> log odds of each node without context."""
    out = np.zeros(1 << CLASS_BITS, np.float32)
    for d in range(CLASS_BITS):
        halves = counts.reshape(1 << d, 2, -1).sum(axis=2)
        out[1 << d : 2 << d] = _odds(halves[:, 1], halves[:, 0])
    return out


def model_of(chunk: Chunk, row: dict, totals: np.ndarray, apart: bool) -> tuple:
    """What _inputs needs of a chunk: counts of all training texts; with apart, of all but the chunk's own."""
    owned = _by_owner(chunk.keys, row["parts"], row["bits"] + CLASS_BITS)
    raw = [x["counts"] for x in row["answers"] if x["part"] in owned]
    cuts = np.append([owned[k].start for k in sorted(owned)], len(chunk.keys)).astype(np.int64)
    if apart:
        totals = totals - np.array(row["class_counts"])
    own = chunk.counts if row["fold"] >= 0 and not apart else None
    odds, seen = np.empty((len(chunk.keys), CLASS_BITS), np.float32), np.empty((len(chunk.keys), CLASS_BITS), np.uint8)
    for lo, hi in runs(cuts):
        part = slice(cuts[lo], cuts[hi])
        _fill(odds[part], seen[part], chunk.keys[part], None if own is None else own[part], raw[lo:hi], cuts[lo : hi + 1] - cuts[lo])
    return base_odds(totals), [odds.ravel()] * CONTEXTS, [seen.ravel()] * CONTEXTS


def _fill(odds: np.ndarray, seen: np.ndarray, keys: np.ndarray, own, raw: list[bytes], ends: np.ndarray):
    """Answers to some keys -> log odds of each bit of each key's class, and how much its context has seen. own: counts to add."""
    levels, cuts = list(climb(depths(keys))), [ends]
    for _, lead in levels:
        cuts.append(np.searchsorted(lead, cuts[-1]))
    steps = [np.empty(at[-1], np.int64) for at in cuts]
    for k, some in enumerate(map(unpack_small, raw)):
        for step, at in zip(steps, cuts, strict=True):
            n = at[k + 1] - at[k]
            step[at[k] : at[k + 1]], some = some[:n], some[n:]
    others, node = steps[0], None
    if own is not None:
        mine, all_mine = sums_before(own), own.sum()
    came = others if own is None else others + own
    for d, (first, lead), step in zip(range(CLASS_BITS - 1, -1, -1), levels, steps[1:], strict=True):
        others = every = step + others.take(lead)
        if own is not None:
            mine = mine.take(lead)
            every = others + np.diff(mine, append=all_mine)
        above = np.cumsum(first) - 1
        x = _odds(came, every.take(above) - came)
        odds[:, d] = x if node is None else x.take(node)
        node, came = above if node is None else above.take(node), every
        seen[:, d] = ((every > 2).view(np.uint8) + (every > 30).view(np.uint8)).take(node)
    odds *= _SIGNS.take((keys & _U((1 << CLASS_BITS) - 1)).astype(np.int64), axis=0)


def word_totals(chunk: Chunk, row: dict, v: Vocabulary) -> np.ndarray:
    """How often each of the chunk's words came in all training texts."""
    out = np.zeros(len(chunk.words), np.int64)
    out[chunk.known >= 0] = v.counts[chunk.known[chunk.known >= 0]]
    if len(chunk.rare):
        out[chunk.rare] = np.concatenate([unpack(x["words"], np.uint32) for x in row["answers"]]) + (chunk.rare_counts if row["fold"] >= 0 else 0)
    return out


_NODES, _BITS = events(np.arange(1 << CLASS_BITS))
_NODES = _NODES.astype(np.int64)


def _inputs(model, of_class: np.ndarray, context: np.ndarray):
    """(log odds of each predictor, gate, bit) of every event. context: each token's request by context."""
    base, odds, seen = model
    n = len(of_class)
    x = np.ones((INPUTS, n, CLASS_BITS), np.float32)
    x[0] = base.take(_NODES[of_class])
    saw = []
    for c in range(CONTEXTS):
        whole = len(odds[c]) // CLASS_BITS * CLASS_BITS
        x[c + 1] = odds[c][:whole].reshape(-1, CLASS_BITS).take(context[c], axis=0)
        if c != 1:
            saw.append(seen[c][:whole].reshape(-1, CLASS_BITS).take(context[c], axis=0))
    gate = (_PLACES * (SEEN * SEEN)).astype(np.uint8) + saw[0] * np.uint8(SEEN) + saw[1]
    return x.reshape(INPUTS, -1), gate.ravel().astype(np.int64), _BITS[of_class].ravel()


def _mixed(x: np.ndarray, weights: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """Log odds of every event. weights: by input and gate."""
    z = weights[0].take(gate)
    z *= x[0]
    for k in range(1, INPUTS):
        z += x[k] * weights[k].take(gate)
    return z


def _squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(-z, -12, 12)))


def _cell(z: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(z * 2.5) + CELLS // 2, 0, CELLS - 1).astype(np.int64)


START = np.array([0.4, 0.2, 0.5, 0.1, 0.0], np.float32)


def learned_sums(ready: DataFrame, vocab, totals) -> np.ndarray:
    """Events, weights by gate (times events) and what came true by gate and cell, learned online in each chunk and summed."""

    def run(batches):
        total = np.zeros(1 + GATES * INPUTS + GATES * CELLS * 2)
        for batch in batches:
            for row in rows_of(batch):
                weights, cells, n = np.repeat(START[:, None], GATES, axis=1), np.zeros(GATES * CELLS * 2), 0
                chunk = Chunk.read(row, vocab.value)
                model = model_of(chunk, row, totals, apart=True)
                of_class = classes(chunk.words)[chunk.places]
                for at in range(0, len(of_class), LEARN_WORDS):
                    xs, gates, all_bits = _inputs(model, of_class[at : at + LEARN_WORDS], chunk.of_token[:, at : at + LEARN_WORDS])
                    zs = np.empty(len(gates), np.float32)
                    for lo in range(0, len(gates), 512 * CLASS_BITS):
                        part = slice(lo, lo + 512 * CLASS_BITS)
                        x, gate = xs[:, part], gates[part]
                        zs[part] = z = _mixed(x, weights, gate)
                        missed = all_bits[part] - _squash(z)
                        rate = RATE / np.sqrt(np.maximum(np.bincount(gate, minlength=GATES), 1))
                        for k in range(INPUTS):
                            weights[k] += rate * np.bincount(gate, missed * x[k], GATES)
                    cells += np.bincount((gates * CELLS + _cell(zs)) * 2 + all_bits, minlength=len(cells))
                    n += len(gates)
                total += np.concatenate(([n], weights.T.ravel().astype(float) * n, cells))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], names=["sums"])

    sums = np.zeros(1 + GATES * INPUTS + GATES * CELLS * 2)
    learned = ready.where("fold >= 0").select("fold", "lengths", "words", "places", "class_counts", "answers", "parts", "bits").mapInArrow(run, "sums array<double>")
    with few_at_a_time(ready.sparkSession):
        for k, x in learned.select(F.posexplode("sums").alias("k", "x")).groupBy("k").agg(F.sum("x")).collect():
            sums[k] = x
    return sums


def fit_mixer(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """learned_sums() -> (weights by gate, averaged over events; refined probability by gate and cell)."""
    cells = sums[1 + GATES * INPUTS :].reshape(GATES, CELLS, 2)
    weights = sums[1 : 1 + GATES * INPUTS].reshape(GATES, INPUTS) / sums[0] if sums[0] else np.tile(START, (GATES, 1))
    # a cell starts at its own probability, with the weight of 20 events
    own = _squash((np.arange(CELLS) - CELLS // 2) / 2.5)
    refined = (cells[:, :, 1] + 20 * own) / (cells.sum(axis=2) + 20)
    return weights.astype(np.float32), refined.astype(np.float32)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def score_documents(docs: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, held_out, text), training (doc_id, text; else the docs not held out) -> scores of every document.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities), bits_per_byte.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    counts = stash(word_counts(docs.where("not held_out") if training is None else training))
    words = vocabulary(counts)
    unstash(counts)
    vocab = spark.sparkContext.broadcast(words)
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    no = F.lit(-1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.lit(True).alias("scored"), (F.when(~F.col("held_out"), fold).otherwise(no) if training is None else no).alias("fold"), "text")
    if training is not None:
        rows = rows.union(training.select(F.col("doc_id").cast("long"), F.lit(False), F.lit(False), fold, "text"))
    keyed = rows.withColumns({"k1": F.xxhash64(F.coalesce("text", F.lit(""))), "k2": F.xxhash64("doc_id", "scored", "fold"), "size": F.lit(0)})
    keyed = numbered(keyed, repeated(keyed))
    dealt = keyed.repartition(LEAST_PARTS + words.tokens // PART_TOKENS, F.xxhash64("k1", "k2")).sortWithinPartitions("k1", "k2")
    chunks = stash(cut_chunks(dealt))
    tokens = chunks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    totals = class_totals(chunks)
    parts, bits, slices = 1 + (CONTEXTS * tokens >> TABLE_BITS + 1), key_bits(tokens), SLICES if tokens > SLICE_TOKENS else 1
    with few_at_a_time(spark):
        answers = answers_to(chunks, vocab, parts, bits, ASK_GROUPS) if tokens > SLICE_TOKENS else stash(answers_to(chunks, vocab, parts, bits))
    ready = [answered(chunks, answers, parts, bits, slices, k) for k in range(slices)]
    mixer = spark.sparkContext.broadcast(fit_mixer(sum(learned_sums(r, vocab, totals) for r in ready)))

    def run(batches):
        v, (weights, refined) = vocab.value, mixer.value
        by_input = np.ascontiguousarray(weights.T)
        for batch in batches:
            for row in rows_of(batch):
                chunk = Chunk.read(row, v)
                model = model_of(chunk, row, totals, apart=False)
                of_class, first, some = classes(chunk.words)[chunk.places], chunk.first, len(chunk.first) - 1
                logs = np.zeros(len(of_class))
                for lo in range(0, len(of_class), CHUNK_WORDS):
                    part = slice(lo, lo + CHUNK_WORDS)
                    k = of_class[part]
                    x, gate, bits = _inputs(model, k, chunk.of_token[:, part])
                    z = _mixed(x, by_input, gate)
                    p = 0.5 * _squash(z) + 0.5 * refined.ravel().take(gate * CELLS + _cell(z))
                    p = np.where(bits, p, 1 - p)
                    logs[part] = np.log10(p.reshape(-1, CLASS_BITS).prod(axis=1, dtype=float)) - v.class_mass[k]
                number = np.repeat(np.arange(some), np.diff(first))
                count = word_totals(chunk, row, v)[chunk.places]
                known = np.bincount(number, np.log10(count + 1), some)
                n, score = np.diff(first), known + np.bincount(number, logs, some)
                size = np.array(row["bytes"], float)
                columns = [row["doc_ids"], row["held"], n, np.bincount(number, count > 0, some).astype(np.int64), np.full(some, v.tokens), known - n * math.log10(v.tokens + v.distinct + 1), score]
                rates = pa.array(-score * math.log2(10) / np.maximum(size, 1), pa.float64(), mask=size == 0)
                yield pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], rates], names=[c.split(" ")[0] for c in SCORES.split(", ")])

    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    wanted = ["fold", "doc_ids", "held", "bytes", "lengths", "words", "places", "class_counts", "answers", "parts", "bits"]
    with few_at_a_time(spark):
        out = [stash(r.where("scored").select(*wanted).mapInArrow(run, SCORES)) for r in ready]
    unstash(chunks, answers)
    return reduce(DataFrame.unionByName, out)
