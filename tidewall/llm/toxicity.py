"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct lower-cased words and their first four, five and six letters, each hashed into
2 ** HASH_BITS buckets. The machine scores sum(w) + sum over pairs <v, v'> of the terms present, so that two
terms that are harmless apart can count together. It is fitted on at most LABELLED labelled rows (those of least
id hash; the bound keeps the fit on the driver small) over the TERMS buckets of these rows that tell the classes
apart best, by chi-squared. Every text is scored whole.

Labels that are null don't train; of several labels of one id the largest counts. Null and empty texts have no
terms and get the score of the bias alone. Without training rows every score is 0. Null ids and repeated rows
keep their rows.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewall.llm._spark import arrow_rows, stash

HASH_BITS, TERMS, FACTORS = 22, 4096, 8
LABELLED = 20_000
#: Rows of the sample that a term needs
LEAST_ROWS = 4
EPOCHS, BATCH, RATE, SHRINK = 12, 128, 0.05, 1e-4

WORD = re.compile(r"[^\W\d_]+")
#: Characters of one text that are cut into words at a time
PIECE = 1 << 20


def _pieces(text: str):
    at = 0
    while at < len(text):
        to = at + PIECE
        while to < len(text) and text[to].isalpha():
            to += 1
        yield text[at:to]
        at = to


def terms(text: str | None) -> set[int]:
    """The hashed terms of a text."""
    found: set[str] = set()
    for piece in _pieces(text or ""):
        found.update(WORD.findall(piece.lower()))
    found |= {w[:n] + "^" for w in found for n in (4, 5, 6) if len(w) >= n}
    mask = (1 << HASH_BITS) - 1
    return {zlib.crc32(w.encode()) & mask for w in found}


@dataclass
class Machine:
    """known: sorted buckets; bias, weight and factor: the parameters."""

    known: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def score(self, present: np.ndarray) -> float:
        """Probability of the label; present: positions of the text's terms in known."""
        v = self.factor[present]
        pairs = 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        raw = self.bias + self.weight[present].sum() + pairs
        return float(1 / (1 + np.exp(-np.clip(raw, -30, 30))))


def fit(known: np.ndarray, rows: list[np.ndarray], labels: np.ndarray) -> Machine:
    """Logistic loss, AdaGrad, mini-batches. rows: positions in known."""
    rng = np.random.Generator(np.random.PCG64(5))
    k, rate = len(known), labels.mean() if len(labels) else 0.0
    bias = float(np.log((rate * len(labels) + 0.5) / ((1 - rate) * len(labels) + 0.5))) if len(labels) else -30.0
    weight, factor = np.zeros(k), rng.normal(0, 0.01, (k, FACTORS))
    past_w, past_v, past_b = np.full(k, 1e-6), np.full((k, FACTORS), 1e-6), 1e-6
    for _ in range(EPOCHS if len(set(labels.tolist())) == 2 and k else 0):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            x = np.zeros((len(batch), k))
            for i, row in enumerate(batch):
                x[i, rows[row]] = 1
            sums = x @ factor
            raw = bias + x @ weight + 0.5 * ((sums**2).sum(axis=1) - x @ (factor**2).sum(axis=1))
            error = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[batch]
            grad_w = x.T @ error / len(batch) + SHRINK * weight
            grad_v = (x.T @ (error[:, None] * sums) - (x.T @ error)[:, None] * factor) / len(batch) + SHRINK * factor
            past_w += grad_w**2
            past_v += grad_v**2
            past_b += error.mean() ** 2
            weight -= RATE * grad_w / np.sqrt(past_w)
            factor -= RATE / 4 * grad_v / np.sqrt(past_v)
            bias -= RATE * error.mean() / np.sqrt(past_b)
    return Machine(known, bias, weight, factor)


def _positions(known: np.ndarray, found: set[int]) -> np.ndarray:
    if not len(known) or not found:
        return np.zeros(0, np.int64)
    buckets = np.fromiter(found, np.int64, len(found))
    at = np.searchsorted(known, buckets)
    at[at == len(known)] = 0
    return np.sort(at[known[at] == buckets])


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """docs (doc_id, text), labels (doc_id, toxic); rows that may not train are left out by the caller."""
    spark = docs.sparkSession
    arrow_rows(spark)
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = stash(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED))

    def cut(batches):
        for batch in batches:
            found = [sorted(terms(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "terms"])

    # at most LABELLED rows are broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))
    rows = stash(rows.mapInArrow(cut, "toxic int, terms array<int>"))
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    both = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").cast("double").alias("n"), F.sum("toxic").cast("double").alias("a"))
    a, m = F.col("a"), F.col("n")
    chi = (n * (a * n - m * ones) * (a * n - m * ones)) / (m * F.greatest(n - m, F.lit(1.0)))
    best = both.where(m >= LEAST_ROWS).orderBy(F.desc(chi), "term").limit(TERMS).select("term").toPandas()
    known = np.sort(best["term"].to_numpy(np.int64))

    def keep(batches):
        for batch in batches:
            found = [_positions(known, set(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["toxic", "at"])

    table = rows.mapInArrow(keep, "toxic int, at array<long>").toArrow()
    return fit(known, [np.array(x, np.int64) for x in table["at"].to_pylist()], table["toxic"].to_numpy().astype(float))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs (doc_id, held_out, text) -> doc_id, held_out, score."""
    arrow_rows(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        m = known.value
        for batch in batches:
            scores = [m.score(_positions(m.known, terms(t))) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
