"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 drawn from its code point. A trigram binds its letters: the
elementwise product of the letters' vectors, rotated by two, one and no places. A text bundles its trigrams
(their weighted sum); a language's prototype bundles the trigrams of all its training texts. A text gets the
language whose prototype has the largest cosine.

Texts are lower-cased letter by letter, and each run of other characters is one space. Null texts and texts
without a letter are `und` with score 0. Rows without a language don't train. Without any training row all
texts are `und`. Ties go to the language that sorts first. Null ids and repeated rows keep their rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewall.llm._spark import arrow_rows

DIM = 512
#: Characters of one text that are bundled at a time, and trigram vectors that a worker keeps
PIECE, KEPT = 1 << 20, 1 << 14
UND = "und"


@cache
def _letters() -> np.ndarray:
    """Code point -> lower-case letter's code point, or 0x20."""
    table = np.full(0x110000, 0x20, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


@cache
def _letter_vector(code: int) -> np.ndarray:
    bits = np.random.Generator(np.random.PCG64([11, code])).integers(0, 2, DIM, dtype=np.int8)
    return (bits * 2 - 1).astype(np.float32)


_rows: dict[int, int] = {}
_table = np.zeros((0, DIM), np.float32)


def _bind(gram: int) -> np.ndarray:
    a, b, c = gram >> 42, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF
    return np.roll(_letter_vector(a), 2) * np.roll(_letter_vector(b), 1) * _letter_vector(c)


def _vectors(grams: np.ndarray) -> np.ndarray:
    """The vectors of distinct trigrams. A bounded number is kept for the next text."""
    global _table
    new = [g for g in grams.tolist() if g not in _rows]
    if len(_rows) + len(new) > KEPT:
        _rows.clear()
        new = grams.tolist()
    if new:
        if len(_rows) + len(new) > len(_table):
            grown = np.zeros((max(2 * len(_table), len(_rows) + len(new), 4096), DIM), np.float32)
            grown[: len(_table)] = _table
            _table = grown
        for g in new:
            _table[len(_rows)] = _bind(g)
            _rows[g] = len(_rows)
    return _table[[_rows[g] for g in grams.tolist()]]


def _grams(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct trigrams and their counts, in pieces; nothing for a text without letters."""
    for at in range(0, max(1, len(text)), PIECE):
        # pieces overlap by two characters, so that no trigram is lost
        part = text[max(0, at - 2) : at + PIECE]
        codes = _letters()[np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32)]
        space = codes == 0x20
        if space.all():
            continue
        codes = codes[~(space & np.concatenate(([at == 0], space[:-1])))]
        codes = np.concatenate(([0x20], codes, [0x20])).astype(np.int64)
        yield np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_counts=True)


def bundle(text: str | None) -> np.ndarray | None:
    """A text's vector; None without a letter."""
    total = None
    for grams, counts in _grams(text or ""):
        part = np.zeros(DIM)
        for at in range(0, len(grams), KEPT // 4):
            part += counts[at : at + KEPT // 4].astype(np.float32) @ _vectors(grams[at : at + KEPT // 4])
        total = part if total is None else total + part
    return total


def prototypes(training: DataFrame) -> dict[str, np.ndarray]:
    """training (text, lang) -> each language's prototype, bundled from every row.

    Each task sends one vector for each of its languages; a vector for each language reaches the driver.
    """
    arrow_rows(training.sparkSession)

    def bundled(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                vector = bundle(text)
                if vector is not None:
                    sums[lang] = sums.get(lang, 0) + vector
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "vector"])

    parts = training.select("text", "lang").where("text is not null and lang is not null").mapInArrow(bundled, "lang string, vector array<double>")
    sums = parts.select("lang", F.posexplode("vector").alias("k", "v")).groupBy("lang", "k").agg(F.sum("v").alias("v"))
    rows = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("v")).orderBy("lang").collect()
    return {r["lang"]: np.array([v for _, v in r["v"]]) for r in rows}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """docs with lang_pred and score, the cosine scaled to 0..1, in place of columns of these names."""
    arrow_rows(docs.sparkSession)
    names = list(profiles)
    matrix = np.stack([v / (np.linalg.norm(v) or 1) for v in profiles.values()]) if names else np.zeros((0, DIM))
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index("text")

    def predicted(batches):
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(at).to_pylist():
                vector = bundle(text) if names else None
                if vector is None or not (norm := np.linalg.norm(vector)):
                    langs.append(UND)
                    scores.append(0.0)
                    continue
                cosine = matrix @ vector / norm
                best = int(cosine.argmax())
                langs.append(names[best])
                scores.append(float(min(1.0, max(0.0, cosine[best]))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(predicted, f"{fields}, lang_pred string, score double")

