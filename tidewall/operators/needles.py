"""Many literal needles from a table, all found in one pass over each text.

The needles become an automaton (Aho-Corasick) that a task builds once, so a text costs its length and its hits, whatever the number of needles; texts and
rules are never joined. Needles go to the tasks in parts of at most PART_BYTES, each a pass of its own, so that a part is all that the driver
and a worker hold of them at once. Needles are matched without regard to the case of A-Z; with `word` only where no letter A-Z, digit or _ stands beside them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewall.scratch import written

PART_BYTES = 16 << 20
HITS = "array<struct<needle:string,n:int,first:int>>"

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")
_built: dict = {}


def _automaton(needles):
    """The automaton of a broadcast list, kept while the worker lives and asks for no other."""
    import ahocorasick

    found = _built.get(needles.value[0])
    if found is None:
        found = ahocorasick.Automaton()
        for k, needle in enumerate(needles.value[1]):
            found.add_word(needle.translate(_LOWER), k)
        found.make_automaton()
        _built.clear()
        _built[needles.value[0]] = found
    return found


def _finder(needles, word: bool):
    def find(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton, names = _automaton(needles), needles.value[1]

        def one(text):
            if text is None:
                return None
            low, hits = text.translate(_LOWER), {}
            for end, k in automaton.iter(low):
                start = end + 1 - len(names[k])
                if word and (low[start - 1 : start] in _WORD and start or low[end + 1 : end + 2] in _WORD):
                    continue
                n, first = hits.get(k, (0, start))
                hits[k] = n + 1, first
            return [{"needle": names[k], "n": n, "first": first} for k, (n, first) in sorted(hits.items(), key=lambda h: names[h[0]])]

        for part in parts:
            yield part.map(one)

    return find


def needle_hits(df: DataFrame, needles: DataFrame, text: str = "text", needle: str = "needle", word: bool = False) -> DataFrame:
    """df with hits: an array of needle, n (places, overlapping ones too), first (its first place, in characters from 0); null for a null text.

    Null and empty needles hit nothing; of needles that differ in the case of A-Z alone the least one is reported.
    """
    sc = df.sparkSession.sparkContext
    plain = F.translate(needle, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    table = written(needles.where(F.length(needle) > 0).groupBy(plain.alias("plain")).agg(F.min(needle).alias("needle")))
    size = table.agg(F.sum(F.octet_length("needle"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    found = []
    for k in range(parts):
        some = table.where(F.pmod(F.xxhash64("plain"), F.lit(parts)) == k).select("needle").toArrow()["needle"].to_pylist()
        if some:
            known = sc.broadcast((f"{sc.applicationId}-{id(table)}-{k}", some))
            found.append(F.pandas_udf(_finder(known, word), HITS)(F.col(text)))
    none = F.when(F.col(text).isNotNull(), F.array().cast(HITS))
    hits = F.concat(*found) if len(found) > 1 else found[0] if found else none
    return df.withColumn("hits", hits)
