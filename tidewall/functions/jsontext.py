"""JSON texts as Columns, by their string tokens in document order; no tree is built and nothing leaves the JVM.

Outside of strings a JSON text has no quotes, so its keys and strings are the matches of one pattern from left to right. They are unescaped
together, as one JSON array. A text is read only if it is one whole JSON value; repeated keys count each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewall.functions import let

STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
#: A string (a key, if a colon follows) or a bracket
TOKEN = rf"(?s){STRING}\s*+:?|[\[\]{{}}]"
MOST_DEPTH = 64


def is_json(raw: Column) -> Column:
    """The text is one JSON value."""
    return F.coalesce(F.json_array_length(F.concat(F.lit("["), raw, F.lit("]"))) == 1, F.lit(False))


def _unescaped(tokens: Column) -> Column:
    return F.from_json(F.concat(F.lit("["), F.array_join(tokens, ","), F.lit("]")), "array<string>")


def _depth(token: Column) -> Column:
    return F.when(token.isin("[", "{"), 1).when(token.isin("]", "}"), -1).otherwise(0)


def _shallow(tokens: Column) -> Column:
    """Tokens of strings down to MOST_DEPTH, and of the keys of the last objects there."""
    state = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, t: Column) -> Column:
        keep = t.startswith('"') & (acc["depth"] <= F.when(t.endswith(":"), MOST_DEPTH + 1).otherwise(MOST_DEPTH))
        return F.struct((acc["depth"] + _depth(t)).alias("depth"), F.when(keep, F.array_append(acc["kept"], t)).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(tokens, state, step, lambda acc: acc["kept"])


def strings(raw: Column) -> Column:
    """Array of all keys and strings in document order, without what lies deeper than MOST_DEPTH; null: no JSON."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    deepest = lambda tokens: F.aggregate(tokens, start, lambda a, t: let(a["now"] + _depth(t), lambda d: F.struct(d.alias("now"), F.greatest(a["most"], d).alias("most"))), lambda a: a["most"])

    def kept(tokens: Column) -> Column:
        few = F.when(deepest(tokens) <= MOST_DEPTH, F.filter(tokens, lambda t: t.startswith('"'))).otherwise(_shallow(tokens))
        return _unescaped(F.transform(few, lambda t: F.regexp_replace(t, r"\s*:\z", "")))

    return F.when(is_json(raw), let(F.regexp_extract_all(raw, F.lit(TOKEN), F.lit(0)), kept))


def with_strings(raw: Column, change: Callable[[Column], Column]) -> Column:
    """The text with each key and string changed, and without spaces between tokens; null: no JSON."""

    def joined(x: Column) -> Column:
        gaps = F.transform(F.split(x, f"(?s){STRING}", -1), lambda g: F.regexp_replace(g, r"\s+", ""))
        texts = _unescaped(F.regexp_extract_all(x, F.lit(f"(?s){STRING}"), F.lit(0)))
        quoted = F.transform(texts, lambda t: F.regexp_extract(F.to_json(F.array(change(t))), r"(?s)\A\[(.*)\]\z", 1))
        both = F.arrays_zip(gaps.alias("gap"), quoted.alias("text"))
        return F.array_join(F.transform(both, lambda z: F.concat(z["gap"], F.coalesce(z["text"], F.lit("")))), "")

    return F.when(is_json(raw), let(raw, joined))
