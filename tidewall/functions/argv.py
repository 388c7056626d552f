"""The argument gate of interpreter front ends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewall.functions import let
from tidewall.functions.text import DIALECTS


def inline_body(argv: Column, dialect: str) -> Column:
    """Struct body, rest, error of [program, flag BODY, ARGS...]; anything before the flag is an error."""
    flag = DIALECTS[dialect][1]
    first = F.get(argv, F.lit(1))
    bundled = F.lit(False) if dialect != "shell" else first.rlike(r"^-[A-Za-z]{2,}\z") & first.contains(flag[1])
    alone = (first == flag) | bundled
    attached = first.startswith(flag) & ~alone

    def parts(a: Column) -> Column:
        return F.slice(argv, F.when(a, 4).otherwise(3), F.size(argv))

    body = F.when(alone, F.get(argv, F.lit(2))).when(attached, F.substring(first, 3, 1 << 30))
    error = F.when(first.isNull(), "no body").when(~alone & ~attached, "unrecognized argument before the flag").when(body.isNull(), "missing argument")
    return let(F.coalesce(alone, F.lit(False)), lambda a: F.struct(body.alias("body"), F.when(body.isNotNull(), parts(a)).alias("rest"), error.alias("error")))


def interpreter_ok(path: Column) -> Column:
    """An override must be absolute and without dot-dot segments."""
    return path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")
