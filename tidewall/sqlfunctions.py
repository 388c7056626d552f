"""Functions for queries in SQL text: the lexer as a table function, and the two kernels that SQL has no words for.

    SELECT c.id, s.* FROM commands c, LATERAL parse_shell(c.command) s
    SELECT nfkc(text), whatwg_url(url).host FROM pages
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewall.functions import net, text
from tidewall.functions.shell import lexed

STAGE_ROW = "readable boolean, pipeline int, stage int, name string, argv0 string, args array<string>, targets array<string>, subs array<string>"


class ParseShell:
    """A row for each stage of a command's own pipelines, numbered from 0; one row of nulls, not readable, for what the lexer can't read."""

    def eval(self, command: str) -> Iterator[tuple]:
        if command is None:
            return
        whole, pipelines = lexed(command)
        if not whole:
            yield False, None, None, None, None, None, None, None
            return
        for p, stages in enumerate(pipelines):
            for k, (_, name, argv0, args, _, redirects, subs, *_) in enumerate(stages):
                yield True, p, k, name, argv0, args, [r[2] for r in redirects], subs


def register(spark: SparkSession) -> None:
    """Makes parse_shell, nfkc and whatwg_url known to a session's SQL."""
    spark.udtf.register("parse_shell", F.udtf(ParseShell, returnType=STAGE_ROW, useArrow=True))
    spark.udf.register("nfkc", text._nfkc())
    spark.udf.register("whatwg_url", net._split_url())
