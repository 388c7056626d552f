"""Pieces of query definitions: payload templates that Spark and SQL choose alike."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Least rows of a task, for rows that take much work
TASK_ROWS = 250


def spread(df: DataFrame) -> DataFrame:
    """A table whose rows are dealt to all cores: one task reads a whole row group, however much work its rows take."""
    tasks = min(2 * df.sparkSession.sparkContext.defaultParallelism, df.count() // TASK_ROWS)
    return df.repartition(tasks) if tasks > 1 else df


def pick(key: str, options: list) -> Column:
    """The option that the key's remainder chooses."""
    out = F.lit(options[-1])
    for k in range(len(options) - 2, -1, -1):
        out = F.when(F.col(key) % len(options) == k, F.lit(options[k])).otherwise(out)
    return out


def text_literal(value: str | None) -> str:
    if value is None:
        return "NULL"
    out, plain = [], ""
    for c in value:
        if ord(c) < 32 or ord(c) > 126:
            out += [f"'{plain}'"] * bool(plain) + [f"chr({ord(c)})"]
            plain = ""
        else:
            plain += "''" if c == "'" else c
    out += [f"'{plain}'"] if plain or not out else []
    return out[0] if len(out) == 1 else "(" + " || ".join(out) + ")"


def sql_value(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    return text_literal(value) if value is None or isinstance(value, str) else str(value)


def sql_pick(key: str, options: list) -> str:
    """pick() in SQL."""
    cases = " ".join(f"WHEN {k} THEN {sql_value(v)}" for k, v in enumerate(options))
    return f"(CASE {key} % {len(options)} {cases} END)"


def replaced(x: str, patterns: list[str], by: str = "") -> str:
    """Chained regexp_replace in SQL."""
    for p in patterns:
        x = f"regexp_replace({x}, {text_literal(p)}, {text_literal(by)}, 'g')"
    return x


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {text_literal(pattern)})"


def _number(key: str, before: int, n: int, division: str) -> str:
    return f"(({key}) {division} {before}) % {n}"


@dataclass(frozen=True)
class Parts:
    """Rows of a table whose parts are chosen from options, in all combinations as `key` (SQL of both engines) counts up.

    A template has parts, columns and expressions that both engines know between « and ». The same text comes out in Spark and in SQL, where
    a rule over the parts can then say what must hold.
    """

    table: str
    key: str
    options: dict[str, list[str]]

    def _steps(self) -> list[tuple[str, int, list[str]]]:
        out, before = [], 1
        for name, some in self.options.items():
            out.append((name, before, some))
            before *= len(some)
        return out

    def rows(self, spark: SparkSession, sf_dir: str, **templates: str) -> DataFrame:
        df = table(spark, sf_dir, self.table)
        for name, before, some in self._steps():
            at = F.expr(_number(self.key, before, len(some), "div"))
            df = df.withColumn(name, F.element_at(F.array(*map(F.lit, some)), (at + 1).cast("int")))
        for name, template in templates.items():
            df = df.withColumn(name, F.concat(*[F.expr(p).cast("string") if k % 2 else F.lit(p) for k, p in enumerate(re.split("[«»]", template))]))
        return df

    def sql(self, **templates: str) -> str:
        """The same rows as a parenthesized SELECT."""
        cases = []
        for name, before, some in self._steps():
            when = " ".join(f"WHEN {k} THEN {text_literal(v)}" for k, v in enumerate(some))
            cases.append(f"CASE {_number(self.key, before, len(some), '//')} {when} END AS {name}")
        made = [" || ".join(f"CAST({p} AS VARCHAR)" if k % 2 else text_literal(p) for k, p in enumerate(re.split("[«»]", t))) + f" AS {name}" for name, t in templates.items()]
        return f"(SELECT {', '.join(['*', *made])} FROM (SELECT *, {', '.join(cases)} FROM {self.table}))"
