"""The JSON-lines audit trail: one nullable schema for its three shapes, its sink, its source and its reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewall.functions import jsontext
from tidewall.functions import text as T

SCHEMA = (
    "ts string, event string, tool string, session string, cwd string, input string, path string, findings array<string>, "
    "dialect string, decision string, body_sha256 string, reason string, detail string, exit int"
)


def sanitize_json(raw: Column) -> Column:
    """JSON text whose strings and keys have no terminal escapes and at most 4000 bytes; null for what is no JSON."""
    return jsontext.with_strings(raw, T.sanitize_field)


def _nulls(df: DataFrame, **columns: Column) -> DataFrame:
    fields = [f.strip().split(" ", 1) for f in re.split(r",\s(?![^<]*>)", SCHEMA)]
    return df.select(*[columns.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields])


def hook_rows(df: DataFrame, ts: Column, event: Column, tool: Column, session: Column, cwd: Column, tool_input: Column) -> DataFrame:
    return _nulls(df, ts=T.iso_time(ts), event=event, tool=T.sanitize_field(tool), session=T.sanitize_field(session), cwd=T.sanitize_field(cwd), input=sanitize_json(tool_input))


def advisory_rows(df: DataFrame, ts: Column, event: str, tool: Column, findings: Column, path: Column | None = None, session: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return _nulls(df, ts=T.iso_time(ts), event=F.lit(event), tool=tool, findings=findings, path=none if path is None else T.escape_for_prose(path), session=none if session is None else session)


def wrapper_rows(df: DataFrame, ts: Column, dialect: Column, decision: Column, body: Column, reason: Column, exit_code: Column) -> DataFrame:
    """Gated inline code: the body's hash, never the body."""
    return _nulls(df, ts=T.iso_time(ts), event=F.lit("wrapper"), dialect=dialect, decision=decision, body_sha256=T.body_hash(body), reason=T.sanitize_field(reason), exit=exit_code)


def append(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines, with their nulls."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The trail, with its times also as timestamps (null for a clock anomaly)."""
    return spark.read.schema(SCHEMA).json(path).withColumn("at", F.try_to_timestamp("ts", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")))


def daily_counts(trail: DataFrame) -> DataFrame:
    """Rows by day, event and decision, with subtotals."""
    return trail.withColumn("day", F.to_date("at")).rollup("day", "event", "decision").agg(F.count("*").alias("n"))


def top_tools(trail: DataFrame, k: int = 10) -> DataFrame:
    return trail.where("tool is not null").groupBy("tool").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tool").limit(k)


def collapse_suggestions(entries: DataFrame, command: str = "command", least: int = 3) -> DataFrame:
    """Program names that more than `least` allow entries share."""
    name = T.basename(F.substring_index(F.trim(F.col(command)), " ", 1))
    return entries.groupBy(name.alias("program")).agg(F.count("*").alias("n")).where(F.col("n") > least)
