"""Readers of command events and files, and the gates on raw events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewall.config import Policy
from tidewall.functions import jsontext
from tidewall.functions import text as T
from tidewall.operators.commands import classify

EVENT = "tool_name string, tool_input struct<command:string>"
PAYLOAD = "tool_name string, tool_input string, tool_response string, session_id string, hook_event_name string, cwd string"


def read_raw_events(spark: SparkSession, path: str) -> DataFrame:
    """One event for each line, as the file's bytes in `raw`: what is no UTF-8 must reach its denial.

    The format tidewall_lines (tables.py) reads the same and cuts lines at a cap while it reads; it also streams.
    """
    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("raw"))


def decode_events(df: DataFrame, raw: str = "raw", policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """df with decoded (ok, blank, not_utf8, bad_json), tool_name and command. Every row stays."""
    cut = F.substring(F.col(raw), 1, policy.event_cap).cast("string")
    text = F.when(F.is_valid_utf8(cut), cut)
    out = df.withColumn("_text", text).withColumn("_json", F.from_json("_text", EVENT, {"mode": "PERMISSIVE"})).withColumn("_any", F.try_parse_json("_text"))
    blank = F.trim(F.translate("_text", "\t\r\n", "   ")) == ""
    # the parser stops at the end of the first value; as the only item of a list nothing may follow it
    alone = F.coalesce(F.json_array_length(F.concat(F.lit("["), "_text", F.lit("]"))) == 1, F.lit(False))
    state = F.when(F.col("_text").isNull(), "not_utf8").when(blank, "blank").when(F.col("_any").isNull() | ~alone, "bad_json").otherwise("ok")
    return out.withColumn("decoded", state).withColumn("tool_name", F.coalesce("_json.tool_name", F.lit(""))).withColumn("command", F.coalesce("_json.tool_input.command", F.lit(""))).drop("_text", "_json", "_any")


def event_verdicts(df: DataFrame, raw: str = "raw", policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """Verdicts of raw events: undecodable ones are denied (or allowed by the escape hatch), other tools allowed."""
    decoded = decode_events(df, raw, policy).withColumn("command", F.when((F.col("decoded") == "ok") & (F.col("tool_name") == "Bash"), F.col("command")))
    judged = classify(decoded, policy=policy)
    bad = F.col("decoded").isin("not_utf8", "bad_json") & F.lit(not policy.allow_malformed)
    return judged.withColumn("verdict", F.when(bad, "deny").otherwise(F.col("verdict"))).withColumn("policy", F.when(bad, "undecodable").otherwise(F.col("policy"))).withColumn("exit", F.when(F.col("verdict") == "deny", 2).otherwise(0))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Post-event payloads; lines that aren't one JSON object give no row. Nested inputs stay JSON text."""
    raw = spark.read.text(path).where(jsontext.is_json(F.col("value")))
    return raw.select(F.from_json("value", PAYLOAD).alias("p")).select("p.*").where("tool_name is not null")


def read_text_files(spark: SparkSession, path: str, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """path and body of files, up to the read cap and one byte, decoded without failing."""
    files = spark.read.format("binaryFile").load(path)
    body = F.make_valid_utf8(F.substring("content", 1, policy.read_cap + 1).cast("string"))
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), body.alias("body"))


def inspect_source(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Texts in memory as rows."""
    return spark.createDataFrame([(t,) for t in texts], "text string")


def truncated(df: DataFrame, text: str, cap: int) -> DataFrame:
    return df.withColumn(text, T.truncate_bytes(F.col(text), cap))
