"""The same transforms on streams, and windowed reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewall.config import Policy
from tidewall.functions.redact import redact_line
from tidewall.operators.advisory import emissions, tool_output_advisories
from tidewall.operators.commands import classify
from tidewall.sources import audit
from tidewall.sources.events import event_verdicts


def by_batches(stream: DataFrame, judge: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Writes judge(micro-batch) as Parquet below `out`; a batch that is run again replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        judge(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def judge_commands(stream: DataFrame, out: str, checkpoint: str, command: str = "command", policy: Policy = Policy()) -> StreamingQuery:  # noqa: B008
    """Verdicts of a stream of commands. Each micro-batch is judged like a table, its distinct commands once."""
    return by_batches(stream, lambda batch: classify(batch, command, policy), out, checkpoint)


def judge_events(stream: DataFrame, out: str, checkpoint: str, raw: str = "raw", policy: Policy = Policy()) -> StreamingQuery:  # noqa: B008
    """Verdicts of a stream of raw events, such as tidewall_lines gives."""
    return by_batches(stream, lambda batch: event_verdicts(batch, raw, policy), out, checkpoint)


def redacted_lines(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Lines of text files as they come, without known tokens; lines of over a MiB are redacted in pieces."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).option("lineSep", "\n").text(path).select(redact_line(F.col("value")).alias("value"))


def advisories(stream: DataFrame, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    return tool_output_advisories(stream, policy=policy)


def emit_advisories(stream: DataFrame, out: str, trail: str, checkpoint: str, policy: Policy = Policy()) -> StreamingQuery:  # noqa: B008
    """Three outputs of one stream of tool output: hook answers and prose (text, below `out`), and rows of the audit trail."""

    def write(batch: DataFrame, number: int) -> None:
        found = emissions(advisories(batch, policy), "advisory")
        for name, column in (("hook", "hook_json"), ("prose", "prose")):
            # a batch that is run again replaces its own files
            found.select(F.col(column).alias("value")).write.mode("overwrite").text(f"{out}/{name}/batch={number}")
        rows = audit.advisory_rows(found, F.current_timestamp(), "advisory", F.col("notice.tool"), F.col("notice.findings"))
        rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{trail}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def denials_by_window(verdicts: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Verdicts by window and policy; rows later than the watermark are dropped, and state with them."""
    return verdicts.withWatermark(ts, late).groupBy(F.window(ts, width).alias("window"), "verdict", "policy").agg(F.count("*").alias("n"))


def to_audit_trail(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of audit rows to the trail, exactly once for each checkpoint."""
    return rows.writeStream.format("json").option("ignoreNullFields", "false").option("checkpointLocation", checkpoint).outputMode("append").start(path)


AUDIT_SCHEMA = audit.SCHEMA
