"""Command verdicts: every script that a command reaches is lexed and judged once, and the first denial decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewall.config import Policy
from tidewall.functions.shell import STAGE
from tidewall.operators.scripts import UNPARSABLE, Scripts, script_id
from tidewall.scratch import small, written

RESULTS = ("verdict", "policy", "reason", "depth", "origin")


def classify(df: DataFrame, command: str = "command", policy: Policy = Policy(), only: set[int] | None = None) -> DataFrame:  # noqa: B008
    """df with verdict, policy, reason, depth, origin. Blank and null commands are allowed.

    Distinct commands are judged, and only denials are joined back: by a broadcast while they were counted and are few. df itself is
    read twice and otherwise only passed through. On streams it is called for each micro-batch (streaming/flows.py).
    """
    if df.isStreaming:
        raise ValueError("judge a stream by micro-batches: flows.judge_commands")
    kept = [c for c in df.columns if c not in RESULTS]
    used = F.when(F.trim(F.col(command)) != "", F.col(command))
    denials = small(written(Scripts(df.select(used.alias("text")), policy).denials(only)))
    judged = df.select(*kept, script_id(used).alias("_script")).join(denials, F.col("_script") == F.col("root"), "left")
    d = F.col("denial")
    return judged.select(*kept, F.when(d.isNull(), "allow").otherwise("deny").alias("verdict"), *[d[c].alias(c) for c in RESULTS[1:]])


def explain(df: DataFrame, dialect: str = "shell", code: str = "code", policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """Verdicts of inline code in a dialect, with the JSON line and the exit code that a command line would give."""
    from tidewall.functions.text import classifier_input

    out = classify(df.withColumn("command", classifier_input(F.lit(dialect), F.col(code))), policy=policy)
    line = F.to_json(F.struct("verdict", "reason"))
    blank = F.coalesce(F.trim(F.col(code)) == "", F.lit(True))
    return out.withColumn("json", line).withColumn("exit", F.when(blank, 1).when(F.col("verdict") == "deny", 2).otherwise(0))


def script_rows(df: DataFrame, key: str, command: str = "command", policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """key, place, depth, origin, malformed, stages: one row for each pipeline that a command reaches, the queryable form of parsed commands.

    place sorts like the order in which pipelines are judged. A row of df whose command reaches none has nulls. The column of df is named `key`.
    """
    found = Scripts(df.select(F.col(command).alias("text")), policy)
    at = found.places().join(found.scripts.drop("first"), "sid", "left")
    bad = F.coalesce("reason", F.when(~F.col("readable") & (F.col("origin") != "stdin"), UNPARSABLE))
    none = F.array().cast(f"array<array<{STAGE}>>")
    at = at.select("root", F.col("key").alias("place"), "depth", "origin", bad.alias("malformed"), F.when(bad.isNull(), F.coalesce("pipelines", none)).otherwise(F.array(F.array().cast(f"array<{STAGE}>"))).alias("pipelines"))
    rows = at.select("root", "place", "depth", "origin", "malformed", F.posexplode("pipelines").alias("p", "stages"))
    rows = rows.withColumn("place", F.when(F.col("malformed").isNull(), F.concat("place", F.array(F.lit(0), "p"))).otherwise(F.col("place"))).drop("p")
    return df.select(F.col(key), script_id(F.col(command)).alias("root")).join(rows, "root", "left").drop("root")

