"""Reports by event time that keep state: sessions, repeats within a delay, and denials near advisories of one stream pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(rows: DataFrame, ids: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Rows whose ids were not seen within the delay, as senders may send again. On tables: one row of each."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(ids) if rows.isStreaming else rows.dropDuplicates(ids)


def sessions(verdicts: DataFrame, user: str, ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user, start, end, n, denials, policies: a user's events with no gap between them. A session is final when the watermark has passed its end."""
    rows = verdicts.withWatermark(ts, late) if verdicts.isStreaming else verdicts
    denied = F.col("verdict") == "deny"
    out = rows.groupBy(F.col(user).alias("user"), F.session_window(ts, gap).alias("w")).agg(
        F.count("*").alias("n"), F.count_if(denied).alias("denials"), F.sort_array(F.collect_set(F.when(denied, F.col("policy")))).alias("policies")
    )
    return out.select("user", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "denials", "policies")


def denials_after_advisories(verdicts: DataFrame, advisories: DataFrame, session: str = "session", within: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """session, advised_at, denied_at, event, policy: denials of a session that follow an advisory on it by at most `within`.

    verdicts: session, ts, verdict, policy; advisories: session, ts, event. An interval join, so that on two streams each side's state goes
    when the other's watermark has passed it. Null sessions meet nothing.
    """
    v = verdicts.where("verdict = 'deny'").select(F.col(session).alias("v_session"), F.col("ts").alias("denied_at"), "policy")
    a = advisories.select(F.col(session).alias("session"), F.col("ts").alias("advised_at"), "event")
    if v.isStreaming:
        v, a = v.withWatermark("denied_at", late), a.withWatermark("advised_at", late)
    near = (F.col("session") == F.col("v_session")) & (F.col("denied_at") >= F.col("advised_at")) & (F.col("denied_at") <= F.col("advised_at") + F.expr(f"interval {within}"))
    return a.join(v, near).select("session", "advised_at", "denied_at", "event", "policy")
