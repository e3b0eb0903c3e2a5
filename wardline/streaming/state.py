"""Keyed recurrences as streaming state: token buckets, budgets and approval gates.

State is a value a key, kept by Spark and checkpointed; it goes when it can no longer matter.  Within a batch a
key's rows are taken in event order; rows of a later batch come after those of an earlier one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ordered import GLOBAL, bucket_step


def _frames(frames: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(by, kind="stable")


def rate_limit(events: DataFrame, key: str, ts: str, row_id: str, *, per_minute: float, burst: int = 1, per: str = "session") -> DataFrame:
    """(key, row_id, allowed) for each event of a stream.

    A bucket idle for as long as it takes to fill is dropped: a new one is full too.
    """
    if per_minute <= 0:
        raise ValueError("per_minute must be positive")
    full = float(max(1, burst))
    take = bucket_step(per_minute / 60.0, full)
    idle_ms = int(full / (per_minute / 60.0) * 1000) + 1

    def run(_, frames: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = _frames(frames, ["us", "row_id"])
        bucket = state.get if state.exists else None
        allowed = []
        for at in rows["us"]:
            bucket, ok = take(bucket, int(at))
            allowed.append(ok)
        state.update(bucket)
        state.setTimeoutTimestamp(max(int(bucket[1] // 1000) + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": rows["key"], "row_id": rows["row_id"], "allowed": allowed})

    scope = F.col(key).cast("string") if per == "session" else F.lit(GLOBAL)
    rows = events.select(scope.alias("scope"), F.col(key).cast("string").alias("key"), F.col(row_id).cast("bigint").alias("row_id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(ts).cast("timestamp").alias("at")).withWatermark("at", "0 seconds")
    return rows.groupBy("scope").applyInPandasWithState(run, "key string, row_id bigint, allowed boolean", "tokens double, last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def budget(messages: DataFrame, key: str, row_id: str, *, cost: str = "cost", is_input: str = "is_input", max_usd: float, per: str = "session") -> DataFrame:
    """(key, row_id, admitted, spent) for each message of a stream, in ``row_id`` order within a batch."""

    def run(_, frames: Iterator[pd.DataFrame], state: GroupState):
        rows = _frames(frames, ["row_id"])
        spent, open_ = state.get if state.exists else (0.0, True)
        admitted, after = [], []
        for amount, first in zip(rows["cost"], rows["is_input"]):
            if first:
                open_ = bool(spent + amount <= max_usd)
            if open_:
                spent = float(spent + amount)
            admitted.append(open_)
            after.append(spent)
        state.update((spent, open_))
        yield pd.DataFrame({"key": rows["key"], "row_id": rows["row_id"], "admitted": admitted, "spent": after})

    scope = F.col(key).cast("string") if per == "session" else F.lit(GLOBAL)
    rows = messages.select(scope.alias("scope"), F.col(key).cast("string").alias("key"), F.col(row_id).cast("bigint").alias("row_id"), F.col(cost).cast("double").alias("cost"), F.col(is_input).alias("is_input"))
    return rows.groupBy("scope").applyInPandasWithState(run, "key string, row_id bigint, admitted boolean, spent double", "spent double, open boolean", "append", GroupStateTimeout.NoTimeout)


def gates(requests: DataFrame, decisions: DataFrame, *, timeout_seconds: float, on_timeout: str = "deny", delay: str = "0 seconds") -> DataFrame:
    """(gate_id, allowed, outcome): a stream-stream join of requests (gate_id, ts) and decisions (gate_id, ts, approved).

    Both sides carry watermarks, so a request without a decision times out when both have passed its interval.
    A gate with several decisions in time has a row for each; the earliest stands first in event time.
    """
    r = requests.select("gate_id", F.col("ts").cast("timestamp").alias("asked_at")).withWatermark("asked_at", delay)
    d = decisions.select(F.col("gate_id").alias("_gate"), F.col("ts").cast("timestamp").alias("decided_at"), "approved").withWatermark("decided_at", delay)
    near = F.expr(f"gate_id = _gate AND decided_at >= asked_at AND decided_at <= asked_at + interval {float(timeout_seconds)} seconds")
    joined = r.join(d, near, "leftOuter")
    outcome = F.when(F.col("approved").isNull(), "timeout").when(F.col("approved"), "approved").otherwise("denied")
    return joined.select("gate_id", F.coalesce("approved", F.lit(on_timeout == "allow")).alias("allowed"), outcome.alias("outcome"), "decided_at")
