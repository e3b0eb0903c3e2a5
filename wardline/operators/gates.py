"""Approval gates: requests joined to the decisions that came in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import any_glob
from ..plans.policies import CODES, Approval


def triggered(triggers: list[str] | tuple[str, ...], *, tool: Column | None = None, spent: Column | None = None, pii: Column | None = None) -> Column:
    """The first trigger that fires, or null.

    Globs are asked of tool calls only (rows with a tool); what was spent, and personal data, of inputs only (rows
    without one).  A trigger that can't be read, or lacks its column, never fires.
    """
    out, an_input = [], F.lit(True) if tool is None else tool.isNull()
    for trigger in triggers:
        kind, _, value = trigger.partition(":")
        if kind == "tool_call" and tool is not None:
            out.append(F.when(any_glob(tool, [value]), F.lit(trigger)))
        elif kind == "cost_exceeds" and spent is not None:
            try:
                out.append(F.when(an_input & (spent > float(value)), F.lit(trigger)))
            except ValueError:
                continue
        elif kind == "pii_detected" and pii is not None:
            out.append(F.when(an_input & pii, F.lit(trigger)))
    return F.coalesce(*out) if out else F.lit(None).cast("string")


def gate_id(*parts: Column) -> Column:
    """A request's id: eight hex digits of its parts' hash, the same in every run."""
    return F.concat(F.lit("gate-"), F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 8))


def resolve(requests: DataFrame, decisions: DataFrame, *, timeout_seconds: float, on_timeout: str = "deny", key: str = "gate_id", ts: str = "ts") -> DataFrame:
    """``requests`` (unique gates) with ``outcome`` (approved, denied, timeout), ``decided_at`` and ``allowed``.

    The earliest decision at or after the request and within the timeout counts; at one moment a denial goes
    before an approval.  Decisions come as (key, ts, approved).  The join is on the key, the interval a condition
    of it; the decision is chosen by an aggregate, so a gate with many decisions costs one row a task.
    """
    d = decisions.select(F.col(key).alias("_gate"), F.col(ts).cast("timestamp").alias("_at"), F.col("approved").alias("_ok"))
    r = requests.withColumn("_from", F.col(ts).cast("timestamp"))
    near = r.join(d, (r[key] == d["_gate"]) & (d["_at"] >= r["_from"]) & (d["_at"] <= r["_from"] + F.make_dt_interval(secs=F.lit(float(timeout_seconds)))))
    first = near.groupBy(F.col(key).alias("_gate"), F.col("_from").alias("_start")).agg(F.min(F.struct("_at", "_ok")).alias("_first"))
    joined = r.join(first, (r[key] == first["_gate"]) & (r["_from"] == first["_start"]), "left")
    outcome = F.when(F.col("_first").isNull(), F.lit("timeout")).when(F.col("_first._ok"), F.lit("approved")).otherwise(F.lit("denied"))
    return joined.select(*[r[c] for c in requests.columns], outcome.alias("outcome"), F.col("_first._at").alias("decided_at"), F.when(F.col("_first").isNull(), F.lit(on_timeout == "allow")).otherwise(F.col("_first._ok")).alias("allowed"))


def gated(df: DataFrame, policy: Approval, decisions: DataFrame, *, parts: list[str], ts: str = "ts", tool: str | None = None, spent: str | None = None, pii: str | None = None) -> DataFrame:
    """``df`` (with ``allowed`` and ``reason_code`` from the policies before) with an approval policy applied after them.

    Rows still allowed that fire a trigger become requests, named by a hash of the columns ``parts`` (unique rows),
    and are allowed if approved in time.  Adds gate_id, gate_trigger and gate_outcome, null for rows without a gate.

    Decisions with the columns ``parts`` are those of the calls so named, whatever their ids.  Others come by gate_id, which
    some 230 of a million calls share with another: an approval whose id several requests have doesn't say which is
    meant, and counts as a denial.
    """
    column = lambda name: None if name is None else F.col(name)
    fired = triggered(policy.triggers, tool=column(tool), spent=column(spent), pii=column(pii))
    marked = df.withColumn("gate_trigger", F.when(F.col("allowed"), fired))
    text = F.lit(None).cast("string")
    free = marked.where("gate_trigger is null").withColumns({"gate_id": text, "gate_outcome": text})
    # As a struct, in which nulls are equal: a part that is null names its call too.
    call = F.struct(*[F.col(p) for p in parts])
    asked = marked.where("gate_trigger is not null").withColumns({"gate_id": gate_id(*[F.col(p) for p in parts]), "_call": call})
    if set(parts) <= set(decisions.columns):
        key, decisions = "_call", decisions.withColumn("_call", call)
    else:
        key, decisions = "gate_id", _of_one_request(decisions, asked)
    answered = resolve(asked.drop("allowed"), decisions, timeout_seconds=policy.timeout_seconds, on_timeout=policy.on_timeout, key=key, ts=ts)
    code = F.when(F.col("allowed"), F.col("reason_code")).otherwise(F.lit(CODES[Approval]))
    answered = answered.withColumn("reason_code", code).withColumnRenamed("outcome", "gate_outcome").drop("decided_at")
    return free.unionByName(answered.select(free.columns))


def _of_one_request(decisions: DataFrame, asked: DataFrame) -> DataFrame:
    """``decisions`` with the approvals of ids that several calls of ``asked`` share turned into denials."""
    shared = asked.groupBy(F.col("gate_id").alias("_shared")).agg((F.min("_call") != F.max("_call")).alias("_several")).where("_several").select("_shared")
    marked = decisions.join(shared, F.col("gate_id") == F.col("_shared"), "left")
    return marked.withColumn("approved", F.col("approved") & F.col("_shared").isNull()).drop("_shared")
