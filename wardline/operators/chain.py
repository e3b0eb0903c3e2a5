"""The policy chain over messages and over tool calls.

Each policy sees the text as the policies before it rewrote it; the first that blocks ends the chain; what the
ones before it did (tokens spent, costs added, records written) stays.  Verdicts of stateless policies are pure
functions of a row, so they are columns; without rates and budgets the rest is window functions, and with them one
fold that walks the policies in order for each session's rows by (seq, direction), taking those verdicts where they
stand.  An output takes part only if its session's input before it was admitted.

The chain fails closed: a text that is null, a verdict or a token count that can't be given, and a row that is
neither input nor output are blocked, and a policy that a chain can't apply is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import decoding, injection, metering, pii
from ..functions.custom import checked
from ..plans.policies import CANARY_CODE, CODES, ERROR_CODE, ML_CODE, Approval, Audit, CostLimit, Custom, PersonalData, Policy, PromptRules, RateLimit, ToolRules
from ..shared import written
from . import gates, tokens, tools
from .ordered import GLOBAL, bucket_step, fold

COLUMNS = ("session_id", "seq", "direction", "text")


def _session(messages: DataFrame) -> Column:
    """The session's id; a row without one is a session of its own, named by a hash of the row, the same in every run."""
    return F.coalesce(F.col("session_id").cast("string"), F.concat(F.lit("row-"), F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in messages.columns])), 256)))


def prepared(messages: DataFrame, policies: list[Policy]) -> DataFrame:
    """``messages`` with each policy's stateless part: ``_code<i>``, ``_reason<i>``, ``_cost<i>``, and the final text."""
    df = messages.withColumns({"session_id": _session(messages), "_is_input": F.col("direction") == "input", "final_text": F.col("text"), "pii_detected": F.lit(False)})
    text, first = F.col("final_text"), F.col("_is_input")
    nothing = F.lit(None).cast("string")
    for i, p in enumerate(policies):
        code, reason = nothing, nothing
        if isinstance(p, PromptRules):
            df = df.withColumn("_scan", F.when(first, decoding.scan_text(text)))
            df = df.withColumn("_rule", injection.first_rule(F.col("_scan"), p.custom))
            rule = F.col("_rule")
            code, reason = F.when(rule.isNotNull(), CODES[PromptRules]), injection.rule_reason(rule, p.custom)
            if p.scorer is not None:
                score = p.scorer(text)
                high = F.coalesce(score >= p.sensitivity, F.lit(p.fail_closed))
                code = F.coalesce(code, F.when(first & high, ML_CODE))
            if p.use_canary:
                leak = ~first & injection.leaks(text, injection.canary(F.col("session_id"), p.canary_salt, p.canary_prefix))
                code = F.when(leak, CANARY_CODE).otherwise(code)
        elif isinstance(p, PersonalData):
            if p.engine is not None or p.mode == "tokenize":
                # Found once, for the new text and for the tokens.
                own = pii.found(text, p.entities) if p.engine is None else pii.separate(pii.engine_hits(text, p.engine, p.entities, p.threshold))
                df = df.withColumn("_hits", F.when(first, own))
                if p.mode == "tokenize":
                    df = _restored(df, p)
                changed = F.nullif(pii.rewrite(text, F.col("_hits"), p.mode, F.col("session_id"), p.prefix), text)
            else:
                changed = pii.transform(text, p.mode, p.entities, p.overlap, F.col("session_id"), p.prefix)
            df = df.withColumn("_new", F.when(first, changed))
            df = df.withColumns({"final_text": F.coalesce("_new", "final_text"), "pii_detected": F.col("pii_detected") | F.col("_new").isNotNull()})
        elif isinstance(p, CostLimit):
            rates = metering.rate_literal(p.model, {m: (a, b) for m, a, b in p.prices})
            count = metering.scaled_tokens((p.counter or metering.estimated_tokens)(text), F.lit(p.model))
            df = df.withColumn(f"_cost{i}", metering.cost(count, F.when(first, rates[0]).otherwise(rates[1])))
        elif isinstance(p, Custom):
            here = F.lit(False)
            for d in p.on:
                here = here | (F.col("direction") == d)
            if p.block is not None:
                reason = F.when(here, p.block(text))
                code = F.when(reason.isNotNull(), p.code)
            if p.check is not None:
                df = df.withColumn("_said", F.when(here, checked(p.check)(text)))
                reason = F.coalesce(reason, F.col("_said.reason"))
                code = F.when(F.col("_said.failed"), ERROR_CODE).otherwise(F.coalesce(code, F.when(reason.isNotNull(), p.code)))
            if code is not nothing:
                df = df.withColumns({f"_code{i}": code, f"_reason{i}": reason})
            if p.rewrite is not None:
                df = df.withColumn("final_text", F.when(here, F.coalesce(p.rewrite(text), text)).otherwise(text))
        elif not isinstance(p, (Audit, RateLimit)):
            raise ValueError(f"a chain over messages can't apply {type(p).__name__}: {'use run_tool_chain' if 'tool' in p.directions else 'it is no policy that it knows'}")
        if isinstance(p, PromptRules):
            df = df.withColumns({f"_code{i}": code, f"_reason{i}": reason})
    return df.drop("_scan", "_rule", "_new", "_said", "_hits")


def _restored(df: DataFrame, p: PersonalData) -> DataFrame:
    """``df`` with the tokens of its session's inputs (whose hits are ``_hits``) put back into the texts of its outputs."""
    # Not a filter on the hits: a filter moves below the columns it is over, and would have them made twice.
    made = df.select("session_id", F.explode_outer(pii.tokens(F.col("final_text"), F.col("session_id"), F.col("_hits"), p.prefix)).alias("t")).where("t is not null").select("session_id", "t.token", "t.original")
    outputs = df.where("not coalesce(_is_input, false)")
    back = tokens.restore(outputs, made, row=["session_id", "seq"], text="final_text", prefix=p.prefix, name="_back")
    return df.where("_is_input").unionByName(back.withColumn("final_text", F.col("_back")).select(df.columns))


def run_chain(messages: DataFrame, policies: list[Policy], *, inputs_only: bool = False) -> DataFrame:
    """``messages`` (session_id, seq, direction, text, ts, ...) with the chain's verdict.

    Adds final_text, pii_detected, allowed (null for an output whose input was not admitted), blocked_by (the
    policy's place from 1, and its kind), reason_code, reason, cost_usd (the session's, after the row),
    request_count (inputs fully admitted so far), warnings, and reached (the places of audits that saw the row).
    A null session is a session of its own row; rows go by (seq, input before output).

    A null text is blocked by the first policy that takes part in its direction, and a text whose tokens can't be
    counted by the budget, with the error's code; a row of another direction by none (``0:direction``).  Tool rules and
    gates are refused: they are run_tool_chain's.  ``inputs_only`` says that there are no outputs, and spares finding
    out which of them have an admitted input.
    """
    if any(isinstance(p, Approval) for p in policies):
        raise ValueError("gates are resolved against decisions: use run_tool_chain, or operators.gates on the chain's result")
    df = prepared(messages, policies).withColumn("_after", (~F.coalesce("_is_input", F.lit(False))).cast("int"))
    codes = [i for i in range(len(policies)) if f"_code{i}" in df.columns]
    # What blocks before any policy is asked.
    odd = F.when(~F.coalesce(F.col("direction").isin("input", "output"), F.lit(False)), F.lit(0))
    for direction in ("input", "output"):
        taking = [i for i, p in enumerate(policies, 1) if direction in p.directions]
        if taking:
            odd = odd.when(F.col("text").isNull() & (F.col("direction") == direction), F.lit(taking[0]))
    df = df.withColumn("_odd", odd)
    if any(isinstance(p, (RateLimit, CostLimit)) for p in policies):
        out = _folded(df, policies, codes)
    else:
        out = _windowed(df, policies, codes, inputs_only)
    reason = F.lit(None).cast("string")
    for i in codes:
        reason = F.when(F.col("blocked_by").startswith(f"{i + 1}:"), F.col(f"_reason{i}")).otherwise(reason)
    reason = F.when(F.col("reason_code") != ERROR_CODE, reason)
    return out.withColumn("reason", reason).drop("_scope", "_after", "_us", "_is_input", "_odd", *[f"_{k}{i}" for k in ("code", "reason", "cost") for i in range(len(policies))])


def _name(policies: list[Policy], i: int) -> str:
    """How blocked_by names the policy at place i from 1; 0 is none."""
    return f"{i}:{type(policies[i - 1]).__name__ if i else 'direction'}"


def _windowed(df: DataFrame, policies: list[Policy], codes: list[int], inputs_only: bool) -> DataFrame:
    """The verdicts of a chain without rates and budgets, in columns."""
    text = F.lit(None).cast("string")
    by = F.when(F.col("_odd").isNotNull(), F.element_at(F.array(*[F.lit(_name(policies, i)) for i in range(len(policies) + 1)]), F.col("_odd") + 1))
    code = F.when(F.col("_odd").isNotNull(), ERROR_CODE)
    place = F.col("_odd")
    for i in codes:
        hit = F.col(f"_code{i}").isNotNull()
        by, code, place = F.coalesce(by, F.when(hit, _name(policies, i + 1))), F.coalesce(code, F.col(f"_code{i}")), F.coalesce(place, F.when(hit, F.lit(i + 1)))
    df = df.withColumns({"blocked_by": by, "reason_code": code, "_place": place})
    seen = [F.when(F.col("direction").isin(*p.directions) & (F.col("_place").isNull() | (F.col("_place") > i)), F.lit(str(i))) for i, p in enumerate(policies, 1) if isinstance(p, Audit)]
    df = df.withColumn("reached", F.nullif(F.concat_ws(",", *seen), F.lit("")) if seen else text)
    upto = Window.partitionBy("session_id").orderBy("seq", "_after").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    free = F.col("_place").isNull()
    if inputs_only:
        taking = F.lit(True)
    else:
        # An output follows the verdict of the input before it; without one it takes part.
        df = df.withColumn("_open", F.coalesce(F.last(F.when(F.col("_is_input"), free), ignorenulls=True).over(upto), F.lit(True)))
        taking = F.coalesce(F.col("_is_input"), F.lit(False)) | F.col("_open")
    counts = {"cost_usd": F.lit(0.0), "request_count": F.sum((F.coalesce(F.col("_is_input"), F.lit(False)) & free).cast("bigint")).over(upto), "warnings": text, "allowed": F.when(taking, free)}
    return df.withColumns(counts | {c: F.when(taking, F.col(c)) for c in ("blocked_by", "reason_code", "reached")}).drop("_place", "_open")


def _folded(df: DataFrame, policies: list[Policy], codes: list[int]) -> DataFrame:
    """The verdicts of a chain with rates or budgets: one state a session, or one for all sessions where a scope is global."""
    all_sessions = any(getattr(p, "per", "session") == "global" for p in policies)
    rated = any(isinstance(p, RateLimit) for p in policies)
    df = df.withColumns({"_us": F.unix_micros(F.col("ts").cast("timestamp")) if rated else F.lit(0).cast("bigint"), "_scope": F.lit(GLOBAL) if all_sessions else F.col("session_id")})
    costs = [i for i, p in enumerate(policies) if isinstance(p, CostLimit)]
    inputs = ["session_id", "_is_input", "_us", "_odd", *[f"_code{i}" for i in codes], *[f"_cost{i}" for i in costs]]
    names = [_name(policies, i) for i in range(len(policies) + 1)]
    takes = {i: bucket_step(p.per_minute / 60.0, float(p.burst)) for i, p in enumerate(policies) if isinstance(p, RateLimit)}
    # What the executors need to know of each policy: its functions of columns stay here.
    plain = [(type(p), p.directions, getattr(p, "per", "session") == "global", getattr(p, "max_usd", 0.0), getattr(p, "mode", "") == "block") for p in policies]

    def step(state, session, first, at, odd, *values):
        code_of = dict(zip(codes, values))
        cost_of = dict(zip(costs, values[len(codes) :]))
        own = state.setdefault(session, {"cost": 0.0, "count": 0, "open": True, "buckets": {}})
        if not first and not own["open"]:
            return state, (None, None, None, own["cost"], own["count"], None, None)
        verdict = code = None
        warnings, reached = [], []
        for i, (kind, directions, shared, most, blocks) in enumerate(plain):
            if odd is not None and odd in (0, i + 1):
                verdict, code = names[odd], ERROR_CODE
                break
            if ("input" if first else "output") not in directions:
                continue
            if kind is Audit:
                reached.append(str(i + 1))
            elif i in code_of and code_of[i] is not None:
                verdict, code = names[i + 1], code_of[i]
            elif kind is RateLimit:
                if at is None:
                    verdict, code = names[i + 1], ERROR_CODE
                    break
                holder = state.setdefault(GLOBAL, {"buckets": {}}) if shared else own
                holder["buckets"][i], allowed = takes[i](holder["buckets"].get(i), at)
                if not allowed:
                    verdict, code = names[i + 1], CODES[RateLimit]
            elif kind is CostLimit:
                # Both totals always grow; the scope decides which is compared.
                total = state.setdefault(GLOBAL, {"buckets": {}})
                spent = total.get(i, 0.0) if shared else own["cost"]
                amount = cost_of[i]
                if amount is None:
                    verdict, code = names[i + 1], ERROR_CODE
                    break
                if first and spent + amount > most:
                    if blocks:
                        verdict, code = names[i + 1], CODES[CostLimit]
                        break
                    warnings.append(f"cost limit: {i + 1}")
                own["cost"] += amount
                total[i] = total.get(i, 0.0) + amount
            if verdict:
                break
        if first:
            own["open"] = verdict is None
            own["count"] += verdict is None
        return state, (verdict is None, verdict, code, own["cost"], own["count"], ";".join(warnings) or None, ",".join(reached) or None)

    outputs = T.StructType([T.StructField("allowed", T.BooleanType()), T.StructField("blocked_by", T.StringType()), T.StructField("reason_code", T.StringType()), T.StructField("cost_usd", T.DoubleType()), T.StructField("request_count", T.LongType()), T.StructField("warnings", T.StringType()), T.StructField("reached", T.StringType())])
    return fold(df, ["_scope"], ["seq", "_after", "session_id"] if all_sessions else ["seq", "_after"], inputs, outputs, dict, step)


def run_batch(messages: DataFrame, policies: list[Policy], agent) -> DataFrame:
    """Inputs through the chain, admitted ones to ``agent`` (a column function of the final text), its answers through the chain's output side.

    Returns the inputs with the chain's columns and of the answer: ``answer`` (as the output policies rewrote it; null if
    either side blocked), ``answer_allowed``, ``answer_code``, ``answer_blocked_by``, ``answer_reached`` and ``cost_after``
    (the session's, after the answer).  Answers are outputs of their sessions like any others: they are scanned, metered,
    audited and have their tokens restored, and what they cost counts for the inputs after them.  (session_id, seq) tells
    the inputs apart.  The agent is not asked about an input that a verdict by itself blocks; one that a rate or a budget
    blocks has its answer thrown away unseen.
    """
    inputs = messages.where("direction = 'input'")
    inputs = inputs.withColumn("session_id", _session(inputs))
    ready = prepared(inputs, policies)
    free = F.col("text").isNotNull()
    for c in ready.columns:
        if c.startswith("_code"):
            free = free & F.col(c).isNull()
    # Written before it is filtered: a filter moves below the columns it is over, with all that they are made of.
    ready = written(ready.select(*inputs.columns, "final_text", free.alias("_free")), "ready").where("_free")
    answers = ready.withColumns({"text": agent(F.col("final_text")).cast("string"), "direction": F.lit("output")}).select(inputs.columns)
    # Both are written: the agent answers once, and the chain runs once for its two sides.
    out = written(run_chain(inputs.unionByName(written(answers, "answers")), policies), "chain")
    said = out.where("direction = 'output'").select(F.col("session_id").alias("_session"), F.col("seq").alias("_seq"), F.when(F.col("allowed"), F.col("final_text")).alias("answer"), F.col("allowed").alias("answer_allowed"), F.col("reason_code").alias("answer_code"), F.col("blocked_by").alias("answer_blocked_by"), F.col("reached").alias("answer_reached"), F.col("cost_usd").alias("cost_after"))
    first = out.where("direction = 'input'")
    return first.join(said, (F.col("session_id") == F.col("_session")) & (F.col("seq") == F.col("_seq")), "left").drop("_session", "_seq")


def run_tool_chain(calls: DataFrame, policies: list[Policy], *, decisions: DataFrame | None = None, parts: tuple[str, ...] = ("session_id", "seq"), tool: str = "tool_name", params: str = "params", ts: str = "ts") -> DataFrame:
    """``calls`` with the chain's verdict over tool calls: each policy that takes part in them, in order, until one blocks.

    Adds allowed, blocked_by, reason_code, reason, warnings, reached, gate_id, gate_trigger and gate_outcome.  Tool rules
    check names and parameters; a gate needs ``decisions`` (ts, approved, and the call's ``parts`` or its gate_id, which
    several calls may share), and names its requests by the columns ``parts``, which tell the calls apart; an audit
    records that the call reached it; a custom policy gets the parameters' JSON and can't rewrite it.  Rates, budgets, prompt rules and personal data have no part in tool calls.  A call without a name is blocked
    by the first policy that takes part, with the error's code.
    """
    text = F.lit(None).cast("string")
    df = calls.withColumns({"allowed": F.lit(True)} | {c: text for c in ("blocked_by", "reason_code", "reason", "warnings", "reached", "gate_id", "gate_trigger", "gate_outcome")})
    taking = [(i, p) for i, p in enumerate(policies, 1) if "tool" in p.directions]
    if taking:
        unnamed = F.col(tool).isNull()
        df = df.withColumns({"allowed": ~unnamed, "blocked_by": F.when(unnamed, _name(policies, taking[0][0])), "reason_code": F.when(unnamed, ERROR_CODE)})
    for i, p in taking:
        here, by = F.col("allowed"), F.lit(_name(policies, i))
        if isinstance(p, ToolRules):
            code, reason, warning = tools.verdict(F.col(tool), F.col(params), p)
        elif isinstance(p, Audit):
            df = df.withColumn("reached", F.when(here, F.concat_ws(",", "reached", F.lit(str(i)))).otherwise(F.col("reached")))
            continue
        elif isinstance(p, Custom):
            reason = p.block(F.col(params)) if p.block is not None else text
            code, warning = F.when(reason.isNotNull(), p.code), text
            if p.check is not None:
                df = df.withColumn("_said", F.when(here, checked(p.check)(F.col(params))))
                reason = F.coalesce(reason, F.col("_said.reason"))
                code = F.when(F.col("_said.failed"), ERROR_CODE).otherwise(F.when(reason.isNotNull(), p.code))
        elif isinstance(p, Approval):
            if decisions is None:
                raise ValueError("a gate needs decisions")
            before = df
            df = gates.gated(df.drop("gate_id", "gate_trigger", "gate_outcome"), p, decisions, parts=list(parts), ts=ts, tool=tool).select(before.columns)
            df = df.withColumn("blocked_by", F.when(~F.col("allowed") & F.col("blocked_by").isNull(), by).otherwise(F.col("blocked_by")))
            continue
        else:
            raise ValueError(f"a chain over tool calls can't apply {type(p).__name__}")
        df = df.withColumns({"_code": F.when(here, code), "_reason": F.when(here, reason), "_warning": F.when(here, warning)})
        blocked = F.col("_code").isNotNull()
        df = df.withColumns({"allowed": here & ~blocked, "blocked_by": F.when(blocked, by).otherwise(F.col("blocked_by")), "reason_code": F.coalesce("_code", "reason_code"), "reason": F.when(blocked, F.col("_reason")).otherwise(F.col("reason")), "warnings": F.nullif(F.concat_ws(";", "warnings", "_warning"), F.lit(""))}).drop("_code", "_reason", "_warning", "_said")
    return df.withColumn("reached", F.nullif(F.col("reached"), F.lit("")))
