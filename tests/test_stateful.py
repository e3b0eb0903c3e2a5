import random

import pytest
from pyspark.sql import functions as F

from wardline.functions import metering
from wardline.operators import chain, ordered
from wardline.plans.policies import Audit, CostLimit, Custom, PersonalData, PromptRules, RateLimit


def limited(spark, rows, **options):
    df = spark.createDataFrame(rows, "session_id string, seq int, second double").withColumn("ts", F.timestamp_micros((F.col("second") * 1000000).cast("bigint")))
    out = ordered.rate_limit(df, "session_id", "ts", ["seq"], **options).collect()
    return [r["allowed"] for r in sorted(out, key=lambda r: r["seq"])]


def test_rate_limit_cases(spark):
    assert limited(spark, [("a", 1, 0.0)], per_minute=10) == [True]
    assert limited(spark, [("a", i, 0.0) for i in range(4)], per_minute=60, burst=3) == [True, True, True, False]
    assert limited(spark, [("a", 1, 0.0), ("b", 2, 0.0)], per_minute=1) == [True, True]
    assert limited(spark, [("a", 1, 0.0), ("b", 2, 0.0)], per_minute=1, per="global") == [True, False]
    assert limited(spark, [("a", 1, 0.0), ("a", 2, 59.0), ("a", 3, 60.5)], per_minute=1) == [True, False, True]
    with pytest.raises(ValueError):
        RateLimit(per_minute=0)


def plain_budget(rows, limit):
    spent, open_, out = 0.0, True, []
    for cost, first in rows:
        if first:
            open_ = spent + cost <= limit
        if open_:
            spent += cost
        out.append((open_, spent))
    return out


def test_budget_against_a_loop(spark):
    r = random.Random(3)
    rows = [(f"s{k}", i, r.choice([0.1, 0.5, 2.0]), i % 2 == 0) for k in range(5) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, i int, cost double, is_input boolean")
    got = {}
    for x in ordered.budget(df, "k", ["i"], max_usd=6.0).collect():
        got.setdefault(x["k"], []).append((x["i"], x["admitted"], x["spent"]))
    for k in got:
        want = plain_budget([(c, f) for s, _, c, f in rows if s == k], 6.0)
        assert [(a, s) for _, a, s in sorted(got[k])] == want


def test_equality_passes_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1, 1.0, True), ("a", 2, 1.0, True)], "k string, i int, cost double, is_input boolean")
    assert [r["admitted"] for r in ordered.budget(df, "k", ["i"], max_usd=2.0).orderBy("i").collect()] == [True, True]
    assert ordered.budget(df.limit(0), "k", ["i"], max_usd=2.0).collect() == []


def test_running_global_is_a_prefix_sum(spark):
    df = spark.range(1, 501).select("id", F.col("id").cast("double").alias("v"))
    rows = ordered.running_global(df, "v", "id", "s", parts=7).orderBy("id").collect()
    assert [r["s"] for r in rows] == [float(n * (n + 1) // 2) for n in range(1, 501)]


def test_prices(spark):
    df = spark.createDataFrame([("gpt-4o", "input"), ("nope", "output"), ("mine", "input")], "model string, direction string")
    rows = {r["model"]: r["rate"] for r in metering.with_rate(df, metering.price_table(spark, {"mine": (100.0, 100.0)})).collect()}
    assert rows == {"gpt-4o": 2.5, "nope": 30.0, "mine": 100.0}
    n = spark.range(1).select(metering.scaled_tokens(F.lit(100), F.lit("gpt-4o")), metering.scaled_tokens(F.lit(3), F.lit("x"))).first()
    assert tuple(n) == (100, 3)


def conversation(spark, rows):
    return spark.createDataFrame(rows, "session_id string, seq bigint, direction string, text string, second double").withColumn("ts", F.timestamp_seconds("second"))


def plain_chain(rows, limit, per_minute, burst, rates):
    out, state = {}, {}
    for session, seq, direction, text, second in sorted(rows, key=lambda r: (r[0], r[1], r[2] == "output")):
        s = state.setdefault(session, {"tok": None, "cost": 0.0, "open": True, "n": 0})
        cost = -(-len(text) // 4) / 1e6 * rates[direction == "output"]
        if direction == "output":
            if not s["open"]:
                out[session, seq, direction] = None
                continue
            s["cost"] += cost
            out[session, seq, direction] = (True, None, s["cost"], s["n"])
            continue
        tok = burst if s["tok"] is None else min(burst, s["tok"][0] + (second - s["tok"][1]) * per_minute / 60)
        code = None
        if tok < 1:
            code = "RATE_LIMIT_EXCEEDED"
            s["tok"] = (tok, second)
        else:
            s["tok"] = (tok - 1, second)
            if "jailbreak" in text:
                code = "PROMPT_INJECTION_DETECTED"
            elif s["cost"] + cost > limit:
                code = "COST_LIMIT_EXCEEDED"
            else:
                s["cost"] += cost
        s["open"] = code is None
        s["n"] += code is None
        out[session, seq, direction] = (code is None, code, s["cost"], s["n"])
    return out


def test_fused_chain_against_a_loop(spark):
    r = random.Random(5)
    rows = []
    for k in range(12):
        at = 0.0
        for i in range(20):
            at += r.choice([1.0, 10.0, 40.0])
            rows.append((f"s{k}", i, "input", r.choice(["hello there friend", "jailbreak now", "x" * 400]), at))
            rows.append((f"s{k}", i, "output", "y" * r.choice([10, 300]), at))
    out = chain.run_chain(conversation(spark, rows), [RateLimit(per_minute=4.0, burst=2), PromptRules(), CostLimit(max_usd=0.003)]).collect()
    want = plain_chain(rows, 0.003, 4.0, 2.0, (2.5, 10.0))
    codes = set()
    for x in out:
        got = None if x["allowed"] is None else (x["allowed"], x["reason_code"], x["cost_usd"], x["request_count"])
        assert got == want[x["session_id"], x["seq"], x["direction"]]
        codes.add(x["reason_code"])
    assert codes == {None, "RATE_LIMIT_EXCEEDED", "PROMPT_INJECTION_DETECTED", "COST_LIMIT_EXCEEDED"} and len(out) == len(rows)


def test_order_rewriting_and_audit(spark):
    rows = [("a", 1, "input", "mail me at x@y.org", 0.0), ("b", 1, "input", "jailbreak x@y.org", 0.0), ("c", 1, "input", None, 0.0), (None, 1, "input", "hi", 0.0), (None, 2, "input", "hi", 0.0)]
    out = chain.run_chain(conversation(spark, rows), [Audit(), PersonalData(), PromptRules(), Audit()]).collect()
    by = {r["session_id"]: r for r in out if r["session_id"] in "abc"}
    assert (by["a"]["final_text"], by["a"]["allowed"], by["a"]["reached"], by["a"]["pii_detected"]) == ("mail me at [REDACTED_EMAIL]", True, "1,4", True)
    assert (by["b"]["allowed"], by["b"]["blocked_by"], by["b"]["reached"], by["b"]["reason"]) == (False, "3:PromptRules", "1", "Matched pattern: 'jailbreak'")
    assert (by["c"]["allowed"], by["c"]["reason_code"]) == (False, "SHIELD_ERROR")
    own = [r for r in out if r["session_id"] not in "abc"]
    assert len({r["session_id"] for r in own}) == 2 and all(r["request_count"] == 1 for r in own)


def test_custom_policies_and_warnings(spark):
    rows = [("a", 1, "input", "hello", 0.0), ("a", 2, "input", "stop", 0.0)]
    stop = Custom(name="stop", block=lambda t: F.when(t == "STOP", F.lit("told to")), code="INPUT_BLOCKED")
    shout = Custom(name="shout", rewrite=F.upper)
    out = sorted(chain.run_chain(conversation(spark, rows), [shout, stop, CostLimit(max_usd=0.0, mode="warn")]).collect(), key=lambda r: r["seq"])
    assert [(r["final_text"], r["allowed"], r["reason"], r["warnings"]) for r in out] == [("HELLO", True, None, "cost limit: 3"), ("STOP", False, "told to", None)]


def test_canary_blocks_an_output_and_agents_see_admitted_text(spark):
    from wardline.functions import injection

    rows = [("a", 1, "input", "hi", 0.0), ("b", 1, "input", "jailbreak", 0.0)]
    policies = [PromptRules(use_canary=True, canary_salt="s")]
    out = {r["session_id"]: r for r in chain.run_batch(conversation(spark, rows), policies, lambda t: F.concat(t, F.lit(" "), injection.canary(F.lit("a"), "s"))).collect()}
    assert out["a"]["answer_code"] == "CANARY_TRIGGERED" and out["b"]["answer"] is None


def test_a_chain_fails_closed(spark):
    from wardline.plans.policies import Approval, ToolRules

    rows = [("a", 1, "input", None, 0.0), ("a", 1, "output", "late", 0.0), ("b", 1, "tool", "x", 0.0), ("c", 1, "input", "fine", 0.0), ("c", 1, "output", None, 0.0)]
    for policies in ([CostLimit(max_usd=0.0)], [RateLimit(per_minute=60), CostLimit()], [Audit(), CostLimit()], [PersonalData(), Audit()], [PromptRules(use_canary=True), Audit()], [Custom(on=("input", "output"))]):
        got = {(r["session_id"], r["direction"]): r for r in chain.run_chain(conversation(spark, rows), policies).collect()}
        assert len(got) == 5
        assert (got["a", "input"]["allowed"], got["a", "input"]["reason_code"], got["a", "input"]["reached"]) == (False, "SHIELD_ERROR", None)
        assert got["a", "output"]["allowed"] is None and got["a", "input"]["request_count"] == 0
        assert (got["b", "tool"]["allowed"], got["b", "tool"]["blocked_by"]) == (False, "0:direction")
        if policies[0] != CostLimit(max_usd=0.0) and "output" in policies[-1].directions:
            assert (got["c", "input"]["allowed"], got["c", "output"]["allowed"], got["c", "output"]["reason_code"]) == (True, False, "SHIELD_ERROR")
    for refused in (ToolRules(blocked=("delete_*",)), Approval(("pii_detected",))):
        with pytest.raises(ValueError, match="run_tool_chain"):
            chain.run_chain(conversation(spark, rows), [PromptRules(), refused])


def test_checks_that_raise_block_their_row_alone(spark):
    def check(text):
        if "stop" in text:
            return "told to"
        return None if text.isascii() else 1 / 0

    rows = [("a", 1, "input", "fine", 0.0), ("b", 1, "input", "stop", 0.0), ("c", 1, "input", "é", 0.0)]
    for more in ([], [CostLimit()]):
        out = {r["session_id"]: (r["allowed"], r["reason_code"], r["reason"]) for r in chain.run_chain(conversation(spark, rows), [Custom(check=check), *more]).collect()}
        assert out == {"a": (True, None, None), "b": (False, "INPUT_BLOCKED", "told to"), "c": (False, "SHIELD_ERROR", None)}


def test_windows_and_fold_give_the_same(spark):
    r = random.Random(6)
    rows = [(f"s{k % 4}", k, d, r.choice(["hello", "jailbreak", None, "x@y.org"]), 0.0) for k in range(60) for d in ("input", "output")]
    policies = [Audit(), PersonalData(), PromptRules(), Custom(block=lambda t: F.when(F.contains(t, F.lit("REDACTED")), "no"), on=("input", "output")), Audit()]
    names = ["session_id", "seq", "direction", "allowed", "blocked_by", "reason_code", "reason", "request_count", "reached", "final_text"]
    one, other = (chain.run_chain(conversation(spark, rows), p).select(names).orderBy(*names).collect() for p in (policies, [*policies, CostLimit(max_usd=1e9)]))
    assert one == other and {x["allowed"] for x in one} == {True, False, None}
    inputs = [x for x in rows if x[2] == "input"]
    plain, only = (chain.run_chain(conversation(spark, inputs), policies, inputs_only=o).select(names).orderBy(*names).collect() for o in (False, True))
    assert plain == only


def test_answers_go_through_every_policy(spark):
    rows = [("a", 1, "input", "mail x@y.org", 0.0), ("a", 2, "input", "jailbreak", 0.0), ("b", 1, "input", "ask", 0.0), ("b", 2, "input", "ask", 0.0)]
    block = Custom(block=lambda t: F.when(F.contains(t, F.lit("bad")), F.lit("bad word")), on=("output",), code="OUTPUT_BLOCKED")
    policies = [PersonalData(mode="tokenize"), PromptRules(), block, Custom(rewrite=F.upper, on=("output",)), CostLimit(max_usd=0.0), Audit()]
    policies[4] = CostLimit(max_usd=0.00005)
    agent = lambda t: F.when(t == "ask", F.lit("bad answer")).otherwise(F.concat(F.lit("to "), t))
    out = {(r["session_id"], r["seq"]): r for r in chain.run_batch(conversation(spark, rows), policies, agent).collect()}
    assert out["a", 1]["final_text"].startswith("mail [TOK_EMAIL_") and out["a", 1]["answer"] == "TO MAIL X@Y.ORG" and out["a", 1]["answer_reached"] == "6"
    assert out["a", 1]["cost_after"] > out["a", 1]["cost_usd"] > 0
    assert (out["a", 2]["allowed"], out["a", 2]["answer"], out["a", 2]["answer_allowed"]) == (False, None, None)
    assert (out["b", 1]["answer"], out["b", 1]["answer_allowed"], out["b", 1]["answer_code"], out["b", 1]["answer_blocked_by"]) == (None, False, "OUTPUT_BLOCKED", "3:Custom")
    assert out["b", 1]["cost_after"] == out["b", 1]["cost_usd"]


def test_token_counts_of_a_vocabulary(spark, tmp_path):
    import base64

    ranks = [bytes([b]) for b in range(256)] + [b"th", b"the", b" the", b"an"]
    (tmp_path / "ranks").write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(ranks)))
    count = metering.bpe_counter(spark, str(tmp_path / "ranks"), r" ?\w+|\s|[^\w\s]+")
    df = spark.createDataFrame([("the the",), ("an ant",), ("",), (None,), ("a <|endoftext|> b",)], "t string")
    assert [r[0] for r in df.select(count(F.col("t"))).collect()] == [2, 4, 0, None, None]
    rows = [("a", 1, "input", "the the", 0.0), ("b", 1, "input", "an <|endoftext|>", 0.0)]
    out = {r["session_id"]: r for r in chain.run_chain(conversation(spark, rows), [CostLimit(counter=count)]).collect()}
    assert out["a"]["cost_usd"] == 2 / 1e6 * 2.5 and (out["b"]["allowed"], out["b"]["reason_code"], out["b"]["blocked_by"]) == (False, "SHIELD_ERROR", "1:CostLimit")


def test_an_engine_finds_personal_data(spark):
    def engine():
        return lambda t: [(t.index("Ann"), t.index("Ann") + 3, "PERSON", 0.9), (0, 1, "PERSON", 0.2)] if "Ann" in t else []

    rows = [("a", 1, "input", "héllo Ann", 0.0), ("b", 1, "input", "nobody", 0.0)]
    out = {r["session_id"]: (r["final_text"], r["pii_detected"]) for r in chain.run_chain(conversation(spark, rows), [PersonalData(engine=engine)]).collect()}
    assert out == {"a": ("héllo [REDACTED_PERSON]", True), "b": ("nobody", False)}


def test_tool_chain(spark):
    from wardline.operators import gates
    from wardline.plans.policies import Approval, ToolRules

    calls = spark.sql("SELECT * FROM VALUES ('s', 1, 'delete_users', '{}', timestamp'2024-01-01 00:00:00'), ('s', 2, 'pay', '{\"x\":1}', timestamp'2024-01-01 00:00:00'), ('s', 3, 'pay', 'evil', timestamp'2024-01-01 00:00:00'), ('s', 4, 'read', '{}', timestamp'2024-01-01 00:00:00'), ('s', 5, CAST(null AS STRING), '{}', timestamp'2024-01-01 00:00:00') t(session_id, seq, tool_name, params, ts)")
    said = calls.where("seq in (2, 3)").select(gates.gate_id(F.col("session_id"), F.col("seq")).alias("gate_id"), "ts", (F.col("seq") == 2).alias("approved"))
    custom = Custom(block=lambda t: F.when(F.contains(t, F.lit("none of this")), F.lit("no")), on=("tool",), code="TOOL_BLOCKED")
    policies = [Audit(), ToolRules(("delete_*",)), Approval(("tool_call:pay",), timeout_seconds=60), custom, PromptRules(), Audit()]
    out = {r["seq"]: (r["allowed"], r["blocked_by"], r["reason_code"], r["reached"], r["gate_outcome"]) for r in chain.run_tool_chain(calls, policies, decisions=said).collect()}
    assert out == {
        1: (False, "2:ToolRules", "TOOL_NOT_ALLOWED", "1", None), 2: (True, None, None, "1,6", "approved"), 3: (False, "3:Approval", "HUMAN_GATE_DENIED", "1", "denied"),
        4: (True, None, None, "1,6", None), 5: (False, "1:Audit", "SHIELD_ERROR", None, None),
    }
    with pytest.raises(ValueError, match="decisions"):
        chain.run_tool_chain(calls, policies)
