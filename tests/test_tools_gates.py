import fnmatch
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from wardline.functions import audit
from wardline.functions.patterns import glob_regex
from wardline.functions.toolcheck import ParamRule
from wardline.operators import gates, reports, tools
from wardline.plans.policies import ToolRules
from wardline.sources import sinks


def codes(spark, calls, rules):
    df = spark.createDataFrame([(i, n, json.dumps(p) if not isinstance(p, str) else p) for i, (n, p) in enumerate(calls)], "i int, tool_name string, params string")
    return [(r["allowed"], r["reason_code"], r["warning"] is not None) for r in sorted(tools.check_calls(df, rules).collect())]


OK, NAME, PARAM = (True, None, False), (False, "TOOL_NOT_ALLOWED", False), (False, "TOOL_PARAM_INVALID", False)


def test_names(spark):
    assert codes(spark, [("delete_users", {})], ToolRules(("delete_*",))) == [NAME]
    allow = ToolRules(allowed=("search_*", "read_*"))
    assert codes(spark, [("search_hotels", {"city": "x"}), ("delete_records", {})], allow) == [OK, NAME]
    assert codes(spark, [("delete_production_db", {}), ("delete_x", {})], ToolRules(("delete_production_*",), ("delete_*",))) == [NAME, OK]
    assert codes(spark, [("anything_goes", {"x": 1})], ToolRules()) == [OK]
    assert codes(spark, [("a", {})], ToolRules(allowed=())) == [NAME]
    assert codes(spark, [("delete_users", {})], ToolRules(("delete_*",), mode="warn")) == [(True, None, True)]


def test_globs_are_those_of_the_shell(spark):
    globs = ["a*", "?b", "[ab]c", "[!ab]c", "[]]x", "a.b", "[a", "*", "x[a-c]?", "[!]]", "a\\b"]
    names = ["a", "abc", "ab", "bb", "ac", "cc", "]x", "a.b", "axb", "[a", "xbz", "a\nb", "", "]", "a\\b", "A"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select("n", *[F.col("n").rlike(glob_regex(g)).alias(f"g{i}") for i, g in enumerate(globs)]).collect()
    for row in got:
        assert [row[f"g{i}"] for i in range(len(globs))] == [fnmatch.fnmatchcase(row["n"], g) for g in globs], row["n"]


def test_params(spark):
    rules = (
        ParamRule("transfer_funds", "amount", ("float",), max=1000.0),
        ParamRule("search", "query", ("str",), maxlen=10),
        ParamRule("transfer", "account", pattern=r"[A-Z]{2}\d+"),
        ParamRule("count", "n", ("int",), min=1, max=1),
    )
    calls = [
        ("transfer_funds", {"amount": 9999.0}), ("transfer_funds", {"amount": 100.0}), ("transfer_funds", {"amount": 1000.0}), ("transfer_funds", {"amount": 100}),
        ("search", {"query": 12345}), ("search", {"query": "a" * 100}), ("search", {}), ("search", {"query": None}),
        ("transfer", {"account": "not-valid"}), ("transfer", {"account": "GB12"}), ("transfer", {"account": "GB12\n"}),
        ("count", {"n": True}), ("count", {"n": 0}), ("count", {"n": False}), ("count", {"n": 1.0}), ("count", "not json"), ("other", {"n": 5}),
    ]
    want = [PARAM, OK, OK, PARAM, PARAM, PARAM, OK, OK, PARAM, OK, PARAM, OK, PARAM, PARAM, PARAM, OK, OK]
    assert codes(spark, calls, ToolRules(params=rules)) == want
    with pytest.raises(ValueError):
        ParamRule("x", "y", ("number",))


def test_gates(spark):
    asked = spark.sql("SELECT * FROM VALUES ('g1', timestamp'2024-01-01 00:00:00', 'keep'), ('g2', timestamp'2024-01-01 00:00:00', null), ('g3', timestamp'2024-01-01 00:00:00', ''), ('g4', timestamp'2024-01-01 00:00:00', 'x') t(gate_id, ts, approved)")
    said = spark.sql("SELECT * FROM VALUES ('g1', timestamp'2024-01-01 00:00:10', true), ('g1', timestamp'2024-01-01 00:00:20', false), ('g2', timestamp'2024-01-01 00:00:10', false), ('g3', timestamp'2024-01-01 00:10:00', true), ('g4', timestamp'2023-12-31 00:00:00', true) t(gate_id, ts, approved)")
    for on, late in (("deny", False), ("allow", True)):
        out = {r["gate_id"]: (r["outcome"], r["allowed"]) for r in gates.resolve(asked, said, timeout_seconds=60, on_timeout=on).collect()}
        assert out == {"g1": ("approved", True), "g2": ("denied", False), "g3": ("timeout", late), "g4": ("timeout", late)}


def test_triggers(spark):
    df = spark.createDataFrame([("pay", 5.0, False), ("read", 20.0, True), (None, 20.0, False), (None, 1.0, True), (None, 1.0, False), (None, None, None)], "t string, c double, p boolean")
    triggers = ["tool_call:pa*", "cost_exceeds:10", "cost_exceeds:x", "pii_detected", "unknown"]
    fired = gates.triggered(triggers, tool=F.col("t"), spent=F.col("c"), pii=F.col("p"))
    # Globs are asked of calls, money and personal data of inputs.
    assert [r[0] for r in df.select(fired).collect()] == ["tool_call:pa*", None, "cost_exceeds:10", "pii_detected", None, None]
    assert [r[0] for r in df.select(gates.triggered(triggers, spent=F.col("c"))).collect()] == [None, "cost_exceeds:10", "cost_exceeds:10", None, None, None]


def test_gates_after_other_policies(spark):
    from wardline.plans.policies import Approval

    calls = spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-01 00:00:00', 'pay', true, CAST(null AS STRING)), (2, timestamp'2024-01-01 00:00:00', 'read', true, null), (3, timestamp'2024-01-01 00:00:00', 'pay', false, 'TOOL_NOT_ALLOWED'), (4, timestamp'2024-01-01 00:00:00', 'pay', true, null) t(i, ts, tool_name, allowed, reason_code)")
    said = calls.where("i = 1").select(gates.gate_id(F.col("i")).alias("gate_id"), (F.col("ts") + F.expr("interval 5 seconds")).alias("ts"), F.lit(True).alias("approved"))
    out = {r["i"]: (r["allowed"], r["reason_code"], r["gate_outcome"]) for r in gates.gated(calls, Approval(("tool_call:pay",), timeout_seconds=60), said, parts=["i"], tool="tool_name").collect()}
    assert out == {1: (True, None, "approved"), 2: (True, None, None), 3: (False, "TOOL_NOT_ALLOWED", None), 4: (False, "HUMAN_GATE_DENIED", "timeout")}


# Two calls whose gate ids are both gate-fd497ccc.
SHARED = ((31920, 2182757), (53750, 3583795))


def test_calls_that_share_a_gate_id(spark):
    from wardline.plans.policies import Approval

    a, b = SHARED
    calls = spark.createDataFrame([a, b, (1, 1), (None, 5), (5, None)], "s long, i long").selectExpr("s", "i", "timestamp'2024-01-01 00:00:00' ts", "'pay' tool_name", "true allowed", "cast(null as string) reason_code")
    assert calls.select(gates.gate_id(F.col("s"), F.col("i"))).distinct().count() == 3
    said = calls.where(f"i in (1, 5, {b[1]})").select(gates.gate_id(F.col("s"), F.col("i")).alias("gate_id"), F.col("s").cast("int").alias("s"), F.col("i").cast("int").alias("i"), "ts", F.lit(True).alias("approved"))

    def outcomes(decisions):
        out = gates.gated(calls, Approval(("tool_call:pay",), timeout_seconds=60), decisions, parts=["s", "i"], tool="tool_name")
        return {(r["s"], r["i"]): (r["allowed"], r["gate_outcome"]) for r in out.collect()}

    yes, no, late = (True, "approved"), (False, "denied"), (False, "timeout")
    assert outcomes(said) == {a: late, b: yes, (1, 1): yes, (None, 5): yes, (5, None): late}
    # By the id alone none of several is approved.
    assert outcomes(said.drop("s", "i")) == {a: no, b: no, (1, 1): yes, (None, 5): no, (5, None): no}


def test_tool_chain_equals_its_sql_where_gate_ids_are_shared(spark, tmp_path):
    import duckdb

    from wardline import catalog

    rows = [(e, u, "purchase", v, "{}") for (u, e), v in zip(SHARED, (11.8, 83.31))]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(catalog.SQL["tool_chain"]).fetchall()
    assert sorted(tuple(r) for r in catalog.tool_chain(spark, str(tmp_path)).collect()) == sorted(want)


def test_audit_records(spark, tmp_path):
    df = spark.createDataFrame([("s", "héllo", '{"b":1,"a":[2]}')], "s string, t string, p string")
    ts = F.lit("2024-01-01 00:00:00.1234567").cast("timestamp")
    one = json.loads(df.select(audit.line(audit.input_record(F.col("s"), F.lit(None).cast("string"), F.col("t"), F.lit(0.12345678), F.lit(2), ts))).first()[0])
    assert one == {"event": "input_scan", "timestamp": 1704067200.123, "session_id": "s", "user_id": None, "input_hash": hashlib.sha256("héllo".encode()).hexdigest()[:16], "input_length": 5, "cost_so_far_usd": 0.123457, "request_count": 2}
    assert df.select(audit.tool_record(F.col("s"), F.lit("x"), F.col("p"), F.lit(0.0), ts)["param_keys"]).first()[0] == ["a", "b"]
    sinks.write_audit(df, audit.output_record(F.col("s"), F.col("t"), F.lit(1.0), ts, hashed=False), str(tmp_path / "log"))
    assert json.loads(spark.read.text(str(tmp_path / "log")).first()[0])["output_hash"] is None


@pytest.mark.parametrize("key", [b"k", b"x" * 64, b"y" * 100])
def test_hmac(spark, key):
    body = '{"gate_id":"g"}'
    assert spark.range(1).select(audit.hmac_sha256(key, F.lit(body))).first()[0] == hmac.new(key, body.encode(), hashlib.sha256).hexdigest()


def test_notifiers(spark):
    df = spark.createDataFrame([("g-1", "tool_call", None)], "gate_id string, type string, note string")
    lines = []
    sinks.ConsoleNotifier(lines.append)(df, 0)
    assert lines == ["[gate] g-1\n  type: tool_call\n  approve('g-1') or deny('g-1')"]
    row = sinks.HttpNotifier("http://x", b"k").requests(df).first()
    assert json.loads(row["body"]) == {"gate_id": "g-1", "type": "tool_call", "note": None}
    assert row["signature"] == "sha256=" + hmac.new(b"k", row["body"].encode(), hashlib.sha256).hexdigest()
    with pytest.raises(Exception, match="answered 500"):
        sinks.HttpNotifier("http://x", post=lambda url, body, headers: 500)(df, 0)


def test_reports(spark):
    values = [float((i * 37) % 100) for i in range(100)] + [None]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    row = reports.latency(df, "v", ["k"]).first()
    assert (row["mean"], row["p99"], row["n"]) == (49.5, sorted(v for v in values if v is not None)[99], 100)
    m = reports.binary_metrics(spark.createDataFrame([(True, False)], "p boolean, a boolean").limit(0), F.col("p"), F.col("a")).first()
    assert tuple(m) == (0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0)
