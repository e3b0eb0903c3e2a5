from pyspark.sql import functions as F

from wardline.operators import ordered
from wardline.streaming import state


def drained(query_frame, name, tmp_path):
    q = query_frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.exception()
    return query_frame.sparkSession.table(name)


def test_rate_limit_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parquet*")
    got = {r["row_id"]: r["allowed"] for r in drained(state.rate_limit(stream, "user_id", "ts", "event_id", per_minute=1 / 600, burst=2), "rated", tmp_path).collect()}
    want = {r["event_id"]: r["allowed"] for r in ordered.rate_limit(events, "user_id", "ts", ["event_id"], per_minute=1 / 600, burst=2).collect()}
    assert got == want and not all(want.values())


def test_budget_stream_equals_batch(spark, sf, tmp_path):
    shape = lambda df: df.select("user_id", "event_id", (F.col("value") / 100).alias("cost"), (F.col("event_type") != "view").alias("is_input"))
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parquet*")
    got = {r["row_id"]: (r["admitted"], r["spent"]) for r in drained(state.budget(shape(stream), "user_id", "event_id", max_usd=2.0), "spent", tmp_path).collect()}
    want = {r["event_id"]: (r["admitted"], r["spent"]) for r in ordered.budget(shape(events), "user_id", ["event_id"], max_usd=2.0).collect()}
    assert got == want


def test_gate_stream(spark, tmp_path):
    spark.sql("SELECT * FROM VALUES ('g1', timestamp'2024-01-01 00:00:00'), ('g2', timestamp'2024-01-01 00:00:00'), ('late', timestamp'2024-01-02 00:00:00') t(gate_id, ts)").write.parquet(str(tmp_path / "r"))
    spark.sql("SELECT * FROM VALUES ('g1', timestamp'2024-01-01 00:00:30', true), ('x', timestamp'2024-01-02 00:00:00', true) t(gate_id, ts, approved)").write.parquet(str(tmp_path / "d"))
    r = spark.readStream.schema("gate_id string, ts timestamp").parquet(str(tmp_path / "r"))
    d = spark.readStream.schema("gate_id string, ts timestamp, approved boolean").parquet(str(tmp_path / "d"))
    out = {x["gate_id"]: (x["allowed"], x["outcome"]) for x in drained(state.gates(r, d, timeout_seconds=60), "gated", tmp_path).collect()}
    assert out["g1"] == (True, "approved") and out.get("g2", (False, "timeout")) == (False, "timeout")
