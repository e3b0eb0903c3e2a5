"""Audit records: what passed, by hash and length, never by content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(text: Column) -> Column:
    """The first 16 hex digits of SHA-256 over the text's UTF-8."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def _seconds(ts: Column) -> Column:
    return F.round(F.unix_micros(ts.cast("timestamp")) / F.lit(1e6), 3)


def input_record(session: Column, user: Column, text: Column, cost: Column, requests: Column, ts: Column, hashed: bool = True) -> Column:
    return F.struct(F.lit("input_scan").alias("event"), _seconds(ts).alias("timestamp"), session.alias("session_id"), user.alias("user_id"), (digest(text) if hashed else F.lit(None).cast("string")).alias("input_hash"), F.length(text).alias("input_length"), F.bround(cost, 6).alias("cost_so_far_usd"), requests.alias("request_count"))


def output_record(session: Column, text: Column, cost: Column, ts: Column, hashed: bool = True) -> Column:
    return F.struct(F.lit("output_scan").alias("event"), _seconds(ts).alias("timestamp"), session.alias("session_id"), (digest(text) if hashed else F.lit(None).cast("string")).alias("output_hash"), F.length(text).alias("output_length"), F.bround(cost, 6).alias("cost_total_usd"))


def tool_record(session: Column, tool: Column, params_json: Column, cost: Column, ts: Column) -> Column:
    """Parameter names only, sorted."""
    return F.struct(F.lit("tool_call").alias("event"), _seconds(ts).alias("timestamp"), session.alias("session_id"), tool.alias("tool_name"), F.array_sort(F.json_object_keys(params_json)).alias("param_keys"), F.bround(cost, 6).alias("cost_so_far_usd"))


def line(record: Column) -> Column:
    """A record as a JSON line; null fields stay."""
    return F.to_json(record, {"ignoreNullFields": "false"})


def hmac_sha256(key: bytes, body: Column) -> Column:
    """HMAC-SHA256 (RFC 2104) of a text under a constant key, in hex, from hashes alone."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in block))
    outer = F.lit(bytes(b ^ 0x5C for b in block))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body.cast("binary")), 256))), 256)
