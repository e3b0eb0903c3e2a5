"""Recurrences over the rows of a key in order, and running sums over a whole table.

A recurrence (token bucket, budget) decides each row by the state that the rows before left, so a key's rows
are one after the other by definition.  They are dealt by key and sorted by Spark, spilling as it needs to, and
the fold reads them as a stream: it holds one state and one batch, however many rows a key has.  A ``global``
scope is one key, and so one task: that is its meaning, not a choice of plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

GLOBAL = "__global__"


def fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], outputs: T.StructType, start: Callable[[], object], step: Callable) -> DataFrame:
    """``df`` with the columns ``outputs``: for each key's rows by ``order``, ``step(state, *inputs)`` gives (state, outputs).

    Null keys are one key.  Rows that tie in ``order`` are taken in an order of their own; give a unique last column.
    """
    names = df.columns
    schema = T.StructType([*df.schema.fields, *outputs.fields])
    arrow = [pa.field(f.name, kind) for f, kind in zip(outputs.fields, _arrow(outputs))]

    def run(batches: Iterator[pa.RecordBatch]):
        before, state = None, None
        for batch in batches:
            key_columns = [batch.column(names.index(k)).to_pylist() for k in keys]
            value_columns = [batch.column(names.index(c)).to_pylist() for c in inputs]
            out = []
            for row in range(batch.num_rows):
                key = tuple(c[row] for c in key_columns)
                if state is None or key != before:
                    before, state = key, start()
                state, values = step(state, *(c[row] for c in value_columns))
                out.append(values)
            made = [pa.array([o[i] for o in out], f.type) for i, f in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*names, *(f.name for f in arrow)])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _arrow(schema: T.StructType) -> list[pa.DataType]:
    kinds = {"boolean": pa.bool_(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return [kinds[f.dataType.simpleString()] for f in schema.fields]


def scoped(df: DataFrame, key: str, per: str) -> tuple[DataFrame, str]:
    """The frame and its key column for a scope: the key itself, or one for all rows."""
    if per == "session":
        return df, key
    return df.withColumn("_scope", F.lit(GLOBAL)), "_scope"


def bucket_step(per_second: float, burst: float):
    """The token bucket: state (tokens, last time in microseconds); full at first, refilled with time, one token a request."""

    def step(state, at):
        tokens, last = state if state else (burst, at)
        tokens = min(burst, tokens + (at - last) / 1e6 * per_second)
        allowed = tokens >= 1.0
        return (tokens - 1.0 if allowed else tokens, at), allowed

    return step


def rate_limit(df: DataFrame, key: str, ts: str, order: list[str], *, per_minute: float, burst: int = 1, per: str = "session") -> DataFrame:
    """``df`` with ``allowed`` and ``tokens_left``.  Times must not be null; rows go by time, then ``order``."""
    if per_minute <= 0:
        raise ValueError("per_minute must be positive")
    frame, scope = scoped(df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))), key, per)
    take = bucket_step(per_minute / 60.0, float(max(1, burst)))

    def step(state, at):
        state, allowed = take(state, at)
        return state, (allowed, state[0])

    outputs = T.StructType([T.StructField("allowed", T.BooleanType()), T.StructField("tokens_left", T.DoubleType())])
    return fold(frame, [scope], ["_us", *order], ["_us"], outputs, tuple, step).drop("_us", "_scope")


def budget(df: DataFrame, key: str, order: list[str], *, cost: str = "cost", is_input: str = "is_input", max_usd: float, per: str = "session") -> DataFrame:
    """``df`` with ``admitted`` and ``spent`` (after the row): inputs that would pass the budget are denied and cost nothing.

    An output counts if its input (the input row before it, in its key) was admitted; it is never denied itself.
    """
    frame, scope = scoped(df, key, per)

    def step(state, amount, first):
        spent, open_ = state
        if first:
            open_ = spent + amount <= max_usd
        if open_:
            spent += amount
        return (spent, open_), (open_, spent)

    outputs = T.StructType([T.StructField("admitted", T.BooleanType()), T.StructField("spent", T.DoubleType())])
    return fold(frame, [scope], order, [cost, is_input], outputs, lambda: (0.0, True), step).drop("_scope")


def running(df: DataFrame, value: Column, key: str, order: list[str]) -> Column:
    """A sum over the key's rows so far."""
    return F.sum(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


#: Rows of a range of a running sum over a whole table, and the most ranges.
RANGE_ROWS, RANGES = 1_000_000, 4096


def running_global(df: DataFrame, value: str, order: str, name: str, parts: int | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows so far by ``order`` (unique), without bringing all rows to one task.

    Rows are cut into ranges of ``order``, by their number as many as keep a range small; each range's total is one row,
    their running sum is the offset of the next range, and the rest is a running sum within a range.
    """
    parts = parts or min(RANGES, max(8, -(-df.count() // RANGE_ROWS)))
    cuts = sorted(set(df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.25 / parts)))
    above = F.array(*[F.lit(c) for c in cuts]).cast("array<double>")
    dealt = df.withColumn("_range", F.size(F.filter(above, lambda c: F.col(order) > c)))
    totals = dealt.groupBy("_range").agg(F.sum(value).alias("_total"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row for each of ``parts`` ranges.
    return dealt.join(F.broadcast(offsets), "_range").withColumn(name, F.sum(value).over(within) + F.col("_offset")).drop("_range", "_offset")


def last_row(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; one row a task and key before the shuffle."""
    packed = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(key).agg(F.max_by(packed, F.struct(*order)).alias("_row")).select("_row.*")
