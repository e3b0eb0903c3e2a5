"""Reports over verdicts: latencies, classification metrics, and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latency(df: DataFrame, value: str, keys: list[str], percent: int = 99) -> DataFrame:
    """mean, p99 and n by ``keys``: p99 is the value at place floor(0.99 n), from zero, in ascending order.

    Values are counted before they are ranked, so a key's values are not gathered, only its distinct ones are
    summed in order.
    """
    from pyspark.sql import Window

    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    totals = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    upto = Window.partitionBy(*keys).orderBy(value)
    ranked = counts.withColumn("_upto", F.sum("_n").over(upto))
    joined = ranked.join(totals, keys) if keys else ranked.crossJoin(F.broadcast(totals))
    place = F.floor(F.col("n") * percent / 100)
    found = joined.where((F.col("_upto") > place) & (F.col("_upto") - F.col("_n") <= place))
    return found.select(*keys, "mean", F.col(value).alias("p99"), "n")


def binary_metrics(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """accuracy, precision, recall and f1 of a binary prediction; 0 where a ratio has no denominator."""
    c = df.agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn"))

    def ratio(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def verdicts(df: DataFrame) -> DataFrame:
    """Rows by policy and code, with totals."""
    return df.rollup("blocked_by", "reason_code").agg(F.count(F.lit(1)).alias("n"))
