"""Connected components of a link table, by alternating large and small stars.

Each round is two aggregations (with map-side combining) and two equi-joins, so a node with very many links
costs one row a task in the aggregation, and its join partition is one that adaptive execution splits.  Rounds
are written to the shared folder; the rounds before are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, scratch


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star operation over links (a, b), a > b: both ways for the large one, downwards for the small one."""
    if large:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
    down = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return joined.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node that ``links`` (a, b: bigint) mentions; the label is the smallest node reachable.

    Links may repeat, point either way or join a node to itself (a node with no other link has no row); links
    with a null end are no links.  An empty table gives an empty result.
    """
    spark = links.sparkSession
    now = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    old, before = None, None
    while True:
        path = scratch(spark, "components")
        now.write.parquet(path)
        if old:
            delete(spark, old)
        old = path
        now = spark.read.schema("a bigint, b bigint").parquet(path)
        # Done when the links form stars: every a once, and no b is an a.
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        before = state
        now = _star(_star(now, True).distinct(), False).distinct()
