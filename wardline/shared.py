"""Scratch tables in the folder that the driver and the executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or on one machine, where it is unset, one of our own.

    A cluster without that setting has no folder that all can read, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), f"wardline-checkpoints-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder.  Results may be read lazily from it, so nothing here deletes it."""
    return f"{shared_root(spark)}/wardline/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and reread: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)
