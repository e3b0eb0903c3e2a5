"""The package shipped to executors, which need not have it installed."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the session's executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="wardline-")
    path = os.path.join(folder, "wardline_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(here):
            for name in sorted(n for n in names if n.endswith(".py")):
                z.write(os.path.join(top, name), os.path.relpath(os.path.join(top, name), os.path.dirname(here)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shipped(function):
    """``function`` (its first argument the session) with the package shipped first."""

    @functools.wraps(function)
    def run(spark, *args, **kwargs):
        ship(spark)
        return function(spark, *args, **kwargs)

    return run
