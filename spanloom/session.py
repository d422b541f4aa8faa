"""What a session needs before its Python workers can run the library's functions."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ready(spark: SparkSession) -> SparkSession:
    """Put the library on the Python path of the workers; a cluster that installs it needs nothing of this."""
    environment = spark.sparkContext.environment
    path = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if _ROOT not in path.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, path) if x)
    return spark


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """See that checkpoint() has a folder all machines see: spark.checkpoint.dir; unset, a local run has one of its own."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(found or f"{tempfile.gettempdir()}/checkpoints")
    return spark
