"""A scratch folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A path under ``spark.checkpoint.dir``; where that is unset, under a temporary folder in local mode, and an error on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="pulsegrid-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/{name}"
