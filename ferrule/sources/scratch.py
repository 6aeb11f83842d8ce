"""Where files for a while are written."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def can_write(spark: SparkSession) -> bool:
    """Whether shared_folder() gives a path."""
    return bool(spark.conf.get("spark.checkpoint.dir", None)) or bool(re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares (spark.checkpoint.dir); where that is unset, and tasks run in the driver's own process, in its
    temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not can_write(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or f'file://{tempfile.gettempdir()}').rstrip('/')}/ferrule-{name}-{uuid.uuid4().hex}"
