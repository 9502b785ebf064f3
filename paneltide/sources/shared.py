"""Paths in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a default only where they are one process anyway."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(folder or '/tmp/checkpoints').rstrip('/')}/{name}-{uuid.uuid4().hex}"
