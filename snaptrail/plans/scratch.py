"""Folders for files that queries write."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share; a temporary one only in a single process."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared is None:
        if not (spark.sparkContext.master or "").startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        shared = tempfile.mkdtemp(prefix="spark-")
    return f"{shared}/{uuid.uuid4().hex}"
