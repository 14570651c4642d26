"""A folder that driver and executors share, for what a job writes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the session's checkpoint directory; a local one only where the master is local too."""
    named = spark.conf.get("spark.checkpoint.dir", None) or _set_by_code(spark)
    if named:
        return f"{named.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix=f"tidemark-{name}-")


def _set_by_code(spark: SparkSession) -> str | None:
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get() if found.isDefined() else None
