"""A folder for tables of a run, on storage that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="palimpsest-"))
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"
