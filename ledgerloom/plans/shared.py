"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Where a session on one machine (tests) names none, a temporary folder is made once; on a cluster that is an
    error, as executors would write to disks of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master.split("[")[0] != "local":
        raise RuntimeError(f"spark.checkpoint.dir isn't set: executors of {master} share no folder with the driver")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="ledgerloom-"))
    return _LOCAL[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
