"""Folder for tables that queries and examples build."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir``, or in local mode below a temporary folder where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tablelog.scratch.dir", None)
    if not base:
        check_local(spark)
        base = "file://" + tempfile.mkdtemp(prefix="tablelog-")
        spark.conf.set("tablelog.scratch.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def check_local(spark: SparkSession) -> None:
    """A temporary folder is the driver's own: on a cluster executors don't share it."""
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
