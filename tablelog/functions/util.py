"""Driver-side file helpers, through the Hadoop file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tablelog.sources.fs import Fs


def write_blob(spark: SparkSession, path: str, data: bytes) -> bool:
    """Write a file, with the folders above it."""
    return Fs(spark).write(path, bytes(data), overwrite=True)


def copy_dir(spark: SparkSession, source: str, target: str) -> None:
    """Copy a folder with all below it."""
    Fs(spark).copy_dir(source, target)
