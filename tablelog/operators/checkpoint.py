"""Checkpoints: the state of a version as one parquet file, and the hint to it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelog.errors import LogError
from tablelog.sources.fs import Fs
from tablelog.sources.snapshot import LAST_CHECKPOINT, LOG_DIR, Snapshot, _checkpoint_schema


def checkpoint_rows(snapshot: Snapshot) -> DataFrame:
    """Rows of a checkpoint: each live file, and the table's other state."""
    spark, schema, s = snapshot.spark, _checkpoint_schema(), snapshot.state
    kinds = [f.name for f in schema.fields]
    adds = snapshot.files.select(
        F.struct(
            "path", F.col("partition_values").alias("partitionValues"), "size", F.col("mod_time").alias("modificationTime"),
            F.lit(False).alias("dataChange"), "stats", F.col("dv").alias("deletionVector"),
        ).alias("add")
    )
    adds = adds.select("add", *[F.lit(None).cast(schema[k].dataType).alias(k) for k in kinds if k != "add"])
    other = [{"protocol": s.protocol}, {"metaData": s.metadata}]
    other += [{"txn": {"appId": a, "version": v}} for a, v in sorted(s.txns.items())]
    other += [{"domainMetadata": d} for _, d in sorted(s.domains.items()) if not d.get("removed")]
    lines = spark.createDataFrame([(json.dumps(x),) for x in other], "j string")
    parsed = lines.select(F.from_json("j", schema).alias("x")).select("x.*")
    return parsed.select(*kinds).unionByName(adds.select(*kinds))


#: Files of the table for each part of a checkpoint.
PART_FILES = 100_000


def write_checkpoint(snapshot: Snapshot) -> bool:
    """Write the checkpoint of the snapshot's version, in parts for a large table; False if it is there already."""
    fs, folder, version = Fs(snapshot.spark), f"{snapshot.root}/{LOG_DIR}", f"{snapshot.version:020d}"
    parts = 1 + snapshot.file_count // PART_FILES
    names = [f"{version}.checkpoint.parquet"] if parts == 1 else [f"{version}.checkpoint.{k + 1:010d}.{parts:010d}.parquet" for k in range(parts)]
    if all(fs.exists(f"{folder}/{n}") for n in names):
        return False
    staging = f"{folder}/_tmp_{uuid.uuid4().hex}"
    try:
        rows = checkpoint_rows(snapshot)
        # every part has a file, also one that no row falls to
        rows = rows.coalesce(1) if parts == 1 else rows.repartition(parts)
        rows.write.parquet(staging)
        written = sorted(n for n, _, _ in fs.names(staging) if n.startswith("part-"))
        if len(written) != parts:
            raise LogError("IOErrorError", f"{len(written)} files of {parts} parts were written")
        for name, part in zip(names, written):
            fs.rename(f"{staging}/{part}", f"{folder}/{name}")
            fs.delete(f"{folder}/.{name}.crc")
    finally:
        fs.delete(staging, recursive=True)
    size = snapshot.spark.read.parquet(*[f"{folder}/{n}" for n in names]).count()
    hint = {"version": snapshot.version, "size": size} | ({"parts": parts} if parts > 1 else {})
    fs.write(f"{folder}/{LAST_CHECKPOINT}", json.dumps(hint).encode(), overwrite=True)
    return True
