"""Log tables built from plain parquet: for queries, the bench and tests.

Tables that this package doesn't write itself (renamed columns, deletion
vectors, evolved schemas) are published action by action.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tablelog.operators.transaction import Transaction
from tablelog.operators.write import commit_info, create_table
from tablelog.sources import dv as DV
from tablelog.sources.fs import Fs
from tablelog.sources.snapshot import LOG_DIR, READER_FEATURES, Snapshot, commit_name
from tablelog.workspace import scratch


def publish(spark: SparkSession, root: str, version: int, actions: Sequence[dict]) -> None:
    """Write a commit as it is given."""
    lines = [commit_info("MANUAL", {}), *[json.dumps(a) for a in actions]]
    if not Fs(spark).put_if_absent(f"{root}/{LOG_DIR}/{commit_name(version)}", "\n".join([*lines, ""]).encode()):
        raise FileExistsError(f"version {version}")


def metadata(schema: T.StructType, partition_columns: Sequence[str] = (), configuration: dict | None = None) -> dict:
    return {
        "metaData": {
            "id": "00000000-0000-0000-0000-000000000001", "format": {"provider": "parquet", "options": {}}, "schemaString": schema.json(),
            "partitionColumns": list(partition_columns), "configuration": configuration or {}, "createdTime": 0,
        }
    }


def protocol(*features: str) -> dict:
    if not features:
        return {"protocol": {"minReaderVersion": 1, "minWriterVersion": 2}}
    readers = [f for f in features if f in READER_FEATURES]
    out = {"minReaderVersion": 3 if readers else 1, "minWriterVersion": 7, "writerFeatures": list(features)}
    return {"protocol": out | ({"readerFeatures": readers} if readers else {})}


def data_file(df: DataFrame, root: str, name: str, partition_values: dict | None = None, stats: str | None = None, vector: dict | None = None) -> dict:
    """Write a frame as one parquet file of the table and return its add action."""
    fs = Fs(df.sparkSession)
    staging = f"{root}/_staging/{name}.d"
    df.coalesce(1).write.parquet(staging)
    (part,) = [n for n, _, _ in fs.names(staging) if n.startswith("part-")]
    fs.rename(f"{staging}/{part}", f"{root}/{name}")
    fs.delete(staging, recursive=True)
    fs.delete_if_empty(f"{root}/_staging")
    size, changed = fs.status(f"{root}/{name}")
    add = {"path": name, "partitionValues": partition_values or {}, "size": size, "modificationTime": changed, "dataChange": True}
    return {"add": add | ({"stats": stats} if stats else {}) | ({"deletionVector": vector} if vector else {})}


def inline_vector(rows: np.ndarray) -> dict:
    """Descriptor of a deletion vector within the log; bytes are padded to whole groups of base 85."""
    data = DV.encode(rows)
    return {"storageType": "i", "pathOrInlineDv": DV.z85_encode(data + b"\0" * (-len(data) % 4)), "sizeInBytes": len(data), "cardinality": len(np.unique(rows))}


def stored_vector(spark: SparkSession, root: str, rows: np.ndarray, uid: bytes) -> dict:
    """Write a deletion vector's file and return its descriptor."""
    data = DV.encode(rows)
    name = DV.z85_encode(uid)
    Fs(spark).write(DV.file_of(root, "u", name), b"\x01" + DV.framed(data), overwrite=True)
    return {"storageType": "u", "pathOrInlineDv": name, "offset": 1, "sizeInBytes": len(data), "cardinality": len(np.unique(rows))}


def build(spark: SparkSession, name: str, frames: Sequence[DataFrame], partition_columns: Sequence[str] = ()) -> str:
    """A new table with a commit for each frame; returns its path."""
    root = scratch(spark, name)
    create_table(spark, root, T.StructType([T.StructField(f.name, f.dataType, True) for f in frames[0].schema.fields]), list(partition_columns))
    for df in frames:
        with Transaction(Snapshot.load(spark, root)) as tx:
            tx.insert(df)
    return root
