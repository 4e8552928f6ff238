"""Appends: data files, their statistics, and the actions that add them."""

from __future__ import annotations

import datetime
import decimal
import json
import math
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelog import schema as S
from tablelog.errors import ConstraintError, InvalidInput, LogError, Unsupported
from tablelog.plans.skipping import stats_json
from tablelog.sources.fs import Fs, glob_escaped
from tablelog.sources.scan import NULL_PARTITION
from tablelog.sources.snapshot import LOG_DIR, READER_FEATURES, Snapshot, commit_name

#: Longer strings give no bounds.
LONGEST_BOUND = 1024
#: Files that are moved at the same time.
PLACED_AT_ONCE = 16
#: Columns with statistics in one pass over the written files.
STATS_COLUMNS = 200


@dataclass(frozen=True)
class Added:
    """A written file and its ``add`` action."""

    path: str
    action: dict
    rows: int


def conform(df: DataFrame, snapshot: Snapshot, columns: list[str] | None = None) -> DataFrame:
    """The rows in the table's columns, by position as INSERT takes them, or by the given names."""
    fields = snapshot.schema.fields
    names = {f.name.lower(): f for f in fields}
    if columns is None:
        if len(df.columns) != len(fields):
            raise InvalidInput(f"table has {len(fields)} columns but {len(df.columns)} values were supplied")
        columns = [f.name for f in fields]
    elif len(columns) != len(df.columns) or any(c.lower() not in names for c in columns):
        raise InvalidInput(f"columns {columns} don't fit the table or the {len(df.columns)} values")
    df = df.toDF(*[f"__c{k}" for k in range(len(columns))])
    given = {c.lower(): F.col(f"__c{k}") for k, c in enumerate(columns)}
    return df.select(*[given.get(f.name.lower(), F.lit(None)).cast(S._map_type(f.dataType, "none")).alias(f.name) for f in fields])


def required_paths(schema: T.StructType) -> list[tuple[tuple[str, ...], tuple[str, ...]]]:
    """(path, parent that may be null) of each field that mustn't be null."""
    try:
        return list(S.not_null_paths(schema))
    except LookupError:
        raise Unsupported("Inserting into a table with null constraints in arrays is not supported") from None


def check_not_null(written: DataFrame, required: list[tuple[tuple[str, ...], tuple[str, ...]]], table: str) -> None:
    """One aggregation over the required columns of the staged files; a null below a null struct that may be null is fine.

    The rows as they were written are what counts: the input is run once only.
    """
    if not required:
        return

    def broken(path: tuple[str, ...], parent: tuple[str, ...]) -> Column:
        missing = S.column(path).isNull()
        return F.max(missing & S.column(parent).isNotNull() if parent else missing)

    row = written.agg(*[broken(p, parent).alias(f"b{k}") for k, (p, parent) in enumerate(required)]).first()
    for k, (p, _) in enumerate(required):
        if row[f"b{k}"]:
            raise ConstraintError(f"NOT NULL constraint failed: {table}.{'.'.join(p)}")


def check_writable(snapshot: Snapshot) -> None:
    p = snapshot.state.protocol
    if snapshot.mapping_mode != "none":
        raise LogError("UnsupportedError", "writes to tables with column mapping are not supported")
    known = {"appendOnly", "invariants", "domainMetadata", "deletionVectors", "timestampNtz", "v2Checkpoint", "vacuumProtocolCheck",
             "variantType", "variantType-preview", "catalogManaged", "catalogOwned-preview", "inCommitTimestamp", "typeWidening", "typeWidening-preview", "columnMapping"}
    unknown = set(p.get("writerFeatures") or ()) - known
    if (p.get("minWriterVersion") or 1) > 7 or unknown:
        raise LogError("UnsupportedError", f"writer version {p.get('minWriterVersion')} with features {sorted(unknown)} is not supported")
    if '"delta.invariants"' in snapshot.state.metadata["schemaString"] or any(k.startswith("delta.constraints.") for k in snapshot.configuration):
        raise LogError("UnsupportedError", "writes to tables with check constraints or invariants are not supported")
    if any(f'"delta.{k}' in snapshot.state.metadata["schemaString"] for k in ("generationExpression", "identity.")):
        raise LogError("UnsupportedError", "writes to tables with generated or identity columns are not supported")


def _json_value(v: object) -> object:
    if isinstance(v, datetime.datetime):
        return v.strftime("%Y-%m-%dT%H:%M:%S.") + f"{v.microsecond // 1000:03d}" + ("Z" if v.tzinfo else "")
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() and v.as_tuple().exponent >= 0 else float(v) if decimal.Decimal(repr(float(v))) == v else str(v)
    return v


def _put(tree: dict, path: tuple[str, ...], value: object) -> None:
    for p in path[:-1]:
        tree = tree.setdefault(p, {})
    tree[path[-1]] = value


def file_stats(written: DataFrame, schema: T.StructType, parts: list[str]) -> dict[str, tuple[int, str]]:
    """File URI -> (rows, statistics), from the files as they were written."""
    own = [(p, t) for p, t in S.leaves(schema) if p[0] not in parts]
    bounded = [(p, t) for p, t in own if not isinstance(t, T.BinaryType)]
    out: dict[str, list] = {}
    for k in range(0, max(1, len(own)), STATS_COLUMNS):
        # a set that stays empty has Spark keep strings' bounds in a hash table too; else it sorts all rows by their file
        aggs = [F.count("*").alias("n"), F.collect_set(F.when(F.col("_metadata.file_path").isNull(), 0)).alias("hashed")]
        for j, (p, t) in enumerate(own[k : k + STATS_COLUMNS]):
            c = S.column(p)
            aggs.append(F.count_if(c.isNull()).alias(f"n{j}"))
            if (p, t) in bounded:
                aggs += [F.min(c).alias(f"l{j}"), F.max(c).alias(f"h{j}")]
                if isinstance(t, (T.FloatType, T.DoubleType)):
                    aggs.append(F.max(F.isnan(c)).alias(f"x{j}"))
        for r in written.groupBy(F.col("_metadata.file_path").alias("f")).agg(*aggs).collect():
            n, nulls, lows, highs = out.setdefault(r["f"], [r["n"], {}, {}, {}])
            for j, (p, t) in enumerate(own[k : k + STATS_COLUMNS]):
                _put(nulls, p, r[f"n{j}"])
                if (p, t) not in bounded:
                    continue
                low, high = r[f"l{j}"], r[f"h{j}"]
                if isinstance(t, (T.FloatType, T.DoubleType)) and (r[f"x{j}"] or any(isinstance(v, float) and math.isinf(v) for v in (low, high))):
                    continue
                if isinstance(t, T.StringType) and any(v is not None and len(v) > LONGEST_BOUND for v in (low, high)):
                    continue
                if isinstance(t, T.TimestampType) and high is not None:
                    high = high + datetime.timedelta(microseconds=999)  # milliseconds, rounded up
                if low is not None:
                    _put(lows, p, _json_value(low))
                    _put(highs, p, _json_value(high))
    return {f: (n, stats_json(n, nulls, lows, highs, bool(own))) for f, (n, nulls, lows, highs) in out.items()}




def write_files(df: DataFrame, snapshot: Snapshot, table: str) -> list[Added]:
    """Write rows, already in the table's columns, as data files of the table; nothing is committed.

    Spark writes beside the table's data under a name that readers ignore; then
    the files move to their folders.  Failures leave no data file behind.
    """
    spark, fs, root = snapshot.spark, Fs(snapshot.spark), snapshot.root
    check_writable(snapshot)
    required = required_paths(snapshot.schema)
    parts = snapshot.partition_columns
    staging = f"{root}/_staging/{uuid.uuid4().hex}"
    added: list[Added] = []
    try:
        if parts:
            # a value's rows meet in few tasks, so there are few files for each; AQE splits large ones
            df = df.hint("rebalance", *parts)
        writer = df.write.partitionBy(*parts) if parts else df.write
        writer.parquet(staging)
        written = spark.read.schema(S.physical(snapshot.schema, "none")).option("basePath", glob_escaped(staging)).parquet(glob_escaped(staging))
        check_not_null(written, required, table)
        stats = file_stats(written.select("*", "_metadata"), snapshot.schema, parts)
        values = _partition_values(fs, staging, parts)

        def place(uri: str, rows: int, text: str) -> None:
            """Move a staged file to its folder, under a name that no other has."""
            source = fs.path(fs.jvm.java.net.URI(uri).getPath()) if uri.startswith("file:") else fs.path(uri)
            relative = source.toString().split(f"/{staging.rsplit('/', 1)[-1]}/", 1)[1]
            folder = relative.rpartition("/")[0]
            name = f"{uuid.uuid4()}.parquet"
            target = f"{folder}/{name}" if folder else name
            fs.rename(source.toString(), f"{root}/{target}")
            size, changed = fs.status(f"{root}/{target}")
            action = {
                "path": quote(target, safe="/=+:@!$&'()*,;~"),
                "partitionValues": values[folder],
                "size": size,
                "modificationTime": changed,
                "dataChange": True,
                "stats": text,
            }
            added.append(Added(f"{root}/{target}", action, rows))

        with ThreadPoolExecutor(PLACED_AT_ONCE) as pool:
            for moved in [pool.submit(place, uri, rows, text) for uri, (rows, text) in stats.items()]:
                moved.result()
        added.sort(key=lambda a: a.path)
    except BaseException:
        discard(fs, added)
        raise
    finally:
        fs.delete(staging, recursive=True)
        fs.delete_if_empty(f"{root}/_staging")
    return added


def _partition_values(fs: Fs, staging: str, parts: list[str]) -> dict[str, dict[str, str]]:
    """Folder below the staging folder -> partition values; null is the empty string."""
    from urllib.parse import unquote

    out: dict[str, dict[str, str]] = {"": {}}
    todo = [("", 0)]
    while todo:
        folder, depth = todo.pop()
        if depth == len(parts):
            continue
        for s in fs.of(staging).listStatus(fs.path(f"{staging}/{folder}" if folder else staging)):
            if s.isDirectory():
                name = s.getPath().getName()
                own = f"{folder}/{name}" if folder else name
                text = unquote(name.partition("=")[2])
                out[own] = out[folder] | {parts[depth]: "" if text == NULL_PARTITION else text}
                todo.append((own, depth + 1))
    return out


def discard(fs: Fs, added: list[Added]) -> None:
    for a in added:
        fs.delete(a.path)


def create_table(
    spark, path: str, schema: T.StructType, partition_columns: list[str] = (), configuration: dict[str, str] | None = None,
    reader_version: int = 1, writer_version: int = 2, features: list[str] | None = None,
) -> Snapshot:
    """Write version 0 of an empty table.  Tables are otherwise made elsewhere; tests and examples need this."""
    from tablelog.operators.committer import FileCommitter

    fs = Fs(spark)
    root = fs.qualified(path)
    fs.of(root).mkdirs(fs.path(root))
    protocol: dict = {"minReaderVersion": reader_version, "minWriterVersion": writer_version}
    if features is not None:
        protocol = {"minReaderVersion": 3, "minWriterVersion": 7, "readerFeatures": [f for f in features if f in READER_FEATURES], "writerFeatures": features}
    now = int(time.time() * 1000)
    meta = {
        "id": str(uuid.uuid4()), "format": {"provider": "parquet", "options": {}}, "schemaString": schema.json(),
        "partitionColumns": list(partition_columns), "configuration": configuration or {}, "createdTime": now,
    }
    lines = [commit_info("CREATE TABLE", {}), json.dumps({"metaData": meta}), json.dumps({"protocol": protocol})]
    if not FileCommitter(spark).commit(root, 0, lines):
        raise LogError("FileAlreadyExists", f"a table exists at {root}")
    return Snapshot.load(spark, root)


def owned_by_catalog(snapshot: Snapshot) -> bool:
    """Whether only the table's catalog may say which commits count."""
    return bool({"catalogManaged", "catalogOwned-preview"} & set(snapshot.state.protocol.get("writerFeatures") or ()))


def commit_time(snapshot: Snapshot) -> dict[str, int]:
    """The in-commit timestamp that the next commit of the table needs: later than the last one's."""
    if snapshot.configuration.get("delta.enableInCommitTimestamps") != "true":
        return {}
    now = int(time.time() * 1000)
    last = Fs(snapshot.spark).read(f"{snapshot.root}/{LOG_DIR}/{commit_name(snapshot.version)}").split(b"\n", 1)[0]
    before = json.loads(last).get("commitInfo", {}).get("inCommitTimestamp", 0)
    return {"inCommitTimestamp": max(now, before + 1)}


def commit_info(operation: str, parameters: dict, **more) -> str:
    from tablelog import VERSION

    own = {"timestamp": int(time.time() * 1000), "operation": operation, "operationParameters": parameters, "engineInfo": f"tablelog/{VERSION}", **more}
    return json.dumps({"commitInfo": own})
